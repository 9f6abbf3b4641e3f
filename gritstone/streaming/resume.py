"""Split-and-continue: a stage reads its records range by range under a budget of time, stops, and goes on from where it
stopped. The ranges come from a streaming source with offsets of its own; the records are read by Spark in each range."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SOURCE = "gritstone_ranges"


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, total: int, step: int):
        self.total, self.step = total, step

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"at": min(start["at"] + self.step, self.total)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(start["at"], end["at"])] if start["at"] < end["at"] else [])


class Ranges(DataSource):
    """Ranges (lo, hi), half open, of ``total`` record numbers, ``step`` of them in each."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "lo long, hi long"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(int(self.options["total"]), int(self.options["step"]))


def run_stage(records: DataFrame, number: str, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, step: int, seconds: float | None = None, batches: int | None = None) -> dict:
    """Writes ``stage(records)`` to ``out``, one folder a batch, by ranges of the whole number ``number``. Ends when all
    is done, or with ``split`` when the budget of seconds or of batches is used; called again with the same checkpoint it
    goes on. A batch that is met again after a stop replaces its own folder, so that a run cut anywhere equals one run.
    Records whose number is null or negative are no records."""
    spark: SparkSession = records.sparkSession
    spark.dataSource.register(Ranges)
    total = (records.agg(F.max(number)).first()[0] or -1) + 1 if records.where(F.col(number) >= 0).limit(1).count() else 0
    done = {"at": 0, "n": 0}

    def batch(ranges: DataFrame, i: int) -> None:
        for lo, hi in ranges.collect():  # one a batch
            own = records.where((F.col(number) >= lo) & (F.col(number) < hi))
            stage(own).write.mode("overwrite").parquet(f"{out}/batch={i}")

    ranges = spark.readStream.format(SOURCE).option("total", total).option("step", step).load()
    q = ranges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    began = time.time()
    try:
        while True:
            if q.exception():
                raise q.exception()
            progress = [p for p in q.recentProgress if p["sources"] and p["sources"][0]["endOffset"]]
            if progress:
                done["at"] = max(_offset(p["sources"][0]["endOffset"]) for p in progress)
                done["n"] = sum(p["numInputRows"] > 0 for p in progress)
            if done["at"] >= total and (progress or not total):
                return {"status": "completed", "next_offset": total, "remaining": 0}
            if (batches is not None and done["n"] >= batches) or (seconds is not None and time.time() - began > seconds):
                return {"status": "split", "next_offset": done["at"], "remaining": total - done["at"]}
            time.sleep(0.05)
    finally:
        q.stop()
        q.awaitTermination()


def _offset(x) -> int:
    """The number in a reported offset, whose form is the engine's."""
    return int(re.search(r"\d+", str(x))[0])
