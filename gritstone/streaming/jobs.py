"""Life cycles of jobs: on a stream with a state store and a timer, and the same as one batch.

Events (job_id, seq, status, at, result, error) count in the order of ``seq``. ``queued`` makes a job that is not there;
``running`` follows queued; ``done`` follows running; ``failed`` follows either; both are final. What is not a legal
move, tells of an unknown job or is older than the job's last change is rejected. A change sets the four fields
``status``, ``result``, ``error`` and ``updated_at``; the rest of a job never changes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# What may follow what.
MOVES = {None: ("queued",), "queued": ("running", "failed"), "running": ("done", "failed"), "done": (), "failed": ()}
#: Times are microseconds in the state: they compare alike whatever zone a worker is in.
JOB = "status string, created_at long, updated_at long, result string, error string"
OUT = "job_id string, seq long, " + JOB + ", outcome string"
_ROW = Row("job_id", "seq", "status", "created_at", "updated_at", "result", "error", "outcome")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Jobs(StatefulProcessor):
    """One state a job. With ``ttl_ms`` a job that has not changed for so long, by event time, is forgotten."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", JOB)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        job = self.state.get() if self.state.exists() else None
        first, changed = job, False
        for r in sorted(rows, key=lambda r: r.seq):
            if r.status not in MOVES[job[0] if job else None]:
                outcome = "illegal" if job or r.status not in MOVES else "unknown"
            elif job and r.us < job[2]:
                outcome = "late"
            else:
                job = (r.status, job[1] if job else r.us, r.us, r.result, r.error)
                outcome, changed = "accepted", True
            yield _ROW(key[0], r.seq, *(job or (None,) * 5), outcome)
        if changed:
            self.state.update(job)
            if self.ttl_ms:
                ms = lambda us: us // 1000 + self.ttl_ms
                if first:
                    self.handle.deleteTimer(ms(first[2]))
                self.handle.registerTimer(ms(job[2]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            job = self.state.get()
            self.state.clear()
            yield _ROW(key[0], None, *job, "expired")


def job_stream(events: DataFrame, ttl_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """A row for each event, with the job after it and what became of the event, and one when a job is forgotten.
    Needs the state store PROVIDER."""
    if ttl_ms:
        events = events.withWatermark("at", late)
    out = events.withColumn("us", F.unix_micros(F.col("at").cast("timestamp"))).groupBy("job_id").transformWithState(Jobs(ttl_ms), OUT, "Update", "EventTime" if ttl_ms else "None")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("created_at", "updated_at")})


def job_table(events: DataFrame) -> DataFrame:
    """The same as a batch, without a loop over a job's events: (job_id, status, created_at, updated_at, result, error,
    accepted, rejected). Statuses only rise, so each change is the first event of its kind after the change before: three
    sums by job, pre-aggregated. Jobs that were never queued have null fields."""
    when = lambda test: F.min(F.when(test, F.struct("seq", "at", "status", "result", "error")))
    is_ = lambda s: F.col("status") == s
    after = lambda c: (F.col("seq") > F.col(f"{c}.seq")) & (F.col("at") >= F.col(f"{c}.at"))
    put = events.groupBy("job_id").agg(when(is_("queued")).alias("put"), F.count(F.lit(1)).alias("n"))
    next_ = events.join(put, "job_id").where(after("put")).groupBy("job_id").agg(when(is_("running")).alias("run"), when(is_("failed")).alias("end_0"))
    # A failure before the run is the end; else what ends is what follows the run.
    next_ = next_.withColumn("run", F.when(F.col("end_0").isNull() | (F.col("run.seq") < F.col("end_0.seq")), F.col("run")))
    last = events.join(next_.where("run is not null").select("job_id", "run"), "job_id").where(after("run")).groupBy("job_id").agg(when(is_("done") | is_("failed")).alias("end_1"))
    j = put.join(next_, "job_id", "left").join(last, "job_id", "left")
    end = F.when(F.col("run").isNotNull(), F.col("end_1")).otherwise(F.col("end_0"))
    now = F.coalesce(end, "run", "put")
    n = sum((c.isNotNull().cast("long") for c in (F.col("run"), end)), F.col("put").isNotNull().cast("long"))
    return j.select("job_id", now["status"].alias("status"), F.col("put.at").alias("created_at"), now["at"].alias("updated_at"), now["result"].alias("result"), now["error"].alias("error"), n.alias("accepted"), (F.col("n") - n).alias("rejected"))
