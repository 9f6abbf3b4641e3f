"""Streaming: file ingest, windows, job state. Batch functions do the work in foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def tumbling(events: DataFrame, ts: str, value: str, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """Sums by window; late rows up to the watermark count."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "total", "n")


def sliding(events: DataFrame, ts: str, by: str, value: str, late: str = "10 minutes") -> DataFrame:
    """W4 on a stream: five-minute windows each minute."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "5 minutes", "1 minute").alias("w"), by).agg(F.max(value).alias("largest"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "largest", "n")


def run(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | str, mode: str = "append"):
    """Starts the query; available data only, so that a job ends. A name makes a table in memory."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return w.format("memory").queryName(sink).start() if isinstance(sink, str) else w.foreachBatch(sink).start()


def job_state(events: DataFrame) -> DataFrame:
    """Job life cycle: the latest event of each job; done and failed are final."""
    final = F.col("status").isin("done", "failed")
    w = Window.partitionBy("job_id").orderBy(F.desc(final), F.when(final, F.col("at")).asc(), F.desc("at"))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
