"""Aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Nearest rank; no rows give no group. Values are counted on the map side, so a large group is not sorted in
    one task."""
    pick = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return df.where(F.col(value).isNotNull()).groupBy(*group).agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"), F.count(F.lit(1)).alias("n"))


def rolling(df: DataFrame, group: str, ts: str, value: str, key: str) -> DataFrame:
    """The last five minutes of each group, lower edge included."""
    w = f"(PARTITION BY {group} ORDER BY {ts} RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW)"
    return df.select(key, group, F.expr(f"count(*) OVER {w}").alias("n"), F.expr(f"round(max({value}) OVER {w}, 4)").alias("largest"))


def alarm_windows(df: DataFrame, ts: str, value: str, threshold: float, needed: int) -> DataFrame:
    """300 s sums; an alarm stands where ``needed`` windows in a row are above the threshold."""
    b = df.groupBy(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 300).alias("bucket")).agg(F.round(F.sum(value), 4).alias("total"))
    b = b.withColumn("breach", (F.col("total") > threshold).cast("int"))
    recent = F.sum("breach").over(Window.orderBy("bucket").rangeBetween(-(needed - 1), 0))
    return b.withColumn("alarm", recent >= needed)


def share(part: Column, of: Column, places: int = 4) -> Column:
    """Guarded ratio."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), of.cast("double")), F.lit(0.0)), places)


def contribution(df: DataFrame, by: str, text: str) -> DataFrame:
    """A1: total, with text, ratio."""
    n, t = F.count(F.lit(1)), F.count_if(F.length(F.coalesce(F.col(text), F.lit(""))) > 0)
    return df.groupBy(by).agg(n.alias("total"), t.alias("with_text"), share(t, n).alias("ratio"))


def diversity(df: DataFrame, by: str, group: str) -> DataFrame:
    """A10: whether the dominant value of each group stays below 0.8 of it; always with fewer than two rows."""
    c = df.groupBy(group, by).count().groupBy(group).agg(F.max("count").alias("top"), F.sum("count").alias("n"))
    return c.select(group, "n", share(F.col("top"), F.col("n")).alias("dominant"), ((F.col("n") < 2) | (F.col("top") / F.col("n") < 0.8)).alias("diverse"))


def coverage(df: DataFrame, answer: str, evidence: str) -> DataFrame:
    """A5: supported, unsupported and all sentences by answer."""
    ok = F.count_if(F.col(evidence) > 0)
    return df.groupBy(answer).agg(ok.alias("supported"), (F.count(F.lit(1)) - ok).alias("unsupported"), F.count(F.lit(1)).alias("total"))


def carry_forward(df: DataFrame, group: str, order: list, value: Column, reset: Column, name: str) -> DataFrame:
    """The last value since the last reset."""
    w = Window.partitionBy(group).orderBy(*order)
    scope = df.withColumn("_scope", F.sum(reset.cast("int")).over(w))
    return scope.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(group, "_scope").orderBy(*order))).drop("_scope")


def tiles(df: DataFrame, group: str, start: str, end: Column, key: str) -> DataFrame:
    """A block ends where the next begins, the last at ``end``."""
    return df.withColumn("block_end", F.coalesce(F.lead(start).over(Window.partitionBy(group).orderBy(start, key)), end))


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, tie: str) -> DataFrame:
    """To each left row the last right row of its key at or before it; one shuffle, no join."""
    both = left.select(key, ts, tie, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(right.select(key, ts, F.lit(None).cast(left.schema[tie].dataType).alias(tie), F.lit(0).alias("_side"), value))
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").drop("_side")


def batch_outcome(df: DataFrame, ok: Column) -> DataFrame:
    """Successes, errors and the status code of a batch: 200 if all went well, else 207."""
    n, good = F.count(F.lit(1)), F.count_if(ok)
    return df.agg(n.alias("total"), good.alias("success"), (n - good).alias("errors"), F.when(n == good, 200).otherwise(207).alias("status"))


def named_events(df: DataFrame, name: Column, pattern: str) -> DataFrame:
    """How many events a log pattern names."""
    return df.agg(F.count_if(name == pattern).alias("n"))


def cost(usage: DataFrame, service: str, volume: str, unit_price: str) -> DataFrame:
    """Price times volume by service, cut to two decimals."""
    amount = F.sum(F.col(volume).cast("decimal(20,4)") * F.col(unit_price).cast("decimal(12,6)"))
    return usage.groupBy(service).agg((F.floor(amount * 100) / 100).cast("decimal(20,2)").alias("cost"))
