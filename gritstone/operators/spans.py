"""Places in texts as sorted rows: matches of a pattern, brackets that belong together, innermost enclosing intervals,
the next match within a distance. All by windows over sorted rows; nothing meets in pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matches(texts: DataFrame, key: str, text: str, pattern: str, groups: int = 0) -> DataFrame:
    """(key, start, end, g0, g1, ...) of all matches and their groups, offsets in code points, half open. Null texts
    have none. A key names one text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The pieces between matches and the matches add up to the text; the last piece has no match.
    rows = texts.where(F.col(text).rlike(pattern)).select(key, F.posexplode(F.arrays_zip(F.split(F.col(text), pattern, -1).alias("piece"), found.alias("g0"))).alias("at", "x"))
    rows = rows.select(key, "at", F.length("x.piece").alias("gap"), F.col("x.g0").alias("g0"))
    so_far = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("g0"), F.lit(0))).over(so_far)).where("g0 is not null")
    more = [F.regexp_extract("g0", pattern, i).alias(f"g{i}") for i in range(1, groups + 1)]
    return rows.select(key, (F.col("end") - F.length("g0")).alias("start"), "end", "g0", *more)


def passed(points: DataFrame, marks: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """``points`` with ``name``, the sum of ``n`` over the marks (key, at, n) of their key at or before their ``at``."""
    kind = points.select(F.struct(*points.columns).alias("_p")).schema["_p"].dataType
    both = points.select(key, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_turn"), F.lit(0).alias("_n"), F.struct(*points.columns).alias("_p"))
    both = both.unionByName(marks.select(key, F.col("at").cast("long").alias("_at"), F.lit(0).alias("_turn"), F.col("n").cast("int").alias("_n"), F.lit(None).cast(kind).alias("_p")))
    so_far = Window.partitionBy(key).orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.sum("_n").over(so_far)).where("_p is not null").select("_p.*", name)


def closing(marks: DataFrame, key: str, at: str, opens: Column, shut: str) -> DataFrame:
    """Bracket matching: ``marks`` with ``close``, for each opening mark the ``shut`` of the mark that closes it, else
    null. Each mark opens or closes one level. With r the running sum after an opening mark, the mark that closes it is
    the next closing mark that r stood before: opening and closing marks of a level meet in one window."""
    so_far = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marks.withColumn("_open", opens).withColumn("_sum", F.sum(F.when(F.col("_open"), 1).otherwise(-1)).over(so_far))
    rows = rows.withColumn("_level", F.when(F.col("_open"), F.col("_sum")).otherwise(F.col("_sum") + 1))
    # Read backwards: Spark runs on over a frame that grows, and begins anew for each row of one that shrinks.
    ahead = Window.partitionBy(key, "_level").orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("close", F.when(F.col("_open"), F.last(F.when(~F.col("_open"), F.col(shut)), ignorenulls=True).over(ahead))).drop("_open", "_sum", "_level")


def owners(intervals: DataFrame, points: DataFrame, key: str, path: bool = False, upto: str | None = None) -> DataFrame:
    """``points`` (key, at, ...) with ``owner``, the struct of the innermost interval (key, lo, hi, of) that holds
    them, lo <= at < hi, or null; with ``path``, in ``around`` all that hold them, outermost first. Intervals of a key are nested and
    distinct. Points that are intervals themselves name their end by ``upto`` and are not their own owner.

    Ends, starts and points are swept in order. The number of open intervals is a running sum, and the interval that is
    open on a level is the last that began there: a window over (key, level)."""
    kind = intervals.schema["of"].dataType
    extra = [c for c in points.columns if c not in (key, "at")]
    point = points.select(key, "at", F.struct(*extra, F.col("at").alias("_at")).alias("point"))
    none_p, none_o = F.lit(None).cast(point.schema["point"].dataType).alias("point"), F.lit(None).cast(kind).alias("of")
    events = intervals.select(key, F.col("hi").alias("at"), F.lit(0).alias("turn"), F.lit(0).cast("long").alias("within"), F.lit(0).alias("sub"), none_o, none_p)
    events = events.unionByName(intervals.select(key, F.col("lo").alias("at"), F.lit(1).alias("turn"), (-F.col("hi")).cast("long").alias("within"), F.lit(1).alias("sub"), "of", none_p))
    # After all that begins at its place; an interval just before itself, after longer ones.
    events = events.unionByName(point.select(key, "at", F.lit(1 if upto else 2).alias("turn"), (-F.col("point")[upto] if upto else F.lit(0)).cast("long").alias("within"), F.lit(0).alias("sub"), none_o, "point"))
    order = ["at", "turn", "within", "sub"]
    asks = F.col("point").isNotNull()
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(asks, 0).when(F.col("turn") == 0, -1).otherwise(1)
    events = events.withColumn("depth", F.sum(step).over(so_far)).where("turn > 0")
    if path:
        levels = F.when(~asks, F.array("depth")).otherwise(F.when(F.col("depth") > 0, F.sequence(F.lit(1).cast("long"), F.col("depth"))))
        events = events.withColumn("place", F.struct("at", "turn", "within", "point"))
        events = events.withColumn("level", F.explode_outer(levels))
    else:
        events = events.withColumn("level", F.col("depth"))
    last = Window.partitionBy(key, "level").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.withColumn("owner", F.when(F.col("level") > 0, F.last("of", ignorenulls=True).over(last))).where(asks)
    if path:
        inside = F.struct("level", "owner")
        rows = rows.groupBy(key, "place").agg(F.first("point").alias("point"), F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), inside))).alias("_in"))
        rows = rows.withColumn("around", F.transform("_in", lambda x: x["owner"])).withColumn("owner", F.get("around", F.size("around") - 1))
    return rows.select(key, F.col("point._at").alias("at"), *[F.col("point")[c].alias(c) for c in extra], "owner", *["around"] * path)


def upcoming(left: DataFrame, right: DataFrame, key: str, within: int, value: str) -> DataFrame:
    """``left`` (key, start, ...) with ``value`` of the next ``right`` (key, start, end, value) that begins at or after
    it and ends within so many places of its start, else null: one window, read backwards as in :func:`closing`."""
    cols = [c for c in left.columns if c not in (key, "start")]
    side = left.select(key, "start", F.struct(*cols).alias("_left") if cols else F.struct(F.lit(1)).alias("_left"))
    kind = side.schema["_left"].dataType
    both = side.select(key, "start", F.lit(0).alias("_side"), "_left", F.lit(None).cast(right.select(F.struct("end", value)).schema[0].dataType).alias("_next"))
    both = both.unionByName(right.select(key, "start", F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_left"), F.struct("end", value).alias("_next")))
    ahead = Window.partitionBy(key).orderBy(F.desc("start"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_n", F.last("_next", ignorenulls=True).over(ahead)).where("_side = 0")
    return both.select(key, "start", *[F.col("_left")[c].alias(c) for c in cols], F.when(F.col("_n.end") <= F.col("start") + within, F.col("_n")[value]).alias(value))


def innermost(blocks: DataFrame, group: str, key: str, start: str, end: str) -> DataFrame:
    """(key, parent): to each block the shortest other block of its group that encloses it, both whole-numbered ends
    included, without being equal to it; of equally short ones the smallest key.

    The sweep of :func:`owners` answers for groups whose blocks are nested, which it also tests: the first crossing
    shows as an owner that ends too early. In other groups blocks lie in cells of their own length by the power of two
    and are asked for at the cells of longer lengths that hold a block's start, so that candidates are blocks around
    that start, not all of the group."""
    rows = blocks.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(start).cast("long").alias("lo"), F.col(end).cast("long").alias("hi"))
    once = rows.groupBy("g", "lo", "hi").agg(F.min("k").alias("k"))
    spans = once.select("g", "lo", (F.col("hi") + 1).alias("hi"), F.struct("k", "lo", "hi").alias("of"))
    swept = owners(spans, once.select("g", F.col("lo").alias("at"), (F.col("hi") + 1).alias("end"), "hi"), "g", upto="end")
    early = swept.where(F.col("owner.hi") < F.col("hi")).select("g").distinct()
    nested = swept.join(early, "g", "left_anti").select("g", F.col("at").alias("lo"), "hi", F.col("owner.k").alias("parent"))
    crossing = once.join(early, "g", "left_semi")
    level = F.ceil(F.log2(F.col("hi") - F.col("lo") + 1)).cast("int")
    cell = lambda at: F.floor(at / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    crossing = crossing.withColumn("level", level)
    laid = crossing.select("g", "level", F.col("k").alias("parent"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.explode(F.array_distinct(F.array(cell(F.col("lo")), cell(F.col("hi"))))).alias("cell"))
    top = crossing.groupBy("g").agg(F.max("level").alias("top"))
    asked = crossing.join(top, "g").select("g", "lo", "hi", F.explode(F.sequence("level", "top")).alias("level")).withColumn("cell", cell(F.col("lo")))
    longer = (F.col("from") <= F.col("lo")) & (F.col("to") >= F.col("hi")) & (F.col("to") - F.col("from") > F.col("hi") - F.col("lo"))
    found = asked.join(laid, ["g", "level", "cell"]).where(longer).groupBy("g", "lo", "hi").agg(F.min(F.struct((F.col("to") - F.col("from")).alias("n"), "parent")).alias("m"))
    known = nested.where("parent is not null").unionByName(found.select("g", "lo", "hi", F.col("m.parent").alias("parent")))
    return rows.join(known, ["g", "lo", "hi"], "left").select(F.col("k").alias(key), F.col("parent").alias("parent"))

