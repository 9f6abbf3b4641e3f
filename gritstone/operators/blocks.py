"""Documents cut into typed blocks (C6), by windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The forms of a fence and of the lines that open a block, in the order in which they are tried, and the
# longest line that a keyword may open.
FENCE = r"^[ \t]*(?:`{3,}|~{3,})"
HEADERS = [
    (r"(?i)^[ \t]*(?:command|syntax|usage)\b[ \t]*:?", "command"),
    (r"(?i)^[ \t]*(?:options|arguments)\b[ \t]*:?", "option"),
    (r"^[ \t]*-{1,2}[A-Za-z]", "option"),
    (r"(?i)^[ \t]*(?:flow|methodology|procedure|step)\b[ \t]*:?", "flow_step"),
    (r"(?i)^[ \t]*examples?\b[ \t]*:?", "example"),
]
DEFINITION = HEADERS[2][0]
LONGEST_HEADER = 80


def before(swap: Column, key: str, at: str, turn_on: Column | None = None, turn_off: Column | None = None) -> Column:
    """The state, false at first, that a two-state automaton is in before each row of a key.

    A row keeps the state, swaps it, or sets it. Such transition tables compose to one of the same kind: the value set
    last, if any, swapped as often as rows after it swap. So the state before a row is a prefix composition: two
    running windows, no loop over the rows of a key."""
    prefix = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum(swap.cast("int")).over(prefix), F.lit(0))
    if turn_on is None and turn_off is None:
        return swaps % 2 == 1
    on, off = (F.lit(False) if c is None else c for c in (turn_on, turn_off))
    # A row that sets counts the swaps up to and with it.
    upto = F.sum(swap.cast("int")).over(prefix.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.last(F.when(on | off, F.struct(upto.alias("n"), on.alias("value"))), ignorenulls=True).over(prefix)
    return F.when(last.isNull(), swaps % 2 == 1).otherwise(((swaps - last["n"]) % 2 == 1) != last["value"])


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, raw): the pieces between line feeds, in order."""
    return docs.where(F.length(text) > 0).select(key, F.length(text).alias("total"), F.posexplode(F.split(text, "\n", -1)).alias("at", "raw"))


def header(line: Column) -> Column:
    """What kind of block a line opens outside fences, or null. A keyword before a long run of prose opens none."""
    short = F.length(F.regexp_replace(line, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")) <= LONGEST_HEADER
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(HEADERS):
        opened = F.lit(kind) if pattern == DEFINITION else F.when(short, F.lit(kind))
        out = F.when(line.rlike(pattern), opened).otherwise(out)
    return out


def block_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_start, block_end, object_type): blocks that tile each text, offsets in code points, half open.

    A fence opens an example and hides lines up to the fence that closes it; a line that opens a block ends the one
    before; what stands before the first is a section. Null and empty texts have no blocks. Rows are told apart even
    if keys repeat or are null. Only numbers and kinds of lines are shuffled, not lines."""
    rows = docs.select(F.struct(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row")).alias("doc"), F.col(text).alias("text"))
    line = F.regexp_replace(F.regexp_replace("raw", r"\r+\z", ""), r"^\f+|\f+\z", "")
    facts = lines(rows, "doc", "text").select("doc", "at", "total", (F.length("raw") + 1).alias("n"), line.rlike(FENCE).alias("fence"), header(line).alias("kind"))
    to_here = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    facts = facts.select("doc", "at", "total", "fence", "kind", (F.sum("n").over(to_here) - F.col("n")).alias("start"), before(F.col("fence"), "doc", "at").alias("inside"))
    kind = F.when(F.col("inside"), None).when(F.col("fence"), F.lit("example")).otherwise(F.col("kind"))
    heads = facts.withColumn("kind", F.coalesce(kind, F.when(F.col("at") == 0, "section"))).where("kind is not null")
    end = F.coalesce(F.lead("start").over(Window.partitionBy("doc").orderBy("at")), "total")
    return heads.select(F.col("doc.key").alias(key), F.col("start").cast("long").alias("block_start"), end.cast("long").alias("block_end"), F.col("kind").alias("object_type"))
