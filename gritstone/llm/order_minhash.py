"""Document fingerprints by order MinHash (operator 10). DataFrame operations only.

A text's k-mers of words are numbered by occurrence; a hash of (k-mer, number) deals each to one of ``BINS`` bins
and ranks it there. Each bin keeps its ``KEEP`` least, puts them back in text order and hashes the tuple, so both
lost k-mers and moved ones change the signature. One 64-bit value holds hash (high 41 bits) and position (low 23).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

K, KEEP, BITS = 3, 2, 5
BINS = 1 << BITS
_POS = (1 << 23) - 1
_NONE = "-" * 8
#: Words, of which long ones are cut, so texts without spaces have k-mers too.
_PIECE = r"[^\x20\x09-\x0D]{1,12}+"


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of a column: 32 groups of 8 hex digits, dashes for an empty bin. Each step is a
    projection of its own, since the next uses its array more than once."""
    pos = F.lit(_POS).cast("long")
    rows = rows.withColumn("_w", F.regexp_extract_all(text, F.lit(_PIECE), 0))
    kmer = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - K, F.lit(0))), lambda i: F.xxhash64(F.slice("_w", i + 1, K)).bitwiseAND(F.bitwise_not(pos)).bitwiseOR(i.cast("long").bitwiseAND(pos)))
    rows = rows.withColumn("_s", F.sort_array(F.when(F.size("_w") > 0, kmer).otherwise(F.array().cast("array<bigint>")))).drop("_w")
    # Runs of one k-mer: where each begins.
    head = lambda i: F.shiftright(F.get("_s", i), 23)
    begins = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (head(i) != head(i - 1)))
    rows = rows.withColumn("_b", F.when(F.size("_s") > 0, begins).otherwise(F.array().cast("array<int>")))

    def numbered(start, run):
        end = F.coalesce(F.get("_b", run + 1), F.size("_s")) - 1
        key = lambda i: F.xxhash64(head(i), i - start).bitwiseAND(F.bitwise_not(pos)).bitwiseOR(F.get("_s", i).bitwiseAND(pos))
        return F.transform(F.sequence(start, end), key)

    rows = rows.withColumn("_n", F.sort_array(F.flatten(F.transform("_b", numbered)))).drop("_s", "_b")
    bin_of = lambda v: F.shiftright(v, 64 - BITS)
    rows = rows.withColumn("_l", F.filter("_n", lambda v, i: (i < KEEP) | (bin_of(F.get("_n", i - KEEP)) != bin_of(v)))).drop("_n")

    def signature(j):
        own = F.filter("_l", lambda v: bin_of(v) == j)
        order = F.sort_array(F.transform(own, lambda v: F.shiftleft(v.bitwiseAND(pos), 40).bitwiseOR(F.shiftrightunsigned(v, 24))))
        tuple_ = F.transform(order, lambda v: v.bitwiseAND(F.lit((1 << 40) - 1).cast("long")))
        return F.when(F.exists("_l", lambda v: bin_of(v) == j), F.substring(F.lower(F.lpad(F.hex(F.xxhash64(tuple_)), 16, "0")), 1, 8)).otherwise(F.lit(_NONE))

    sign = F.array_join(F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda j: signature(j.cast("long"))), "")
    return rows.withColumn(out, F.when(F.size("_l") > 0, sign).otherwise(F.lit(_NONE * BINS))).drop("_l")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among bins that either text fills; equal fingerprints give 1."""
    pair = lambda i: (F.substring(a, i * 8 + 1, F.lit(8)), F.substring(b, i * 8 + 1, F.lit(8)))

    def add(acc, i):
        x, y = pair(i)
        used = (x != _NONE) | (y != _NONE)
        return F.struct((acc["n"] + F.when(used, 1.0).otherwise(0.0)).alias("n"), (acc["same"] + F.when(used & (x == y), 1.0).otherwise(0.0)).alias("same"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("same"))
    share = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), zero, add, lambda acc: F.when(acc["n"] > 0, acc["same"] / acc["n"]).otherwise(0.0))
    return F.when(a == b, 1.0).otherwise(share)


def with_next(rows: DataFrame, columns: list[str], derive) -> DataFrame:
    """Adds what ``derive`` adds to rows (doc_id, text), and ``next_<column>`` of the next row by descending doc_id
    (then text), after the last the first. The row that a range gets from the next is derived by itself.

    Ids are cut into ranges at approximate quantiles; each range is sorted by itself, and gets a copy of the first
    row of the range below as its last, so no task sees all rows. Null ids come last."""
    buckets = 2 * partitions(rows.sparkSession)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc_id"))), F.lit(-1)) if cuts else F.lit(0)
    rows = rows.withColumn("_bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket)).withColumn("_ghost", F.lit(0))
    firsts = {b: i for b, i in rows.groupBy("_bucket").agg(F.max("doc_id")).collect()}  # a row a range
    order = sorted(firsts, reverse=True)
    if not order:
        rows = derive(rows).drop("_bucket", "_ghost")
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    ghosts = None
    for at, b in enumerate(order):
        nxt = order[(at + 1) % len(order)]
        one = F.struct(F.lit(nxt).alias("b"), F.lit(firsts[nxt]).cast("long").alias("i"), F.lit(b).alias("to"))
        ghosts = [*(ghosts or []), one]
    wanted = rows.sparkSession.range(1).select(F.explode(F.array(*ghosts)).alias("g")).select("g.*")
    head = rows.join(F.broadcast(wanted), (rows["_bucket"] == wanted["b"]) & rows["doc_id"].eqNullSafe(wanted["i"]))
    head = head.groupBy("to").agg(F.min("text").alias("text"))
    head = head.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("_bucket"), F.lit(1).alias("_ghost"))
    w = Window.partitionBy("_bucket").orderBy("_ghost", F.desc_nulls_last("doc_id"), "text")
    out = derive(rows).unionByName(derive(head)).withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return out.where("_ghost = 0").drop("_bucket", "_ghost")


def order_minhash(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty, with a fingerprint of dashes. A lone row is its own next. Null ids come last, repeated
    ids in order of their texts. Texts are read whole; beyond 8,388,607 pieces positions wrap around, which changes
    the order within a bin and no more. No rows give no rows. Other columns are not read, whatever their names."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = with_next(rows, ["text", "fingerprint"], lambda r: with_fingerprint(r, "text", "fingerprint"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    a, b, c = (F.col(x) for x in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"))
