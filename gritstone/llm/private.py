"""Information-theoretic sanitisation of personal data (operator 5). DataFrame operations only.

Base spans come from four patterns. Then the words of all texts with a protected value are weighed: over the whole
corpus, a term reveals an entity as far as knowing the term raises the entity's probability (pointwise mutual
information, in bits). Entities are literal values and, behind them, their kinds; the probability of a value given a
term is smoothed by that of its kind, and that by how often words as rare as the term stand beside the kind at all.
Terms (words of three letters or more) beyond the disclosure threshold become spans of kind ``term`` wherever they stand, in every text.

Positions come from ``split`` and ``regexp_extract_all`` with one pattern: the pieces between the matches and the
matches themselves, whose lengths add up. Patterns are possessive and anchored at the start of a run, which changes
no match and keeps them linear on very long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to have a chance; saves most scans.
GUARD = {"email": "@", "ip": "[0-9][.][0-9]", "card": "(?:[0-9][ -]?){11}[0-9]", "phone": "[+][0-9]"}
WORD = r"\p{L}{3,}+"
PRIOR = 3.0  # texts that the back-off weighs
MIN_SHARE = 0.5  # smoothed probability of the entity given the term
MIN_BITS = 4.0
#: Most bytes of the filter of disclosing terms that rows carry; below that 64 a term, and at least 2^16, so that one
#: word in 64 at most passes by chance. As it fills more rows are shuffled, results stay exact.
FILTER_CELLS = 1 << 20
#: Stands around words while a text is cut; where a text has it itself a space stands instead, no letter either.
MARK = "\x01"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return {"email": F.lit(True), "ip": value.rlike(rf"^{part}(?:\.{part}){{3}}$"), "card": _luhn(digits), "phone": F.length(digits).between(9, 15)}[kind]


def _cut(rows: DataFrame, source: str, pattern: Column, name: str, guard: Column, keep=lambda value: F.lit(True)) -> DataFrame:
    """Adds ``name``: array of (start, end, value) of the matches in a column that are to be kept."""
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"_m": F.when(guard, F.regexp_extract_all(source, pattern, F.lit(0))).otherwise(none), "_p": F.when(guard, F.split(source, pattern, -1)).otherwise(none)})
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(acc, x):
        start = acc["at"] + F.length(x["_p"])
        end = start + F.length(x["_m"])
        span = F.struct(start.alias("start"), end.alias("end"), x["_m"].alias("value"))
        out = F.when(keep(x["_m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.when(x["_m"].isNull(), acc).otherwise(F.struct(end.alias("at"), out.alias("out")))

    # Each array stands once, and outside the lambda: a projection merged into it would scan the text again and again.
    walk = F.aggregate(F.arrays_zip("_p", "_m"), F.struct(F.lit(0).alias("at"), empty.alias("out")), add)["out"]
    return rows.withColumn(name, walk).drop("_m", "_p")


def _key(text: Column) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(text.cast("binary")))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """text_key, text, spans of each distinct text: array of (start, kind order, kind, end, value), in order."""
    rows = docs.select(F.coalesce(text, F.lit("")).alias("text")).withColumn("text_key", _key(F.col("text"))).dropDuplicates(["text_key"])
    for kind, pattern in KINDS.items():
        guard = F.col("text").rlike(GUARD[kind]) if len(GUARD[kind]) > 1 else F.contains("text", F.lit(GUARD[kind]))
        rows = _cut(rows, "text", F.lit(pattern), kind, guard, lambda value, kind=kind: _valid(kind, value))

    def spans_of(order: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("k"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))

    parts = [spans_of(order, kind) for order, kind in enumerate(KINDS)]
    return rows.select("text_key", "text", F.array_sort(F.concat(*parts)).alias("spans"))


def _words() -> Column:
    return F.regexp_extract_all("text", F.lit(WORD), F.lit(0))


def disclosing_terms(found: DataFrame, min_share: float = MIN_SHARE, min_bits: float = MIN_BITS) -> DataFrame:
    """(term, entity, bits, outside) beyond the threshold, from base_spans; an entity is ``kind:value`` or a kind alone.
    ``outside``: the term also stands in texts without any protected value.

    All counts are of distinct texts and cover all of them. With N texts, for a value e of kind k and a term t that
    stands in as many texts as the other terms of its frequency class c (by the power of two):

        p(k | c) = share of the texts of the terms of c that hold k
        p(k | t) = (texts with t and k + PRIOR * p(k | c)) / (texts with t + PRIOR)
        p(e | t) = (texts with t and e + PRIOR * p(k | t) * p(e) / p(k)) / (texts with t + PRIOR)

    So a word that stands once, beside a value, is taken for what other words that stand once are: chance."""
    terms = F.explode(F.array_distinct(F.transform(_words(), lambda w: F.lower(w)))).alias("term")
    words = stored(found.select(terms).groupBy("term").agg(F.count(F.lit(1)).alias("with_t")), "words")
    level = F.floor(F.log2("with_t")).cast("int").alias("level")
    entity = F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"))))
    held = found.where(F.size("spans") > 0).withColumn("entities", entity)
    flags = [F.array_contains(F.transform("spans", lambda s: s["kind"]), kind).cast("int").alias(f"with_{kind}") for kind in KINDS]
    sums = [F.sum(f"with_{kind}").alias(f"with_{kind}") for kind in KINDS]
    inside = held.select(terms, *flags).groupBy("term").agg(F.count(F.lit(1)).alias("with_h"), *sums)
    inside = stored(inside.join(words, "term").withColumn("level", level), "inside")

    # One row a frequency class, 64 at most, and one a kind.
    levels = words.select(level, "with_t").groupBy("level").agg(F.sum("with_t").alias("all_t"))
    levels = inside.groupBy("level").agg(*sums).join(levels, "level").select("level", F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*[F.col(f"with_{k}") / F.col("all_t") for k in KINDS])).alias("by_chance"))
    values = held.select(F.explode("entities").alias("e")).groupBy("e.kind", "e.entity").agg(F.count(F.lit(1)).alias("with_e"))
    total = found.agg(F.count(F.lit(1)).alias("n"))
    kinds = held.select(F.explode(F.array_distinct(F.transform("entities", lambda e: e["kind"]))).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("with_k")).crossJoin(F.broadcast(total))
    kinds = kinds.join(values.groupBy("kind").agg(F.max("with_e").alias("most_e")), "kind")

    given = F.col("with_t") + PRIOR
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"with_{k}").alias("both_k")) for k in KINDS])).alias("x")
    by_kind = inside.join(F.broadcast(levels), "level").select("term", "with_t", "with_h", "by_chance", each).where("x.both_k > 0")
    p_k = (F.col("x.both_k") + PRIOR * F.col("by_chance")[F.col("x.kind")]) / given
    by_kind = by_kind.select("term", "with_t", "with_h", F.col("x.kind").alias("kind"), F.col("x.both_k").alias("both_k"), p_k.alias("p_k")).join(F.broadcast(kinds), "kind")
    # What falls short even if all its texts hold the kind's most common value need not meet its entities.
    able = stored(by_kind.where(F.col("both_k") + PRIOR * F.greatest(F.lit(0.0), F.col("p_k") * F.col("most_e") / F.col("with_k")) >= min_share * given).unionByName(by_kind.where(F.col("p_k") >= min_share)).distinct(), "able")
    pairs = held.select("entities", terms).join(able.select("term").distinct(), "term").select("term", F.explode("entities").alias("e"))
    by_value = pairs.groupBy("term", "e.kind", "e.entity").agg(F.count(F.lit(1)).alias("both")).join(able, ["term", "kind"])
    by_value = by_value.where(F.col("both") + PRIOR >= min_share * given).join(values, ["kind", "entity"])
    p = (F.col("both") + PRIOR * F.col("p_k") * F.col("with_e") / F.col("with_k")) / given
    outside = (F.col("with_t") > F.col("with_h")).alias("outside")
    weighed = by_value.select("term", "entity", p.alias("p"), (F.col("with_e") / F.col("n")).alias("prior"), outside)
    weighed = weighed.unionByName(able.select("term", F.col("kind").alias("entity"), F.col("p_k").alias("p"), (F.col("with_k") / F.col("n")).alias("prior"), outside))
    bits = F.log2(F.col("p") / F.col("prior"))
    return weighed.where((F.col("p") >= min_share) & (bits >= min_bits)).select("term", "entity", bits.alias("bits"), "outside")


def _cell(term: Column, size: int) -> Column:
    return (F.xxhash64(term).bitwiseAND(F.lit(size - 1))).cast("int")


def term_spans(found: DataFrame, terms: DataFrame) -> DataFrame:
    """text_key, terms: array of (start, kind order, kind, end) of all occurrences of the terms (column term)."""
    size = min(FILTER_CELLS, 1 << max(16, (64 * terms.count()).bit_length()))
    cells = [0] * size
    for row in terms.select(_cell(F.col("term"), size).alias("at")).distinct().toLocalIterator():
        cells[row["at"]] = 1
    # An array is read in place; a binary would be copied for each word, a literal would fill every plan that is logged.
    cells = found.sparkSession.createDataFrame([(cells,)], "cells array<tinyint>")

    def maybe(word: Column) -> Column:
        return F.get("cells", _cell(F.lower(word), size)) == 1

    rows = found.select("text_key", "text").crossJoin(F.broadcast(cells))
    likely = F.explode(F.filter(F.array_distinct(F.transform(_words(), lambda w: F.lower(w))), maybe)).alias("term")
    # Stored, so that its true size decides whether it goes to the texts or the texts are shuffled.
    hits = stored(rows.select("text_key", likely).join(terms, "term", "left_semi").select("text_key").distinct(), "hits")
    # Words stand between marks, so at odd places of the split; those that may be terms are cut out, all else is gaps.
    # Places add up in a window: an array that grows in an aggregate would be copied at each word.
    words = F.split(F.regexp_replace(F.replace("text", F.lit(MARK), F.lit(" ")), WORD, f"{MARK}$0{MARK}"), MARK, -1)
    cut = F.array_join(F.transform(words, lambda x, i: F.when((i % 2 == 1) & maybe(x), F.concat(F.lit(MARK), x, F.lit(MARK))).otherwise(x)), "")
    pieces = F.transform(F.split(cut, MARK, -1), lambda x, i: F.struct(F.length(x).alias("n"), F.when(i % 2 == 1, F.lower(x)).alias("term")))
    rows = rows.join(hits, "text_key", "left_semi").select("text_key", F.posexplode(pieces).alias("pos", "x"))
    so_far = Window.partitionBy("text_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("text_key", "x.n", "x.term", F.sum("x.n").over(so_far).cast("int").alias("end"))
    rows = rows.where("term is not null").select("text_key", "term", (F.col("end") - F.col("n")).alias("start"), "end").join(terms, "term", "left_semi")
    return rows.groupBy("text_key").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("k"), F.lit("term").alias("kind"), "end")).alias("terms"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_private(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, counts by kind, base_sha256, spans, n_term.

    Null texts count as empty; a text without spans has the empty string and its hash. A term that overlaps a base
    span is dropped. Repeated rows repeat; an empty table gives an empty result. Very long texts are read whole.
    Other columns are not read, whatever their names."""
    found = stored(base_spans(docs, text), "private")
    terms = stored(disclosing_terms(found).select("term", "outside").distinct(), "terms")
    # Most terms stand in no text without a protected value, so those texts are searched for the others alone.
    held = F.size("spans") > 0
    marked = term_spans(found.where(held), terms).unionByName(term_spans(found.where(~held), terms.where("outside")))
    base = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["kind"].alias("kind"), x["end"].alias("end")))
    rows = found.select("text_key", base.alias("base")).join(marked, "text_key", "left")
    clear = F.filter(F.coalesce("terms", F.array().cast("array<struct<start:int,k:int,kind:string,end:int>>")), lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    rows = rows.withColumn("clear", clear)

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    count = {f"n_{k}": number(k) for k in KINDS}
    rows = rows.select("text_key", *[c.alias(n) for n, c in count.items()], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "clear"))).alias("spans"), F.size("clear").cast("long").alias("n_term"))
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _key(F.coalesce(text, F.lit(""))).alias("text_key"))
    return ids.join(rows, "text_key").drop("text_key")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with spans, as find_private gives them, generalised to ``<kind>``; overlaps count once, the first wins."""
    parsed = F.transform(F.filter(F.split(spans, ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[0].alias("kind"), F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end")))

    def add(acc, s):
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), new.alias("out")))

    return F.aggregate(parsed, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
