"""Answer verification: evidence, coverage, marks, placeholders, coordinates."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def normalised_evidence(c: Column) -> Column:
    """Defaults and a confidence clamped to [0, 1]."""
    return F.struct(F.coalesce(c["source"], F.lit("unknown")).alias("source"), F.coalesce(c["strength"], F.lit("weak")).alias("strength"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c["confidence"], F.lit(0.0)))).alias("confidence"))


def answer_sentences(answers: DataFrame, key: str, text: str) -> DataFrame:
    """C9, R14."""
    return answers.select(key, F.posexplode(T.sentences(F.col(text))).alias("idx", "sentence"))


def marked(text: Column, unsupported: Column) -> Column:
    """Each unsupported segment gets the mark."""
    return F.aggregate(unsupported, text, lambda acc, s: F.replace(acc, s, F.concat(s, F.lit(T.UNSUPPORTED_MARK))))


def may_publish(text: Column, unsupported: Column, answered: Column) -> Column:
    """R24."""
    return ~T.unresolved_latest(text) & ~((unsupported > 0) & answered)


def snapshot(requested: Column, resolved: Column) -> Column:
    """A concrete snapshot or an error, never ``latest``."""
    s = F.coalesce(F.when(F.lower(requested) != "latest", requested), resolved)
    return F.when(s.isNull(), F.raise_error(F.lit("no concrete snapshot"))).otherwise(s)


# The form of a placeholder, of a name in a statement by its kind, of any name in one, and the comment
# that stands for a placeholder without a name.
PLACEHOLDER = r"\{(MODULE|INSTANCE|SIGNAL|PORT)_([A-Z0-9_]+)\}"
NAMED = {"MODULE": r"[Mm]odule\s+'([^']+)'", "INSTANCE": r"[Ii]nstance\s+'([^']+)'", "SIGNAL": r"[Ss]ignal\s+'([^']+)'", "PORT": r"[Pp]ort\s+'([^']+)'"}
QUOTED = r"'([^']+)'"
UNRESOLVED = "<!-- NAME_RESOLUTION_FAILED: %s -->"
GRAM = 3


def containing(parts: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """The pairs of ``parts`` (by..., part) and ``names`` (by..., name, ...) whose name contains the part.

    An inverted index of q-grams of the names, of 1 to 3 characters. A part is looked up by the rarest of its own grams,
    of its length or 3, and verified; a part with a gram that no name has meets nothing. No pair is formed beyond the
    postings of that gram, and nothing is broadcast."""
    grams = lambda c, q: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - q + 1), lambda i: F.substring(c, i, q)))
    every = [F.when(F.length("name") >= q, grams("name", F.lit(q))).otherwise(F.array().cast("array<string>")) for q in range(1, GRAM + 1)]
    once = names.select(*by, "name").distinct()
    posted = once.select(*by, "name", F.explode(F.concat(*every)).alias("gram"))
    often = posted.groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("df"))
    asked = parts.select(*by, "part").distinct().where(F.length("part") > 0)
    asked = asked.select(*by, "part", F.explode(grams("part", F.least(F.length("part"), F.lit(GRAM)))).alias("gram"))
    asked = asked.join(often, [*by, "gram"], "left").groupBy(*by, "part").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
    found = asked.join(posted, [*by, "gram"]).where(F.contains("name", F.col("part"))).select(*by, "part", "name")
    return parts.join(found, [*by, "part"]).join(names, [*by, "name"])


def resolve_placeholders(docs: DataFrame, claims: DataFrame, results: DataFrame | None = None, key: str = "doc_id", topic: str = "topic", text: str = "text") -> DataFrame:
    """(key, text, unresolved): placeholders replaced by the names that they stand for, in three tiers.

    1. The name of the placeholder's kind in a claim (topic, statement, confidence, created_at) of the text's topic, if
    it contains the rest of the placeholder without regard to case, spaces as underscores. 2. The first of the search
    ``results`` (token, rank, module_name, instances, ports) with a fitting name: the module for modules and signals, else the first
    instance or port that contains it. 3. Any quoted name of a claim, hyphens as underscores too. Among claims the
    highest confidence counts, then the latest, then the smallest name. What has no name becomes a comment."""
    found = docs.select(F.col(key).alias("_k"), F.col(topic).alias("_t"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)))).alias("token"))
    found = found.select("_k", "_t", "token", F.regexp_extract("token", PLACEHOLDER, 1).alias("kind"), F.lower(F.regexp_extract("token", PLACEHOLDER, 2)).alias("part"))
    asked = found.select("_t", "token", "kind", "part").distinct()
    best = F.struct(F.col("confidence"), F.col("created_at"))
    said = claims.select(F.col(topic).alias("_t"), "statement", F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence"), F.coalesce("created_at", F.lit("")).alias("created_at"))

    def chosen(hits: DataFrame, name: str) -> DataFrame:
        """By token the smallest of the names that stand in the best claim."""
        of_name = hits.groupBy("_t", "token", "shown").agg(F.max(best).alias("top"))
        tops = of_name.groupBy("_t", "token").agg(F.max("top").alias("most"))
        return of_name.join(tops, ["_t", "token"]).where(F.col("top") == F.col("most")).groupBy("_t", "token").agg(F.min("shown").alias(name))

    by_kind = [said.select("_t", F.lit(kind).alias("kind"), F.regexp_extract("statement", pattern, 1).alias("shown"), "confidence", "created_at") for kind, pattern in NAMED.items()]
    own = reduce(DataFrame.unionByName, by_kind).where("shown <> ''").withColumn("name", F.replace(F.lower("shown"), F.lit(" "), F.lit("_")))
    first = chosen(containing(asked, own, ["_t", "kind"]), "name_1")
    any_name = said.select("_t", F.explode(F.array_distinct(F.regexp_extract_all("statement", F.lit(QUOTED), F.lit(1)))).alias("shown"), "confidence", "created_at")
    any_name = any_name.withColumn("name", F.translate(F.lower("shown"), " -", "__"))
    third = chosen(containing(asked, any_name, ["_t"]), "name_3")
    known = asked.join(first, ["_t", "token"], "left").join(third, ["_t", "token"], "left")
    if results is not None:
        fits = lambda c: F.get(F.filter(F.transform(c, lambda n: F.trim(n)), lambda n: F.contains(F.replace(F.lower(n), F.lit(" "), F.lit("_")), F.col("part"))), 0)
        hit = asked.select("token", "kind", "part").distinct().join(results, "token")
        module = F.when(F.col("module_name") != "", F.col("module_name"))
        hit = hit.withColumn("name", F.when(F.col("kind").isin("MODULE", "SIGNAL"), module).when(F.col("kind") == "INSTANCE", fits("instances")).otherwise(fits("ports"))).where("name is not null")
        known = known.join(hit.groupBy("token").agg(F.min_by("name", "rank").alias("name_2")), "token", "left")
    else:
        known = known.withColumn("name_2", F.lit(None).cast("string"))
    names = found.join(known.select("_t", "token", F.coalesce("name_1", "name_2", "name_3").alias("name")), ["_t", "token"], "left")
    per = names.groupBy("_k", "_t").agg(F.array_sort(F.collect_list(F.struct("token", "name"))).alias("_names"))
    out = docs.join(per, docs[key].eqNullSafe(per["_k"]) & docs[topic].eqNullSafe(per["_t"]), "left")
    comment = lambda x: F.replace(F.lit(UNRESOLVED), F.lit("%s"), x["token"])
    none = F.array().cast(per.schema["_names"].dataType)
    done = F.aggregate(F.coalesce("_names", none), F.col(text), lambda acc, x: F.replace(acc, x["token"], F.coalesce(x["name"], comment(x))))
    return out.select(docs[key], done.alias(text), F.transform(F.filter(F.coalesce("_names", none), lambda x: x["name"].isNull()), lambda x: x["token"]).alias("unresolved"))


def scrub(docs: DataFrame, east: int = 3, west: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """In paragraphs marked [FROM LLM], a sentence whose coordinates contradict its side loses them."""
    pair = re.compile(r"\(\s*(\d+)\s*,\s*(\d+)\s*\)")

    def clean(t: str) -> str:
        out = []
        for par in t.split("\n\n"):
            if "[FROM LLM]" in par:
                parts = re.split(r"(?<=[.!?])(\s+)", par)
                for i in range(0, len(parts), 2):
                    side = east if re.search(r"\beast\b", parts[i], re.I) else west if re.search(r"\bwest\b", parts[i], re.I) else None
                    if side is not None and any(int(m[1]) != side for m in pair.finditer(parts[i])):
                        parts[i] = pair.sub("", parts[i])
                par = "".join(parts)
            out.append(par)
        return "\n\n".join(out)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else clean(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "doc_id long, text string")
