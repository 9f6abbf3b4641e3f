"""The document archive: listings, filtered search, answers with citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SOURCES

SLOW_MS = 30_000


def listing(objects: DataFrame, team: str = "", category: str = "", prefix: str = "documents/", most: int = 100) -> DataFrame:
    """(key, filename, team, category) of the first ``most`` keys under a prefix; folders count, but are not shown.
    A category without a team does not narrow the listing."""
    under = prefix + (f"{team}/" if team else "") + (f"{category}/" if team and category else "")
    page = objects.where(F.startswith("key", F.lit(under))).select("key").orderBy("key").limit(most).where(~F.endswith("key", F.lit("/")))
    parts = F.split(F.replace("key", F.lit(prefix), F.lit("")), "/", 3)
    whole = F.size(parts) >= 3
    part = lambda i: F.when(whole, parts[i]).otherwise("")
    return page.select("key", F.element_at(parts, -1).alias("filename"), part(0).alias("team"), part(1).alias("category"))


def search(hits: DataFrame, topic: str = "", source: str = "", most: int = 20) -> DataFrame:
    """The best hits of a topic and a source, either of which may be blank; an unknown source is an error."""
    if source and source not in SOURCES:
        raise ValueError(f"invalid source value: {source}. allowed: {sorted(SOURCES)}")
    for name, value in (("topic", topic), ("source", source)):
        if value:
            hits = hits.where(F.col(name) == value)
    return hits.orderBy(F.desc_nulls_last("score"), "uri").limit(most)


def index_status(reports: DataFrame) -> DataFrame:
    """index_version, last_updated_at, embedding_model of reports with any of the known names; blank is absent."""
    known = {"index_version": ["index_version", "version"], "last_updated_at": ["last_updated_at", "last_success_at", "updated_at"], "embedding_model": ["embedding_model", "model"]}

    def first(names: list[str], otherwise: Column) -> Column:
        return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names if n in reports.columns], otherwise)

    return reports.select(*[first(names, F.lit(None).cast("string") if n == "last_updated_at" else F.lit("unknown")).alias(n) for n, names in known.items()])


def answers(replies: DataFrame, key: str) -> DataFrame:
    """References of all citations of a reply, their number, and the two warnings, from (key, citations
    array<struct<text, references array<struct<uri, ...>>>>, response_time_ms)."""
    refs = F.flatten(F.transform("citations", lambda c: F.coalesce(c["references"], F.array())))
    n = F.coalesce(F.size(F.filter(refs, lambda r: r.isNotNull())), F.lit(0))
    n = F.greatest(n, F.lit(0)).cast("long")
    return replies.select(key, F.transform(refs, lambda r: r["uri"]).alias("uris"), n.alias("citation_count"), (n == 0).alias("no_citation"), F.coalesce(F.col("response_time_ms") > SLOW_MS, F.lit(False)).alias("slow"))


def extraction_outcome(files: DataFrame, status: str = "status") -> DataFrame:
    """How many files of an archive went in, were skipped, failed."""
    n = lambda s: F.count_if(F.col(status) == s)
    return files.agg(F.count(F.lit(1)).alias("total_files"), n("success").alias("success_count"), n("skipped").alias("skipped_count"), n("error").alias("error_count"))
