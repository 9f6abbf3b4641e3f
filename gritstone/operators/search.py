"""Retrieval: filters, vector top-k, boost, de-duplication, shaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def must(df: DataFrame, **equal) -> DataFrame:
    """AND of the given equalities; blanks are off, none keeps all."""
    terms = [F.col(k) == v for k, v in equal.items() if v not in (None, "")]
    return df.where(reduce(lambda a, b: a & b, terms)) if terms else df


def should(df: DataFrame, words: str, fields: list[str]) -> DataFrame:
    """Any field contains the text, without regard to case."""
    return df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(words.lower())) for f in fields]))


def vector_topk(df: DataFrame, vector: Column, query: list[float], k: int, key: str) -> DataFrame:
    """K1, R2: cosine, descending, ties by key; Spark keeps k rows a task and merges those."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("score", F.round(T.cosine(F.transform(vector, lambda x: x.cast("double")), q), 6)).orderBy(F.desc("score"), key).limit(k)


def boost(df: DataFrame, flag: Column, key: str, weight: float = 2.0) -> DataFrame:
    """Flagged rows count double; ties go to flagged rows, then the first rank."""
    return df.withColumn("boosted", F.round(F.when(flag, F.col("score") * weight).otherwise(F.col("score")), 6)).withColumn("flagged", flag)


def first_by(df: DataFrame, fingerprint: list[str], order: list) -> DataFrame:
    """Of each fingerprint the first row in order stays."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*fingerprint).orderBy(*order))).where("_n = 1").drop("_n")


def same_metadata(df: DataFrame, **wanted) -> DataFrame:
    """equality without regard to case; None is off."""
    return reduce(lambda d, kv: d.where(F.lower(F.col(kv[0])) == kv[1].lower()) if kv[1] is not None else d, wanted.items(), df)


def shaped(df: DataFrame, order: list, cap: int = 20) -> DataFrame:
    """Complete citations only, best first, at most ``cap`` (the report's limit)."""
    return df.where(T.complete_citation(F.col("source_file"), F.col("doc_version"), F.col("page"), F.col("section"))).orderBy(*order).limit(cap)


def reply_state(df: DataFrame, filtered: bool) -> str:
    """R20."""
    return "ok" if not df.isEmpty() else "no_match" if filtered else "not_found"


def page_after(df: DataFrame, key: str, token, n: int) -> DataFrame:
    """K6: the next n rows after a key."""
    return (df.where(F.col(key) > token) if token is not None else df).orderBy(key).limit(n)
