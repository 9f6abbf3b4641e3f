"""Search over an index of records from question to answer list, for a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search
from .providers import Embedder, embedded

# How many times the answers asked for are fetched, how much of a claim tells it apart.
OVER_FETCH, CLAIM_PREFIX = 3, 200


def fingerprint() -> Column:
    """What makes two records the same result, by kind."""
    kind = F.coalesce("analysis_type", F.lit(""))
    of = lambda name, *cs: F.concat_ws(":", F.lit(name), *[F.coalesce(c, F.lit("")) for c in cs])
    base = F.regexp_extract(F.coalesce("file_path", F.lit("")), r"([^/]*)$", 1)
    return (
        F.when(kind == "claim", of("claim", F.substring("claim_text", 1, CLAIM_PREFIX)))
        .when(kind == "hdd_section", of("hdd", "topic", "hdd_section_title"))
        .when(kind.isin("module_parse", "module_parse_chunk"), of("mp", "module_name", "analysis_type", "sub_record_type"))
        .when(kind == "signal_path_edge", of("spe", "edge_type", "src", "dst"))
        .otherwise(of("other", "module_name", base))
    )


def rtl_search(index: DataFrame, questions: list[str], make: Callable[[], Embedder], key: str, results: int = 20, **filters) -> DataFrame:
    """(question, query_type, rank, key, score, ...): questions are classified and embedded, the nearest records that
    pass the filters fetched three times over, those in use weighed double, results told apart by kind, the first
    ``results`` kept. ``index`` has ``embedding``, ``used_in_n1`` and the fields of :func:`fingerprint`.

    The questions are the caller's list; all of them meet each record where it lies, and a task passes on no more than
    the nearest of its own for each. Ties go to records in use, then to the smaller key. A blank question gives nothing."""
    asked = [q for q in questions if q and q.strip()]
    spark = index.sparkSession
    asks = spark.createDataFrame(list(enumerate(asked)), "n int, question string").withColumn("query_type", T.query_type(F.col("question"))).withColumn("vector", embedded(F.col("question"), make))
    vectors = {r.n: r.vector for r in asks.select("n", "vector").collect()}  # as many as the caller asked
    own = search.must(index, **filters)
    score = lambda v: F.round(T.cosine(F.transform("embedding", lambda x: x.cast("double")), F.array(*[F.lit(float(x)) for x in v])), 6)
    scores = F.array(*[F.struct(F.lit(n).alias("n"), score(v).alias("score")) for n, v in vectors.items() if v is not None])
    near = own.select("*", F.explode(scores).alias("x")).select(*own.columns, "x.n", "x.score").where("score is not null")
    fetched = Window.partitionBy("n").orderBy(F.desc("score"), key)
    near = near.withColumn("_rank", F.row_number().over(fetched)).where(F.col("_rank") <= OVER_FETCH * results)
    near = search.boost(near, F.coalesce("used_in_n1", F.lit(False)), key).withColumn("_same", fingerprint())
    order = [F.desc("boosted"), F.desc("flagged"), "_rank"]
    near = search.first_by(near, ["n", "_same"], order)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(*order))).where(F.col("rank") <= results)
    return near.join(asks.drop("vector"), "n").select("question", "query_type", "rank", key, F.col("boosted").alias("score"), *[c for c in own.columns if c not in (key, "embedding")])
