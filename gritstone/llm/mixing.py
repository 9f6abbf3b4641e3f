"""Mixing sources to target weights by iterative proportional fitting (operator 4).

Tokens are summed by cell (source, language, topic). Each sweep scales the cells so that the token totals of one
dimension after another meet their target shares; targets are the shares raised to a power below 1 (a temperature),
or given. The result is a weight for each cell: over-represented cells (weight below 1) are sampled with that
probability, others are kept and carry the weight that is left, so expected weighted totals meet the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored

#: Topic by the first sign found in a text.
TOPIC_SIGNS = [("mail", "@"), ("table", "|"), ("code", "="), ("shout", "!!"), ("question", "?"), ("numbers", "+")]
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
SWEEPS = 5


def topic_of(text: Column) -> Column:
    c = F.lit("prose")
    for name, sign in reversed(TOPIC_SIGNS):
        c = F.when(F.contains(text, F.lit(sign)), F.lit(name)).otherwise(c)
    return c


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target tokens by value of one dimension: shares to a power, on the same total. Values without tokens have none."""
    by = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    total = by.agg(F.sum("t").alias("all"), F.sum(F.pow("t", F.lit(power))).alias("norm"))
    return by.crossJoin(F.broadcast(total)).select(dim, (F.col("all") * F.pow("t", F.lit(power)) / F.col("norm")).alias("goal"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """cells (dimensions..., tokens) with the column ``weight`` after so many sweeps over the targets (dim, goal).
    Sums are pre-aggregated by the shuffle's map side; each sweep is stored, which keeps plans short."""
    now = cells.withColumn("weight", F.lit(1.0))
    for _ in range(sweeps):
        for dim, goal in targets.items():
            factor = now.groupBy(dim).agg(F.sum(F.col("weight") * F.col("tokens")).alias("have")).join(goal, dim).select(dim, F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(1.0).alias("factor"))
            now = now.join(factor, dim, "left").select(*cells.columns, (F.col("weight") * F.coalesce("factor", F.lit(1.0))).alias("weight"))
        now = stored(now, "rake")
    return now


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, powers: dict[str, float] = POWERS, key: str | None = None) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, tokens, weight, probability, kept, token_weight.

    Null sources and languages are a value of their own (''); null texts hold no token and are always kept, as are
    cells without tokens (weight 1). The draw is a hash of the id, so reruns agree and repeated ids share a fate.
    Only cells are shuffled; documents meet their weight in a join on the cell, which Spark may split if skewed.
    ``key``, a column that names rows, is carried."""
    own = [key] if key else []
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        topic_of(text).alias("topic"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        *own,
    )
    rows = stored(rows, "mix")
    dims = ["source", "lang", "topic"]
    cells = stored(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    targets = targets or {d: stored(tempered(cells, d, powers[d]), "goal") for d in dims}
    weights = rake(cells, targets, sweeps).drop("tokens")
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    p = F.least(F.lit(1.0), F.col("weight"))
    return rows.join(weights, dims).select("doc_id", *dims, "tokens", F.round("weight", 6).alias("weight"), F.round(p, 6).alias("probability"), (draw < p).alias("kept"), F.round(F.greatest(F.lit(1.0), F.col("weight")), 6).alias("token_weight"), *own)


def oracle(sweeps: int = SWEEPS, powers: dict[str, float] = POWERS) -> str:
    topic = "CASE " + " ".join(f"WHEN contains(t, '{sign}') THEN '{name}'" for name, sign in TOPIC_SIGNS) + " ELSE 'prose' END"
    ctes = [
        "x AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents)",
        f"r AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM x)",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, 1.0::DOUBLE AS weight FROM r GROUP BY ALL)",
    ]
    for d, p in powers.items():
        ctes.append(f"b_{d} AS (SELECT {d}, sum(tokens) AS t FROM c0 GROUP BY 1 HAVING sum(tokens) > 0)")
        ctes.append(f"g_{d} AS MATERIALIZED (SELECT {d}, (SELECT sum(t) FROM b_{d}) * pow(t, {p}) / (SELECT sum(pow(t, {p})) FROM b_{d}) AS goal FROM b_{d})")
    k = 0
    for _ in range(sweeps):
        for d in powers:
            ctes.append(f"f{k} AS (SELECT {d}, goal / sum(weight * tokens) AS factor FROM c{k} JOIN g_{d} USING ({d}) GROUP BY {d}, goal HAVING sum(weight * tokens) > 0)")
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.source, c{k}.lang, c{k}.topic, tokens, weight * coalesce(factor, 1.0) AS weight FROM c{k} LEFT JOIN f{k} ON c{k}.{d} = f{k}.{d})")
            k += 1
    draw = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, source, lang, topic, r.tokens, round(weight, 6) AS weight, round(least(1.0, weight), 6) AS probability,
    {draw} < least(1.0, weight) AS kept, round(greatest(1.0, weight), 6) AS token_weight
FROM r JOIN c{k} USING (source, lang, topic)"""
