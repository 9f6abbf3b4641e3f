"""Question to verified answer, as one plan: topics, claims, evidence, flags, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.claims import latest, publishable


def verified_answer(questions: DataFrame, claims: DataFrame, most_topics: int = 3) -> DataFrame:
    """questions: (question_id, topics array); claims: versions with evidence array. By question: the number of
    claims and of distinct sources, whether any claim is in conflict, and whether to fall back."""
    t = questions.select("question_id", F.explode_outer(F.slice("topics", 1, most_topics)).alias("topic"))
    now = latest(claims)
    good = publishable(now).select("topic", "claim_id", F.explode_outer("evidence").alias("source"))
    bad = now.where("status = 'conflicted'").groupBy("topic").agg(F.count(F.lit(1)).alias("conflicts"))
    j = t.join(good, "topic", "left").join(bad, "topic", "left")
    out = j.groupBy("question_id").agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct("source").alias("sources"), (F.coalesce(F.max("conflicts"), F.lit(0)) > 0).alias("conflict"))
    return out.withColumn("fallback", F.col("claims") == 0)
