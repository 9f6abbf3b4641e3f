"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import documents


def op1_quality_classifier(spark, sf_dir):
    from .quality import quality

    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_substring_dedup(spark, sf_dir):
    from .substring_dedup import substring_dedup

    kept = substring_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_lm_scores(spark, sf_dir):
    from .lm import lm_scores

    return lm_scores(documents(spark, sf_dir))


def op4_mixing(spark, sf_dir):
    from .mixing import mix

    return mix(documents(spark, sf_dir))


def op5_private_data(spark, sf_dir):
    from .private import find_private

    return find_private(documents(spark, sf_dir))


def op6_language_id(spark, sf_dir):
    from .language_id import language_id

    return language_id(documents(spark, sf_dir))


def op7_ngram_join(spark, sf_dir):
    from .ngram_join import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op8_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op9_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from .byte_bpe import bpe, digests

    return digests(bpe(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op10_order_minhash(spark, sf_dir):
    from .order_minhash import order_minhash

    return order_minhash(documents(spark, sf_dir))


def _embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_itq(spark, sf_dir):
    from .itq import near_vectors

    return near_vectors(_embeddings(spark, sf_dir))


def op12_whitening(spark, sf_dir):
    from .whitening import whiten

    return whiten(_embeddings(spark, sf_dir))


def op13_hard_negatives(spark, sf_dir):
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_embeddings(spark, sf_dir), label=label, anchors=F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from .exact_dedup import ORACLE as exact
    from .hard_negatives import ORACLE as negatives
    from .mixing import oracle as mixing

    return {"op4_mixing": mixing(), "op8_exact_dedup": exact, "op13_hard_negatives": negatives}
