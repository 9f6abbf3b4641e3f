"""The corpus pipeline: language ID, exact dedup, near-duplicate join, mixing, byte-level BPE.

Documents with null or repeated ids are rows like others, named by a key; null and blank texts go in the first stage,
very long ones are read whole, repeated rows leave one, ties fall to the smallest id. No documents give no rows.
Columns beyond those of documents are carried up to the last stage, which does not read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.common import documents, stored

#: In the metadata of the column that names a row from the first stage to the last but one; ids may be null or repeat.
#: The column takes a name that no other has; its values rise with the id, null last.
MARK = "gritstone_row"


def _key(docs: DataFrame) -> str | None:
    return next((f.name for f in docs.schema.fields if f.metadata.get(MARK)), None)


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with their key, written down, so that every later reading sees the same keys."""
    if _key(docs):
        return docs
    taken, name = {c.lower() for c in docs.columns}, "_row"
    while name in taken:
        name += "_"
    by = docs.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    return stored(by.withColumn(name, F.monotonically_increasing_id().alias(name, metadata={MARK: True})), "keyed")


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose key is the first column of ``keys``."""
    key = _key(docs)
    return docs.join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_semi").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter, no text) go."""
    from gritstone.llm.language_id import language_id

    docs = _keyed(docs)
    key = _key(docs)
    return _only(docs, language_id(docs, key=key).where("lang_pred <> 'und'").select(key))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from gritstone.llm.exact_dedup import exact_dedup

    docs = _keyed(docs)
    return _only(docs, exact_dedup(docs, doc_id=_key(docs)).where("kept").select("doc_id"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row of the smallest id stays."""
    from gritstone.llm.ngram_join import near_duplicates

    docs = _keyed(docs)
    return _only(docs, near_duplicates(docs, doc_id=_key(docs)).where("doc_id = component_id").select("doc_id"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample; what its documents count beyond being kept is in ``token_weight``."""
    from gritstone.llm.mixing import mix

    docs = _keyed(docs)
    key = _key(docs)
    kept = mix(docs, key=key).where("kept").select(key, "token_weight")
    return docs.drop("token_weight").join(kept, key)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text they decode to."""
    import public_tokenizers

    from gritstone.llm.byte_bpe import bpe

    carry = ("token_weight",) if "token_weight" in docs.columns else ()
    encoded = bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, carry=carry)
    digest = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    return encoded.select("doc_id", "n_tokens", "ids", *digest, *carry)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixing), ("byte_bpe", encode)]

#: Language ID and the byte-pair encoding are not SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
