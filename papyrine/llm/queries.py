"""The registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, lm, media, mixing, quality, secrets, simhash, token_counts, toxicity
from .common import documents, labels


def _hex(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text stored as PNG and read back, with the hash of its low frequencies."""
    made = media.store_media(documents(spark, sf_dir))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), "media_sha256", F.lower(F.hex("perceptual")).alias("feature"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts and digest of the exact patterns, and all spans."""
    return secrets.scan(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by a lexicon learnt from labels."""
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, labels(spark, sf_dir)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, the fixed rules and the learnt decision list."""
    docs = documents(spark, sf_dir)
    return quality.judged(docs, quality.learn(docs, labels(spark, sf_dir)))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the bytes decoded from them."""
    import public_tokenizers

    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix to target weights takes of every document."""
    return mixing.taken(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by a byte network trained on labelled texts."""
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.learn(docs))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, and whether they exceed 2048."""
    import public_tokenizers

    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and neural log10 probability of every text."""
    return lm.score(documents(spark, sf_dir))


#: Where there is no SQL (PNG, zstandard, XXH64, tokenisers, trained models), the query is tested against brute force.
QUERIES = {
    f.__name__: f
    for f in (op1_media_columns, op2_secret_scans, op3_toxicity, op4_quality_rules, op5_simhash_near_dedup, op6_byte_level_bpe, op7_mixing_sources, op8_language_id, op9_token_counts, op10_lm_scoring)
} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"op7_mixing_sources": mixing.ORACLE}
