"""The corpus pipeline: documents through five operators, each stage's result written as Parquet and read by the next.

quality rules drop junk; SimHash near-dedup keeps one document of each group; secret scans mask secrets; mixing emits each
document as often as its source's rate says; byte-level BPE encodes what is left and decodes it again. Each stage learns, where it does, from its own
input and the labels. Stages take and return DataFrames; the columns of documents, and any others, pass through all but the last.

Edge cases are those of the operators, named stage by stage below. In all of them an empty table stays empty, very long texts are
whole, and further columns of docs pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import bpe, common, mixing, quality, secrets, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the fixed rules or the learnt decision list reject. Null, empty and short texts (fewer than 10 words)
    fail the fixed rules; repeated rows are each judged, and alike; rows with a null doc_id are judged but not learnt from; without
    labels of both kinds only the fixed rules count; ties between conditions go to the first statistic and lowest threshold."""
    return quality.filtered(docs, quality.learn(docs, common.labels(spark, sf_dir)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of docs for each near-duplicate group: texts whose five-word shingles are alike by 0.8 or more, found by fingerprints
    of their word pairs. The least doc_id stays (null last; ties: the least hash of the text); of repeated rows one; null and empty
    texts, which the stage before leaves none of, are one group."""
    return simhash.representatives(docs, shingle=2, bits=7, check=(5, 0.8))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the secrets in their texts masked. Null texts stay null, empty ones empty; overlapping spans are one mask; rows stay
    as they are otherwise, repeated ones too, whatever their doc_id."""
    return secrets.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each row as often as the mix takes it. A null source is a source of its own; texts without words are never taken if
    their source has none; rows equal in size class are taken in the order of a hash of id and text; repeated rows and rows with null
    or repeated doc_id are each a document."""
    return mixing.mix(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, their number, and the digest of the bytes decoded from them. Null and empty texts have no ids;
    rows stay as they came, repeated ones and those of a null doc_id too; equal ranks don't occur."""
    import public_tokenizers

    made = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: SQL can express neither the learnt rules nor XXH64, zstandard and BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = common.written(made, f"stage{k}") if k + 1 < len(STAGES) else made
    return docs
