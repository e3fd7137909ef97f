"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage calls one operator of ``quill.llm`` on all that its predecessor kept:

1. quality rules: rejected documents go;
2. line dedup: repeated lines go from the texts, ``n_chars`` follows;
3. SimHash near-dedup: of each component the row with the smallest doc_id stays;
4. mixing: documents are repeated or left out to meet the target weights;
5. SentencePiece: ids and digests of every text.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm import common, lines, mixing, pieces, quality, queries, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs).filter("_q_judged.kept").drop("_q_judged")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; a null text stays null, and so does its ``n_chars``."""
    d = lines.dedup_rows(docs)
    if "n_chars" not in d.columns:
        return d
    return d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: that of the smallest doc_id (the smaller text hash on a tie)."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mixture takes it."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of every row."""
    return pieces.encode_table(docs, queries.piece_model(), with_ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``; each stage's result is a table in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


# The fingerprints' hash is not in DuckDB; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None
