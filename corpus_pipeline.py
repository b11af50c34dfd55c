"""A corpus pipeline over ``documents``: five stages, each an operator on all that the one before
kept. Every stage but the last returns the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm import jaccard, mixing, packing, quality, secrets
from voxelmill.llm._shared import fresh, numbered, settle, small_side, table

#: Near-duplicates share 4/5 of their five-word shingles (exact Jaccard similarity).
SHINGLE_WORDS, SIMILAR = 5, (4, 5)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more."""
    model, score = quality.train(docs, table(spark, sf_dir, "labels")), fresh("score", docs.columns)
    scored = quality.score_documents(docs, model, keep=tuple(docs.columns), name=score)
    return scored.filter(F.col(score) >= 0.7).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id, nulls last.
    Of rows that repeat, one stays."""
    row, gone = (fresh(n, docs.columns) for n in ("_row", "_gone"))
    rows = numbered(docs, row)
    others = jaccard.others(rows.select("doc_id", "text", F.col(row).alias("row")), row="row", first="doc_id", words=SHINGLE_WORDS, least=SIMILAR)
    others = small_side(settle(others.select(F.col("row").alias(gone)), "others"))
    return rows.join(others, F.col(row) == F.col(gone), "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; the values of live-looking secrets are masked."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered shares of sources, languages and topics; those of scarce cells
    may stay more than once, so that the shares are attained."""
    return mixing.sample(docs, repeat=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4,096 tokens."""
    pieces = packing.pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality_filter), ("near duplicates", near_duplicates), ("secret scan", secret_scan), ("mixing", mix), ("packing", pack)]
#: The classifier, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
