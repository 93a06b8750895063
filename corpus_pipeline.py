"""A pipeline of five training-data operators over documents.

Quality classifier, exact deduplication, near-deduplication, mixing of sources, byte-level BPE: each stage takes what
its predecessor kept, and all but the last return the columns of documents. Null and empty texts go in the first stage,
as they have no word. In the fourth a document appears as often as the mix takes it, up to twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import bpe, exact_dedup, minhash, mixing, quality
from lexmill.llm.common import remove, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer, trained on posteriors of weak labels, doesn't reject."""
    return quality.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the least id."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles the one with the least id."""
    return minhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.repeat_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded bytes of each document."""
    return bpe.bpe(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", without_copies),
    ("minhash_near_dedup", without_near_copies),
    ("source_mixing", mixed_sources),
    ("byte_bpe", encoded),
]

#: No SQL: a trained scorer decides in the first stage, and MinHash groups in the third need a transitive closure.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage returns is written to the shared folder, and gone once the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
