"""From documents to packed training sequences, stage by stage.

Every stage reads a written table and returns one; the columns of `documents`
stay the same until the last stage, which returns token pieces with their
places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelens.llm import decontaminate, packing, pii, quality, simhash
from scorelens.session import settle

LEAST_QUALITY = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: those it holds likelier good than bad."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"), LEAST_QUALITY)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", not_in_benchmark),
    ("personal_data", redacted),
    ("packing", packed),
]

# Statistics, hashes and tokens of these stages are beyond SQL; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
