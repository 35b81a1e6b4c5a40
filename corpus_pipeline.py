"""The corpus pipeline: language ID, exact dedup, near dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) with docs read from Parquet and returns a DataFrame; all but the last return the
columns of documents. What a stage drops or changes is final for the later ones.

Empty tables pass through every stage; null and empty texts, which have no language, go in the first one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import exact_dedup, language_id, packing, secret_scan, simhash_dedup
from quillframe.llm.common import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those of which no learned language explains a fifth of the n-grams."""
    return language_id.keep_known(docs, language_id.learn(docs), least_score=0.2)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that are equal but for white space."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that share at least 80 % of their five-word shingles."""
    return simhash_dedup.keep_one(docs, shingle=5, similarity=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row; secrets in texts are replaced by a mask."""
    language = secret_scan.learn_words(docs)
    return secret_scan.redact(docs, secret_scan.train(secret_scan.synthetic_findings(spark, language=language), language))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs, context=2048, end=0), context=2048).drop("row", "ids")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

ORACLE_SQL = None  # a random forest and a packing plan are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tmp, before = Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = tmp.keep(stage(spark, docs, sf_dir), name)
        if before:
            tmp.drop(before)  # nothing reads it any more
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
