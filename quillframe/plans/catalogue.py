"""Every registered query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import scoring

from . import lookups, models, texts, timeline  # noqa: F401  (they register their queries)
from .registry import ORACLE, QUERIES, table

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance, rule class and report bucket of every document."""
    docs = table(spark, sf_dir, "documents")
    structure = F.regexp_count("text", F.lit(r"\|")) / F.greatest(F.char_length("text"), F.lit(1))
    rated = docs.select("doc_id", "source", scoring.keyword_relevance(F.col("text")).alias("relevance"), scoring.classify_by_rules(F.col("text"), structure).alias("c"))
    return rated.select("doc_id", "source", "relevance", "c.section_type", "c.confidence", scoring.report_bucket(F.col("c.section_type")).alias("bucket"))
