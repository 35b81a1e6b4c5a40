"""Rows dealt to all cores before work that costs far more than reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows, evenly over the cluster, those with equal values of the columns `by` together: a file of short rows is one split or a few by its bytes, however long the work on each row takes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *by)
