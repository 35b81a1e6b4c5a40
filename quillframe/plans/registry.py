"""Registration of queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: a user is a job; value and props stand for scores, the event type for a section."""
    e = table(spark, sf_dir, "events")
    index = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("user_id").alias("job_id"), "event_id", index.alias("frame_index"), ms.alias("timestamp_ms"), F.col("event_type").alias("section"), "value", k.alias("k"))


#: The same in SQL.
FRAMES = """frames as (
    select user_id as job_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_index,
           epoch_us(ts) // 1000 as timestamp_ms, event_type as section, value, cast(json_extract_string(props, '$.k') as int) as k
    from events)"""
