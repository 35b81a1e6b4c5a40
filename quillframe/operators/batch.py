"""Functions over whole tables, row by row in Python, where one failing row must not end the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.shipping import ship


def batch_map(df: DataFrame, key: str, inputs: list[str], run: Callable[..., Any], kind: str) -> DataFrame:
    """(key, result, error): run(*inputs) of each row; where it raises, the result is null and the error says why.

    kind: the type of result. Rows go through in Arrow batches on all executors.
    """
    ship(df.sparkSession)
    schema = T.StructType([df.schema[key], T.StructField("result", T._parse_datatype_string(kind)), T.StructField("error", T.StringType())])

    def one(row: tuple) -> tuple[Any, str | None]:
        try:
            return run(*row), None
        except Exception as error:  # of one row only
            return None, f"{type(error).__name__}: {error}"[:500]

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [one(row) for row in b[inputs].itertuples(index=False, name=None)]
            yield pd.DataFrame({key: b[key], "result": pd.Series([o[0] for o in out], dtype=object, index=b.index), "error": pd.Series([o[1] for o in out], dtype=object, index=b.index)})

    return df.select(key, *[c for c in inputs if c != key]).mapInPandas(mapped, schema)


def batch_counts(done: DataFrame) -> DataFrame:
    """One row: how many rows of a batch_map succeeded and failed."""
    return done.agg(F.count_if(F.col("error").isNull()).alias("done"), F.count("error").alias("errors"))
