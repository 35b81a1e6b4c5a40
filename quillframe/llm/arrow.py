"""Columns computed in Arrow batches by functions over lists, for the operators that need a Python library or NumPy."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import give_back, ship

SLICE = 1 << 22  # characters, or items of a list, that are worked on at a time


def slices(sizes: list[int], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of about `limit` characters or ids; a longer row is a range of its own."""
    lo = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= limit:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def added(df: DataFrame, sources: list[str], columns: list[tuple[str, T.DataType, pa.DataType]], run: Callable, limit: int = SLICE) -> DataFrame:
    """df with columns computed from slices of the source columns by run(list, ...) -> one list per new column.

    The first source gives the sizes of the slices. A column of df that has the name of a new one, whatever its case, gives way to it.
    """
    ship(df.sparkSession)
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    at = [names.index(s) for s in sources]
    schema = T.StructType([*plain.schema.fields, *(T.StructField(f"added{i}", c[1]) for i, c in enumerate(columns))])
    kinds = [c[2] for c in columns]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at[0])
            sizes = (pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length)(column).fill_null(0).to_pylist()
            for lo, hi in slices(sizes, limit):
                part = b.slice(lo, hi - lo)
                new = [pa.array(x, kind) for x, kind in zip(run(*(part.column(i).to_pylist() for i in at)), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *(f"added{i}" for i in range(len(new)))])
        give_back()

    made = plain.mapInArrow(mapped, schema)
    gone = {c[0].lower() for c in columns}
    kept = [i for i, n in enumerate(names) if n.lower() not in gone]
    return made.select(*[f"c{i}" for i in kept], *[f"added{i}" for i in range(len(columns))]).toDF(*[names[i] for i in kept], *(c[0] for c in columns))


def present(rows: list, run: Callable[[list], list]) -> list:
    """run over the rows that aren't null."""
    gc.disable()  # no cycles are made here, and hundreds of thousands of short objects would keep the collector busy
    found = iter(run([x for x in rows if x is not None]))
    gc.enable()
    return [None if x is None else next(found) for x in rows]
