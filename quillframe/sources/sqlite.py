"""Tables of SQLite files as a Spark source: columns and filters are pushed into the query, partitions are ranges of row ids."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from quillframe.shipping import ship

#: Declared types by the part of their names that decides, as SQLite does.
AFFINITY = [("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double")]
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _kind(declared: str | None) -> str | None:
    """The Spark type of a declared one; none where SQLite may hold values of several kinds (they are read as strings and not compared there)."""
    return next((t for part, t in AFFINITY if part in (declared or "").upper()), None)


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.parts, self.schema = options["path"], options["table"], int(options.get("partitions", "8")), schema
        self.where: list[tuple[str, list[Any]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  (the base class's name)
        """Takes what SQLite compares as Spark does: values of a column's own type. The rest goes back to Spark."""
        with opened(self.path) as db:
            kinds = {name: _kind(kind) for _, name, kind, *_ in db.execute(f"pragma table_info({quoted(self.table)})")}
        for f in filters:
            at = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            own = {"bigint": int, "double": (int, float), "string": str}.get(kinds.get(at) or "")
            if type(f) in COMPARED and own and isinstance(f.value, own) and not isinstance(f.value, bool):
                self.where.append((f"{quoted(at)} {COMPARED[type(f)]} ?", [f.value]))
            elif isinstance(f, In) and own and f.value and all(isinstance(v, own) and not isinstance(v, bool) for v in f.value):
                self.where.append((f"{quoted(at)} in ({', '.join('?' * len(f.value))})", list(f.value)))
            elif isinstance(f, (IsNull, IsNotNull)) and at in kinds:
                self.where.append((f"{quoted(at)} is {'not ' if isinstance(f, IsNotNull) else ''}null", []))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with opened(self.path) as db:
            first, last = db.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        if first is None:
            return [_Rows(0, -1)]
        step = -(-(last - first + 1) // self.parts)
        return [_Rows(at, min(at + step - 1, last)) for at in range(first, last + 1, step)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        columns = ", ".join(quoted(f.name) for f in self.schema.fields)
        where = " and ".join(["rowid between ? and ?", *(w for w, _ in self.where)])
        makers = [{"bigint": int, "double": float, "binary": bytes, "string": str}[f.dataType.simpleString()] for f in self.schema.fields]
        db = opened(self.path)
        try:
            for row in db.execute(f"select {columns} from {quoted(self.table)} where {where}", [partition.first, partition.last, *(v for _, vs in self.where for v in vs)]):
                yield tuple(None if v is None else make(v) for v, make in zip(row, makers))
        finally:
            db.close()


class SqliteSource(DataSource):
    """spark.read.format("sqlite") with path and table (and partitions): a table with row ids in a file that all machines see."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with opened(self.options["path"]) as db:
            columns = db.execute(f"pragma table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{name}` {_kind(kind) or 'string'}" for _, name, kind, *_ in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def table(spark: SparkSession, path: str, name: str, partitions: int = 8) -> DataFrame:
    """A table of a SQLite file. Values that don't suit their column's declared type are converted, or raise."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", name).option("partitions", partitions).load()
