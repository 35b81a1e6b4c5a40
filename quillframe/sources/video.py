"""Recordings as a Spark source: a probe of files and a reader of frames, with the decoder as a plug-in.

A decoder is "module:function"; the function takes a path and returns an object with fps, frame_count, width, height, codec,
end_ms (the last position) and frames(), which yields (timestamp_ms, pixels) or raises. Executors import it where they run.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillframe.operators.batch import batch_map
from quillframe.shipping import ship

from .readers import VIDEO_BYTES, VIDEO_EXTENSIONS, duration_ms, file_error, files

FRAME = "path string, frame_index int, timestamp_ms bigint, width int, height int, pixels binary"
PROBE = "struct<fps:double,frame_count:double,width:int,height:int,codec:string,end_ms:double>"


def decoder(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def probe(spark: SparkSession, folder: str, decode: str) -> DataFrame:
    """path, size_mb, valid, error, duration_ms, fps, frame_count, width, height, codec of every file below a folder.

    Files with a wrong extension or size are not opened; one that can't be opened has an error and ends nothing.
    """
    listed = files(spark, folder).select("path", "length")
    checked = listed.withColumn("refused", file_error(F.col("path"), F.col("length"), VIDEO_EXTENSIONS, VIDEO_BYTES))

    def look(path: str) -> tuple:
        v = decoder(decode)(path)
        return float(v.fps), float(v.frame_count), int(v.width), int(v.height), str(v.codec), float(v.end_ms)

    told = batch_map(checked.filter("refused is null"), "path", ["path"], look, PROBE)
    met = checked.join(told, "path", "left")
    length = duration_ms(F.col("result.frame_count"), F.col("result.fps"), F.col("result.end_ms"))
    error = F.coalesce("refused", "error", F.when(length <= 0, "no length"))
    return met.select("path", (F.col("length") / 1048576).alias("size_mb"), error.isNull().alias("valid"), error.alias("error"), length.alias("duration_ms"), "result.fps", "result.frame_count", "result.width", "result.height", "result.codec")


class _Video(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _decoded(path: str, decode: str) -> Iterator[tuple]:
    v = decoder(decode)(path)
    for i, (at, pixels) in enumerate(v.frames()):
        yield path, i, int(at), int(v.width), int(v.height), bytes(pixels)


class _Frames(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.decode = options["paths"].split("\n"), options["decoder"]

    def partitions(self) -> list[InputPartition]:
        return [_Video(p) for p in self.paths]

    def read(self, partition: _Video) -> Iterator[tuple]:
        return _decoded(partition.path, self.decode)


class _Arriving(DataSourceStreamReader):
    """Recordings of a folder in order of their modification times (then names), which must not go back; they arrive whole, by a move. An offset is the last recording handled."""

    def __init__(self, options: dict):
        self.folder, self.decode = options["folder"], options["decoder"]

    def _listed(self) -> list[tuple[int, str]]:
        with os.scandir(self.folder) as entries:
            return sorted((e.stat().st_mtime_ns, e.name) for e in entries if e.is_file() and e.name.rsplit(".", 1)[-1].lower() in VIDEO_EXTENSIONS)

    def initialOffset(self) -> dict:  # noqa: N802  (the base class's names, here and below)
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        at, name = max(self._listed(), default=(-1, ""))
        return {"time": at, "name": name}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = (start["time"], start["name"]), (end["time"], end["name"])
        return [_Video(os.path.join(self.folder, x[1])) for x in self._listed() if after < x <= upto]

    def read(self, partition: _Video) -> Iterator[tuple]:
        return _decoded(partition.path, self.decode)


class FrameSource(DataSource):
    """spark.read.format("frames") for given recordings, spark.readStream for those that arrive in a folder: one partition per recording, its frames streamed in order."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> DataSourceReader:
        return _Frames(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Arriving(self.options)


def frames(spark: SparkSession, paths: list[str], decode: str) -> DataFrame:
    """Frames of recordings, every one; `timeseries.sample_adaptive` thins them out."""
    ship(spark)
    spark.dataSource.register(FrameSource)
    return spark.read.format("frames").option("paths", "\n".join(paths)).option("decoder", decode).load()


def arriving_frames(spark: SparkSession, folder: str, decode: str) -> DataFrame:
    """A stream of the frames of recordings as they arrive in a folder that all machines see."""
    ship(spark)
    spark.dataSource.register(FrameSource)
    return spark.readStream.format("frames").option("folder", folder).option("decoder", decode).load()
