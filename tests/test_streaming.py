"""The stream gives what the batch gives."""

import os
import time

from quillframe.operators import timeseries
from quillframe.sources import video
from quillframe.streaming import changes

SCHEMA = "job string, ts bigint, value double, ord bigint"


def rows():
    return [(f"j{i % 3}", i * 700, float(i * i % 290), i) for i in range(90)]


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_changes(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    got = run(spark, changes.detect_changes_stream(stream, "job", "ts", "value", "ord", timeseries.scalar_likeness(300.0), timeseries.scalar_likeness(400.0)), tmp_path, "changes_out")
    batch = timeseries.detect_changes(spark.read.parquet(source), "job", "ts", "value", "ord", timeseries.scalar_likeness(300.0), timeseries.scalar_likeness(400.0))
    columns = ["job", "ord", "score", "is_change"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))


def test_adaptive_sampler(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    got = run(spark, changes.sample_adaptive_stream(stream, "job", "ts", "value", "ord", 3000, timeseries.scalar_likeness(300.0)), tmp_path, "adaptive_out")
    batch = timeseries.sample_adaptive(spark.read.parquet(source), "job", "ts", "value", "ord", 3000, timeseries.scalar_likeness(300.0))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and 3 < batch.count() <= 45


def test_sampler_over_batches_and_late_rows(spark, tmp_path):
    source = str(tmp_path / "in2")
    parts = [[("j", 0, 0.0, 0), ("j", 900, 0.0, 1)], [("j", 1000, 0.0, 2), ("j", 500, 0.0, 3)], [("j", 2500, 0.0, 4)]]
    os.makedirs(source)
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = changes.sample_gaps_stream(spark.readStream.schema(SCHEMA).parquet(source), "job", "ts", 1000, "ord")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    # 500 comes after 900 and 1000 were handled and is dropped; 2500 is over 1000 after the last kept frame.
    assert sorted(r.ts for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1000, 2500]


STILLS = """
import struct

import numpy as np

BASES = [np.random.default_rng(7).integers(0, 256, (24, 32)).astype(np.uint8), np.tile(np.arange(0, 256, 8, dtype=np.uint8), (24, 1))]


class Still:
    fps, width, height, codec, end_ms = 2.0, 32, 24, "raw", 0.0

    def __init__(self, path):
        self.kinds = open(path, "rb").read()
        self.frame_count = len(self.kinds)

    def frames(self):
        for i, kind in enumerate(self.kinds):
            image = BASES[kind % 2].copy()
            image[: kind // 2] = 0
            yield i * 500, image.tobytes()


def opened(path):
    return Still(path)
"""


def test_recordings_arrive_and_pixels_are_compared(spark, tmp_path):
    """Recordings that arrive in a folder in two batches go through the sampler and the two-pass detector as in a batch."""
    def still(raw):
        from quillframe.functions import kernels

        return kernels.image(bytes(raw), 24, 32, 1)

    def first(a, b):
        from quillframe.functions import kernels

        return kernels.hash_likeness(still(a), still(b))

    def second(a, b):
        import numpy as np

        from quillframe.functions import kernels

        return kernels.precise_likeness(*(np.repeat(still(x)[:, :, None], 3, axis=2) for x in (a, b)))

    (tmp_path / "still_decoder.py").write_text(STILLS)
    spark.sparkContext.addPyFile(str(tmp_path / "still_decoder.py"))
    folder, staged = tmp_path / "clips", [("a.mp4", [0, 0, 2, 1, 1, 1, 5, 0, 0, 30, 0, 0]), ("b.mov", [1, 1, 1, 1, 7, 7, 0, 1]), ("c.webm", [0, 1] * 6)]
    folder.mkdir()

    def pour(kind, n):
        frames = video.arriving_frames(spark, str(folder), "still_decoder:opened").select("path", "timestamp_ms", "pixels", "frame_index")
        if kind == "changes":
            out = changes.detect_changes_stream(frames, "path", "timestamp_ms", "pixels", "frame_index", first, second, idle_ms=3_600_000).drop("pixels")
        else:
            out = changes.sample_adaptive_stream(frames, "path", "timestamp_ms", "pixels", "frame_index", 2000, first).drop("pixels")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / f"{kind}_out")).option("checkpointLocation", str(tmp_path / f"{kind}_check")).start()
        until = time.monotonic() + 90
        while time.monotonic() < until and q.isActive and not any(p["numInputRows"] for p in q.recentProgress):
            time.sleep(0.5)
        q.stop()

    for n, (name, kinds) in enumerate(staged):
        (folder / f"{name}.tmp").write_bytes(bytes(kinds))
        os.rename(folder / f"{name}.tmp", folder / name)
        if n != 1:  # the second and third arrive together
            pour("changes", n)
            pour("sampled", n)
    read = video.frames(spark, [str(folder / name) for name, _ in staged], "still_decoder:opened")
    batch = timeseries.detect_changes(read, "path", "timestamp_ms", "pixels", "frame_index", first, second)
    columns = ["path", "frame_index", "score", "is_change"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "changes_out")).select(*columns).collect()))
    assert got == sorted(map(tuple, batch.select(*columns).collect())) and len(got) == 32 and 5 < sum(r[3] for r in got) < 20
    kept = timeseries.sample_adaptive(read, "path", "timestamp_ms", "pixels", "frame_index", 2000, first)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "sampled_out")).select("path", "frame_index").collect()))
    assert got == sorted(map(tuple, kept.select("path", "frame_index").collect())) and got


def test_states_keep_bytes():
    state = {"state": {"frame": b"\x00\xff", "recent": [0.5], "more": [b"x", {"y": b""}]}, "last": 3}
    assert changes.unpacked(*changes.packed(state)) == state and changes.unpacked(*changes.packed(None)) is None
