"""The change detector and the samplers on streams: the batch operators' step, with a state per job.

Rows of a job are put in order inside a micro-batch. Rows older than the last one handled are late: they are dropped and
counted in the state (a policy of this library; a batch has no late rows). Numbers of the state are JSON, its frames are binary
beside it, so pixels work as numbers do. With `idle_ms`, the state of a job that has had no rows for so long (by the clock) is
removed; should the job go on after that, it begins anew. Without it, states stay until the query ends.

The functions need the RocksDB state store and set it for the session where it still has Spark's default; queries read the
setting when they start, so it stays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillframe.operators.timeseries import Likeness, change_step, missing, sample_step
from quillframe.shipping import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DEFAULT_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FRAME = "binary frame"


def packed(state: Any) -> tuple[str, list[bytes]]:
    """A state as JSON and the binary values in it, which JSON names by their place."""
    frames: list[bytes] = []

    def plain(x: Any) -> Any:
        if isinstance(x, (bytes, bytearray)):
            frames.append(bytes(x))
            return {_FRAME: len(frames) - 1}
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(state)), frames


def unpacked(text: str, frames: list[bytes]) -> Any:
    return json.loads(text, object_hook=lambda x: bytes(frames[x[_FRAME]]) if _FRAME in x else x)


class _Fold(StatefulProcessor):
    """Keeps a state per job; step(state, row) -> (state, columns or None)."""

    def __init__(self, ts: str, order: str, idle_ms: int | None = None):
        self.ts, self.order, self.idle_ms = ts, order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string, frames array<binary>", *([self.idle_ms] if self.idle_ms else []))

    def step(self, state: dict | None, row: dict) -> tuple[dict, dict | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (the base class's names)
        held = unpacked(*self.state.get()) if self.state.exists() else {"state": None, "last": None, "late": 0}
        out = []
        for row in pd.concat(list(rows)).sort_values([self.ts, self.order]).to_dict("records"):
            at = int(row[self.ts])
            if held["last"] is not None and at < held["last"]:
                held["late"] += 1
                continue
            held["last"] = at
            held["state"], added = self.step(held["state"], row)
            if added is not None:
                out.append(row | added)
        self.state.update(packed(held))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _plain(frame):
    """As a state holds it."""
    return None if missing(frame) else bytes(frame) if isinstance(frame, (bytes, bytearray, memoryview)) else frame.tolist() if hasattr(frame, "tolist") else frame


class ChangeDetector(_Fold):
    def __init__(self, ts: str, order: str, frame: str, first: Likeness, second: Likeness | None, idle_ms: int | None = None):
        super().__init__(ts, order, idle_ms)
        self.frame, self.first, self.second = frame, first, second

    def step(self, state, row):
        new, score, changed = change_step(state, int(row[self.ts]), _plain(row[self.frame]), self.first, self.second)
        return new, {"score": score, "is_change": changed}


class AdaptiveSampler(_Fold):
    def __init__(self, ts: str, order: str, frame: str, interval: float, likeness: Likeness, idle_ms: int | None = None):
        super().__init__(ts, order, idle_ms)
        self.frame, self.interval, self.likeness = frame, interval, likeness

    def step(self, state, row):
        new, kept = sample_step(state, float(row[self.ts]), _plain(row[self.frame]), self.likeness, self.interval)
        return new, {} if kept else None


class GapSampler(_Fold):
    def __init__(self, ts: str, order: str, interval: int, idle_ms: int | None = None):
        super().__init__(ts, order, idle_ms)
        self.interval = interval

    def step(self, state, row):
        at = int(row[self.ts])
        if state is None or at - state["kept"] >= self.interval:
            return {"kept": at}, {}
        return state, None


def _run(df: DataFrame, job: str, processor: _Fold, added: str) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(PROVIDER, DEFAULT_STORE) == DEFAULT_STORE:
        spark.conf.set(PROVIDER, STATE_STORE)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + added
    return df.groupBy(job).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if processor.idle_ms else "None")


def detect_changes_stream(df: DataFrame, job: str, ts: str, frame: str, order: str, first: Likeness, second: Likeness | None = None, idle_ms: int | None = None) -> DataFrame:
    """Adds score and is_change to a stream of frames."""
    return _run(df, job, ChangeDetector(ts, order, frame, first, second, idle_ms), ", score double, is_change boolean")


def sample_adaptive_stream(df: DataFrame, job: str, ts: str, frame: str, order: str, interval: float, likeness: Likeness, idle_ms: int | None = None) -> DataFrame:
    """The frames of a stream that the adaptive sampler keeps."""
    return _run(df, job, AdaptiveSampler(ts, order, frame, interval, likeness, idle_ms), "")


def sample_gaps_stream(df: DataFrame, job: str, ts: str, interval: int, order: str, idle_ms: int | None = None) -> DataFrame:
    """The frames of a stream that are the first of their job or `interval` or more after the last kept one."""
    return _run(df, job, GapSampler(ts, order, interval, idle_ms), "")
