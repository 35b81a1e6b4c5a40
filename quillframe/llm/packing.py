"""Best-fit packing of documents into fixed-length sequences by linear grouping.

1. Every text is encoded where it lies and an end id is added; only what is longer than the context is cut, the first
   piece taking the remainder. The pieces (lengths and check sums, or ids on request) are written once.
2. Lengths are whole numbers up to the context, so one exact histogram (`context` rows at most) describes any corpus.
   The plan is made from it alone: large lengths are sorted, dealt into `groups` groups of equal cardinality and rounded
   up to the largest of their group; the linear program over configurations of these few sizes is solved by column
   generation; its whole part is used as it stands. Actual lengths take the places of the rounded ones, run by run,
   so equal bins are described once with a multiplicity. What is left of the large and all small lengths go, longest first,
   into the fullest bin that has room (best fit), again run by run.
3. A piece's rank among those of its length decides its place. Ranks come from counts per (length, salt), so a length
   that a third of all pieces share is numbered by many tasks; the plan, whose size depends on the context only, is broadcast.

Defined results: a null text counts as empty; an empty text is one piece that holds the end id. Null and repeated ids are
kept as rows of their own. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, ship
from .tokens import default_tokenizer, encoder

PIECES = "row bigint, doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, ids binary"


def _cut(path: str, context: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]

        def batch(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for b in batches:
            out, held = [], 0
            for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % context or context
                bounds = [0, *range(first, len(ids) + 1, context)]
                for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                    raw = ids[lo:hi].tobytes()
                    out.append((row, doc_id, i, lo, hi - lo, zlib.crc32(raw), raw if keep_ids else None))
                    held += len(raw) if keep_ids else 0
                if held > 16 << 20:
                    yield batch(out)
                    out, held = [], 0
            yield batch(out)
        give_back()

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, context: int = 2048, end: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_cut(tokenizer or default_tokenizer(), context, end, keep_ids), PIECES)


def dearest(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the highest price that fits: (price, count of each size). Round r allows r lengths; few large ones fit."""
    left = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits, value, picks = left >= 0, np.zeros(capacity + 1), []
    left = np.maximum(left, 0)
    for _ in range(capacity // int(sizes.min())):
        got = np.where(fits, value[left] + price[:, None], -1.0)
        best = got.argmax(axis=0)
        top = got[best, np.arange(capacity + 1)]
        better = top > value + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, best, -1))
        value = np.where(better, top, value)
    count, c = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[c] >= 0:
            count[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(value[capacity]), count


def configurations(sizes: list[int], demand: list[int], capacity: int, tolerance: float = 1e-4, steps: int = 3000) -> list[tuple[list[int], float]]:
    """Solves min sum(x) with sum(x * configuration) = demand by column generation; [(count of each size, x)]."""
    k, s, d = len(sizes), np.array(sizes), np.array(demand, dtype=float)
    columns = np.diag((capacity // s).astype(float))
    for _ in range(steps):
        x = np.linalg.solve(columns, d)
        price = np.linalg.solve(columns.T, np.ones(k))
        worth, new = dearest(s, price, capacity)
        if worth <= 1 + tolerance:
            break
        move = np.linalg.solve(columns, new)
        ratio = np.where(move > 1e-9, np.maximum(x, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = new
    x = np.linalg.solve(columns, d)
    return [([int(round(v)) for v in columns[:, j]], float(x[j])) for j in range(k) if x[j] > 1e-9]


def linear_groups(hist: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """[(rounded size, [[length, count], ...])]: equal cardinalities, largest first; groups of one size are merged."""
    total = sum(hist.values())
    each = -(-total // groups) if total else 1
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in sorted(hist, reverse=True):
        n = hist[length]
        while n:
            if not room:
                if out and out[-1][0] == length:
                    room = each
                else:
                    out.append((length, []))
                    room = each
            take = min(n, room)
            out[-1][1].append([length, take])
            n, room = n - take, room - take
    return out


def plan(hist: dict[int, int], capacity: int, groups: int = 64, small: int | None = None) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """([(length, first rank, end rank, first sequence, pieces per sequence, offset)], number of sequences)."""
    small = capacity // 4 if small is None else small
    rank: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[list[int]]] = defaultdict(list)  # free tokens -> [first sequence, sequences]
    free = np.zeros(capacity + 1, dtype=bool)
    used = 0

    def put(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        rows.append((length, rank[length], rank[length] + n, sequence, each, offset))
        rank[length] += n

    def leave(left: int, sequence: int, n: int) -> None:
        if left and n:
            room[left].append([sequence, n])
            free[left] = True

    if hist.get(capacity):
        put(capacity, hist[capacity], 0, 1, 0)
        used = hist[capacity]
    grouped = linear_groups({k: v for k, v in hist.items() if small < k < capacity and v}, groups)
    runs = [list(r) for _, r in grouped]
    if grouped:
        sizes, demand = [g[0] for g in grouped], [sum(n for _, n in g[1]) for g in grouped]
        for config, x in sorted(configurations(sizes, demand, capacity), reverse=True):
            todo, slots = int(x + 1e-6), [(g, n) for g, n in enumerate(config) if n]
            while todo and all(sum(n for _, n in runs[g]) >= a for g, a in slots):
                same = min(runs[g][0][1] // a for g, a in slots)
                times, offset = min(todo, max(same, 1)), 0
                for g, a in slots:
                    need = a
                    while need:
                        each = need if same else min(need, runs[g][0][1])
                        put(runs[g][0][0], each * times, used, each, offset)
                        offset += each * runs[g][0][0]
                        runs[g][0][1] -= each * times
                        need -= each
                        if not runs[g][0][1]:
                            runs[g].pop(0)
                leave(capacity - offset, used, times)
                used, todo = used + times, todo - times
    rest: dict[int, int] = defaultdict(int)
    for length, n in [*((k, v) for k, v in hist.items() if k <= small), *(x for r in runs for x in r)]:
        rest[length] += n
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            fits = np.flatnonzero(free[length:])
            if not len(fits):
                each = capacity // length
                times = max(n // each, 1)
                each = min(each, n)
                put(length, each * times, used, each, 0)
                leave(capacity - each * length, used, times)
                used, n = used + times, n - each * times
                continue
            left = length + int(fits[0])
            sequence, count = room[left].pop()
            free[left] = bool(room[left])
            each = min(left // length, n)
            times = min(count, n // each)
            put(length, each * times, sequence, each, capacity - left)
            leave(left - each * length, sequence, times)
            leave(left, sequence + times, count - times)
            n -= each * times
    return rows, used


def best_plan(hist: dict[int, int], capacity: int, groups: int = 64) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The shortest of the plans that call lengths over 1/8, 1/4, 1/3 and 1/2 of the context large.

    Rounding costs most where configurations hold many lengths; best fit needs small pieces to fill with. Which end
    wins depends on the corpus, and a plan costs a second or two on the driver, whatever the corpus.
    """
    least, best = -(-sum(k * v for k, v in hist.items()) // capacity), None
    for share in (8, 4, 3, 2):
        got = plan(hist, capacity, groups, capacity // share)
        best = got if best is None or got[1] < best[1] else best
        if best[1] == least:
            break
    return best


def pack(cut: DataFrame, context: int = 2048, groups: int = 64, salts: int = 64) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns row, piece and length; others are carried)."""
    spark, tmp = cut.sparkSession, Scratch(cut.sparkSession, "packing")
    cut = tmp.keep(cut.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)).cast("int")), "pieces")
    counts = tmp.keep(cut.groupBy("length", "salt").count(), "counts")
    hist = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # `context` rows at most
    rows, _ = best_plan(hist, context, groups)
    places = spark.createDataFrame(rows, "length int, first bigint, ended bigint, sequence bigint, each bigint, place bigint")
    before = counts.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("row", "piece")
    ranked = cut.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    met = ranked.join(F.broadcast(places), ["length"]).filter("rank >= first and rank < ended")
    at = F.col("rank") - F.col("first")
    return met.withColumns({"sequence_id": F.col("sequence") + F.expr("(rank - first) div each"), "offset": F.col("place") + (at % F.col("each")) * F.col("length")}).drop("salt", "rank", "before", "first", "ended", "sequence", "each", "place")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (pieces cut with keep_ids): sequence_id, length, ids (little-endian uint32), pieces.

    A group never holds more than one context of tokens.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    done = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return done.select("sequence_id", (F.octet_length(joined) / 4).cast("int").alias("length"), joined.alias("ids"), F.transform("parts", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("pieces"))
