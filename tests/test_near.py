"""Near-duplicate frames by indexes against all pairs and the fold over a job."""

import random

import pytest
from pyspark.sql import functions as F

from quillframe.operators import near, timeseries


def like(a, b):
    return round(1 - ((a ^ b) & (1 << 64) - 1).bit_count() / 64, 4)


def frames(rng, n, jobs, flips):
    """Hashes around a few centres."""
    centres, rows = [rng.getrandbits(64) for _ in range(12)], []
    for i in range(n):
        h = rng.choice(centres)
        for _ in range(rng.randint(0, flips)):
            h ^= 1 << rng.randrange(64)
        rows.append((f"j{rng.randrange(jobs)}", float(rng.randrange(20)), i, None if rng.random() < 0.03 else h - (1 << 64) if h >> 63 else h))
    return rows


SCHEMA = "job string, score double, ord int, hash bigint"


@pytest.mark.parametrize("least, flips", [(0.92, 8), (0.97, 3), (0.62, 20), (1.0, 1), (1.1, 1)])
def test_distinct_frames_are_the_folds(spark, least, flips):
    rows = frames(random.Random(int(least * 100)), 600, 2, flips)
    want = set()
    for job in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == job), key=lambda r: (-r[1], r[2])):
            if r[3] is None or all(k is None or like(k, r[3]) < least for k in kept):
                kept.append(r[3])
                want.add((job, r[2]))
    got = near.distinct_frames(spark.createDataFrame(rows, SCHEMA), "job", "score", "ord", "hash", least).collect()
    assert {(r.job, r.ord) for r in got} == want and len(got) == len(want)


def test_a_chain_takes_rounds(spark):
    """Each hash is near the next only, each worse than the one before: every second one stays."""
    rows = [("j", float(-i), i, (1 << 6 * i) - 1 if i < 10 else -1) for i in range(11)]
    got = near.distinct_frames(spark.createDataFrame(rows, SCHEMA), "job", "score", "ord", "hash", 0.9)
    assert sorted(r.ord for r in got.collect()) == [0, 2, 4, 6, 8, 10]


def test_masks_find_every_pair():
    rng = random.Random(2)
    for radius in (1, 2, 3, 5):
        masks = near.block_masks(radius)
        assert masks and len(masks) <= near.TABLES
        for _ in range(300):
            d = sum(1 << i for i in rng.sample(range(64), rng.randint(1, radius)))
            assert any(d & m == 0 for m in masks)
    assert near.block_masks(24) == [] and near.radius_of(0.92, 64) == 5


@pytest.mark.parametrize("above, flips", [(0.9, 8), (0.6, 24), (1.0, 1)])
def test_redundant_hashes(spark, above, flips):
    rows = frames(random.Random(8), 400, 2, flips)
    want = {(r[0], r[2]): r[3] is not None and any(e[0] == r[0] and e[2] < r[2] and e[3] is not None and like(e[3], r[3]) > above for e in rows) for r in rows}
    got = near.redundant_hashes(spark.createDataFrame(rows, SCHEMA), "job", "ord", "hash", above).collect()
    assert {(r.job, r.ord): r.redundant for r in got} == want and len(got) == len(rows)


def test_redundant_values(spark):
    rng = random.Random(3)
    rows = [(f"j{i % 2}", i, None if i % 50 == 7 else rng.choice([round(rng.random(), 3), i * 0.05, -0.001 * i])) for i in range(400)]
    df = spark.createDataFrame(rows, "job string, ord int, v double")
    for above in (0.995, 0.9):
        want = {r[1]: r[2] is not None and any(e[0] == r[0] and e[1] < r[1] and e[2] is not None and 1 - abs(e[2] - r[2]) > above for e in rows) for r in rows}
        got = near.redundant_values(df, "job", "ord", "v", above).collect()
        assert {r.ord: r.redundant for r in got} == want and len(got) == len(rows)
        pairs = timeseries.redundant_with_earlier(df.filter("v is not null"), "job", "ord", lambda a, b: 1 - F.abs(a["v"] - b["v"]), above)
        assert {r.ord for r in pairs.filter("redundant").collect()} == {o for o, r in want.items() if r}


def test_without_an_index_no_job_meets_itself(spark, monkeypatch):
    """A radius that no index serves: heads of the ranking are decided round by round, with no table of pairs."""
    rows = frames(random.Random(5), 500, 3, 30) + [(None, 1.0, 1000 + i, i * 3) for i in range(5)]
    want = set()
    for job in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == job), key=lambda r: (-r[1], r[2])):
            if r[3] is None or all(k is None or like(k, r[3]) < 0.62 for k in kept):
                kept.append(r[3])
                if job is not None:
                    want.add((job, r[2]))
    monkeypatch.setattr(near, "near_pairs", lambda *a: pytest.fail("pairs of a whole job"))
    monkeypatch.setattr(near, "HEAD", 7)
    got = near.distinct_frames(spark.createDataFrame(rows, SCHEMA), "job", "score", "ord", "hash", 0.62).collect()
    assert {(r.job, r.ord) for r in got} == want and len(got) == len(want)
