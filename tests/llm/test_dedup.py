"""Exact and near deduplication against brute force, with odd inputs."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quillframe.llm import components, exact_dedup, simhash_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, digest string"


def stored(spark, tmp_path, rows, name="docs"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows; columns named like the operator's own."""
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", "  ", "a b", "ab", "a\tb\n", "Ab", long, long + " ", "same", "same", "x" * 50_000]
    rows = [(i, t, "en", "s", 1, 7, "d") for i, t in enumerate(texts)]
    return [*rows, (None, "same", None, None, None, None, None), (10, "same", "en", "s", 1, 7, "d"), (None, None, None, None, None, None, None)]


def squeezed(t):
    return "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")


def test_exact_against_brute_force(spark, tmp_path):
    rows = odd_rows()
    got = exact_dedup.dedup(stored(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(squeezed(r[1]), []).append((r[0], r[1] or ""))
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        members = groups[key]
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        assert (r.keep_id, r.group_size) == (best[0], len(members))
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_first(stored(spark, tmp_path, rows, "again"))
    assert kept.count() == len(groups) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "digest"]


def test_exact_empty(spark, tmp_path):
    docs = stored(spark, tmp_path, [])
    assert exact_dedup.dedup(docs).collect() == [] and exact_dedup.keep_first(docs).collect() == []


def test_index_persists_over_batches(spark, tmp_path):
    path = "file://" + str(tmp_path / "index")
    first = exact_dedup.DigestIndex(spark, path, 4)
    a = spark.createDataFrame([(1, "x y"), (2, "xy"), (3, "z")], "doc_id bigint, text string")
    assert sum(r.kept for r in first.ingest(a, "monday").collect()) == 2
    spark.sql(f"drop table {first.table}")  # what a new session sees: files, no catalogue entry
    second = exact_dedup.DigestIndex(spark, path, 4)
    b = spark.createDataFrame([(9, " x y "), (10, "new"), (11, "new ")], "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in second.ingest(b, "tuesday").collect()}
    assert got == {9: (1, False, 3), 10: (11, False, 2), 11: (11, True, 2)}
    second.compact()
    assert second.read().count() == 3


def test_batches_are_told_apart_and_retried(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, "file://" + str(tmp_path / "index"), 4)
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id bigint, text string")
    told = lambda df: {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in df.collect()}
    assert told(index.ingest(rows((1, "x")))) == {1: (1, 1, True)}
    assert told(index.ingest(rows((9, "x")))) == {9: (1, 2, False)}  # no label: another batch
    batch = rows((20, "y"), (21, "y "), (22, "x"))
    first = told(index.ingest(batch, "tuesday"))
    assert first == {20: (21, 2, False), 21: (21, 2, True), 22: (1, 2, False)}
    assert told(index.ingest(batch, "tuesday")) == first and index.read().count() == 2  # a retry appends nothing
    with pytest.raises(ValueError, match="other rows"):
        index.ingest(rows((30, "z")), "tuesday")
    assert index.batches().count() == 3 and exact_dedup.DigestIndex(spark, index.path, 99).buckets == 4
    index.close()
    assert not spark.catalog.tableExists(index.table)


def test_a_retry_ends_what_a_failure_left(spark, tmp_path, monkeypatch):
    index = exact_dedup.DigestIndex(spark, "file://" + str(tmp_path / "index"), 4)
    batch = spark.createDataFrame([(1, "a"), (2, "a "), (3, None)], "doc_id bigint, text string")
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(index, "_append", lambda *x: (_ for _ in ()).throw(RuntimeError("executor lost")))
        index.ingest(batch, "b")
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.ingest(batch, "b").collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (3, True)} and index.read().count() == 2


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, simhash_dedup.keep_one])
def test_rows_keep_their_numbers_in_another_plan(spark, tmp_path, keep):
    """Many small files are packed into partitions in another way when the rows are read again; users' columns have likely names."""
    schema = "doc_id bigint, text string, _row bigint, row_number string, _metadata string"
    rows = [(i, f"text number {i % 120} of some words", i, "r", "m") for i in range(240)]
    spark.createDataFrame(rows, schema).repartition(24).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    plain = docs.drop("_metadata")
    for frame in (docs, plain, plain.filter("doc_id >= 0").union(plain.limit(0))) if keep is exact_dedup.keep_first else (plain,):
        spark.conf.set("spark.sql.files.minPartitionNum", "24")
        try:
            kept = keep(frame)
            spark.conf.set("spark.sql.files.minPartitionNum", "1")
            got = kept.collect()
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
        assert sorted(r.doc_id for r in got) == list(range(120)) and kept.columns == frame.columns
        assert all(r["_row"] == r.doc_id and r["row_number"] == "r" for r in got)


def fingerprint(text, k):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, radius):
    items = sorted(set(fps))
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if bin(a ^ b).count("1") <= radius:
                parent[find(a)] = find(b)
    return {x: find(x) for x in items}


def test_groups_against_brute_force(spark, tmp_path):
    r = random.Random(3)
    vocabulary = [f"Wört{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 8, 400]))]
        for _ in range(r.randint(1, 3)):
            rows.append((len(rows), " ".join(words), None, None, None, None, None))
            words = list(words)
            words[r.randrange(len(words))] = r.choice(vocabulary).upper()
    rows += [(len(rows) + i, t, None, None, None, None, None) for i, t in enumerate([None, "", "\n"])] + [(None, "lone text", None, None, None, None, None)]
    got = simhash_dedup.near_groups(stored(spark, tmp_path, rows), shingle=3).collect()
    fps = {row[0]: fingerprint(row[1], 3) for row in rows}
    root = roots(fps.values(), 2)
    least = {}
    for i, fp in fps.items():
        if i is not None:
            least[root[fp]] = min(i, least.get(root[fp], i))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp:016x}", least.get(root[fp])) for i, fp in fps.items()}


@pytest.mark.parametrize("radius", [1, 2])
@pytest.mark.parametrize("bucket", [2, 100])
def test_links_in_crowded_buckets(spark, radius, bucket):
    """Fingerprints that differ in few bits fill buckets; the star of a large one has the components of all its pairs."""
    r = random.Random(radius)
    fps = set()
    for base in (r.getrandbits(64) for _ in range(3)):
        for _ in range(60):
            x = base
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash_dedup.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), radius, bucket)
    found = {x.node: x.root for x in components.components(links).collect()}
    want = roots([x & (1 << 64) - 1 for x in signed], radius)
    groups = lambda pairs: {frozenset(k for k, v in pairs.items() if v == g) for g in set(pairs.values())}
    mine = {x: found.get(x, x) for x in signed}
    assert groups(mine) == groups({x: want[x & (1 << 64) - 1] for x in signed})


def test_groups_of_nothing(spark, tmp_path):
    assert simhash_dedup.near_groups(stored(spark, tmp_path, [])).collect() == []
    assert simhash_dedup.keep_one(stored(spark, tmp_path, [], "b")).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(40)}}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_go_and_others_stay(spark, tmp_path):
    r = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "tu", "ra") for b in ("na", "se", "di", "po", "ru", "xe", "vi")]
    rows, near = [], []
    for _ in range(40):
        words = [r.choice(vocabulary) + str(r.randint(0, 9)) for _ in range(r.choice([60, 150, 600]))]
        rows.append((len(rows), " ".join(words), "en", "s", 1, 1, "d"))
        copy = list(words)
        for _ in range(max(1, len(words) // 150)):
            copy[r.randrange(len(copy))] = "zz"
        near.append((len(rows) - 1, len(rows)))
        rows.append((len(rows), " ".join(copy), "en", "s", 1, 1, "d"))
    rows += [(len(rows), None, None, None, None, None, None), (len(rows) + 1, "", None, None, None, None, None), (None, "one two", None, None, None, None, None)]
    out = simhash_dedup.keep_one(stored(spark, tmp_path, rows))
    kept = {x.doc_id for x in out.collect()}
    text = {row[0]: row[1] for row in rows}
    alike = lambda a, b: len(shingles(text[a]) & shingles(text[b])) >= 0.8 * len(shingles(text[a]) | shingles(text[b]))
    due = [(a, b) for a, b in near if alike(a, b)]
    assert len(due) > 30 and sum(not (a in kept and b in kept) for a, b in due) >= 0.9 * len(due)
    assert all(a in kept or b in kept for a, b in near) and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "digest"]
    assert all((a in kept) and (b in kept) for a, b in near if not alike(a, b))
    assert out.filter(F.col("doc_id").isNull()).count() == 1


def kept_by_brute_force(rows):
    """The ids that stay: the smallest of each component of pairs that share 80 % of their shingles."""
    sets = [shingles(row[1]) for row in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, row in enumerate(rows):
        best[find(i)] = min(row[0], best.get(find(i), row[0]))
    return set(best.values())


def test_appended_truncated_and_block_edited_copies_go(spark, tmp_path):
    r = random.Random(12)
    words = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    texts = []
    for i in range(120):
        base = words(r.choice([60, 120, 400]))
        part = max(1, int(len(base) * r.uniform(0.04, 0.24)))
        at = r.randrange(len(base) - part)
        scattered, shuffled = list(base), list(base)
        for k in r.sample(range(len(base)), max(1, part // 8)):
            scattered[k] = "zz"
        r.shuffle(shuffled)
        copy = [base + words(part), base[: len(base) - part], base[:at] + words(part // 3) + base[at + part // 3 :], base[part:], scattered][i % 5]
        texts += [" ".join(base), " ".join(copy)] + [" ".join(shuffled)] * (i % 6 == 0)
    r.shuffle(texts)
    rows = [(i, t, "en", "s", 1, 1, "d") for i, t in enumerate(texts)]
    want = kept_by_brute_force(rows)
    got = {x.doc_id for x in simhash_dedup.keep_one(stored(spark, tmp_path, rows)).collect()}
    assert 60 < len(rows) - len(want) < 120 and got == want  # every due pair, whatever the edit, and no decoy


def test_pairs_beside_a_dissimilar_first_row(spark, tmp_path):
    """The same words in another order come first and are like neither of two copies; chains and templates meet in crowded shingles."""
    r = random.Random(13)
    lines = [" ".join(f"v{r.randrange(900)}" for _ in range(20)) for _ in range(12)]
    swapped = [*lines[:5], lines[6], lines[5], *lines[7:]]
    mixed = " ".join(lines).split()
    r.shuffle(mixed)
    texts = [" ".join(mixed), " ".join(lines), " ".join(swapped)]
    template = [f"t{i}" for i in range(100)]
    texts += [" ".join(template + [f"own{i}x{k}" for k in range(r.choice([3, 10, 30, 60]))]) for i in range(150)]
    chain = [f"c{i}" for i in range(300)]
    texts += [" ".join(chain[i : i + 100]) for i in range(0, 200, 4)]
    rows = [(i, t, "en", "s", 1, 1, "d") for i, t in enumerate(texts)]
    want = kept_by_brute_force(rows)
    for stars in (0, 2):
        simhash_dedup.STARS, held = stars, simhash_dedup.STARS
        try:
            got = {x.doc_id for x in simhash_dedup.keep_one(stored(spark, tmp_path, rows, f"stars{stars}")).collect()}
        finally:
            simhash_dedup.STARS = held
        assert 2 not in got and got == want
