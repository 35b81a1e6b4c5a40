"""SimHash near-duplicate groups by deletion-variant signatures.

Fingerprints: every shingle's XXH64 votes on 64 bits, summed JVM-side, two bits to a long. Equal fingerprints are
folded into classes first, so copies never pair up. To link classes at `radius` differing bits or fewer, the 64 bits are
cut into ceil((radius + 1) / 2) segments: at least one segment of a linked pair differs by one bit at most. A segment is
indexed once for each of its bits with that bit masked (for radius 2 the second one needs no mask: it agrees wholly where
the first differs by two bits); linked pairs share such a key, are joined on it and verified.

Buckets: a key of two classes gives its pair from the aggregation (minimum and maximum); keys of up to `bucket` classes
are joined back and paired inside; for larger ones nothing is dropped and no pairs are listed: their classes are put
under the points at most one bit away (65 each). Two fingerprints share such a point exactly if they differ by two
bits or fewer, and a point never has more than 65 distinct fingerprints, so a star around its smallest gives the exact
components. (For radius 1 the point of a star is the fingerprint with one bit masked.)

Defined results: null and blank texts have fingerprint 0 and link like any other; rows with null ids are grouped, but the
id of a component is its smallest non-null id (null if there is none). Repeated ids are separate rows.
An empty table gives an empty result. Extra columns are neither read nor returned by `near_groups`; `keep_one` returns
them as they are, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, Scratch, ascii_lower, fingerprint_of, give_back, hex16, light, numbered, shingle_at, ship, split_lookup, votes, without, words_of
from .components import components


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(row, doc_id, fp): one row per row of docs."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    places = base.select("row", "doc_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - shingle, F.lit(0)))).alias("at"))
    hashed = places.select("row", "doc_id", ascii_lower(shingle_at(F.col("words"), F.col("at"), shingle)).alias("s")).select(
        "row", "doc_id", F.when(F.col("s").isNotNull(), F.xxhash64("s")).alias("h")
    )
    summed = hashed.groupBy("row", "doc_id").agg(F.count("h").alias("n"), *votes(F.col("h")))
    return summed.select("row", "doc_id", fingerprint_of(F.col("n")).alias("fp"))


def _masks(radius: int, bits: int = 64) -> list[tuple[int, int]]:
    """(number, bits kept of the fingerprint) of each segment variant; the number of a wildcard is its bit.

    Numbers from `bits` on are whole segments. If every segment but the last differs by two bits or more, radius 2 leaves
    none for the last: it needs no wildcard. The whole first segment holds the pairs that agree in it (see _shared).
    """
    k = math.ceil((radius + 1) / 2)
    cuts = [bits * i // k for i in range(k + 1)]
    wholes = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    wild = cuts[1] if radius == 2 else bits
    return [(bit, wholes[0] & ~(1 << bit)) for bit in range(wild)] + ([(bits + i, whole) for i, whole in enumerate(wholes)] if radius == 2 else [])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(fp: Column, radius: int, bits: int) -> Column:
    def one(n: int, mask: int) -> Column:
        bit = F.shiftrightunsigned(fp, n).bitwiseAND(F.lit(1)) if n < bits else F.lit(0).cast("long")
        return F.struct(F.lit(n).cast("byte").alias("variant"), fp.bitwiseAND(F.lit(_signed(mask))).alias("part"), bit.alias("bit"))

    return F.array(*[one(n, mask) for n, mask in _masks(radius, bits)])


def _shared(keyed: DataFrame, key: list[str], bits: int) -> DataFrame:
    """Keys of two classes and more. A wildcard key whose members agree in the masked bit adds nothing to the whole segment."""
    grouped = keyed.groupBy(*key).agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.sum("bit").alias("ones")).filter("n > 1")
    return grouped.filter((F.col("variant") >= bits) | ((F.col("ones") > 0) & (F.col("ones") < F.col("n")))).drop("ones")


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_links(classes: DataFrame, radius: int = 2, bucket: int = 8, bits: int = 64, by: list[str] | None = None) -> DataFrame:
    """(*by, a, b), a < b: links among distinct fingerprints whose components are those of all pairs within the radius.

    classes: columns fp and `by`, distinct; only fingerprints that agree in `by` are linked. Radius 1 or 2.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    by = by or []
    tmp = Scratch(classes.sparkSession, "hamming")
    # Each class becomes tens of rows here, far more than the few files that it is read from suggest.
    classes = classes.repartition(4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    key, group = [*by, "variant", "part"], F.array_sort(F.collect_list("fp"))
    keyed = classes.select(*by, "fp", F.inline(_variants(F.col("fp"), radius, bits)))
    shared = tmp.keep(_shared(keyed, key, bits), "shared")
    near = _differing(F.col("a"), F.col("b")) <= radius
    two = shared.filter("n = 2").select(*by, "a", "b").filter(near)
    # A class has 64 variants at most, so fewer than 64 * HOT_KEYS keys hold over 1/HOT_KEYS of the classes: they are
    # broadcast. The others meet their members by a sort-merge join in which no key is larger than that.
    limit = max(classes.count() // HOT_KEYS, 1000)
    huge = shared.filter(F.col("n") > limit).select(*key, F.lit(True).alias("huge"))
    marked = keyed.drop("bit").join(F.broadcast(huge), key, "left")
    more = shared.filter((F.col("n") > 2) & (F.col("n") <= limit)).select(*key, (F.col("n") > bucket).alias("large"))
    met = tmp.keep(marked.filter("huge is null").drop("huge").join(more.hint("merge"), key), "met")
    mid = met.filter("not large").groupBy(*key).agg(group.alias("g"))
    mid = mid.select(*by, "g", F.posexplode("g").alias("i", "b")).select(*by, F.explode(F.slice("g", 1, F.col("i"))).alias("a"), "b").filter(near)
    hot = met.filter("large").select(*by, "fp").unionByName(marked.filter("huge").select(*by, "fp")).distinct()
    flips = [F.lit(_signed(1 << i)) for i in range(bits)]
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(x) for x in flips]) if radius == 2 else F.array(*[F.struct(F.lit(i).cast("byte"), F.col("fp").bitwiseAND(F.lit(_signed(~(1 << i) & (1 << 64) - 1)))) for i in range(bits)])
    stars = hot.select(*by, "fp", F.explode(points).alias("point")).groupBy(*by, "point").agg(group.alias("g")).filter(F.size("g") > 1)
    stars = stars.select(*by, F.get("g", F.lit(0)).alias("a"), F.explode(F.slice("g", 2, bits + 1)).alias("b"))
    links = tmp.keep(two.unionByName(mid).unionByName(stars).distinct(), "links")
    tmp.drop("shared", "met")
    return links


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, bucket: int = 8) -> DataFrame:
    """One row per row of docs: row, doc_id, fingerprint (16 hexadecimal digits), component_id, group_rows (of equal fingerprints)."""
    tmp = Scratch(docs.sparkSession, "simhash")
    rows = tmp.keep(fingerprints(docs, id_col, text_col, shingle), "rows")
    total = rows.count()
    classes = tmp.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("group_rows")), "classes")
    roots = components(hamming_links(classes.select("fp"), radius, bucket)).withColumnRenamed("node", "fp")
    tied = tmp.keep(classes.join(roots, "fp", "left"), "tied")
    linked = tied.filter("root is not null")
    sizes = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    alone = tied.filter("root is null").select("fp", "group_rows", F.col("least").alias("component_id"))
    table = split_lookup(linked, sizes, "root", linked.count(), "classes").select("fp", "group_rows", "component_id").unionByName(alone)
    table = tmp.keep(table, "table")
    return split_lookup(rows, table, "fp", total).select("row", "doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id", "group_rows")


#: Rounds, at least and at most, in which shared shingles are compared with one centre each before all remaining pairs are.
STARS, MOST_STARS = 2, 10
#: All remaining pairs are compared once they are at most EACH for each row of a shared shingle, or a round links less than one in GAIN.
EACH, GAIN = 16, 50
#: Bits of a set's bitmap, whose differences bound what two sets can share; sets of over MAPPED have none, as theirs would be full.
BITMAP, MAPPED = 1024, 512
#: Shingles that at least SEEN of every SAMPLEth document have are put last in the order of shingles (the most frequent OFTEN of them).
SAMPLE, SEEN, OFTEN = 16, 8, 100_000
#: Rows of a shared shingle that one task pairs with all the others; pairs of one row that one task compares.
BLOCK, SHARE = 2000, 1000


BITS = [f"b{i}" for i in range(BITMAP // 64)]


def _mix(h, seed: int):
    import numpy as np

    x = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int):
    """The sorted 64-bit hashes of a text's distinct word shingles: one of all words if there are fewer, none without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(len(words) - shingle + 1, 1)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(min(shingle, len(words))):
        total += _mix(hashes[i : i + n], i)
    return np.unique(_mix(total, shingle))


def voted(hashes) -> int:
    """The SimHash of a set: a bit is 1 if over half the hashes have it."""
    import numpy as np

    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def prefix_of(hashes, similarity: float, often, rank):
    """The hashes one of which any set of at least that similarity shares: the first in an order with the frequent ones (`often`, sorted) last."""
    import numpy as np

    if len(often) and len(hashes):
        at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
        hit = often[at] == hashes
        hashes = np.concatenate([hashes[~hit], hashes[hit][np.argsort(rank[at[hit]])]])
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1] if len(hashes) else hashes


def bitmap(hashes):
    """BITMAP bits, as longs: each hash of a set of MAPPED at most sets one. A bit that only one of two sets has is a shingle that the other lacks."""
    import numpy as np

    bits = np.zeros(BITMAP, dtype=np.uint8)
    if len(hashes) <= MAPPED:
        bits[(_mix(hashes, 99) % np.uint64(BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def _lists(arrays: list):
    import numpy as np

    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *[x.view(np.int64) for x in arrays]])))


def _described(shingle: int, similarity: float, often, rank):
    """(row, n, s1, s2, fp, prefix, b0, ...): size, 128-bit digest and SimHash of each row's shingle set, its prefix and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            out, prefixes, bits = np.zeros((4, b.num_rows), dtype=np.int64), [], np.zeros((b.num_rows, BITMAP // 64), dtype=np.int64)
            for i, text in enumerate(b.column(1)):
                s = shingle_set(text.as_py(), shingle)
                out[:, i] = len(s), s.sum(dtype=np.uint64).view(np.int64), _mix(s, 77).sum(dtype=np.uint64).view(np.int64), voted(s)
                prefixes.append(prefix_of(s, similarity, often, rank))
                bits[i] = bitmap(s)
            columns = [*out, _lists(prefixes), *np.ascontiguousarray(bits.T)]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], ["row", "n", "s1", "s2", "fp", "prefix", *BITS])
        give_back()

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingle_set(t.as_py(), shingle) for t in b.column(1)])], ["row", "set"])
        give_back()

    return run


def _frequent(texts: DataFrame, shingle: int):
    """(hashes in order, their ranks) of at most OFTEN frequent shingles, estimated from a part of the documents: any order gives the same links."""
    import numpy as np

    part = texts.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).mapInArrow(_sets(shingle), "row bigint, set array<bigint>")
    counts = part.select(F.explode("set").alias("h")).groupBy("h").count().filter(F.col("count") >= SEEN)
    top = counts.orderBy(F.desc("count"), "h").limit(OFTEN).collect()  # OFTEN rows at most
    hashes = np.array([r.h for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(top) - np.arange(len(top)))[order]


def _star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each row with the centre that it meets at most of its shingles (and at a twentieth of them), unless both are in one component already."""
    met = members.filter("row != centre and comp != centre_comp").groupBy("row", "n", "centre").count().filter(F.col("count") >= 0.05 * F.col("n"))
    best = met.groupBy("row").agg(F.max(F.struct("count", "centre")).alias("best"))
    return best.select(F.least("row", "best.centre").alias("a"), F.greatest("row", "best.centre").alias("b")).distinct()


def _all_pairs(members: DataFrame, similarity: float, one: bool = False) -> DataFrame:
    """(a, b): all rows of different components that share a prefix shingle and can be similar by sizes, bitmaps, places and number of shared ones.

    one: of the pairs of two components only that with the most shared shingles. What can't be similar by sizes and bitmaps never leaves the join. Similar sets have `least` shingles in common. All of these
    are at or after the first shared one in both; and the prefix that ends first holds at least `least` - similarity * size (of the larger set) of them, which the other one has too.
    """
    blocks = F.ceil(F.col("group_rows") / BLOCK).cast("int")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("row", "n", "at", "comp", *BITS)]
    least = (F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity)) - 1e-6
    lacks = lambda x, y: reduce(Column.__add__, [F.bit_count(F.col(f"{c}_{x}").bitwiseAND(F.bitwise_not(F.col(f"{c}_{y}")))) for c in BITS])
    left = members.select("h", F.pmod(F.xxhash64("row"), blocks).cast("int").alias("block"), *side("a"))
    right = members.select("h", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *side("b"))
    fits = (F.col("row_a") < F.col("row_b")) & (F.col("comp_a") != F.col("comp_b")) & (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6)
    fits = fits & ((F.greatest("n_a", "n_b") > MAPPED) | ((F.col("n_a") - lacks("a", "b") >= least) & (F.col("n_b") - lacks("b", "a") >= least)))
    both = left.join(right.hint("merge"), ["h", "block"]).filter(fits)
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    shared = both.groupBy("row_a", "row_b", "n_a", "n_b").agg(F.count("*").alias("shared"), F.max(rest).alias("rest"), F.min(F.least("comp_a", "comp_b")).alias("lo"), F.min(F.greatest("comp_a", "comp_b")).alias("hi"))
    can = (F.col("rest") >= least) & (F.col("shared") >= least - similarity * F.greatest("n_a", "n_b"))
    found = shared.filter(can).select("lo", "hi", "shared", F.col("row_a").alias("a"), F.col("row_b").alias("b"))
    if one:
        found = found.groupBy("lo", "hi").agg(F.max(F.struct("shared", "a", "b")).alias("best")).select("best.a", "best.b")
    return found.select("a", "b")


class _Links:
    """The verified links found so far, and the components that they make."""

    def __init__(self, texts: DataFrame, shingle: int, similarity: float):
        self.texts, self.shingle, self.similarity = texts, shingle, similarity
        self.tmp, self.found, self.sizes = Scratch(texts.sparkSession, "links"), [], []

    def add(self, links: DataFrame) -> int:
        self.found.append(self.tmp.keep(links, f"links{len(self.found)}"))
        self.sizes.append(self.found[-1].count())
        return self.sizes[-1]

    def verify(self, pairs: DataFrame) -> int:
        """Adds those of the pairs (a, b) whose shingle sets are similar; each set is made once, from the whole text."""
        pairs = self.tmp.keep(pairs, "pairs")
        asked = self.tmp.keep(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "asked")
        sets = self.tmp.keep(self.texts.join(light(asked), "row").mapInArrow(_sets(self.shingle), "row bigint, set array<bigint>"), "sets")
        both = self._beside(self._beside(pairs, sets, "a", "b", "x"), sets, "b", "a", "y")
        common = F.size(F.array_intersect("x", "y"))
        n = self.add(both.filter(common >= self.similarity * (F.size("x") + F.size("y") - common)).select("a", "b"))
        self.tmp.drop("sets", "asked", "pairs")
        return n

    def _beside(self, pairs: DataFrame, sets: DataFrame, row: str, other: str, name: str) -> DataFrame:
        """pairs with the set of `row`. A row with over SHARE pairs is dealt, with copies of its set, to as many tasks as it takes."""
        hot = self.tmp.keep(self.pairs_of(pairs, row), f"hot_{name}")
        dealt = pairs.join(light(hot), row, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")), F.lit(0)))
        copies = sets.withColumnsRenamed({"row": row, "set": name}).join(light(hot), row, "left").select(row, name, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)).alias("part"))
        return dealt.drop("parts").join(copies, [row, "part"]).drop("part")

    @staticmethod
    def pairs_of(pairs: DataFrame, row: str) -> DataFrame:
        return pairs.groupBy(row).agg(F.ceil(F.count("*") / SHARE).cast("long").alias("parts")).filter("parts > 1")

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.found)

    def roots(self) -> DataFrame:
        """Of the rows that stand for their classes."""
        return components(reduce(DataFrame.unionByName, self.found[1:]))


def _hamming_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """(a, b) by deletion-variant signatures. sets: row, fp. Rows of a fingerprint meet its first one, and first rows of linked fingerprints each other."""
    tmp = Scratch(sets.sparkSession, "hamming-pairs")
    fps = tmp.keep(sets.groupBy("fp").agg(F.min("row").alias("first"), F.count("*").alias("group_rows")), "fps")
    crowded = fps.filter("group_rows > 1")
    same = split_lookup(sets.select("row", "fp"), crowded, "fp", sets.count()).filter("row != first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    near = hamming_links(fps.select("fp"), radius)
    first = fps.select("fp", "first")
    met = near.join(first.withColumnsRenamed({"fp": "a", "first": "x"}), "a").join(first.withColumnsRenamed({"fp": "b", "first": "y"}), "b")
    return same.unionByName(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def similar_links(rows: DataFrame, shingle: int = 5, similarity: float = 0.8, text_col: str = "text", row_col: str = "row", radius: int = 2) -> DataFrame:
    """(a, b): pairs of rows whose word shingles have at least that Jaccard similarity; their components are those of all such pairs.

    rows: a column row_col with distinct numbers, the same in each scan. Rows of equal sets (by 128 bits) are one class and meet once.

    1. Deletion-variant signatures: the sets' SimHashes within `radius` bits give pairs, which the sets decide exactly. This finds
       the close copies, and joins large groups of them by stars.
    2. A copy of which a fifth was cut off differs in nine bits of 64 on average, beyond any radius that can be indexed. The
       rest is therefore found exactly, and no candidate is left out: in any common order of shingles, two sets of a similarity
       of t share one of the first n - ceil(t * n) + 1 of each, n being its size. These prefixes are joined. The order is that
       of the hashes, with frequent shingles last.

    A shared shingle whose rows are of several components first compares each with a centre, at least STARS times and as long as
    that links many and leaves many pairs; then all pairs in different components that sizes and bitmaps allow are compared.
    """
    spark, tmp = rows.sparkSession, Scratch(rows.sparkSession, "similar")
    ship(spark)
    texts = rows.select(F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = "row bigint, n bigint, s1 bigint, s2 bigint, fp bigint, prefix array<bigint>, " + ", ".join(f"{c} bigint" for c in BITS)
    made = texts.mapInArrow(_described(shingle, similarity, *_frequent(texts, shingle)), schema)
    made = tmp.keep(made.select("row", F.struct("n", "s1", "s2").alias("class"), "fp", "prefix", *BITS), "made")
    classes = tmp.keep(made.groupBy("class").agg(F.min("row").alias("first"), F.count("*").alias("group_rows")).filter("group_rows > 1"), "classes")
    links = _Links(texts, shingle, similarity)
    links.add(split_lookup(made.select("row", "class"), classes, "class", made.count()).filter("row != first").select(F.col("first").alias("a"), F.col("row").alias("b")))
    single = made.join(light(links.found[0].select(F.col("b").alias("row"))), "row", "left_anti").select("row", F.col("class.n").cast("int").alias("n"), "fp", "prefix")
    links.verify(_hamming_pairs(single, radius))
    tokens = single.select("row", "n", F.posexplode("prefix").alias("at", "h"))
    often = tmp.keep(tokens.groupBy("h").agg(F.count("*").alias("group_rows")).filter("group_rows > 1"), "often")
    met = tmp.keep(tokens.select("h", "row", "n", "at").join(often.hint("merge"), "h"), "met")  # a row has a shingle once, and copies are folded
    bits = tmp.keep(made.select("row", *BITS), "bits")
    tmp.drop("made", "often")
    ends = False
    for turn in itertools.count():
        roots = tmp.keep(links.roots(), f"roots{turn}")
        tied = tmp.keep(met.select("h", "row", "n", "at").join(light(roots.withColumnsRenamed({"node": "row", "root": "comp"})), "row", "left").withColumn("comp", F.coalesce("comp", "row")), f"tied{turn}")
        key = F.col("row").bitwiseXOR(F.xxhash64("h", F.lit(turn)) if turn else F.lit(0).cast("long"))  # which row of a shingle is the centre
        seen = tied.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("group_rows"), F.min(F.struct(key, "row", "comp")).alias("best"))
        mixed = tmp.keep(seen.filter("lo < hi").select("h", "group_rows", F.col("best.row").alias("centre"), F.col("best.comp").alias("centre_comp")), f"mixed{turn}")
        members, pairs = mixed.agg(F.coalesce(F.sum("group_rows"), F.lit(0)), F.coalesce(F.sum(F.col("group_rows") * (F.col("group_rows") - 1) / 2), F.lit(0.0))).first()
        if not members:
            break
        met = tmp.keep(tied.join(mixed.hint("merge"), "h"), f"met{turn}")
        tmp.drop(f"met{turn - 1}" if turn else "met", f"tied{turn}")
        ends = ends or turn >= STARS and (pairs <= EACH * members or links.sizes[-1] * GAIN < members or turn == MOST_STARS)
        if not ends:
            links.verify(_star_pairs(met))
            continue
        # One pair of two components first, as long as that joins any; what is left then is compared whole.
        mapped = met.join(bits.hint("merge"), "row")
        if turn >= MOST_STARS + STARS or not links.verify(_all_pairs(mapped, similarity, one=True)):
            links.verify(_all_pairs(mapped, similarity))
            break
    done = Scratch(spark, "similar-links").keep(links.all(), "links")
    links.tmp.drop()
    tmp.drop()
    return done


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each group of similar texts the one with the smallest id."""
    tmp = Scratch(docs.sparkSession, "simhash-kept")
    rows, row = numbered(docs, tmp)
    roots = tmp.keep(components(similar_links(rows, shingle, similarity, text_col, row)), "roots")
    ids = rows.select(F.col(row).alias("node"), F.col(id_col).alias("id"))
    grouped = tmp.keep(ids.join(light(roots), "node"), "grouped")
    stay = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("best")).select(F.col("best.node").alias("node"))
    dropped = tmp.keep(grouped.join(stay, "node", "left_anti").select(F.col("node").alias(row)), "dropped")
    return without(rows, dropped, row)
