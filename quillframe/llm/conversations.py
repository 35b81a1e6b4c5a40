"""Repair of conversations by a min-plus matrix scan.

A conversation is legal if the initials of its roles read `(s?(ua)+)?`, which an automaton of four states accepts: nothing yet,
after system, after user, after assistant. Each turn is a 4 x 4 matrix over the states; an element holds the cost of the cheapest
edits that lead from one state to another and, as its audit, their initials (Keep, Rerole, Delete, Insert), least in ASCII
order among the cheapest. Between turns stands the closure of inserts. Product and minimum of elements are associative:
two audits of one cost over the same turns are never prefixes of each other, as more inserts cost more, so what follows
cannot turn their order. Equal turns have equal matrices, of which there are twelve (initial and fault).

Spark orders all turns by conversation and turn in one range shuffle, by which a long conversation goes to many tasks, and
numbers them without gaps. Spans of SPAN turns are multiplied in a task, then FAN neighbouring products of one conversation,
round by round, until each conversation has one; only conversations with several go through a round. The audit then says
what happens to each turn: its letters are handed out by spans again, and the repaired texts stream through a hash in
order. That last step is one task per conversation, with constant memory, because the hash of a text can't be put
together from parts; an audit, at a byte an edit, must fit a row.

Defined results: nulls in any column count as one space (in texts, roles, and the key of the damage), but a null id is a
conversation of its own and a null turn sorts first and has no part in gaps. Turns of one number are ordered by role, then by
text. Roles are judged by their first character as it is; an empty role has none and is never legal. Repeated rows are rows of
their own, and all but the first are duplicates. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CLASS, Scratch, give_back, ship

#: Turns of a span, and products that a round joins.
SPAN, FAN = 1024, 64

START, SYSTEM, USER, ASSISTANT = range(4)
Matrix = dict[tuple[int, int], tuple[int, str]]
#: The state after a role's initial.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Kinds of turns: a letter for each initial (s, u, a, any other) and fault (none, truncated, blank or duplicate).
KINDS = {chr(ord("A") + 3 * i + f): (initial, f) for i, initial in enumerate("sua-") for f in range(3)}


def least(a: Matrix, b: Matrix) -> Matrix:
    return a | {at: min(x, a[at]) if at in a else x for at, x in b.items()}


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: costs add, audits follow each other."""
    out: Matrix = {}
    for (i, k), (cost, audit) in a.items():
        for j in range(4):
            if (k, j) in b:
                more, rest = b[k, j]
                x = (cost + more, audit + rest)
                if (i, j) not in out or x < out[i, j]:
                    out[i, j] = x
    return out


def _closure() -> Matrix:
    """Any number of inserts of users and assistants; a way that comes back costs more than none."""
    one = {(i, j): (INSERT, "I") for (i, initial), j in NEXT.items() if initial in "ua"}
    none = {(i, i): (0, "") for i in range(4)}
    step = least(none, one)
    return times(step, step)  # no state is further than two inserts away


CLOSURE = _closure()


def turn_matrix(kind: str) -> Matrix:
    """Edits of one turn, then inserts."""
    initial, fault = KINDS[kind]
    edits: Matrix = {(i, i): (DELETE, "D") for i in range(4)}
    if fault < 2:
        extra = TRUNCATED * fault
        for (i, to), j in NEXT.items():
            if to == initial:
                edits = least(edits, {(i, j): (KEEP + extra, "K")})
            if to in "ua":
                edits = least(edits, {(i, j): (REROLE + extra, "R")})
    return times(edits, CLOSURE)


@functools.lru_cache(maxsize=100_000)
def _short(kinds: str) -> Matrix:
    return turn_matrix(kinds) if len(kinds) == 1 else times(_short(kinds[: len(kinds) // 2]), _short(kinds[len(kinds) // 2 :]))


def span_matrix(kinds: str) -> Matrix:
    """The product over a string of kinds, as a balanced tree; products of up to 16 turns are kept."""
    return product([_short(kinds[i : i + 16]) for i in range(0, len(kinds), 16)])


def product(parts: list[Matrix]) -> Matrix:
    while len(parts) > 1:
        parts = [times(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def best(whole: Matrix) -> tuple[int, str]:
    """Cost and audit of a conversation, inserts before its first turn included."""
    done = times(CLOSURE, whole)
    return min(done[START, j] for j in (START, ASSISTANT) if (START, j) in done)


def illegal(kinds: str) -> int:
    """Neighbours whose roles may not follow each other."""
    initials = "".join(KINDS[k][0] for k in kinds)
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copy: rows dropped, emptied, cut short, repeated or given to the user by the hash of their place; a test bed for the repair."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    bare = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), fault.alias("fault"))
    words = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return bare.filter("fault != 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), words.alias("text"), F.explode(copies).alias("copy"))


def _ordered(turns: DataFrame, tmp: Scratch) -> DataFrame:
    """Turns in order, each with its number among all (`at`, without gaps), blank, open (does not end in a stop) and key (a digest of role and text)."""
    bare = F.regexp_replace("text", SPACE_CLASS + r"+\z", "")
    key = F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"), 256)
    dealt = turns.repartitionByRange("conv_id", "turn", "role", "text", "copy", F.rand(7)).sortWithinPartitions("conv_id", "turn", "role", "text", "copy")
    marked = dealt.select("conv_id", "turn", "role", "text", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"), F.unhex(key).alias("key"), F.monotonically_increasing_id().alias("place"))
    kept = tmp.keep(marked, "turns")
    part = F.shiftright("place", 33)
    sizes = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # a row for each task of the shuffle
    first, starts = 0, []
    for r in sorted(sizes, key=lambda r: r.part):
        starts.append((r.part, first))
        first += r.n
    offsets = turns.sparkSession.createDataFrame(starts, "part long, first long")
    return kept.join(F.broadcast(offsets), part == F.col("part")).withColumn("at", F.col("first") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "first", "place")


_ELEMENT = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_PRODUCT = T.StructType([T.StructField("elements", _ELEMENT), T.StructField("illegal", T.LongType()), T.StructField("head", T.StringType()), T.StructField("tail", T.StringType())])


def _packed(m: Matrix) -> list[dict]:
    return [{"i": i, "j": j, "cost": c, "audit": a} for (i, j), (c, a) in m.items()]


def _unpacked(rows: list) -> Matrix:
    return {(e["i"], e["j"]): (e["cost"], e["audit"]) for e in rows}


def _multiplied(spans: DataFrame, tmp: Scratch) -> DataFrame:
    """(conv_id, cost, audit, illegal) from (conv_id, span, kinds)."""
    @F.udf(returnType=_PRODUCT, useArrow=True)
    def of_span(kinds: str):
        return _packed(span_matrix(kinds)), illegal(kinds), kinds[0], kinds[-1]

    @F.udf(returnType=_PRODUCT, useArrow=True)
    def of_products(parts: list):
        parts = [p["p"] for p in parts]
        between = sum(illegal(a["tail"] + b["head"]) for a, b in zip(parts, parts[1:]))
        return _packed(product([_unpacked(p["elements"]) for p in parts])), between + sum(p["illegal"] for p in parts), parts[0]["head"], parts[-1]["tail"]

    @F.udf(returnType="struct<cost:long,audit:string>", useArrow=True)
    def of_whole(elements: list):
        return best(_unpacked(elements))

    done, level = [], 0
    products = tmp.keep(spans.select("conv_id", "span", of_span("kinds").alias("p")), "product0")
    while True:
        several = tmp.keep(products.groupBy("conv_id").agg(F.count("*").alias("spans")).filter("spans > 1").select("conv_id", F.lit(True).alias("several")), f"several{level}")
        met = products.join(several, products.conv_id.eqNullSafe(several.conv_id), "left").drop(several.conv_id)
        done.append(met.filter("several is null").select("conv_id", "p"))
        if several.isEmpty():
            break
        grouped = met.filter("several").groupBy("conv_id", F.expr(f"span div {FAN}").alias("span")).agg(F.sort_array(F.collect_list(F.struct("span", "p"))).alias("parts"))
        level += 1
        products = tmp.keep(grouped.select("conv_id", "span", of_products("parts").alias("p")), f"product{level}")
    whole = functools.reduce(DataFrame.unionByName, done).select("conv_id", of_whole("p.elements").alias("w"), "p.illegal")
    return whole.select("conv_id", "w.cost", "w.audit", "illegal")


def _judged(ordered: DataFrame) -> DataFrame:
    """(conv_id, turn, at, fault: 0 none, 1 truncated, 2 blank, 3 duplicate; kind) of ordered turns."""
    first = ordered.groupBy("conv_id", "key").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    initial = F.instr(F.lit("sua"), F.col("initial")) - 1
    small = ordered.select("conv_id", "turn", "at", F.substring("role", 1, 1).alias("initial"), "blank", "open").join(first, "at", "left")
    fault = F.when(F.col("blank"), 2).when(F.col("first").isNull(), 3).when(F.col("open"), 1).otherwise(0)
    code = F.when((F.col("initial") != "") & (initial >= 0), initial).otherwise(3) * 3 + F.least(F.col("fault"), F.lit(2))
    return small.withColumn("fault", fault).select("conv_id", "turn", "at", "fault", F.char(F.lit(65) + code).alias("kind"))


def _cut(audit: str, first: int) -> list[tuple[int, str, int]]:
    """An audit in parts for the turns of a span each: (number of the part's first turn, letters, turns and inserts left before it)."""
    parts, at, begun, end, left = [], first, 0, 0, 0
    for c in audit:
        end += 1
        if c != "I":
            at += 1
            if at % SPAN == 0 and end < len(audit.rstrip("I")):
                parts.append((max(first, at - SPAN), audit[begun:end], left))
                left += end - begun - audit.count("D", begun, end)
                begun = end
    return [*parts, (max(first, (at - 1) // SPAN * SPAN), audit[begun:], left)]


def _letters(part: str, left: int) -> list[tuple[str, int]]:
    """A part's letters for each turn: the inserts before it, its own, and after the last turn what is inserted there."""
    out, begun, last = [], 0, len(part.rstrip("I"))
    for i, c in enumerate(part[:last]):
        if c != "I":
            letters = part[begun : i + 1] if i + 1 < last else part[begun:]
            out.append((letters, left))
            left += len(letters) - letters.count("D")
            begun = i + 1
    return out


def _edited(ordered: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, ordinal, edit, role, text) of repaired conversations from ordered turns and (conv_id, audit, first)."""
    cut = F.udf(_cut, "array<struct<at:long,letters:string,left:long>>", useArrow=True)
    letters = F.udf(_letters, "array<struct<letters:string,left:long>>", useArrow=True)
    odd = (F.char_length(F.translate("audit", "D", "")) % 2).alias("odd")  # then the first role left is system
    parts = audits.select(odd, F.explode(cut("audit", "first")).alias("p")).select("odd", "p.at", letters("p.letters", "p.left").alias("each"))
    each = parts.select("odd", "at", F.posexplode("each").alias("i", "e")).select((F.col("at") + F.col("i")).alias("at"), "odd", F.translate("e.letters", "D", "").alias("letters"), "e.left")
    met = ordered.select("at", "conv_id", "role", "text").join(each.filter("letters != ''"), "at")
    out = met.select("*", F.explode(F.sequence(F.lit(0), F.char_length("letters") - 1)).alias("i")).withColumn("edit", F.expr("substring(letters, i + 1, 1)")).withColumn("ordinal", F.col("left") + F.col("i"))
    due = F.when((F.col("ordinal") - F.col("odd")) % 2 == 0, "user").otherwise("assistant")
    return out.select("conv_id", "ordinal", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(due).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def _hashed(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the lines of a conversation pass one after the other through its hash."""
    ship(repaired.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, schema = None, None, pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        for b in batches:
            done = []
            for conv, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if digest is not None and conv == now:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                digest.update(line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), schema.types)], schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()], pa.string())], schema=schema)
        give_back()

    sorted_ = repaired.select("conv_id", "ordinal", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "ordinal")
    return sorted_.select("conv_id", "line").mapInArrow(run, "conv_id long, repaired_sha256 string")


class Repair:
    """The repair of a table of turns (conv_id, turn, role, text, copy as `damage` gives them; copy tells equal rows apart).

    `conversations`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. `turns`: conv_id, ordinal, edit, role, text of
    what is left and inserted. Both read tables in the shared folder until `close`.
    """

    def __init__(self, turns: DataFrame):
        ship(turns.sparkSession)
        self.tmp = Scratch(turns.sparkSession, "conversations")
        ordered = _ordered(turns, self.tmp)
        judged = self.tmp.keep(_judged(ordered), "judged")
        wide = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        faults = [F.count_if(F.col("fault") == f).alias(n) for f, n in ((2, "blank"), (3, "duplicate"), (1, "truncated"))]
        counted = judged.groupBy("conv_id").agg(F.coalesce(wide, F.lit(0)).alias("gaps"), *faults, F.min("at").alias("first"))
        grouped = judged.groupBy("conv_id", F.expr(f"at div {SPAN}").alias("span")).agg(F.sort_array(F.collect_list(F.struct("at", "kind"))).alias("t"))
        whole = _multiplied(grouped.select("conv_id", "span", F.array_join("t.kind", "").alias("kinds")), self.tmp)
        self.conversations = self.tmp.keep(joined([counted, whole]), "whole")
        self.turns = _edited(ordered, self.conversations.select("audit", "first"))

    def close(self) -> None:
        self.tmp.drop()


def joined(parts: list[DataFrame]) -> DataFrame:
    """Full outer join of tables with one row a conversation at most, null ids included, in one shuffle."""
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in rows.columns if c != "conv_id"])


def report(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damaged: bool = True) -> DataFrame:
    """A row for each original conversation: gaps, faults, illegal neighbours, cost, audit and repaired_sha256; with `damaged`, of the damaged turns."""
    bare = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    repair = Repair(damage(bare) if damaged else bare.withColumn("copy", F.lit(0)))
    all_ = joined([bare.select("conv_id").distinct(), repair.conversations.drop("first"), _hashed(repair.turns)])
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256().hexdigest())
    out = all_.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
    result = Scratch(turns.sparkSession, "conversations-report").keep(out, "report")
    repair.close()
    return result
