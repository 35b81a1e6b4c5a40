"""Entities from text: pattern and lexicon matches, overlap resolution, categories, normalization."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import rules
from quillframe.functions.spans import CLOSE, OPEN, bound, marked, marked_spans, resolve
from quillframe.functions.text import mask_ssn
from quillframe.shipping import ship

from .lexicon import BROADCAST_PHRASES, lexicon_matches

ENTITY = "struct<start:int,end:int,text:string,type:string>"


#: What a text must have for a match of a built-in pattern, by type: a digit, a capital (the match begins with it), one of some literals in lower case.
WITH_DIGIT = {"ssn", "ein", "medical_code", "phone", "currency", "percentage", "date", "time_value", "zip_code", "policy_number", "address", "account_number", "npi"}
WITH_CAPITAL = {"state", "organization", "person_name"}
LITERALS = {
    "url": ["://"], "email": ["@"], "ein": ["ein", "tax", "tin", "employer"], "claim_number": ["claim", "clm", "auth", "approval", "confirmation", "transaction", "reference"],
    "group_number": ["group", "grp", "plan", "benefit", "subscriber", "member", "enrollee"], "percentage": ["%"], "policy_number": ["pol", "cert", "contract", "account"],
    "case_number": ["case", "ref", "docket", "file", "matter", "ticket", "incident"], "account_number": ["account", "acct", "a/c", "routing", "aba", "rtn", "iban"], "npi": ["npi", "national"],
}


#: Stand for OPEN and CLOSE while a text that has them is matched; no pattern tells the four apart.
STAND_INS = "\ufdd2\ufdd3"


def _signs(text: Column) -> Column:
    """A text with what the triggers ask, each found once per text; odd: it has OPEN or CLOSE of its own."""
    odd = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    return F.struct(
        text.alias("text"), F.when(odd, F.translate(text, OPEN + CLOSE, STAND_INS)).otherwise(text).alias("plain"), odd.alias("odd"),
        text.rlike("[0-9]").alias("digit"), text.rlike("[A-Z]").alias("capital"), F.lower(text).alias("low"),
    )


def _trigger(seen: Column, kind: str) -> Column:
    """A cheap test that a text passes if it has a match of a built-in pattern."""
    tests = [seen["digit"]] if kind in WITH_DIGIT else [seen["capital"]] if kind in WITH_CAPITAL else []
    if kind in LITERALS:
        tests.append(functools.reduce(lambda a, b: a | b, [F.contains(seen["low"], F.lit(w)) for w in LITERALS[kind]]))
    return functools.reduce(lambda a, b: a & b, tests, F.lit(True))


def extract(text: Column, patterns: list[tuple[str, str]] | None = None, not_names: list[str] = rules.NOT_NAMES, state_codes: list[str] = rules.STATE_CODES) -> Column:
    """Resolved entities of a text: array of (start, end, text, type); social-security numbers are masked.

    A text without any trigger (digit, @, :// or a capital) is not scanned. Each pattern that may match marks its matches in a copy of
    the text; copies without a mark go before positions are worked out, in one expression for all patterns.
    """
    empty = F.array().cast(f"array<{ENTITY}>")

    def copy(seen: Column, kind: str, pattern: str) -> Column:
        led = f"(?=[A-Z]){pattern}" if patterns is None and kind in WITH_CAPITAL else pattern  # most places fail on their first sign
        made = F.struct(F.lit(kind).alias("type"), marked(seen["plain"], led).alias("marked"))
        return F.when(_trigger(seen, kind), made) if patterns is None else made

    def found(seen: Column, one: Column) -> Column:
        kind = one["type"]

        def entity(s: Column) -> Column:
            value = F.when(seen["odd"], F.substring(seen["text"], s["start"] + 1, s["end"] - s["start"])).otherwise(s["text"])
            shown = F.when(kind == "ssn", mask_ssn(value)).when(kind == "npi", F.right(value, F.lit(10))).otherwise(F.btrim(value))
            first = F.when(kind == "npi", s["end"] - 10).otherwise(s["start"])  # the name before the digits is no part of it
            return F.struct(first.alias("start"), s["end"], shown.alias("text"), kind.alias("type"))

        def counts(e: Column) -> Column:
            named = F.arrays_overlap(F.split(e["text"], r"\s+"), F.array(*[F.lit(w) for w in not_names]))
            return F.when(kind == "organization", (F.char_length(e["text"]) >= 4) & ~e["text"].isin(state_codes)).when(kind == "person_name", ~named).otherwise(True)

        return F.filter(F.transform(marked_spans(one["marked"]), entity), counts)

    def every(seen: Column) -> Column:
        copies = F.array(*[copy(seen, kind, pattern) for kind, pattern in patterns or rules.ENTITY_PATTERNS])
        hit = F.filter(copies, lambda one: F.contains(one["marked"], F.lit(OPEN)))
        entities = F.flatten(F.transform(hit, lambda one: found(seen, one)))
        scanned = seen["digit"] | seen["capital"] | F.contains(seen["text"], F.lit("@")) | F.contains(seen["text"], F.lit("://"))
        return F.when(scanned, bound(entities, lambda e: resolve(e, ENTITY))).otherwise(empty)

    return bound(_signs(text), every)


def entity_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per entity of a row: keys, type, start, end, text.

    An outer explode, whose empty rows go afterwards: for a plain one the optimizer puts a filter below, and all would be found twice.
    """
    met = df.select(*keys, F.explode_outer(extract(F.col(text))).alias("_e")).filter("_e is not null")
    return met.select(*keys, "_e.type", "_e.start", "_e.end", "_e.text")


def by_category(entities: Column, types: list[str] = rules.ENTITY_TYPES) -> Column:
    """Map from every type, in fixed order, to its distinct texts in order of first sight."""
    def texts(kind: str) -> Column:
        return F.array_distinct(F.transform(F.filter(entities, lambda e: e["type"] == kind), lambda e: e["text"]))

    return F.map_from_arrays(F.array(*[F.lit(t) for t in types]), F.array(*[texts(t) for t in types]))


def lexicon_entities(df: DataFrame, key: str, text: str, lexicon: list[tuple[str, str, str]] | DataFrame, normalization: list[tuple[str, str, str]] = rules.NORMALIZATION) -> DataFrame:
    """One row per lexicon entity of a row: key, start, end, text, label, canonical_name, confidence, source, normalized_acronym.

    lexicon: (phrase, canonical, label), a list in order or a table with the order in `place`; of a phrase's entries the last declared counts. Normalization overrides both.
    """
    norm = df.sparkSession.createDataFrame(list(normalization), "phrase string, n_canonical string, n_label string")
    joined = lexicon_matches(df, key, text, lexicon).join(F.broadcast(norm) if len(normalization) <= BROADCAST_PHRASES else norm, "phrase", "left")
    canonical = F.coalesce("n_canonical", "canonical")
    acronym = F.when((canonical == F.upper(canonical)) & (F.char_length(canonical) <= 8), canonical).otherwise(F.col("n_canonical"))
    return joined.select(key, "start", "end", "text", F.coalesce("n_label", "label").alias("label"), canonical.alias("canonical_name"), F.lit(0.95).alias("confidence"), F.lit("dictionary").alias("source"), acronym.alias("normalized_acronym"))


def layered(layers: list[DataFrame], key: str) -> DataFrame:
    """Layers of entities (key, start, end, text, label) in order of trust: an earlier layer wins an overlap, then the longer span."""
    kind = "struct<layer:int,start:int,end:int,text:string,label:string>"
    all_ = None
    for n, layer in enumerate(layers):
        rows = layer.select(key, F.struct(F.lit(n).alias("layer"), "start", "end", "text", "label").alias("e"))
        all_ = rows if all_ is None else all_.unionByName(rows)
    kept = all_.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("es"))
    return kept.select(key, F.explode(resolve(F.col("es"), kind, ["layer"])).alias("e")).select(key, "e.*")


def label_table(spark: SparkSession, labels: dict[str, str] = rules.ENTITY_LABELS) -> DataFrame:
    """One row per label of the domain tagger: position, label, description."""
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(labels.items())], "position int, label string, description string")


def label_summary(found: DataFrame, labels: list[str]) -> DataFrame:
    """One row per label, those without entities too: total and distinct canonical names."""
    every = found.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, position int")
    counted = found.groupBy("label").agg(F.count("*").alias("total"), F.count_distinct("canonical_name").alias("names"))
    return F.broadcast(every).join(counted, "label", "left").select("label", "position", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("names", F.lit(0)).cast("long").alias("names"))


def normalize(df: DataFrame, text: str, lexicon: list[tuple[str, str, str]], normalization: list[tuple[str, str, str]] = rules.NORMALIZATION) -> DataFrame:
    """Adds canonical, label and matched for a single term: normalization first, then the lexicon."""
    spark = df.sparkSession
    last = {p.lower(): (p.lower(), c, label) for p, c, label in lexicon}
    lex = spark.createDataFrame(list(last.values()), "_p string, _c string, _l string")
    norm = spark.createDataFrame(list(normalization), "_p string, _nc string, _nl string")
    keyed = df.withColumn("_p", F.lower(F.trim(text)))
    hint = F.broadcast if len(last) + len(normalization) <= BROADCAST_PHRASES else (lambda t: t)
    joined = keyed.join(hint(norm), "_p", "left").join(hint(lex), "_p", "left")
    canonical = F.coalesce("_nc", "_c")
    return joined.withColumns({"canonical": canonical, "label": F.coalesce("_nl", "_l"), "matched": canonical.isNotNull()}).drop("_p", "_c", "_l", "_nc", "_nl")


def chunk_layer(df: DataFrame, key: str, text: str, tagger, labels: dict[str, str], threshold: float = 0.4, size: int = 1500, overlap: int = 200, lexicon: list[tuple[str, str, str]] = (), normalization: list[tuple[str, str, str]] = rules.NORMALIZATION) -> DataFrame:
    """Entities of a model with a limit: key, start, end, text, label, canonical_name, confidence, source, normalized_acronym, for `layered`.

    tagger: chunks -> for each a list of (text, label, score). A failing chunk has none. What scores below the threshold, has a label without
    a mapping or fewer than 2 or more than 100 signs goes; its place is the first of its text in the chunk (any case, if there is none as it is). Found again in the overlap of two
    chunks at the same place, it counts once, with its best score. Chunks are rows, so that long texts go to many tasks.
    """
    ship(df.sparkSession)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    cut = rows.select("row", "key", F.explode(chunks(F.col("text"), size, overlap)).alias("c")).select("row", "key", "c.offset", "c.chunk")

    def tag(batches):
        for b in batches:
            out = []
            for row, k, offset, chunk in b.itertuples(index=False):
                try:
                    found = tagger([chunk])[0]
                except Exception:  # one chunk must not end the batch
                    continue
                for t, label, score in found:
                    t = t.strip()
                    at = chunk.find(t) if t in chunk else chunk.lower().find(t.lower())
                    if score >= threshold and label in labels and 2 <= len(t) <= 100 and at >= 0:
                        out.append((row, k, offset + at, offset + at + len(t), t, labels[label], float(score)))
            yield pd.DataFrame(out, columns=["row", "key", "start", "end", "text", "label", "score"]).astype({"row": "int64", "start": "int32", "end": "int32", "score": "float64"})

    kind = rows.schema["key"].dataType.simpleString()
    tagged = cut.mapInPandas(tag, f"row bigint, key {kind}, start int, end int, text string, label string, score double")
    once = tagged.groupBy("row", "key", "start", "end").agg(F.max_by("text", "score").alias("text"), F.max_by("label", "score").alias("label"), F.max("score").alias("score"))
    named = normalize(once.withColumnRenamed("label", "own"), "text", list(lexicon), normalization)
    canonical = F.coalesce("canonical", F.left(F.replace(F.upper("text"), F.lit(" "), F.lit("_")), F.lit(40)))
    acronym = F.when((canonical == F.upper(canonical)) & (F.char_length(canonical) <= 8), canonical).otherwise("")
    return named.select(F.col("key").alias(key), "start", "end", "text", F.coalesce("label", "own").alias("label"), canonical.alias("canonical_name"), F.round("score", 4).alias("confidence"), F.lit("model").alias("source"), acronym.alias("normalized_acronym"))


def chunks(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """Overlapping pieces of a text with their offsets, for models with a limit: array of (offset, chunk). The last one is the first that reaches the end."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.struct(s.alias("offset"), F.substring(text, s + 1, F.lit(size)).alias("chunk")))
