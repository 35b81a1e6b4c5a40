"""Scores, rule classification, synthesis and routing as column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import rules, shapes
from quillframe.functions.text import clamp, strip


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def matched_keywords(text: Column, keywords: list[str] = rules.RELEVANCE_KEYWORDS) -> Column:
    """Keywords that the lower-cased text contains anywhere, in the list's order."""
    low = F.lower(F.coalesce(text, F.lit("")))  # no lambda: inside one it would be lower-cased for each keyword
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(k.lower())) for k in keywords])) if keywords else _strings([])


def keyword_relevance(text: Column, keywords: list[str] = rules.RELEVANCE_KEYWORDS) -> Column:
    """Matched share, full at 30 % of the list."""
    return F.least(F.size(matched_keywords(text, keywords)) / F.greatest(F.lit(0.3 * len(keywords)), F.lit(1.0)), F.lit(1.0))


def line_structure(horizontal: Column, vertical: Column) -> Column:
    """Structure score of counted lines: ten horizontal or five vertical ones are full marks."""
    return 0.6 * F.least(horizontal / 10, F.lit(1.0)) + 0.4 * F.least(vertical / 5, F.lit(1.0))


def image_structure(height: Column, width: Column, pixels: Column) -> Column:
    """Line structure of a grey image, from its pixels; null for an unreadable one."""
    @F.pandas_udf("across int, down int")
    def counted(hs: pd.Series, ws: pd.Series, raws: pd.Series) -> pd.DataFrame:
        def one(h, w, raw):
            if raw is None or pd.isna(h) or pd.isna(w) or len(raw) != h * w or not h * w:
                return (None, None)
            return shapes.line_counts(np.frombuffer(raw, dtype=np.uint8).reshape(int(h), int(w)))

        return pd.DataFrame([one(*x) for x in zip(hs, ws, raws)], columns=["across", "down"]).astype("Int32")

    c = counted(height, width, pixels)
    return F.when(c["across"].isNotNull(), F.round(line_structure(c["across"], c["down"]), 4))


def relevance(text: Column, keyword_score: Column, structure: Column) -> Column:
    return F.when(strip(F.coalesce(text, F.lit(""))) != "", 0.7 * keyword_score + 0.3 * structure).otherwise(structure)


def classify_by_rules(text: Column, structure: Column, matched: Column | None = None, section_rules: dict[str, list[str]] = rules.SECTION_RULES) -> Column:
    """(section_type, confidence): the section with the largest share of its keywords; the first one wins ties; unknown below 0.1."""
    low, own = F.lower(F.coalesce(text, F.lit(""))), F.coalesce(matched, F.array().cast("array<string>")) if matched is not None else None
    scored = []
    for rank, (section, words) in enumerate(section_rules.items()):
        hit = lambda k: F.contains(low, F.lit(k)) if own is None else F.contains(low, F.lit(k)) | F.array_contains(own, k)
        score = reduce(Column.__add__, [hit(k).cast("int") for k in words]) / F.lit(float(len(words)))
        if section == "table":
            score = F.when(structure >= 0.4, F.least(score + 0.3 * structure, F.lit(1.0))).otherwise(score)
        scored.append(F.struct(score.alias("score"), F.lit(-rank).alias("order"), F.lit(section).alias("section")))
    best = F.array_max(F.array(*scored))
    known = best["score"] >= 0.1
    return F.struct(F.when(known, best["section"]).otherwise("unknown").alias("section_type"), F.when(known, best["score"]).otherwise(0.0).alias("confidence"))


def _look_up(table: dict, key: Column, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


# The sentences of `synthesize`.
def synthesize(section: Column, text: Column, matched: Column, confidence: Column, ms: Column) -> dict[str, Column]:
    """Heading, summary, key points and order of a section."""
    heading, body = _look_up(rules.HEADINGS, section, rules.HEADINGS["unknown"]), strip(F.coalesce(text, F.lit("")))
    at = F.format_string("%.1f", ms / 1000)
    percent = F.concat(F.bround(confidence * 100, 0).cast("int").cast("string"), F.lit("%"))
    opening = F.concat(F.lit("This section (captured at "), at, F.lit("s) "))
    with_text = F.concat(opening, F.lit("contains content related to "), F.lower(heading), F.lit('. Extracted text begins: "'), F.left(body, F.lit(300)), F.lit('..."'))
    without = F.concat(opening, F.lit("appears to contain content related to "), F.lower(heading), F.lit(". Full text extraction pending OCR integration."))
    points = F.array_compact(F.array(
        F.when(F.size(matched) > 0, F.concat(F.lit("Matched "), F.size(matched).cast("string"), F.lit(" relevant keyword(s): "), F.array_join(matched, ", "))),
        F.when(section == "table", F.lit("Visual structure suggests tabular or form data.")),
        F.when(confidence >= 0.5, F.concat(F.lit("Classification confidence: "), percent, F.lit("."))).otherwise(F.concat(F.lit("Low classification confidence ("), percent, F.lit("); manual review recommended."))),
        F.when(body == "", F.lit("OCR text not yet available — synthesis is preliminary.")),
    ))
    return {"heading": heading, "summary": F.when(body != "", with_text).otherwise(without), "key_points": points, "order_suggestion": _look_up(rules.ORDER_WEIGHTS, section, 99)}


def report_bucket(section: Column, label: Column | None = None) -> Column:
    by_section = _look_up(rules.SECTION_BUCKETS, section, 5)
    return by_section if label is None else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rules.LABEL_BUCKETS.items() for x in kv]), label), by_section)


def bucket_counts(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    """One row per bucket, empty ones too."""
    every = df.sparkSession.createDataFrame([(b,) for b in rules.BUCKETS], "bucket int")
    counted = df.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def visual_importance(scene: Column, density: Column, relevance_score: Column, blur: Column) -> Column:
    return 0.40 * scene + 0.20 * density + 0.25 * relevance_score + 0.15 * blur


def composite(blur: Column, relevance_score: Column, stability: Column) -> Column:
    return clamp(0.35 * blur + 0.45 * relevance_score + 0.20 * F.coalesce(stability, F.lit(0.5)))


def candidate_score(redundant: Column, importance: Column) -> Column:
    return F.when(redundant, 0.0).otherwise(importance)


def crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """(x1, y1, x2, y2) inside the image; null if nothing is left."""
    bound = lambda v, top: F.greatest(F.lit(0), F.least(v, top))
    x1, y1, x2, y2 = bound(x, width), bound(y, height), bound(x + w, width), bound(y + h, height)
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))
