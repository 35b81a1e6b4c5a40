"""Scalar text and number helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space (what an ASCII \\s matches) at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))


def blank_to(c: Column, other: Column) -> Column:
    """The column, or the other one where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def frame_ref(index: Column) -> Column:
    return F.format_string("frame_%06d", index)


def minutes(ms: Column) -> Column:
    """MM:SS"""
    return F.format_string("%02d:%02d", F.floor(ms / 60000), F.floor(ms / 1000) % 60)


def minutes_ms(ms: Column) -> Column:
    """MM:SS.mmm"""
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def safe_name(c: Column) -> Column:
    return F.left(F.regexp_replace(c, r"[^\w\-.]", "_"), F.lit(200))


def mask_ssn(c: Column) -> Column:
    return F.regexp_replace(c, r"^\d{3}-\d{2}", "***-**")


# Expressions of the two cleanings.
CONTROLS, WIDE, ONE_SIGN, MANY_LINES = r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " {3,}", r"^[\p{L}\p{N}]$", "\n{4,}"
NOT_PRINTABLE, PHONE = r"[^\x20-\x7E]+", r"\(?\b\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}\b"
DATES = [r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b", r"\b\d{4}[/\-]\d{1,2}[/\-]\d{1,2}\b"]
PHONE_MARK, DATE_MARK = "PHONE_NO", "DATE_VAL"


def clean_ocr(text: Column) -> Column:
    """Control characters out, wide gaps to two blanks, one-sign lines out, at most two blank lines in a row."""
    t = F.regexp_replace(F.regexp_replace(text, CONTROLS, ""), WIDE, "  ")
    kept = F.filter(F.split(t, "\n", -1), lambda x: (F.char_length(strip(x)) != 1) | strip(x).rlike(ONE_SIGN))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), MANY_LINES, "\n\n\n"))


def readable_lines(text: Column, most: int = 18) -> Column:
    """Distinct paragraphs with heading marks and white space cleaned, first ones first."""
    parts = F.transform(F.split(text, "\n{2,}", -1), lambda x: strip(F.regexp_replace(F.regexp_replace(x, "^#+", ""), r"\s+", " ")))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, most)


def normalise_for_model(text: Column) -> Column:
    """Printable ASCII, single blanks, phone numbers and dates as placeholders, lower case."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, NOT_PRINTABLE, " "), " {2,}", " "), PHONE, PHONE_MARK)
    for pattern in DATES:
        t = F.regexp_replace(t, pattern, DATE_MARK)
    return F.lower(F.btrim(t))
