"""Seams for what this library does not bring: recognisers, statistical taggers, spelling, renderers.

A tagger is a function from a list of texts to lists of (start, end, label); without one, the layer is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .shipping import ship

Tagger = Callable[[list[str]], list[list[tuple[int, int, str]]]]


def tagged(df: DataFrame, key: str, text: str, tagger: Tagger | None, most: int = 100_000) -> DataFrame:
    """(key, start, end, text, label, error): a tagger's entities in the first `most` characters that a model takes; a failing text has an error row."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                t = (t or "")[:most]
                try:
                    out += [(k, s, e, t[s:e], label, None) for s, e, label in (tagger([t])[0] if tagger else [])]
                except Exception as error:  # one text must not end the batch
                    out.append((k, None, None, None, None, str(error)[:200]))
            yield pd.DataFrame(out, columns=["key", "start", "end", "text", "label", "error"]).astype({"start": "Int64", "end": "Int64"})

    return df.select(key, text).mapInPandas(run, f"key {kind}, start bigint, end bigint, text string, label string, error string")
