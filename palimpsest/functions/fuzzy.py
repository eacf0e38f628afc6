"""Similarity of texts that built-in functions can't express; Arrow batches, nothing by row call."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def partial_ratio(a: str | None, b: str | None) -> float:
    """The best similarity, 0 to 1, of the shorter text with a window as long as it in the longer one.

    Windows start where matching blocks of the two texts line up. Null and
    empty texts are alike only to each other.
    """
    a, b = a or "", b or ""
    if not a or not b:
        return 1.0 if a == b else 0.0
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if short in long_:
        return 1.0
    best = 0.0
    whole = SequenceMatcher(None, short, long_, autojunk=False)
    for i, j, n in whole.get_matching_blocks():
        start = max(0, j - i)
        window = long_[start : start + len(short)]
        if n or not best:
            best = max(best, SequenceMatcher(None, short, window, autojunk=False).ratio())
    return best


@F.pandas_udf(T.DoubleType())
def _partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([round(partial_ratio(x, y), 6) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def _component_recall(text: pd.Series, components: pd.Series, least: pd.Series) -> pd.Series:
    out = []
    for t, parts, x in zip(text, components, least, strict=True):
        parts = [p for p in (parts if parts is not None else []) if p]
        out.append(round(sum(partial_ratio((t or "").lower(), p.lower()) >= x for p in parts) / len(parts), 6) if parts else None)
    return pd.Series(out, dtype="float64")


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """:func:`partial_ratio` of two text columns, in lower case."""
    return _partial_ratio(F.lower(a), F.lower(b))


def component_recall(text: Column, components: Column, least: float = 0.7) -> Column:
    """Share of the components that a text has with a partial ratio of ``least``; null without components."""
    return _component_recall(text, components, F.lit(least))
