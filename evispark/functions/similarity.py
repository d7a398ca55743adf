"""Similarities of texts that no built-in expression gives, as Arrow batches."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().casefold()


def _blocks(a: str, b: str) -> list:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, _flat(x), _flat(y), autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _coverages(claim: pd.Series, source: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        x, y = _flat(x), _flat(y)
        return sum(m.size for m in _blocks(x, y)) / len(x) if x else 0.0

    return pd.Series([one(x, y) for x, y in zip(claim, source, strict=True)], dtype="float64")


def similarity(a: Column | str, b: Column | str) -> Column:
    """Ratcliff-Obershelp ratio of the normalized texts; null if either is null."""
    return F.pandas_udf(_ratios, "double")(a, b)


def lexical_coverage(claim: Column | str, source: Column | str) -> Column:
    """The share of the claim's characters in blocks that it shares with the source, 0 for an empty claim."""
    return F.pandas_udf(_coverages, "double")(claim, source)


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio of two texts can be at most, by their lengths."""
    return F.try_divide(2.0 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b))
