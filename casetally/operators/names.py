"""Projection helpers on column names (lower-casing, de-duplicated select, rename)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def lower_names(df: DataFrame) -> DataFrame:
    """``rename_all(tolower)``; refuses to create two columns with one name."""
    lowered = [c.lower() for c in df.columns]
    dupes = {c for c in lowered if lowered.count(c) > 1}
    if dupes:
        raise ValueError(f"lower-casing makes duplicate columns: {sorted(dupes)}")
    return df.toDF(*lowered)


def select_unique(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """``select(a, b, a)``: a column named twice is kept once, first position."""
    seen: list[str] = []
    for c in cols:
        if c not in seen:
            seen.append(c)
    return df.select(*seen)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """``rename(new = old)`` given as ``{old: new}``; unknown names raise."""
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        raise KeyError(f"cannot rename absent columns {missing}")
    return df.withColumnsRenamed(mapping)
