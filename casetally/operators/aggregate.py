"""Grouped counts and sums with R's two NA conventions made explicit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetally.functions.arith import count_true, strict_sum


def group_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """``group_by(keys) %>% summarise(n = n())``; a NULL key is its own group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def flag_sums(df: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """``sum(flag, na.rm = TRUE)`` per flag: TRUE count, 0 for an all-NULL group."""
    return df.groupBy(*keys).agg(*[count_true(f).alias(f) for f in flags])


def strict_sums(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Plain ``sum(x)``: a group with any NULL input sums to NULL."""
    return df.groupBy(*keys).agg(*[strict_sum(c).alias(c) for c in cols])


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """``first:last`` column selection by position, as in ``across(a:b, ...)``."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    if i > j:
        raise ValueError(f"{first} comes after {last}")
    return cols[i:j + 1]
