"""Balanced panels and data-driven level orders on pooled tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetally.operators.joins import semi_join


def full_panel_units(df: DataFrame, unit_col: str) -> DataFrame:
    """Units whose row count equals the largest row count (``filter(n == max(n))``).

    The maximum is a one-row aggregate joined back by broadcast (a proven
    one-row side), so no single-partition window is needed.
    """
    counts = df.groupBy(unit_col).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("__max_n"))
    return (counts.join(F.broadcast(top), F.col("n") == F.col("__max_n"), "inner")
                  .drop("__max_n"))


def keep_full_panel(df: DataFrame, unit_col: str, drop_units: Sequence[str] = ()) -> DataFrame:
    """Rows of units in the full panel, minus units excluded by hand."""
    units = full_panel_units(df, unit_col).select(unit_col)
    out = semi_join(df, units, [unit_col])
    if drop_units:
        out = out.filter(~F.col(unit_col).isin(list(drop_units)))
    return out


def level_order(df: DataFrame, key_col: str, sort_cols: Sequence, ord_col: str = "ord",
                where: Column | None = None) -> DataFrame:
    """``filter(where) %>% arrange(sort) %>% mutate(ord = 1:n())`` -> (key, ord).

    Runs on a pooled table with one row per unit (tens of rows); the key
    column is the final tiebreak so the order is total. The resulting order
    is joined back to label the category (``factor(levels = order$key)``).
    """
    src = df.filter(where) if where is not None else df
    order = [(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in sort_cols]
    w = Window.orderBy(*order, F.col(key_col).asc_nulls_last())
    return src.select(key_col, F.row_number().over(w).alias(ord_col))
