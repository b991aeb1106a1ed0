"""Data-quality screening of reporting units (unit-years)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetally.functions.arith import count_true, prop_missing, prop_true
from casetally.functions.recode import not_in_keep_null


def quality_flags(df: DataFrame, unit_cols: Sequence[str], flag_col: str,
                  exclude: Sequence[str] = (), exclude_col: str | None = None,
                  max_missing: float = 0.20, min_share: float = 0.01,
                  flag_name: str = "flag_1") -> DataFrame:
    """Per unit: share missing, share TRUE (of all rows), TRUE count, pass flag.

    One aggregation pass with partial aggregation, so a unit holding a third
    of all rows is reduced map-side. A unit passes when the missing share is
    at most ``max_missing`` and the TRUE share at least ``min_share`` (both
    bounds inclusive). Units whose ``exclude_col`` is in ``exclude`` are dropped
    (a NULL unit is kept).
    """
    q = df.groupBy(*unit_cols).agg(
        prop_missing(flag_col).alias("prop_missing"),
        prop_true(flag_col).alias("share_true"),
        count_true(flag_col).alias("n_true"),
    )
    if exclude:
        q = q.filter(not_in_keep_null(exclude_col or unit_cols[0], list(exclude)))
    return q.withColumn(flag_name, (F.col("prop_missing") <= F.lit(max_missing))
                        & (F.col("share_true") >= F.lit(min_share)))


def quality_gate(df: DataFrame, quality: DataFrame, keys: Sequence[str],
                 flag_name: str = "flag_1") -> DataFrame:
    """Keep records of units that passed (left join + ``filter(flag == TRUE)``).

    Written as a semi join against the passing units: no fan-out, and the
    passing-unit table is bounded by units x years.
    """
    passing = quality.filter(F.col(flag_name)).select(*keys)
    return df.join(passing, on=list(keys), how="left_semi")
