"""Rates per 1,000, Total rows, ratio of sums and rate ratios.

These run on pooled tables whose size is bounded by the key domain
(years x units x groups), never by the number of case records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetally.functions.arith import rate_per, safe_ratio, strict_sum
from casetally.functions.recode import binary_label


def add_rates(df: DataFrame, pairs: dict[str, str], pop_col: str = "pop",
              per: float = 1000.0) -> DataFrame:
    """``rate = n / pop * 1000`` for each ``{rate_col: count_col}``; NULL for pop 0."""
    return df.withColumns({r: rate_per(F.col(n), F.col(pop_col), per) for r, n in pairs.items()})


def with_total_rows(df: DataFrame, by: Sequence[str], group_col: str, sum_cols: Sequence[str],
                    label: str = "Total") -> DataFrame:
    """Append one row per ``by`` cell summing ``sum_cols`` over ``group_col``.

    Uses GROUPING SETS so the group rows and the Total rows come from one
    aggregation; the Total label is set from ``grouping()``, so a genuine NULL
    group stays NULL instead of being mistaken for the Total row. Sums are
    plain (NULL-propagating). The per-group pooled minima and maxima are
    summed, giving the wider, conservative Total bounds.
    """
    keys = list(by) + [group_col]
    rest = [c for c in df.columns if c not in keys and c not in sum_cols]
    if rest:
        raise ValueError(f"columns {rest} are neither keys nor summed; drop them first")
    agg = (df.groupingSets([keys, list(by)], *keys)
             .agg(*[strict_sum(c).alias(c) for c in sum_cols],
                  F.grouping(group_col).alias("__total")))
    agg = agg.withColumn(group_col, F.when(F.col("__total") == 1, F.lit(label))
                         .otherwise(F.col(group_col)))
    return agg.drop("__total").select(*df.columns)


def ratio_of_sums(df: DataFrame, by: Sequence[str], num_col: str, den_col: str,
                  name: str = "rate", per: float = 1000.0) -> DataFrame:
    """``sum(n) / sum(pop) * 1000`` per group (pooled rate)."""
    return df.groupBy(*by).agg(
        rate_per(F.sum(num_col), F.sum(den_col), per).alias(name))


def rate_ratios(df: DataFrame, by: Sequence[str], group_col: str, reference: str,
                rate_cols: Sequence[str] = ("r_mn", "r_min", "r_max"),
                ref_names: Sequence[str] = ("wht_mn", "wht_min", "wht_max"),
                drop_groups: Sequence[str] = ("Total",),
                label_col: str = "grt1",
                labels: tuple[str, str] = ("Greater than white rate",
                                           "Less than or equal to white rate")) -> DataFrame:
    """Rate ratio of each group to the reference group in the same ``by`` cell.

    ``d = r / ref``, ``d_min = r_min / ref_max``, ``d_max = r_max / ref_min``
    (interval bounds), division by zero gives NULL. The reference rates are
    attached with a window partitioned by ``by`` (one shuffle of the pooled
    table, no self-join). The reference group and ``drop_groups`` are removed;
    ``label_col`` says whether the lower bound exceeds 1 (NULL when unknown).
    """
    r_mn, r_min, r_max = rate_cols
    w_mn, w_min, w_max = ref_names
    w = Window.partitionBy(*by)
    is_ref = F.col(group_col) == F.lit(reference)
    out = df.withColumns({
        w_mn: F.max(F.when(is_ref, F.col(r_mn))).over(w),
        w_min: F.max(F.when(is_ref, F.col(r_min))).over(w),
        w_max: F.max(F.when(is_ref, F.col(r_max))).over(w),
    })
    out = out.withColumns({
        "d": safe_ratio(r_mn, w_mn),
        "d_min": safe_ratio(r_min, w_max),
        "d_max": safe_ratio(r_max, w_min),
    })
    keep = ~F.coalesce(F.col(group_col).isin([reference, *drop_groups]), F.lit(False))
    out = out.filter(keep & F.col(group_col).isNotNull())
    return out.withColumn(label_col, binary_label(F.col("d_min") > 1, *labels))
