"""Stacking, wide/long reshapes, shares of a total and grid completion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetally.operators.joins import natural_left_join
from casetally.operators.materialize import materialize


def stack_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """``bind_rows``: union by column name, absent columns become NULL."""
    if not frames:
        raise ValueError("nothing to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unpivot_long(df: DataFrame, ids: Sequence[str], value_cols: Sequence[str],
                 names_to: str = "name", values_to: str = "value") -> DataFrame:
    """``pivot_longer``: one output row per input row and value column (narrow)."""
    return df.unpivot(list(ids), list(value_cols), names_to, values_to)


def pivot_wide(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
               values: Sequence[str], prefix: str = "", drop: Sequence[str] = ()) -> DataFrame:
    """``pivot_wider`` with the level list given explicitly.

    Listing the levels avoids the extra job that discovers them and fixes the
    output schema; a NULL level never becomes a column. ``(ids, names_from)``
    must be unique.
    """
    wide = df.groupBy(*ids).pivot(names_from, list(values)).agg(F.first(values_from))
    wide = wide.withColumnsRenamed({v: f"{prefix}{v}" for v in values})
    return wide.drop(*[f"{prefix}{d}" for d in drop])


def share_of_total(df: DataFrame, by: Sequence[str], value_col: str, out_col: str,
                   scale: float = 100.0) -> DataFrame:
    """``group_by(by) %>% mutate(out = value / sum(value) * scale)``."""
    total = F.sum(value_col).over(Window.partitionBy(*by))
    return df.withColumn(out_col, F.try_divide(F.col(value_col).cast("double"), total) * F.lit(float(scale)))


def level_grid(df: DataFrame | None, dims: dict[str, Sequence | None],
               by: Sequence[str] = ()) -> DataFrame:
    """All combinations of the levels of ``dims`` (within each ``by`` group).

    A dimension given as a list uses those levels; ``None`` takes the distinct
    values found in ``df`` (NULL included, as tidyr does), per ``by`` group
    when given (e.g. levels found in each yearly file). The level sets are
    collected into arrays by one small aggregate (bounded by the dimensions'
    domains) and exploded, so the grid is generated in parallel.
    """
    by = list(by)
    found = [d for d, levels in dims.items() if levels is None]
    if (found or by) and df is None:
        raise ValueError("levels must come from a DataFrame")
    if found or by:
        grouped = df.groupBy(*by) if by else df.groupBy()
        # collect_set drops NULL; carry NULL as an explicit has-null flag.
        row = grouped.agg(*[F.collect_set(d).alias(d) for d in found],
                          *[F.max(F.col(d).isNull().cast("int")).alias(f"__null_{d}") for d in found])
        base = row.select(*by, *[
            F.when(F.col(f"__null_{d}") == 1, F.concat(F.col(d), F.array(F.lit(None).cast(df.schema[d].dataType))))
             .otherwise(F.col(d)).alias(d) for d in found])
    else:
        from pyspark.sql import SparkSession
        base = SparkSession.getActiveSession().range(1).select()
    grid = base
    for d, levels in dims.items():
        arr = F.col(d) if levels is None else F.array(*[F.lit(v) for v in levels])
        grid = grid.withColumn(d, F.explode(arr))
    return grid.select(*by, *dims.keys())


def complete_grid(counts: DataFrame, dims: dict[str, Sequence | None], fill: dict[str, object],
                  by: Sequence[str] = ()) -> DataFrame:
    """``tidyr::complete(dims..., fill = list(n = 0))``, within each ``by`` group.

    The grid of levels is left-joined to the counts with NULL-safe keys, so an
    observed count in a NULL category survives, then the fill value is put in
    the empty cells. With ``by`` (e.g. the year) each group is completed over
    the levels found in that group, as when every yearly file is completed
    on its own.
    """
    # counts are bounded by the grid; materialise them once so discovering the
    # levels and the join below do not both recompute the upstream plan
    counts = materialize(counts)
    grid = level_grid(counts, dims, by=by)
    for d, levels in dims.items():
        if levels is not None:
            grid = grid.withColumn(d, F.col(d).cast(counts.schema[d].dataType))
    out = natural_left_join(grid, counts, keys=[*by, *dims], null_safe=True,
                            broadcast_max_bytes=None)
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in fill.items()})
