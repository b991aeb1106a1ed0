"""Joins with explicit keys and a checked broadcast.

R joins without ``by`` match on every shared column name and treat NA as equal
to NA; SQL equality drops NULL keys. ``natural_left_join`` makes the keys
explicit and offers both behaviours.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when the optimizer's size estimate (an upper bound
# for scans, filters and aggregates without CBO) is below this.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan, or None if unavailable."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - e.g. Spark Connect sessions
        return None


def sized_broadcast(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only for a side whose estimated size is within bounds.

    Larger (or unknown) sides are left to the sort-merge join, which AQE can
    still turn into a broadcast once the shuffle has measured the real size.
    """
    size = estimated_bytes(df)
    if size is not None and size <= max_bytes:
        return F.broadcast(df)
    return df


def shared_keys(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str] | None = None,
                      null_safe: bool = True, how: str = "left",
                      broadcast_max_bytes: int | None = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Left join on ``keys`` (default: all shared names), keys appear once.

    ``null_safe=True`` matches NULL to NULL (``<=>``), which Spark still plans
    as an equi-join. The right side is broadcast only if its size is checked.
    """
    keys = list(keys) if keys is not None else shared_keys(left, right)
    if not keys:
        raise ValueError("no join keys: the tables share no column names")
    if not null_safe:
        r = sized_broadcast(right, broadcast_max_bytes) if broadcast_max_bytes else right
        return left.join(r, on=keys, how=how)
    renamed = {k: f"__r_{k}" for k in keys}
    r = right.withColumnsRenamed(renamed)
    if broadcast_max_bytes:
        r = sized_broadcast(r, broadcast_max_bytes)
    cond = reduce(lambda a, b: a & b,
                  [left[k].eqNullSafe(r[renamed[k]]) for k in keys])
    joined = left.join(r, on=cond, how=how)
    if how in ("full", "outer", "full_outer", "right", "right_outer"):
        # rows present only on the right carry their keys in the right copy
        joined = joined.withColumns({k: F.coalesce(left[k], F.col(renamed[k])) for k in keys})
    return joined.drop(*renamed.values())


def semi_join(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``filter(x %in% members$x)``: NULL keys never match, rows never fan out."""
    return df.join(members.select(*keys), on=list(keys), how="left_semi")
