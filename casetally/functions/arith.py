"""Null-safe arithmetic and aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(num, den) -> Column:
    """``num / den`` with NULL (not an error, not Inf) for a zero or NULL den."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def rate_per(num, den, per: float = 1000.0) -> Column:
    """Rate per ``per`` population: ``num / den * per``; NULL for den 0."""
    return safe_ratio(num, den) * F.lit(float(per))


def count_true(col) -> Column:
    """``sum(flag, na.rm = TRUE)``: number of TRUE values, 0 when all NULL."""
    return F.count_if(_c(col)).cast("bigint")


def count_missing(col) -> Column:
    return F.count_if(_c(col).isNull()).cast("bigint")


def strict_sum(col) -> Column:
    """``sum(x)`` without ``na.rm``: NULL as soon as one input is NULL."""
    c = _c(col)
    return F.when(F.count_if(c.isNull()) > 0, F.lit(None)).otherwise(F.sum(c))


def prop_missing(col) -> Column:
    """Share of rows (all rows) whose value is missing."""
    return count_missing(col) / F.count(F.lit(1))


def prop_true(col) -> Column:
    """Share of all rows (NULL rows included in the denominator) that are TRUE."""
    return count_true(col) / F.count(F.lit(1))
