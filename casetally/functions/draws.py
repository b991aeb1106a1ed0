"""Reproducible random draws keyed by row identity.

A draw is a pure function of (seed, row key, imputation, target, round), so it
does not depend on partitioning, task retries or executor loss: a recomputed
task yields exactly the same numbers. The integer form is chosen so that an
ANSI SQL engine can replay it: ``md5`` of the ``|``-joined key, first 8 hex
digits read as an unsigned 32-bit integer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def uniform_u32(*parts) -> Column:
    """Integer in [0, 2**32) derived from the key parts (bigint). A missing part counts as a part (``\\N``)."""
    cols = [_c(p) if not isinstance(p, (int, float)) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def scaled(u: Column, total: Column) -> Column:
    """floor(u * total / 2**32) for u below 2**32, without overflow for totals below 2**47: by halves of u."""
    high, low = F.shiftright(u, 16), u.bitwiseAND(0xFFFF)
    return F.shiftright(high * total + F.shiftright(low * total, 16), 16)
