"""Pooling counts over multiple imputations (mean, minimum, maximum).

Two conventions exist in the analysis: a (key, imputation) cell that has no
records either disappears before pooling (``complete=False``), or counts as 0
(``complete=True``). Both are exposed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POOLED = ("n_mean", "n_min", "n_max")


def pool_counts(counts: DataFrame, keys: Sequence[str], m: int, imp_col: str = "imp",
                n_col: str = "n", names: Sequence[str] = POOLED,
                complete: bool = False) -> DataFrame:
    """Per-(keys, imp) counts -> mean/min/max over imputations.

    ``complete=True`` treats imputations missing for a key as zero counts.
    The mean is a single division of an integer total, so it is exact to the
    last bit whatever the summation order.
    """
    mean_n, min_n, max_n = names
    agg = counts.groupBy(*keys).agg(
        F.sum(n_col).cast("bigint").alias("__sum"),
        F.min(n_col).cast("bigint").alias("__min"),
        F.max(n_col).cast("bigint").alias("__max"),
        F.count(F.lit(1)).alias("__k"),  # one row per (keys, imp)
    )
    if complete:
        out = agg.withColumns({
            mean_n: F.col("__sum") / F.lit(float(m)),
            min_n: F.when(F.col("__k") < m, F.lit(0).cast("bigint")).otherwise(F.col("__min")),
            max_n: F.greatest(F.col("__max"), F.lit(0).cast("bigint")),
        })
    else:
        out = agg.withColumns({
            mean_n: F.col("__sum") / F.col("__k").cast("double"),
            min_n: F.col("__min"),
            max_n: F.col("__max"),
        })
    return out.drop("__sum", "__min", "__max", "__k")


def count_and_pool(long_df: DataFrame, keys: Sequence[str], m: int, imp_col: str = "imp",
                   names: Sequence[str] = POOLED, complete: bool = False) -> DataFrame:
    """Completed long records -> count per (keys, imp) -> pooled statistics."""
    counts = long_df.groupBy(*keys, imp_col).agg(F.count(F.lit(1)).alias("n"))
    return pool_counts(counts, keys, m, imp_col, "n", names, complete)


def pool_split(observed: DataFrame, drawn: DataFrame, keys: Sequence[str], m: int,
               value: str = "n", imp_col: str = "imp", names: Sequence[str] = POOLED,
               complete: bool = False) -> DataFrame:
    """Pool a quantity split into a part shared by all imputations and a drawn part.

    ``observed`` has one row per key with ``value``: the contribution that is
    identical in every imputation (records without imputed values). ``drawn``
    has one row per (key, imp) with the contribution of imputed records.
    Per key and imputation the quantity is the sum of both; a (key, imp)
    cell exists when either part has a row for it. Values must be
    non-negative (counts, sums of flags). The result equals pooling the
    fully expanded long table, but observed records are never replicated.
    """
    mean_n, min_n, max_n = names
    obs = observed.select(*keys, F.col(value).cast("bigint").alias("__obs"))
    dr = drawn.groupBy(*keys).agg(
        F.sum(value).cast("bigint").alias("__dsum"),
        F.min(value).cast("bigint").alias("__dmin"),
        F.max(value).cast("bigint").alias("__dmax"),
        F.count(F.lit(1)).alias("__dk"),
    )
    from casetally.operators.joins import natural_left_join
    both = natural_left_join(obs, dr, keys=list(keys), null_safe=True, how="full",
                             broadcast_max_bytes=None)
    has_obs = F.col("__obs").isNotNull()
    o = F.coalesce(F.col("__obs"), F.lit(0)).cast("bigint")
    dsum = F.coalesce(F.col("__dsum"), F.lit(0)).cast("bigint")
    dk = F.coalesce(F.col("__dk"), F.lit(0))
    # minimum over all m imputations when drawn cells missing in some count 0
    dmin_all = F.when(dk < m, F.lit(0)).otherwise(F.col("__dmin")).cast("bigint")
    dmax = F.coalesce(F.col("__dmax"), F.lit(0)).cast("bigint")
    if complete:
        mean = (o * F.lit(m) + dsum) / F.lit(float(m))
        lo = o + dmin_all
        hi = o + dmax
    else:
        present = F.when(has_obs, F.lit(m)).otherwise(dk)
        mean = (o * present + dsum) / present.cast("double")
        lo = F.when(has_obs, o + dmin_all).otherwise(F.col("__dmin"))
        hi = o + dmax
    return both.select(*keys, mean.alias(mean_n), lo.cast("bigint").alias(min_n),
                       hi.cast("bigint").alias(max_n))


def sparse_pool(observed: DataFrame, drawn: DataFrame, keys: Sequence[str], m: int,
                imp_col: str = "imp", names: Sequence[str] = POOLED,
                complete: bool = False) -> DataFrame:
    """Pool record counts without replicating observed records m times.

    ``observed`` holds records whose keys are fully observed (counted once,
    valid in every imputation); ``drawn`` holds one row per (record, imp) for
    records with imputed values. Only valid when no filter or deduplication
    depends on an imputed column of the observed records.
    """
    obs = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    per_imp = drawn.groupBy(*keys, imp_col).agg(F.count(F.lit(1)).alias("n"))
    return pool_split(obs, per_imp, keys, m, "n", imp_col, names, complete)
