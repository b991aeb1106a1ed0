"""Deduplication of persons and reports.

Row order does not exist in Spark, so "keep the first occurrence" always takes
an explicit total order: the ordering columns plus a unique tiebreak. The
default form is a ``min_by`` aggregate with a map-side partial step, so each
map task forwards at most one row per key: a key holding a third of all rows
is cut down before it reaches one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _order_cols(order: Sequence, descending: bool) -> list[Column]:
    out = []
    for o in order:
        c = F.col(o) if isinstance(o, str) else o
        out.append(c.desc_nulls_last() if descending else c.asc_nulls_last())
    return out


def _desc(c: Column, dtype: T.DataType) -> Column | None:
    """A key that sorts ascending in the descending order of ``c`` (or None)."""
    if isinstance(dtype, T.DateType):
        return -F.unix_date(c)
    if isinstance(dtype, T.TimestampType):
        return -F.unix_micros(c)
    if isinstance(dtype, T.TimestampNTZType):  # wall-clock time: no zone conversion
        return -F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), c)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                          T.DecimalType)):
        return -c
    return None


def ordering_key(df: DataFrame, order: Sequence, tiebreak: Sequence[str], latest: bool = False,
                 first: Sequence[Column] = ()) -> Column | None:
    """Struct whose ascending order is the wanted record order (None if a
    descending order column cannot be reversed arithmetically). ``first``
    columns are compared before everything else."""
    parts = list(first)
    for o in order:
        c = F.col(o) if isinstance(o, str) else o
        if latest:
            rev = _desc(c, df.select(c).schema.fields[0].dataType)
            if rev is None:
                return None
            parts += [c.isNull(), rev]
        else:
            parts += [c.isNull(), c]
    return F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)],
                    *[(F.col(t) if isinstance(t, str) else t).alias(f"t{i}") for i, t in enumerate(tiebreak)])


def row_digest(columns: Sequence[str]) -> Column:
    """A 128-bit digest of all ``columns`` (missing values marked): tells any two different rows apart."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.md5(text.cast("binary"))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence, tiebreak: Sequence,
             latest: bool = False) -> DataFrame:
    """Keep one row per ``keys``.

    ``latest=False`` keeps the smallest ``order`` (first report); ``latest=True``
    the largest (``arrange(desc(date))`` + ``!duplicated``). NULL dates sort
    last either way. ``tiebreak`` (ascending; names or expressions) must make the
    order total; one that is among ``keys`` breaks no tie and is refused.

    Written as ``min_by(row, ordering key)``: an aggregate with a partial
    (map-side) step, so every map task forwards at most one row per key and a
    key holding a third of all rows never lands whole in one task. Order
    columns that cannot be reversed arithmetically (text) use the window form.
    """
    if not tiebreak or all(isinstance(t, str) and t in keys for t in tiebreak):
        raise ValueError("a tiebreak column outside the key is required for a deterministic result")
    ordering = ordering_key(df, order, tiebreak, latest)
    if ordering is None:
        return keep_one_window(df, keys, order, tiebreak, latest)
    payload = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(payload, ordering).alias("__row")).select("__row.*")


def keep_one_window(df: DataFrame, keys: Sequence[str], order: Sequence, tiebreak: Sequence[str],
                    latest: bool = False) -> DataFrame:
    """``row_number() == 1`` form; Catalyst adds a partial ``WindowGroupLimit``
    before the shuffle when the input is not already partitioned by ``keys``."""
    w = Window.partitionBy(*keys).orderBy(
        *_order_cols(order, latest), *[(F.col(t) if isinstance(t, str) else t).asc_nulls_last() for t in tiebreak])
    rn = "__rn"
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) == 1).drop(rn)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence, tiebreak: Sequence[str]) -> DataFrame:
    return keep_one(df, keys, order, tiebreak, latest=False)


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence, tiebreak: Sequence[str]) -> DataFrame:
    return keep_one(df, keys, order, tiebreak, latest=True)


def keep_indexed(df: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep records listed in an external index (first-event index).

    A left semi join: never fans out, even when the index repeats a key.
    """
    return df.join(index.select(*keys), on=list(keys), how="left_semi")


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count (partial aggregation)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
              .filter(F.col("n_rows") > 1))


def uniqueness_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: total rows, distinct keys, keys with duplicates, duplicate rows."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n") > 1).cast("bigint").alias("n_dup_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("bigint").alias("n_extra_rows"),
    )


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise if any key repeats (``length(unique(id)) == nrow(df)`` enforced)."""
    bad = key_violations(df, keys).limit(5).collect()
    if bad:
        raise AssertionError(f"keys {list(keys)} are not unique, e.g. {[r.asDict() for r in bad]}")
