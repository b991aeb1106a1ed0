"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target: its weight's share of the wanted total, at most
``max_epochs`` times its own size, what is cut off being shared out again by
weight. A target is met by complete epochs of the source and a fractional one:
its documents are ordered by the exponential key -ln(u) / quality, u being a
hash of the id, sizes are summed in that order, and documents are taken while
the sum is nearer to the rest of the target with them than without.

The order within a source is cut into fine buckets of the key. Bucket sums say
in which bucket the target falls; only that bucket's rows are sorted. The
outcome is one cut per source, so a source with most of the rows is never
gathered anywhere. One-task steps see one row per source.

Defined cases: a null source is a source of its own and comes last; a null or
empty text has size 0 and is taken 0 words; a source of size 0 has target 0; a
null id is drawn like an id of its own; rows with the same id and text are
taken or left together; a null, non-positive or NaN quality counts as 1; an
empty table gives an empty result. Input columns named like a result are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetally.llm.common import keep_columns, row_key, store

SOURCE_WEIGHTS = (5, 2, 1)
BUCKETS = 4096
RESULTS = ["size", "source_size", "target", "copies", "taken"]


@F.pandas_udf(T.LongType())
def word_count(text: pd.Series) -> pd.Series:
    """Runs of anything but ASCII white space (20, 09-0D)."""
    return pd.Series([0 if t is None else len(t.encode("utf-8", "replace").split()) for t in text], dtype="int64")


def exponential_key(id_col: Column, quality: Column, seed: int) -> Column:
    """-ln(u) / quality; u in (0, 1) are 52 bits of the md5 of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    good = F.when(F.isnan(quality) | (quality <= 0), None).otherwise(quality)
    return -F.log(u) / F.coalesce(good, F.lit(1.0))


def targets(sources: DataFrame, ratio: float, weights: tuple, max_epochs: float) -> DataFrame:
    """``sources`` (s, none, source_size) with ``target``. One row per source."""
    by_name = Window.orderBy("none", "s")  # false before true: the null source is last
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("w", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "none", "s")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(ratio))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    level = F.when(level * F.col("w") <= F.col("cap"), level)  # the first source below its cap has the water level
    filled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return filled.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))).select(
        "s", "none", "source_size", "target")


def _measured(docs: DataFrame, quality: DataFrame | None, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    """(id, d, k, s, none, size, key) for every row: all that the sampling needs, without the text."""
    d, k = row_key(F.col(id_col), F.col(text))
    name = F.col(source).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), d, k, F.coalesce(name, F.lit("")).alias("s"), name.isNull().alias("none"),
                       word_count(F.col(text)).alias("size"))
    weight = F.lit(1.0)
    if quality is not None:
        rated, of = quality.columns
        best = quality.groupBy(F.col(rated).alias("rated")).agg(F.max(F.col(of).cast("double")).alias("weight"))
        rows, weight = rows.join(best, rows.id == best.rated, "left"), F.col("weight")
    return rows.select("id", "d", "k", "s", "none", "size", exponential_key(F.col("id"), weight, seed).alias("key"))


def cuts(rows: DataFrame, ratio: float, weights: tuple, max_epochs: float) -> DataFrame:
    """One row per source: its size, target, complete epochs, and the last (key, d, k) of the fractional one."""
    rows = rows.withColumn("bucket", F.floor((1.0 - F.exp(-F.col("key"))) * BUCKETS).cast("int"))
    sums = store(rows.groupBy("s", "none", "bucket").agg(F.sum("size").alias("n")))
    sources = targets(sums.groupBy("s", "none").agg(F.sum("n").alias("source_size")), ratio, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = store(sources.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    run = Window.partitionBy("s", "none").orderBy("bucket")  # at most BUCKETS rows of a source
    edge = store(sums.withColumn("upto", F.sum("n").over(run)).join(sources, ["s", "none"])
            .filter((F.col("upto") - F.col("n") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
            .groupBy("s", "none").agg(F.min("bucket").alias("bucket"), F.min_by(F.col("upto") - F.col("n"), "bucket").alias("before"),
                                      F.first("rest").alias("rest")))
    inside = rows.join(edge, ["s", "none", "bucket"])
    order = Window.partitionBy("s", "none").orderBy("key", "d", "k")  # equal rows share their sum
    taken = inside.withColumn("upto", F.col("before") + F.sum("size").over(order)).filter(
        F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    last = taken.groupBy("s", "none").agg(F.max(F.struct("key", "d", "k")).alias("last"))
    below = edge.select("s", "none", F.col("bucket").alias("edge"))
    return store(sources.join(below, ["s", "none"], "left").join(last, ["s", "none"], "left"))


def plan(docs: DataFrame, quality: DataFrame | None = None, ratio: float = 1.5, weights: tuple = SOURCE_WEIGHTS, max_epochs: float = 2.0,
         seed: int = 1, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, d, k, s, none, size, source_size, target, copies, taken) for every row of ``docs``.

    ``quality`` has two columns, an id and its weight (of several, the largest); ids it lacks weigh 1. ``copies``: how
    often the mix takes the document; ``taken``: copies x size; d and k are ``row_key``."""
    rows = store(_measured(docs, quality, id_col, text, source, seed))
    found = cuts(rows, ratio, weights, max_epochs)
    bucket = F.floor((1.0 - F.exp(-F.col("key"))) * BUCKETS)
    in_part = (bucket < F.col("edge")) | ((bucket == F.col("edge")) & (F.struct("key", "d", "k") <= F.col("last")))
    copies = F.col("epochs") + F.coalesce(in_part, F.lit(False)).cast("long")
    return rows.join(found, ["s", "none"]).select("id", "d", "k", "s", "none", "size", "source_size", "target", copies.alias("copies"),
                                                  (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source",
        **options) -> DataFrame:
    """The mix: rows of ``docs`` that are taken, with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``."""
    planned = plan(docs, quality, id_col=id_col, text=text, source=source, **options).filter(F.col("taken") > 0)
    marks = [F.col(c).alias(f"__{c}") for c in ("d", "k", "s", "none", *RESULTS)]
    planned = planned.dropDuplicates(["d", "k", "s", "none"]).select(*marks)
    d, k = row_key(F.col(id_col), F.col(text))
    name = F.col(source).cast("string")
    keyed = docs.withColumns({"__d": d, "__k": k, "__s": F.coalesce(name, F.lit("")), "__none": name.isNull()})
    return keyed.join(planned, ["__d", "__k", "__s", "__none"]).select(
        *keep_columns(docs, RESULTS), *[F.col(f"__{c}").alias(c) for c in RESULTS])
