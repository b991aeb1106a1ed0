"""Connected components of a link table, as rounds of grouped minima and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetally.llm.common import store


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of ``edges`` (columns u, v) that is not its component's smallest, that smallest node.

    Alternates the two star steps until the table of links no longer changes;
    the number of rounds grows with the logarithm of the longest path. Links
    stay in Spark, every round is stored in the shared folder, and the joins
    are plain equi-joins that adaptive execution splits where a hub is hot.
    """
    def mark(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = store(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct())
    seen = mark(now)
    while seen[0]:
        now = store(_small_star(_large_star(now).distinct()).distinct())
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
