"""Stand-in case and population tables built from the driver tables.

The surveillance operators are generic over column roles. On the driver
tables the roles are played by:

* case record = one order (``row_key`` = ``o_orderkey``, unique);
* person = ``o_custkey``; unit ("state") = customer nation name;
* year = order year; report date = order date (missing for low-priority
  pending orders);
* medical source = urgent priority;
* group ("race_ethn") = customer market segment, missing for orders of
  unspecified priority that are not finished;
* three-valued exposure flag ("ipse") = order status F -> TRUE, O -> FALSE,
  P -> missing;
* maltreatment-type slots ``chmal1..4`` = codes derived from order fields;
* numeric target ("amount") = order value in thousands, missing for
  unfinished orders of unspecified or low priority;
* population = customers per (nation, segment).

Line-level stand-ins use ``lineitem`` with the supplier nation as unit.
All NULLs are derived from data attributes; no rows are filtered away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetally.functions import recode as R

# Reference group of the stand-in (plays the role of the White group).
REFERENCE_GROUP = "BUILDING"
# Unit dropped by hand from the balanced panel (plays the role of a unit
# whose time series is known to be broken).
DROPPED_UNIT = "NATION_5"
SEED = 57
M = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, F.col("c_nationkey") == F.col("n_nationkey")))
    prio = F.col("o_orderpriority")
    status = F.col("o_orderstatus")
    return j.select(
        F.col("o_orderkey").alias("row_key"),
        F.col("o_custkey").alias("person"),
        F.col("n_name").alias("state"),
        F.year("o_orderdate").cast("int").alias("year"),
        F.when((status == "P") & (prio == "5-LOW"), F.lit(None))
         .otherwise(F.col("o_orderdate").cast("date")).alias("rptdt"),
        (prio == "1-URGENT").alias("medical"),
        F.when((prio == "4-NOT SPECIFIED") & (status != "F"), F.lit(None))
         .otherwise(F.col("c_mktsegment")).alias("race_ethn"),
        R.ladder([(status == "F", True), (status == "O", False)]).alias("ipse"),
        F.substring(prio, 1, 1).cast("int").alias("chmal1"),
        R.ladder([(status == "O", 2), (status == "F", 6)]).alias("chmal2"),
        F.when(F.col("o_totalprice") >= 400000, F.lit(4)).alias("chmal3"),
        F.when(F.dayofmonth("o_orderdate") == 1, F.lit(3)).alias("chmal4"),
        F.when((status == "P") & prio.isin("4-NOT SPECIFIED", "5-LOW"), F.lit(None))
         .otherwise(F.round(F.col("o_totalprice") / 1000).cast("int")).alias("amount"),
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per (unit, group): the denominator table."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
             .groupBy(F.col("n_name").alias("state"), F.col("c_mktsegment").alias("race_ethn"))
             .agg(F.count(F.lit(1)).alias("pop")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-level records with the supplier nation as unit and ship year."""
    li = table(spark, sf_dir, "lineitem")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (li.join(s, li.l_suppkey == s.s_suppkey)
              .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
              .withColumn("unit", F.col("n_name"))
              .withColumn("year", F.year("l_shipdate").cast("int")))


def line_slots(df: DataFrame) -> DataFrame:
    """Four code slots per line (1 yes / 2 no / other / missing) for tri flags."""
    return df.withColumns({
        "s1": R.ladder([(F.col("l_returnflag") == "R", 1), (F.col("l_returnflag") == "A", 2)]),
        "s2": R.ladder([(F.col("l_linestatus") == "O", 2), (F.col("l_quantity") > 45, 1)], default=9),
        "s3": (F.when(F.col("l_discount") == 0.1, F.lit(1))
                .when(F.col("l_discount") == 0.0, F.lit(None))
                .otherwise(F.lit(9))),
        "s4": R.ladder([(F.col("l_tax") == 0.08, 1), (F.col("l_tax") == 0.0, 2)]),
    })


def line_type_slots(df: DataFrame) -> DataFrame:
    """Four maltreatment-type-like code slots per line, with NULLs."""
    disc = F.round(F.col("l_discount") * 100).cast("int")
    return df.withColumns({
        "m1": R.null_if("l_linenumber", 7),
        "m2": F.when(F.col("l_returnflag") == "N", F.lit(None)).otherwise(disc % 6 + 1),
        "m3": F.when(F.col("l_quantity") > 30, F.col("l_quantity").cast("int") % 7 + 1),
        "m4": R.ladder([(F.col("l_tax") >= 0.07, 4), (F.col("l_tax") == 0.0, 5)]),
    })


def type_flags(slots: list[str]) -> dict:
    """Non-exclusive type flags over code slots (Kleene OR)."""
    return {
        "phy_abuse": R.any_equals(slots, 1),
        "neglect": R.any_in(slots, [2, 3]),
        "sex_abuse": R.any_equals(slots, 4),
        "other": R.any_above(slots, 4),
    }


TYPE_COLUMNS = ["phy_abuse", "neglect", "sex_abuse", "other"]


def population_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons at risk per (year, unit, group): customers with an order that year.

    Summed over groups it gives the per-year denominator, so the group and
    total denominators nest as in the surveillance tables.
    """
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
          .select(F.year("o_orderdate").cast("int").alias("year"), F.col("n_name").alias("state"),
                  F.col("c_mktsegment").alias("race_ethn"), "o_custkey"))
    per_person = j.distinct()
    return per_person.groupBy("year", "state", "race_ethn").agg(F.count(F.lit(1)).alias("pop"))


# Hot-deck targets of the stand-in cases and their cells (finest first; the
# whole table is the last fallback).
TARGETS = {"race_ethn": [["state", "year"], ["state"]],
           "ipse": [["state", "year"], ["state"]]}
GROUP_LEVELS = ["Total", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
EXCLUDED_UNITS = ["NATION_1", "NATION_2"]
FOCUS_YEAR = 2000
ORDER_GROUP = "AUTOMOBILE"
