"""Sums with both NA conventions, quality flags, joins, panels."""

from pyspark.sql import functions as F

from casetally.functions import arith as A
from casetally.operators import aggregate as AG
from casetally.operators import joins as J
from casetally.operators import panel as PN
from casetally.operators import quality as Q
from helpers import rows


def test_strict_vs_na_rm_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 2), ("b", None)], "g string, x int")
    out = df.groupBy("g").agg(A.strict_sum("x").alias("strict"), F.sum("x").alias("loose"),
                              A.count_true(F.col("x") > 0).alias("pos"))
    assert rows(out) == [("a", None, 3, 2), ("b", None, None, 0)]


def test_group_count_keeps_null_group(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "g string")
    assert rows(AG.group_count(df, ["g"])) == [(None, 2), ("a", 1)]


def test_quality_boundary_and_all_missing(spark):
    ten = [("S", 2019, v) for v in [True, None, None] + [False] * 7]
    four = [("T", 2019, None)] * 4
    df = spark.createDataFrame(ten + four, "unit string, year int, flag boolean")
    q = Q.quality_flags(df, ["unit", "year"], "flag", max_missing=0.2, min_share=0.01)
    got = {r.unit: r for r in q.collect()}
    assert got["S"].prop_missing == 0.2 and got["S"].share_true == 0.1 and got["S"].flag_1 is True
    assert got["T"].prop_missing == 1.0 and got["T"].n_true == 0 and got["T"].flag_1 is False
    gated = Q.quality_gate(df, q, ["unit", "year"])
    assert gated.count() == 10


def test_quality_exclusion_keeps_null_unit(spark):
    df = spark.createDataFrame([("X", 1, True), (None, 1, True), ("Y", 1, False)], "unit string, year int, flag boolean")
    q = Q.quality_flags(df, ["unit", "year"], "flag", exclude=["X"])
    assert rows(q, "unit") == [(None,), ("Y",)]


def test_natural_join_null_safe(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, n int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, pop int")
    assert rows(J.natural_left_join(left, right), "k", "n", "pop") == [(None, 1, 10), ("a", 2, 20)]
    assert rows(J.natural_left_join(left, right, null_safe=False), "k", "n", "pop") == [(None, 1, None), ("a", 2, 20)]


def test_full_null_safe_join_keeps_right_keys(spark):
    left = spark.createDataFrame([("a", 1)], "k string, n int")
    right = spark.createDataFrame([("b", 2)], "k string, m int")
    out = J.natural_left_join(left, right, how="full", broadcast_max_bytes=None)
    assert rows(out, "k", "n", "m") == [("a", 1, None), ("b", None, 2)]


def test_balanced_panel(spark):
    data = [("A", y) for y in range(4)] + [("B", y) for y in range(4)] + [("C", y) for y in range(3)]
    df = spark.createDataFrame(data, "unit string, year int")
    assert rows(PN.full_panel_units(df, "unit"), "unit") == [("A",), ("B",)]
    assert rows(PN.keep_full_panel(df, "unit", drop_units=["B"]).select("unit").distinct()) == [("A",)]


def test_level_order_with_tiebreak(spark):
    df = spark.createDataFrame([("B", 1.0), ("A", 1.0), ("C", 0.5)], "unit string, r double")
    assert rows(PN.level_order(df, "unit", ["r"])) == [("A", 2), ("B", 3), ("C", 1)]


def test_uniqueness(spark):
    import pytest
    from casetally.operators import dedup as D
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    s = D.uniqueness_summary(df, ["k"]).first()
    assert (s.n_rows, s.n_keys, s.n_dup_keys, s.n_extra_rows) == (3, 2, 1, 1)
    with pytest.raises(AssertionError):
        D.assert_unique(df, ["k"])
    D.assert_unique(df.distinct(), ["k"])


def test_materialize_and_release(spark):
    from casetally.operators import materialize as MZ
    df = spark.range(10).withColumnRenamed("id", "k")
    saved = MZ.materialize(df)
    assert saved.count() == 10
    from pyspark.sql import functions as F
    stats = {"n": F.count("*"), "top": F.max("k")}
    assert MZ.saved_with_stats(df, stats).count() == 10 and stats == {"n": 10, "top": 9}
    assert MZ.release_materialized(spark)
    assert not MZ.release_materialized(spark)
