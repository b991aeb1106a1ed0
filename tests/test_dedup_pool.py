"""Deduplication order, per-imputation dedup, pooling conventions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from casetally.operators import dedup as D
from casetally.operators import pool as PL
from helpers import rows

d1, d2 = dt.date(2019, 1, 1), dt.date(2019, 6, 1)


def test_keep_latest_nulls_last_and_tiebreak(spark):
    df = spark.createDataFrame([("p", 1, d1), ("p", 2, d2), ("p", 3, None),
                                ("q", 5, d1), ("q", 4, d1)], "person string, rk int, d date")
    latest = D.keep_latest(df, ["person"], ["d"], ["rk"])
    assert rows(latest) == [("p", 2, d2), ("q", 4, d1)]
    first = D.keep_first(df, ["person"], ["d"], ["rk"])
    assert rows(first) == [("p", 1, d1), ("q", 4, d1)]


def test_dedup_is_per_imputation_and_idempotent(spark):
    df = spark.createDataFrame([(1, "p", 1, d1), (1, "p", 2, d2), (2, "p", 1, d1), (2, "p", 2, d2)],
                               "imp int, person string, rk int, d date")
    once = D.keep_latest(df, ["imp", "person"], ["d"], ["rk"])
    assert rows(once, "imp", "rk") == [(1, 2), (2, 2)]
    assert rows(D.keep_latest(once, ["imp", "person"], ["d"], ["rk"])) == rows(once)


def test_keep_latest_is_partially_aggregated(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id"))
    plan = D.keep_latest(df, ["k"], ["id"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    wplan = D.keep_one_window(df, ["k"], ["id"], ["id"], True)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in wplan
    assert rows(D.keep_latest(df, ["k"], ["id"], ["id"])) == rows(D.keep_one_window(df, ["k"], ["id"], ["id"], True))


def test_keep_latest_text_order_falls_back(spark):
    df = spark.createDataFrame([("p", "b", 1), ("p", "c", 2), ("p", None, 3)], "k string, d string, rk int")
    assert rows(D.keep_latest(df, ["k"], ["d"], ["rk"])) == [("p", "c", 2)]


def test_keep_indexed_does_not_fan_out(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    index = spark.createDataFrame([("a",), ("a",)], "k string")
    assert rows(D.keep_indexed(df, index, ["k"])) == [("a", 1)]


def test_pool_without_and_with_completion(spark):
    counts = spark.createDataFrame([("x", 1, 4)], "k string, imp int, n long")
    plain = PL.pool_counts(counts, ["k"], m=2).first()
    assert (plain.n_mean, plain.n_min, plain.n_max) == (4.0, 4, 4)
    comp = PL.pool_counts(counts, ["k"], m=2, complete=True).first()
    assert (comp.n_mean, comp.n_min, comp.n_max) == (2.0, 0, 4)


def test_pool_split_equals_long_form(spark):
    rnd = random.Random(3)
    m = 4
    obs = [(rnd.choice("abc"),) for _ in range(40)]
    drawn = [(rnd.choice("abcd"), rnd.randint(1, m)) for _ in range(60)]
    obs_df = spark.createDataFrame(obs, "k string")
    drawn_df = spark.createDataFrame(drawn, "k string, imp int")
    long_df = obs_df.crossJoin(spark.range(1, m + 1).select(F.col("id").cast("int").alias("imp"))) \
        .unionByName(drawn_df)
    for complete in (False, True):
        want = rows(PL.count_and_pool(long_df, ["k"], m, complete=complete))
        got = rows(PL.sparse_pool(obs_df, drawn_df, ["k"], m, complete=complete))
        assert got == want
        for r in got:
            assert r[2] <= r[1] <= r[3]
