"""Reshaping, grid completion, rates, Total rows, rate ratios, golden values."""

import math

from pyspark.sql import functions as F

from casetally.operators import rates as RT
from casetally.operators import reshape as RS
from helpers import rows


def test_complete_grid_keeps_null_key_and_fills_zero(spark):
    counts = spark.createDataFrame([(None, "x", 5), ("A", "y", 2)], "g string, t string, n long")
    out = RS.complete_grid(counts, {"g": None, "t": None}, fill={"n": 0})
    assert rows(out) == [(None, "x", 5), (None, "y", 0), ("A", "x", 0), ("A", "y", 2)]


def test_grid_size_is_product_of_levels(spark):
    counts = spark.createDataFrame([(1, "a", 3)], "imp int, t string, n long")
    out = RS.complete_grid(counts, {"imp": [1, 2, 3], "t": ["a", "b"]}, fill={"n": 0})
    assert out.count() == 6 and out.agg(F.sum("n")).first()[0] == 3


def test_shares_sum_to_100_and_pivot(spark):
    pop = spark.createDataFrame([("S", "A", 1), ("S", "B", 3), ("T", "A", 2)], "st string, g string, pop long")
    sh = RS.share_of_total(pop, ["st"], "pop", "pct")
    assert all(abs(r[1] - 100) < 1e-9 for r in sh.groupBy("st").agg(F.sum("pct")).collect())
    wide = RS.pivot_wide(sh.drop("pop"), ["st"], "g", "pct", ["A", "B"], prefix="pct_", drop=["B"])
    assert rows(wide) == [("S", 25.0), ("T", 100.0)]


def test_unpivot_and_stack(spark):
    wide = spark.createDataFrame([(2019, 1, 2)], "year int, a long, b long")
    long = RS.unpivot_long(wide, ["year"], ["a", "b"], "type", "n")
    assert rows(long) == [(2019, "a", 1), (2019, "b", 2)]
    other = spark.createDataFrame([(2020, 9)], "year int, c long")
    st = RS.stack_by_name([wide, other])
    assert rows(st, "year", "a", "c") == [(2019, 1, None), (2020, None, 9)]


def test_rate_null_for_zero_or_missing_pop(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (3, 1000)], "n long, pop long")
    assert rows(RT.add_rates(df, {"r": "n"}), "r") == [(None,), (None,), (3.0,)]


def test_total_bounds_sum_group_minima(spark):
    df = spark.createDataFrame([(2019, "S", "A", 2.0, 1, 3, 10), (2019, "S", "B", 2.0, 1, 3, 10)],
                               "year int, state string, g string, n_mn double, n_min long, n_max long, pop long")
    tot = RT.with_total_rows(df, ["year", "state"], "g", ["n_mn", "n_min", "n_max", "pop"])
    t = [r for r in tot.collect() if r.g == "Total"][0]
    assert (t.n_mn, t.n_min, t.n_max, t.pop) == (4.0, 2, 6, 20)
    assert tot.count() == 3


def test_total_row_does_not_swallow_null_group(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, "A", 2.0)], "year int, g string, n double")
    tot = RT.with_total_rows(df, ["year"], "g", ["n"])
    assert rows(tot) == [(1, None, 1.0), (1, "A", 2.0), (1, "Total", 3.0)]


def test_ratio_zero_reference_and_zero_numerator(spark):
    df = spark.createDataFrame([(1, "W", 0.0, 0.0, 0.0), (1, "A", 1.0, 1.0, 1.0),
                                (2, "W", 2.0, 2.0, 2.0), (2, "A", 0.0, 0.0, 0.0)],
                               "year int, g string, r_mn double, r_min double, r_max double")
    out = RT.rate_ratios(df, ["year"], "g", "W", labels=("gt", "le"))
    got = {r.year: r for r in out.collect()}
    assert got[1].d is None and got[1].grt1 is None
    assert got[2].d == 0.0 and got[2].grt1 == "le"


# Rows of the reference's committed result tables (the state
# AK, AIAN group, 2019, and its White reference rates) and one row each of
# the type and group figures.
GOLD_FIG4_AK_AIAN = dict(n_mn=100.5, n_min=99, n_max=103, pop=2304,
                         r_mn=43.619791666666664, r_min=42.96875, r_max=44.704861111111114)
GOLD_FIG5_AK_WHITE = dict(wht_mn=8.497203680317517, wht_min=8.118347465271514, wht_max=8.659570629622948)
GOLD_FIG5_AK_AIAN = dict(d=5.133428985314933, d_min=4.961995442708333, d_max=5.506645447530865,
                         grt1="Greater than white rate")
GOLD_FIG1_2010 = dict(n_mean=152163.0, pop=3951430, rate_mean=38.5083374879474)
GOLD_FIG2_2010 = dict(n_bar=4493.5, pop=77364, rate_bar=58.08257070472054)


def test_golden_rates(spark):
    g = GOLD_FIG4_AK_AIAN
    df = spark.createDataFrame([(g["n_mn"], g["n_min"], g["n_max"], g["pop"])],
                               "n_mn double, n_min long, n_max long, pop long")
    r = RT.add_rates(df, {"r_mn": "n_mn", "r_min": "n_min", "r_max": "n_max"}).first()
    assert (r.r_mn, r.r_min, r.r_max) == (g["r_mn"], g["r_min"], g["r_max"])
    for gold, n, rate in [(GOLD_FIG1_2010, "n_mean", "rate_mean"), (GOLD_FIG2_2010, "n_bar", "rate_bar")]:
        d = spark.createDataFrame([(gold[n], gold["pop"])], f"{n} double, pop long")
        assert math.isclose(RT.add_rates(d, {rate: n}).first()[rate], gold[rate], rel_tol=1e-14)


def test_golden_rate_ratio(spark):
    g, w, want = GOLD_FIG4_AK_AIAN, GOLD_FIG5_AK_WHITE, GOLD_FIG5_AK_AIAN
    df = spark.createDataFrame(
        [(2019, "AK", "AIAN", g["r_mn"], g["r_min"], g["r_max"]),
         (2019, "AK", "White", w["wht_mn"], w["wht_min"], w["wht_max"])],
        "year int, state string, race_ethn string, r_mn double, r_min double, r_max double")
    r = RT.rate_ratios(df, ["year", "state"], "race_ethn", "White").first()
    assert (r.d, r.d_min, r.d_max, r.grt1) == (want["d"], want["d_min"], want["d_max"], want["grt1"])


def test_complete_grid_per_group_uses_group_levels(spark):
    counts = spark.createDataFrame([(2018, "A", 1), (2018, "B", 2), (2019, "A", 3)], "year int, g string, n long")
    out = RS.complete_grid(counts, {"g": None}, fill={"n": 0}, by=["year"])
    assert rows(out) == [(2018, "A", 1), (2018, "B", 2), (2019, "A", 3)]
    full = RS.complete_grid(counts, {"year": None, "g": None}, fill={"n": 0})
    assert rows(full, "year", "g", "n") == [(2018, "A", 1), (2018, "B", 2), (2019, "A", 3), (2019, "B", 0)]
