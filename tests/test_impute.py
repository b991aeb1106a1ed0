"""Hot-deck properties: observed values untouched, no NULL left, cell-faithful,
backoff, reproducible across partitionings."""

from pyspark.sql import functions as F

from casetally.operators import impute as IM
from helpers import rows

CELLS = [["state", "year"], ["state"]]


def _cases(spark):
    data = []
    rk = 0
    for st, yr, vals in [("A", 1, ["x"] * 5 + [None] * 3), ("A", 2, [None] * 2),
                         ("B", 1, ["x", "y", "y", "z", None, None]), ("C", 1, [None])]:
        for v in vals:
            rk += 1
            data.append((rk, st, yr, v))
    return spark.createDataFrame(data, "row_key long, state string, year int, g string")


def test_draws_respect_cells_and_backoff(spark):
    df = _cases(spark)
    d = IM.hotdeck_draws(df, "g", CELLS, ["row_key"], m=5, seed=1)
    got = d.groupBy("state", "year").agg(F.collect_set("g").alias("v")).collect()
    by = {(r.state, r.year): set(r.v) for r in got}
    assert by[("A", 1)] == {"x"}          # only donor value in the cell
    assert by[("A", 2)] == {"x"}          # empty cell backs off to state A
    assert by[("B", 1)] <= {"x", "y", "z"}
    assert by[("C", 1)] <= {"x", "y", "z"}  # backs off to the whole table
    assert d.count() == 8 * 5 and d.filter(F.col("g").isNull()).count() == 0


def test_complete_long_keeps_observed(spark):
    df = _cases(spark)
    d = IM.hotdeck_draws(df, "g", CELLS, ["row_key"], m=3, seed=1)
    long = IM.complete_long(df, d, "g", 3)
    assert long.count() == df.count() * 3
    joined = long.join(df.filter(F.col("g").isNotNull()).withColumnRenamed("g", "g0"), ["row_key"])
    assert joined.filter(F.col("g") != F.col("g0")).count() == 0


def test_reproducible_under_repartitioning(spark):
    df = _cases(spark)
    a = rows(IM.hotdeck_draws(df.repartition(1), "g", CELLS, ["row_key"], 4, seed=9))
    b = rows(IM.hotdeck_draws(df.repartition(7, "row_key"), "g", CELLS, ["row_key"], 4, seed=9))
    c = rows(IM.hotdeck_draws(df, "g", CELLS, ["row_key"], 4, seed=10))
    assert a == b and a != c


def test_draw_frequencies_follow_donor_shares(spark):
    data = [(i, "S", 1, "a" if i < 300 else "b") for i in range(400)] + \
           [(1000 + i, "S", 1, None) for i in range(2000)]
    df = spark.createDataFrame(data, "row_key long, state string, year int, g string")
    d = IM.hotdeck_draws(df, "g", CELLS, ["row_key"], m=2, seed=3)
    share_a = d.filter(F.col("g") == "a").count() / d.count()
    assert abs(share_a - 0.75) < 0.03


def test_multi_target_complete(spark):
    df = spark.createDataFrame([(1, "A", 1, "x", True), (2, "A", 1, None, False), (3, "A", 1, "y", None),
                                (4, "A", 1, None, None)],
                               "row_key long, state string, year int, g string, f boolean")
    long = IM.hotdeck_complete(df, {"g": CELLS, "f": CELLS}, ["row_key"], m=3, seed=2)
    assert long.count() == 12
    assert long.filter(F.col("g").isNull() | F.col("f").isNull()).count() == 0
    assert rows(long.filter("row_key = 1").select("g", "f").distinct()) == [("x", True)]


def _numeric(spark):
    data = []
    for i in range(300):
        g = "a" if i % 3 else "b"
        x = i % 5
        y = None if i % 7 == 0 else 10 * x + (1 if g == "b" else 0)
        data.append((i, g, x, y))
    return spark.createDataFrame(data, "row_key long, g string, x int, y int")


def test_pmm_draws_observed_donor_values(spark):
    df = _numeric(spark)
    d = IM.pmm_draws(df, "y", numeric=["x"], categorical=["g"], row_key=["row_key"], m=3, seed=5)
    n_missing = df.filter(F.col("y").isNull()).count()
    assert d.count() == n_missing * 3 and d.filter(F.col("y").isNull()).count() == 0
    observed = {r.y for r in df.filter(F.col("y").isNotNull()).select("y").distinct().collect()}
    assert {r.y for r in d.select("y").distinct().collect()} <= observed
    # the model is exact (y = 10x + [g == b]): donors come from matching predicted values
    close = d.filter(F.abs(F.col("y") - 10 * F.col("x")) <= 1).count()
    assert close / d.count() > 0.9
    again = IM.pmm_draws(df.repartition(5), "y", numeric=["x"], categorical=["g"], row_key=["row_key"], m=3, seed=5)
    assert rows(d) == rows(again)


def test_chained_completes_and_keeps_observed(spark):
    from casetally.operators.chained import chained_impute
    data = []
    for i in range(400):
        s = "S" + str(i % 4)
        g = None if i % 11 == 0 else ("u" if i % 4 < 2 else "v")
        f = None if i % 13 == 0 else (i % 4 == 0)
        y = None if i % 9 == 0 else (i % 4) * 10
        data.append((i, s, i % 2 == 0, g, f, y))
    df = spark.createDataFrame(data, "row_key long, s string, med boolean, g string, f boolean, y int")
    targets = {"g": {"method": "polyreg", "predictors": ["s", "med", "f"]},
               "f": {"method": "logreg", "predictors": ["s", "med", "g"]},
               "y": {"method": "pmm", "predictors": ["s", "med"]}}
    long = chained_impute(df, targets, ["row_key"], m=2, seed=1, maxit=2)
    assert long.count() == 800
    assert long.filter(F.col("g").isNull() | F.col("f").isNull() | F.col("y").isNull()).count() == 0
    obs = df.select("row_key", F.col("g").alias("g0"), F.col("y").alias("y0"))
    j = long.join(obs, "row_key")
    assert j.filter(F.col("g0").isNotNull() & (F.col("g") != F.col("g0"))).count() == 0
    assert j.filter(F.col("y0").isNotNull() & (F.col("y") != F.col("y0"))).count() == 0
    assert {r.y for r in long.select("y").distinct().collect()} <= {0, 10, 20, 30}


def test_binary_search_draw_equals_linear_scan(spark):
    from casetally.functions.draws import uniform_u32
    data = [(i, "S", 1, (i * 37) % 300) for i in range(3000)] + [(10000 + i, "S", 1, None) for i in range(500)]
    df = spark.createDataFrame(data, "row_key long, state string, year int, y int")
    table = IM.backoff_table(df.filter("y IS NULL").select("state", "year").distinct(), df,
                             {"y": [["state", "year"]]})
    miss = df.filter("y IS NULL").join(table, ["state", "year"]).withColumn("u", uniform_u32("row_key"))
    lin = miss.withColumn("a", F.filter("y_thr", lambda x: x["hi"] * F.lit(1 << 32) > F.col("u") * F.col("y_tot"))[0]["v"])
    both = IM.with_draw(lin, "b", "y_thr", "y_tot", F.col("u"), 300)
    assert both.filter(F.col("a") != F.col("b")).count() == 0
    assert both.filter(F.col("b").isNull()).count() == 0


def test_chained_per_year_runs_and_default_methods(spark):
    from casetally.operators.chained import chained_impute, methods_from_schema
    data = []
    for i in range(300):
        yr = 2018 + i % 2
        g = None if i % 7 == 0 else ("u" if (i // 2) % 3 else "v")
        f = None if i % 5 == 0 else (i % 3 == 0)
        data.append((i, yr, i % 4 == 0, g, f))
    df = spark.createDataFrame(data, "row_key long, year int, med boolean, g string, f boolean")
    assert methods_from_schema(df, ["g", "f", "year"]) == {"g": "polyreg", "f": "logreg", "year": "pmm"}
    targets = {"g": {"predictors": ["med", "f"], "cells": [["year"]]},
               "f": {"predictors": ["med", "g"], "cells": [["year"]]}}
    long = chained_impute(df, targets, ["row_key"], m=2, seed=4, maxit=2, by=["year"])
    assert long.count() == 600
    assert long.filter(F.col("g").isNull() | F.col("f").isNull()).count() == 0
    again = chained_impute(df.repartition(3), targets, ["row_key"], m=2, seed=4, maxit=2, by=["year"])
    assert rows(long) == rows(again)


def test_donor_search_matches_brute_force(spark):
    """Equal predictions, few donors, several groups; however the rows fall into partitions."""
    import numpy as np
    from casetally.operators import models as MO
    rng = np.random.default_rng(1)
    pool = {(int(i), b, float(p), float(v)): int(n) for i, b, p, v, n in zip(
        rng.integers(1, 3, 300), rng.choice(["a", "b"], 300), rng.integers(0, 40, 300) / 4, rng.integers(0, 9, 300), rng.integers(1, 4, 300))}
    pool[3, "a", 1.0, 5.0] = 2
    asked = [(j, int(i), b, float(p), int(u)) for j, (i, b, p, u) in enumerate(zip(
        rng.integers(1, 4, 400), rng.choice(["a", "b"], 400), rng.integers(-8, 90, 400) / 8, rng.integers(0, 1 << 32, 400)))]
    donors = spark.createDataFrame([(*k, n) for k, n in pool.items()], "__imp int, __by string, __p double, __v double, __n long")
    need = spark.createDataFrame(asked, "row int, __imp int, __by string, __p double, __u long")
    got = {r.row: r.out for r in MO.match_donors(donors, need, 5, "out").collect()}
    for j, i, b, p, u in asked:
        near, left = [], 5
        own = sorted((q, v, n) for (x, y, q, v), n in pool.items() if (x, y) == (i, b))
        before = sum(q < p for q, _, _ in own)
        for _, q, v, n in sorted((abs(q - p), q, v, n) for q, v, n in own[max(0, before - 5):before + 5]):
            near += [v] * min(n, left)
            left -= min(n, left)
        want = near[u * len(near) >> 32] if near else None
        assert got[j] == want or (want is None and np.isnan(got[j])), (j, p, near)


def test_logit_fit_matches_closed_form(spark):
    """One binary factor: the fitted log odds are the observed ones (up to the weak prior); posterior draws vary."""
    import math

    import numpy as np
    from casetally.operators import models as MO
    data = [(0, "", 1.0 * (i % 2), str(bool(i % 10 < (3 if i % 2 else 7))).lower(), 1) for i in range(20000)]
    rows_ = spark.createDataFrame(data, "__imp int, __by string, x double, __y string, __n long")
    design = MO.Design(numbers={"x": (0.0, 1.0, False)})
    found = {r[0]: r for r in MO.fit_logit(rows_, design, "__y", ["false", "true"], 200, draw=lambda imp, by: [imp]).collect()}
    odds = lambda x: math.log(sum(1 for r in data if r[2] == x and r[3] == "true") / sum(1 for r in data if r[2] == x and r[3] == "false"))
    for imp in (1, 2):
        beta = found[imp].beta
        assert abs(beta[0] - odds(0)) < 0.01 and abs(beta[0] + beta[1] - odds(1)) < 0.01
    drawn = np.array([found[i].drawn for i in found])
    q = [0.3 * 0.7 * 10000] * 2  # information of the two cells; the slope's variance is the sum of theirs
    assert np.allclose(drawn.std(axis=0), [math.sqrt(1 / q[0]), math.sqrt(1 / q[0] + 1 / q[1])], rtol=0.25)


def test_separated_classes_have_finite_coefficients(spark):
    """The class follows from x; pseudo-observations hold the slope back, and the fit equals one over rows and pseudo-rows."""
    import numpy as np
    from casetally.operators import models as MO
    data = [(0, "", float(i % 2), ["no", "yes", "yes"][i % 2], 50) for i in range(40)]
    rows_ = spark.createDataFrame(data, "__imp int, __by string, x double, __y string, __n long")
    fit = MO.fit_logit(rows_, MO.Design(numbers={"x": (0.0, 1.0, False)}), "__y", ["no", "yes"], 1, tolerance=1e-12).first().beta
    x = np.array([[1.0, r[2]] for r in data])
    more = MO.pseudo_observations(x.mean(axis=0), x.std(axis=0), 2)
    assert abs(more[2].sum() - 2) < 1e-12
    full = [np.concatenate(z) for z in zip((x, np.array([float(r[3] == "yes") for r in data]), np.full(40, 50.0)), more, strict=True)]
    grad, _ = MO._gradient(*full, np.array([fit]))
    assert np.abs(grad - MO.RIDGE * np.array(fit)).max() < 1e-4
    assert 5 < fit[1] < 30


def test_many_groups_and_nothing_collected(spark, monkeypatch):
    """500 groups: every group's fit is that of its own rows, and no statistics pass through the driver."""
    import numpy as np
    from casetally.operators import models as MO
    rng = np.random.default_rng(3)
    n = 500 * 40
    by, x = np.arange(n) % 500, rng.integers(0, 5, n)
    y = 3 * x + by % 7 + rng.integers(0, 3, n)
    import pandas as pd
    pdf = pd.DataFrame({"__imp": np.zeros(n, np.int32), "__by": by.astype(str), "x": x.astype(float), "__y": y.astype(float), "__n": np.ones(n, np.int64)})
    rows_ = spark.createDataFrame(pdf)
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    with monkeypatch.context() as patch:
        for name in ("collect", "toPandas", "first", "head", "take"):
            patch.setattr(Classic, name, lambda self, *a, **k: (_ for _ in ()).throw(AssertionError("collected")))
        lin = MO.fit_linear(rows_, MO.Design(numbers={"x": (0.0, 1.0, False)}), "__y", 2, lambda imp, b: [imp, int(b)])
        logit = MO.fit_logit(rows_.withColumn("__y", (F.col("__y") % 2).cast("int").cast("string")), MO.Design(numbers={"x": (0.0, 4.0, False)}), "__y", ["0", "1"], 2)
    got = {(r["__imp"], r["__by"]): r.beta for r in lin.collect()}
    assert len(got) == 1000 and logit.count() == 1000
    for g in (0, 17, 499):
        at = by == g
        want = np.linalg.lstsq(np.column_stack([np.ones(at.sum()), x[at]]), y[at], rcond=None)[0]
        assert np.allclose(got[1, str(g)], want, atol=1e-3) and got[1, str(g)] == got[2, str(g)]


def test_draws_beyond_two_to_the_31_donors(spark):
    from casetally.functions.draws import scaled
    tot = 3_000_000_000
    data = [(u, tot * k) for u in (0, 1, 65535, 65536, 2**31, 2**32 - 1) for k in (1, 7, 10000)]
    df = spark.createDataFrame(data, "u long, tot long").withColumn("r", scaled(F.col("u"), F.col("tot")))
    assert all(r.r == r.u * r.tot >> 32 for r in df.collect())
    thr = spark.createDataFrame([([(tot // 3, "a"), (tot, "b")], tot, u) for u in (0, 2**30, 2**31, 2**32 - 1)],
                                "t array<struct<hi:long,v:string>>, n long, u long")
    out = IM.with_draw(thr, "v", "t", "n", F.col("u"), 2)
    assert [r.v for r in out.orderBy("u").collect()] == ["a", "a", "b", "b"]


def test_missing_key_parts_are_told_apart(spark):
    from casetally.functions.draws import uniform_u32
    df = spark.createDataFrame([("A", None, "C"), ("A", "C", None)], "a string, b string, c string")
    assert len({r[0] for r in df.select(uniform_u32("a", "b", "c")).collect()}) == 2


def test_factor_codes_and_missing_predictors(spark):
    from casetally.operators.chained import chained_impute, methods_from_schema
    data = [(i, None if i % 9 == 0 else (99 if i % 4 == 0 else i % 4), None if i % 11 == 0 else i % 5, None if i % 7 == 0 else float(i % 4)) for i in range(300)]
    df = spark.createDataFrame(data, "row_key long, code int, x int, y double")
    assert methods_from_schema(df, ["code"], {"code": "factor"}) == {"code": "polyreg"}
    long = chained_impute(df, {"code": {"predictors": ["y", "x"]}, "y": {"predictors": ["code", "x"]}}, ["row_key"], 2, 3, maxit=1, kinds={"code": "factor"})
    assert long.count() == 600 and long.filter(F.col("code").isNull() | F.col("y").isNull()).count() == 0
    assert {r.code for r in long.select("code").distinct().collect()} == {1, 2, 3, 99}


def test_equal_predictions_cut_by_a_partition_edge(spark):
    """Many donors share a few predictions; ranges cut them, the draw is that of the whole list all the same."""
    import numpy as np
    from casetally.operators import models as MO
    rng = np.random.default_rng(2)
    donors = [(1, "", float(p), float(v), 1) for p in (1, 2, 3) for v in rng.permutation(400)[:300]]
    need = [(1, "", i, float(p), int(rng.integers(0, 2**32))) for i, p in enumerate([1, 2, 3] * 60)]
    d = spark.createDataFrame(donors, "__imp int, __by string, __p double, __v double, __n long")
    r = spark.createDataFrame(need, "__imp int, __by string, row int, __p double, __u long")
    got = {x.row: x.out for x in MO.match_donors(d, r, 5, "out").collect()}
    ordered = sorted((p, v) for _, _, p, v, _ in donors)
    for _, _, i, p, u in need:
        below, above = [x for x in ordered if x[0] < p][-5:], [x for x in ordered if x[0] >= p][:5]
        five = sorted(below + above, key=lambda x: (abs(x[0] - p), x))[:5]
        assert got[i] == five[u * 5 >> 32][1]


def test_rational_solution():
    from casetally.operators.models import rational_solution
    assert rational_solution([[2, 1], [1, 3]], [5, 10]) == [1, 3, 1]
    assert rational_solution([[3, 0], [0, 7]], [1, 2]) == [7, 6, 21]
    # the second column depends on the first
    assert rational_solution([[2, 4, 1], [4, 8, 2], [1, 2, 5]], [3, 6, 6]) == [1, 0, 1, 1]


def test_exact_round_is_least_squares(spark):
    import numpy as np
    from casetally.operators import models as MO
    rng = np.random.default_rng(1)
    x, z = rng.integers(0, 9, 300), rng.integers(0, 3, 300)
    y = 4 * x - z + rng.integers(0, 5, 300)
    rows_ = spark.createDataFrame([(0, "", int(a), int(b), int(c), 2) for a, b, c in zip(x, z, y)], "__imp int, __by string, x long, z long, y long, __n long")
    *b, whole = (int(v) for v in MO.fit_exact(rows_, ["x", "z"], "y", 3).filter("__imp = 2").first().beta)
    want = np.linalg.lstsq(np.column_stack([np.ones(300), x, z]), y, rcond=None)[0]
    assert np.allclose([v / whole for v in b], want)
    assert MO.fit_exact(rows_.limit(0), ["x"], "y", 2).count() == 0


def test_donor_search_holds_one_piece_at_a_time(spark, monkeypatch):
    """Pieces of seven rows, several files a task: recipients still reach all donors, and no file has more rows."""
    import numpy as np
    from casetally.operators import models as MO
    monkeypatch.setattr(MO, "PIECE", 7)
    stored, write = [], MO.materialize
    monkeypatch.setattr(MO, "materialize", lambda df, *a: stored.append(write(df, *a)) or stored[-1])
    rng = np.random.default_rng(4)
    pool = sorted({(int(i), str(b), float(p), float(v)) for i, b, p, v in zip(
        rng.integers(1, 3, 200), rng.choice(["a", "b"], 200), rng.integers(0, 12, 200), rng.integers(0, 30, 200), strict=True)})
    asked = [(j, int(i), str(b), float(p), int(u)) for j, (i, b, p, u) in enumerate(zip(
        rng.integers(1, 3, 150), rng.choice(["a", "b", "c"], 150), rng.integers(-2, 28, 150) / 2, rng.integers(0, 1 << 32, 150), strict=True))]
    donors = spark.createDataFrame([(*k, 1) for k in pool], "__imp int, __by string, __p double, __v double, __n long")
    need = spark.createDataFrame(asked, "row int, __imp int, __by string, __p double, __u long")
    got = {r.row: r.out for r in MO.match_donors(donors, need, 3, "out").collect()}
    assert max(r[0] for r in stored[0].groupBy(F.input_file_name()).agg(F.count(F.lit(1))).select("count(1)").collect()) <= 7
    for j, i, b, p, u in asked:
        own = [(q, v) for x, y, q, v in pool if (x, y) == (i, b)]
        near = [x for x in own if x[0] < p][-3:] + [x for x in own if x[0] >= p][:3]
        three = sorted(near, key=lambda x: (abs(x[0] - p), x))[:3]
        assert got[j] == (three[u * len(three) >> 32][1] if three else None)


def test_rows_of_a_key_meet_in_few_blocks(spark):
    """30 keys scattered over all partitions: about one block a key, not one per key and task; no row is lost."""
    from casetally.operators import models as MO
    rows_ = spark.range(6000).repartition(16).select((F.col("id") % 3).cast("int").alias(MO.ALL), (F.col("id") % 10).cast("string").alias(MO.BY), F.col("id").cast("double").alias("x"),
                                                     F.lit(1.0).alias("__y"), F.lit(1).cast("bigint").alias(MO.WEIGHT))
    dealt = MO.clustered(rows_)
    blocks = MO.model_blocks(dealt, MO.Design(numbers={"x": (0.0, 1.0, False)}), "__y")
    assert blocks.count() <= 30 + dealt.rdd.getNumPartitions()
    assert sum(len(r.w) // 8 for r in blocks.collect()) == 6000


def test_repeated_rows_of_a_task_are_bounded(spark, monkeypatch):
    """The kept reports do not depend on how many tasks repeat them, and a task has few rows, equal ones too."""
    from casetally.operators import materialize as MT
    from casetally.plans import surveillance as SV
    monkeypatch.setattr(MT, "REPEATED_ROWS", 100)
    same = spark.range(1000).select(F.lit(1).alias("x"))
    per_task = [len(p) for p in MT.spread_repeated(same, 10, 1000).rdd.glom().collect()]
    assert sum(per_task) == 1000 and max(per_task) <= 40
    c = spark.sql("""SELECT id row_key, id % 40 person, 'S' state, 2000 year, date_add(DATE'2000-01-01', cast(id % 90 as int)) rptdt, id % 2 = 0 medical,
        CASE WHEN id % 7 > 0 THEN 'g' || id % 3 END race_ethn, CASE WHEN id % 5 > 0 THEN id % 3 = 0 END ipse FROM range(300)""")
    imp = SV.Imputation(targets={t: [["state", "year"]] for t in ("race_ethn", "ipse")}, m=3, seed=1)
    found = [sorted(map(str, df.collect())) for df in SV.latest_report_split(c, imp, SV.Roles(), F.col("ipse"))]
    sizes, spread = [], MT.spread_repeated
    monkeypatch.setattr(MT, "spread_repeated", lambda df, *a: sizes.append(spread(df, *a).rdd.getNumPartitions()) or df)
    assert found == [sorted(map(str, df.collect())) for df in SV.latest_report_split(c, imp, SV.Roles(), F.col("ipse"))]
    assert sizes == [9]


def test_fits_of_whole_groups_equal_passes(spark, monkeypatch):
    """Small groups are fitted in one task each, large ones in passes: the same steps, coefficients and posterior draws."""
    import numpy as np
    from casetally.operators import models as MO
    rng = np.random.default_rng(6)
    data = [(int(i), str(b), float(x), None if z > 2 else "uvw"[z], "abc"[y], float(y * x), int(n)) for i, b, x, z, y, n in zip(
        rng.integers(0, 3, 400), rng.integers(0, 3, 400), rng.integers(0, 4, 400), rng.integers(0, 4, 400), rng.integers(0, 3, 400), rng.integers(1, 9, 400), strict=True)]
    rows_ = spark.createDataFrame(data, "__imp int, __by string, x double, z string, __y string, v double, __n long")
    design = MO.Design(numbers={"x": (0.0, 3.0, False)}, factors={"z": ["u", "v", "w", None]})
    key = lambda imp, by: [imp, int(by)]

    def found():
        first = MO.fit_logit(rows_, design, "__y", ["a", "b", "c"], 2, draw=key)
        again = MO.fit_logit(rows_.filter("__n > 2"), design, "__y", ["a", "b", "c"], 2, start=first, draw=key)
        return [{(r[0], r[1]): (r.beta, r.drawn) for r in df.collect()} for df in (first, again, MO.fit_linear(rows_.drop("__y"), design, "v", 2, key))]
    whole, passes = [], []
    monkeypatch.setattr(MO, "_solved", lambda *a, f=MO._solved: passes.append(1) or f(*a))
    whole = found()
    assert not passes
    monkeypatch.setattr(MO, "GROUP", 0)
    by_pass = found()
    assert len(passes) > 5 and [len(x) for x in whole] == [6, 6, 6]
    for a, b in zip(whole, by_pass, strict=True):
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-6, atol=1e-7) for k in a)


def test_drawn_classes_follow_the_softmax(spark):
    """The column expression against numpy: missing and unknown predictors, a key without coefficients, a missing group."""
    import numpy as np
    import pandas as pd
    from casetally.operators import models as MO
    rng = np.random.default_rng(7)
    design = MO.Design(numbers={"x": (1.0, 4.0, True)}, factors={"z": ["u", "v", "w", None], "o": ["only"]})
    fits = {(i, b): rng.normal(size=3 * design.width).tolist() for i in (1, 2) for b in ("p", "q")}
    table = spark.createDataFrame([(*k, v, v, 0.0) for k, v in fits.items()], MO.COEFFICIENTS)
    data = [(j, int(rng.integers(1, 4)), [None, "p", "q"][j % 3], None if j % 5 == 0 else float(j % 7), [None, "u", "v", "w", "new"][j % 5], "only", int(rng.integers(0, 1 << 32))) for j in range(600)]
    rows_ = spark.createDataFrame(data, "row int, __imp int, __by string, __x_x double, __x_z string, __x_o string, __u long")
    got = {r.row: r.out for r in MO.draw_classes(rows_, design, list("abcd"), table, "__u", "out").collect()}
    assert got.keys() == {d[0] for d in data if d[2]}
    for j, i, b, x, z, o, u in data:
        if b:
            p = MO.class_probabilities(design.matrix(pd.DataFrame({"x": [x], "z": [z], "o": [o]}).astype({"x": float})), np.array(fits[i, b]).reshape(3, -1))[0] if i < 3 else None
            assert got[j] == (None if i == 3 else "abcd"[min((np.cumsum(p) <= u / 2**32).sum(), 3)])


def test_nearest_donors_of_a_prediction_are_searched_once(spark):
    """The list of donors of a prediction holds what a row there draws, with few donors and none too."""
    from casetally.operators import models as MO
    donors = spark.createDataFrame([(1, "a", p / 2, float(v), 1 + v % 2) for p in range(9) for v in range(p, p + 3)] + [(1, "b", 1.0, 7.0, 2)], "__imp int, __by string, __p double, __v double, __n long")
    us = [0, 1 << 30, 1 << 31, 3 << 30, (1 << 32) - 1]
    need = spark.createDataFrame([(1, b, q / 4, u) for b in "abc" for q in range(-3, 22) for u in us], "__imp int, __by string, __p double, __u long").withColumn("at", F.col("__p"))
    lists = {(r["__by"], r["at"]): r.near for r in MO.match_donors(donors, need.drop("__u").distinct(), 4, "near", None).collect()}
    for r in MO.match_donors(donors, need.withColumn("u", F.col("__u")), 4, "out").collect():
        near = lists[r["__by"], r["at"]]
        assert r.out == (near[r.u * len(near) >> 32] if near else None)
    assert lists["b", 0.0] == [7.0, 7.0] and not lists["c", 0.0] and {len(v) for k, v in lists.items() if k[0] == "a"} == {4}


def test_a_draw_writes_the_rows_that_miss_its_target(spark, monkeypatch):
    """Each drawn target writes its own missing rows, once per imputation, and no others; replaced files go; keys may repeat."""
    from casetally.operators import chained as C
    from casetally.operators import materialize as MT
    data = [(i // 2, 2000 + i % 2, "st"[i % 3 == 0], None if i % 5 == 0 else "uv"[i % 4 > 1], None if i % 7 == 0 else i % 3 == 0, None if i % 11 == 0 else i % 6) for i in range(500)]
    df = spark.createDataFrame(data, "row_key long, year int, s string, g string, f boolean, y int")
    written, gone = [], []
    monkeypatch.setattr(C, "materialize", lambda x, f=C.materialize: written.append(f(x)) or written[-1])
    monkeypatch.setattr(C, "discard", lambda x: gone.append((x, x.count())))
    targets = {"g": {"predictors": ["s", "f"]}, "f": {"predictors": ["s", "g"]}, "y": {"method": "pmm", "predictors": ["s", "g", "f"]}}
    long = C.chained_impute(df, targets, ["row_key"], m=3, seed=2, maxit=2, by=["year"])
    gaps = {t: sum(d[i] is None for d in data) for t, i in (("g", 3), ("f", 4), ("y", 5))}
    layers = [x.count() for x in written if C.GAPS in x.columns and C.MO.ALL in x.columns]
    part = sum(None in d for d in data)
    assert layers == [3 * part] + [3 * gaps[t] for t in ("g", "f", "y")] * 2
    assert [n for _, n in gone] == [3 * part] + [3 * gaps[t] for t in ("g", "f", "y")]
    assert long.count() == 1500 and long.filter("g IS NULL OR f IS NULL OR y IS NULL").count() == 0
    want = long.orderBy(*long.columns).collect()
    for x, _ in gone:  # nothing reads them any more, and no other file goes with them
        MT.discard(x)
    assert long.orderBy(*long.columns).collect() == want


def test_long_distributions_and_short_ones_draw_alike(spark, monkeypatch):
    """A target's draws do not depend on how its distribution is searched, nor on other targets being missing too."""
    data = [(i, "S" + str(i % 3), i % 2, None if i % 4 == 0 else (i * 7) % 40, None if i % 6 == 0 else "xyz"[i % 3]) for i in range(600)]
    df = spark.createDataFrame(data, "row_key long, state string, year int, y int, g string")
    cells = {"y": [["state"]], "g": [["state", "year"], ["state"]]}
    both = rows(IM.hotdeck_complete(df, cells, ["row_key"], 2, 5))
    monkeypatch.setattr(IM, "SHORT", 1000)
    assert both == rows(IM.hotdeck_complete(df, cells, ["row_key"], 2, 5))
    alone = IM.hotdeck_draws(df, "y", [["state"]], ["row_key"], 2, 5)
    assert rows(alone.select("row_key", "imp", "y")) == sorted((r[0], r[5], r[3]) for r in both if r[0] % 4 == 0)
