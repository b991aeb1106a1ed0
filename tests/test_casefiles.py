"""End to end on invented files in the original formats, checked by brute force.

The fixture has no missing target values, so every imputation equals the
observed data and the results can be computed directly in pandas.
"""

import random
from collections import defaultdict

import pandas as pd
import pytest

from helpers import rows

from casetally.plans import casefiles as CF

COLS = ["staterr", "chid", "subyr", "rptdt", "rptfips", "rptsrc", "chage", "chracbl", "chracai", "chracas",
        "chracnh", "chracwh", "cethn", "cddrug", "fcdrug", "cdalc", "fcalc", "chprior", "rptvictim",
        "chmal1", "chmal2", "chmal3", "chmal4"]
RACES = ["Black", "AIAN", "Asian/PI", "Latinx", "White"]


def _rows():
    rnd = random.Random(11)
    out = []
    for year in (2018, 2019):
        for st in ("AK", "AL", "FL", "XX"):
            for i in range(40):
                race = rnd.choice(RACES)
                ind = dict(chracbl=int(race == "Black"), chracai=int(race == "AIAN"),
                           chracas=int(race == "Asian/PI"), chracnh=0, cethn=int(race == "Latinx"),
                           chracwh=1 if race in ("White", "Latinx") else 0)
                drug = rnd.choice([1, 2, 2])
                base = dict(staterr=st, chid=f"{i:04d}", subyr=year, rptfips="001", rptsrc=rnd.choice([2, 2, 1, 4]),
                            chage=rnd.choice([0, 0, 77, 3]), cddrug=drug, fcdrug=2, cdalc=2, fcalc=2, chprior=2,
                            rptvictim=1, chmal1=rnd.choice([1, 2, 3, 4]), chmal2=rnd.choice([2, 5]), chmal3=4,
                            chmal4=1, **ind)
                out.append(dict(base, rptdt=f"{year}-03-{1 + i % 27:02d}"))
                if i % 10 == 0:  # a second, later report of the same child
                    out.append(dict(base, rptdt=f"{year}-11-{1 + i % 27:02d}", rptsrc=1))
    return out


def _pop_lines():
    lines, pops = [], {}
    for year in (2018, 2019):
        for st in ("AK", "AL", "FL", "XX"):
            for code, (race, hisp) in {"White": (1, 0), "Black": (2, 0), "AIAN": (3, 0),
                                       "Asian/PI": (4, 0), "Latinx": (1, 1)}.items():
                for age in (0, 5):
                    pop = 100 + 7 * len(lines)
                    lines.append(f"{year}{st}01001{99:02d}{race}{hisp}1{age:02d}{pop:08d}")
                    if age == 0:
                        pops[(year, st, code)] = pop
    return lines, pops


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("cases")
    rows = _rows()
    for year, order, upper in ((2018, COLS, True), (2019, list(reversed(COLS)), False)):
        hdr = [c.upper() if upper else c for c in order]
        body = ["\t".join(hdr)] + ["\t".join(str(r[c]) for c in order) for r in rows if r["subyr"] == year]
        (d / f"CF{year}v1.tab").write_text("\n".join(body) + "\n")
    lines, pops = _pop_lines()
    (d / "pop.txt").write_text("\n".join(lines) + "\n")
    return d, rows, pops


def _first_reports(rows):
    """First report per child within each yearly file."""
    by = {}
    for r in sorted(rows, key=lambda r: (r["rptdt"], r["chid"])):
        by.setdefault((r["staterr"] + r["chid"], r["subyr"]), r)
    return by.values()


def test_state_path_matches_brute_force(spark, files):
    d, rows, pops = files
    cases = CF.read_child_files(spark, str(d / "CF*.tab"))
    pop = CF.read_population(spark, str(d / "pop.txt"))
    quality = CF.quality_screen(cases)
    prepared = CF.prepare_state_cases(cases, quality)
    counts = CF.state_counts(prepared, CF.infant_population_shares(pop), m=2, seed=1, maxit=1)
    res = CF.state_results(counts, CF.infant_population(pop), 2, 2019)
    got = {(r.state, r.race_ethn): r for r in res["rates"].collect()}

    # brute force
    passing = set()
    qual = defaultdict(lambda: [0, 0])
    for r in rows:
        if r["chage"] in (0, 77) and r["rptsrc"] == 2:
            q = qual[(r["staterr"], r["subyr"])]
            q[0] += 1
            q[1] += r["cddrug"] == 1
    for (st, yr), (n, t) in qual.items():
        if st not in CF.QUALITY_EXCLUDED and t / n >= 0.01:
            passing.add((st, yr))
    kept = [r for r in _first_reports(rows) if (r["staterr"], r["subyr"]) in passing]
    infants = [r for r in kept if r["chage"] in (0, 77) and r["rptsrc"] == 2]
    race_of = lambda r: next(lbl for cols, lbl in CF.RACE_PRIORITY if any(r[c] == 1 for c in cols))
    states = {r["staterr"] for r in infants} - set(CF.RESULT_EXCLUDED)
    levels = {race_of(r) for r in infants}
    n = defaultdict(int)
    for r in infants:
        if r["subyr"] == 2019 and r["cddrug"] == 1:
            n[(r["staterr"], race_of(r))] += 1
    assert {k for k in got if k[1] != "Total"} == {(s, g) for s in states for g in levels}
    for s in states:
        tot_n, tot_pop = 0, 0
        for g in levels:
            row = got[(s, g)]
            assert row.n_mn == row.n_min == row.n_max == n[(s, g)]
            assert row.pop == pops[(2019, s, g)]
            assert row.r_mn == n[(s, g)] / pops[(2019, s, g)] * 1000
            tot_n += n[(s, g)]
            tot_pop += pops[(2019, s, g)]
        assert got[(s, "Total")].n_mn == tot_n and got[(s, "Total")].pop == tot_pop
    ratios = res["ratios"].collect()
    assert {r.race_ethn for r in ratios} == levels - {"White"}
    assert res["panel"].count() > 0


def test_national_path_matches_brute_force(spark, files):
    d, rows, pops = files
    cases = CF.read_child_files(spark, str(d / "CF*.tab"), CF.NATIONAL_COLUMNS)
    pop = CF.read_population(spark, str(d / "pop.txt"))
    prepared = CF.prepare_national_cases(cases)
    res = CF.national_results(prepared, CF.population_shares(pop), CF.infant_population(pop), m=2, seed=1,
                              maxit=1)
    got = {(r.year, r.race_ethn, r.medical): r.n_bar for r in res["group_rates"].collect()}
    race_of = lambda r: next(lbl for cols, lbl in CF.RACE_PRIORITY if any(r[c] == 1 for c in cols))
    latest = {}
    for r in sorted(rows, key=lambda r: (r["rptdt"], r["chid"])):
        if r["staterr"] in CF.NATIONAL_EXCLUDED or r["chage"] not in (0, 77):
            continue
        latest[(r["subyr"], r["staterr"] + r["chid"])] = r  # later reports overwrite
    want = defaultdict(int)
    for (yr, _), r in latest.items():
        want[(yr, race_of(r), r["rptsrc"] == 2)] += 1
    assert got == {k: float(v) for k, v in want.items()}
    types = res["type_rates"].toPandas()
    assert set(types["type"]) == {"Neglect", "Physical abuse", "Sexual abuse", "Other"}
    assert (types["n_min"] <= types["n_mean"]).all() and (types["n_mean"] <= types["n_max"]).all()


def test_national_split_equals_long_form_with_missing_values(spark, tmp_path):
    from pyspark.sql import functions as F

    from casetally.operators import dedup as D
    from casetally.operators.chained import chained_impute
    from casetally.plans import surveillance as SV

    recs = _rows()
    for i, r in enumerate(recs):
        if i % 6 == 0:
            r["chage"] = 99  # age missing
        if i % 8 == 0:
            r["chprior"] = ""
        if i % 7 == 0:
            r["rptvictim"] = ""
        if i % 9 == 0:
            for c in ("chracbl", "chracai", "chracas", "chracnh", "chracwh", "cethn"):
                r[c] = 0  # race missing
    body = ["\t".join(COLS)] + ["\t".join(str(r[c]) for c in COLS) for r in recs if r["subyr"] == 2019]
    (tmp_path / "CF2019v1.tab").write_text("\n".join(body) + "\n")
    lines, _ = _pop_lines()
    (tmp_path / "pop.txt").write_text("\n".join(lines) + "\n")
    cases = CF.read_child_files(spark, str(tmp_path / "CF*.tab"), CF.NATIONAL_COLUMNS)
    pop = CF.read_population(spark, str(tmp_path / "pop.txt"))
    prepared = CF.prepare_national_cases(cases)
    shares, infants = CF.population_shares(pop), CF.infant_population(pop)
    res = CF.national_results(prepared, shares, infants, m=3, seed=2, maxit=1)

    # the same imputations, expanded in full, deduplicated per imputation
    sh = shares.withColumnRenamed("state", "staterr")
    data = CF.with_report_key(prepared).join(sh, ["staterr", "year"], "left")
    share_cols = [c for c in shares.columns if c.startswith("pct_")]
    preds = [*CF.NATIONAL_PREDICTORS, *share_cols]
    specs = {t: {"predictors": [p for p in preds if p != t], "cells": [["staterr"]], **spec}
             for t, spec in CF.NATIONAL_TARGETS.items()}
    kinds = CF.FACTORS
    long = chained_impute(data, specs, ["report", "twin"], 3, 2, maxit=1, by=["year"], kinds=kinds)
    long = long.withColumn("medical", F.col("rptsrc") == 2)
    latest = D.keep_latest(long.filter(F.col("age") == 0), ["imp", "year", "st_id"], ["rptdt"], ["report", "twin"])
    roles = SV.Roles(row_key="chid", person="st_id", unit="staterr", date="rptdt")
    want = SV.group_rates_from_long(latest, infants, 3, roles)
    assert rows(res["group_rates"]) == rows(want)
    open_ = [F.col(c).isNull() for c in ("age", "race_ethn", "chprior", "rptvictim")]
    assert prepared.filter(open_[2] | open_[3]).count() and not long.filter(open_[0] | open_[1] | open_[2] | open_[3]).count()


def test_reports_of_one_day_give_the_same_counts_in_any_partitioning(spark, files):
    """Several reports of a child on one date that differ in nothing but other columns."""
    from casetally.operators import dedup as D
    from pyspark.sql import functions as F
    d, _, pops = files
    cases = CF.read_child_files(spark, str(d / "CF*.tab")).withColumn("rptdt", F.lit("2019-05-05").cast("date"))
    flipped = cases.withColumns({"rptsrc": F.when(F.col("rptsrc") == 2, 4).otherwise(2), "cddrug": 3 - F.col("cddrug")})
    cases = cases.unionByName(flipped)
    quality = CF.quality_screen(cases)
    seen = {str(rows(CF.prepare_state_cases(cases.repartition(n, *keys), quality)))
            for n, keys in ((1, ["rptsrc"]), (5, ["chid"]), (3, ["cddrug"]))}
    assert len(seen) == 1
    with pytest.raises(ValueError):
        D.keep_first(cases, ["staterr", "chid"], ["rptdt"], ["chid"])
