"""The analysis on the original file formats.

Inputs: yearly tab-separated child files (header in any case, year in the
file name) and the fixed-width single-age population file. Each function is
a step of the state path (quality screen -> first-report dedup -> recode ->
quality gate -> chained imputation per year -> completed counts -> panel,
yearly rates, rate ratios) or of the national path (recode -> chained
imputation per year -> latest report per person and imputation -> group
and type rates). Paths are supplied by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casetally.functions import recode as R
from casetally.operators import aggregate as AG
from casetally.operators import dedup as D
from casetally.operators import joins as J
from casetally.operators import quality as Q
from casetally.operators import reshape as RS
from casetally.operators.chained import chained_impute
from casetally.operators.impute import with_imputations
from casetally.plans import surveillance as SV
from casetally.sources import readers as SRC
from casetally.sources import schemas as SC

# Reporter-source codes and labels (99 = missing, any other code
# = non-professional), the exposure items (1 yes, 2 no), the race indicator
# columns in priority order with their labels, the population race/ethnicity
# codes, unit exclusion lists (quality screen; results; national), the unit
# dropped from the panel, and the reference and ordering groups.
REPORTER_LABELS = {1: "social services", 2: "medical", 3: "mental health", 4: "police",
                   5: "education", 6: "day care", 7: "substitute care"}
REPORTER_OTHER = "non-professional"
REPORTER_MISSING = 99
EXPOSURE_ITEMS = ["cddrug", "fcdrug", "fcalc", "cdalc"]
RACE_PRIORITY = [(["chracbl"], "Black"), (["chracai"], "AIAN"), (["chracas", "chracnh"], "Asian/PI"),
                 (["cethn"], "Latinx"), (["chracwh"], "White")]
POP_RACE = [("White", 1, 0), ("Black", 2, None), ("AIAN", 3, None), ("Asian/PI", 4, None), ("Latinx", None, 1)]
QUALITY_EXCLUDED = ["XX", "PR", "PA", "FL", "IA", "NY", "ND"]
RESULT_EXCLUDED = ["FL", "IA", "NY", "PA", "CO", "MO", "NC", "SD", "VT", "WI"]
NATIONAL_EXCLUDED = ["PR", "XX"]
PANEL_DROPPED = ["WV"]
REFERENCE_GROUP = "White"
ORDER_GROUP = "AIAN"
GROUP_LEVELS = ["Total", "AIAN", "Asian/PI", "Black", "Latinx", "White"]

STATE_COLUMNS = ["staterr", "chid", "subyr", "rptdt", "rptsrc", "chage", "chracbl", "chracai", "chracas",
                 "chracnh", "chracwh", "cethn", "cddrug", "fcdrug", "cdalc", "fcalc", "chmal1"]
NATIONAL_COLUMNS = ["staterr", "chid", "subyr", "rptdt", "rptfips", "rptsrc", "chage", "chracbl", "chracai",
                    "chracas", "chracnh", "chracwh", "cethn", "chprior", "rptvictim",
                    "chmal1", "chmal2", "chmal3", "chmal4"]


# ------------------------------------------------------------------- inputs


def read_child_files(spark: SparkSession, paths, columns: Sequence[str] = STATE_COLUMNS) -> DataFrame:
    """Yearly child files (tab-separated, header), declared types, file year attached."""
    return SRC.read_delimited(spark, paths, {c: SC.CASE_COLUMNS[c] for c in columns},
                              year_pattern=SC.CASE_FILE_YEAR)


def read_population(spark: SparkSession, paths) -> DataFrame:
    return SRC.read_fixed_width(spark, paths, SC.POPULATION_FIELDS)


def population_group(race="race", hisp="hisp"):
    r, h = F.col(race), F.col(hisp)
    rules = []
    for label, rc, hc in POP_RACE:
        cond = None
        if rc is not None:
            cond = r == rc
        if hc is not None:
            cond = (h == hc) if cond is None else (cond & (h == hc))
        rules.append((cond, label))
    return R.ladder(rules)


def infant_population(pop: DataFrame, min_year: int | None = None) -> DataFrame:
    """Age-0 population by (year, state, group), the rate denominator."""
    p = pop.filter(F.col("age") == 0)
    if min_year is not None:
        p = p.filter(F.col("year") > min_year)
    p = p.withColumn("race_ethn", population_group())
    return AG.strict_sums(p, ["year", "state", "race_ethn"], ["pop"])


def population_shares(pop: DataFrame, max_age: int = 18, scale: float = 100.0,
                      drop_group: str = "White") -> DataFrame:
    """Child-population shares (ages up to ``max_age``) by group per (state, year), wide: predictors of the national path."""
    p = pop.filter(F.col("age") <= max_age).withColumn("race_ethn", population_group())
    p = AG.strict_sums(p, ["state", "year", "race_ethn"], ["pop"])
    shares = RS.share_of_total(p, ["state", "year"], "pop", "pct_pop", scale).drop("pop")
    labels = [g for g, _, _ in POP_RACE]
    wide = RS.pivot_wide(shares, ["state", "year"], "race_ethn", "pct_pop", labels, prefix="pct_",
                         drop=[drop_group])
    return wide.withColumnsRenamed({"pct_AIAN": "pct_aian", "pct_Asian/PI": "pct_api"})


def infant_population_shares(pop: DataFrame, scale: float = 100.0, drop_group: str = "White") -> DataFrame:
    """The same shares of the age-0 population: predictors of the state path."""
    return population_shares(pop, 0, scale, drop_group)


# --------------------------------------------------------------- state path


def exposure_flag() -> object:
    return R.tri_flag(EXPOSURE_ITEMS)


def race_group(strict: bool = False):
    rules = [(R.any_equals(cols, 1), label) for cols, label in RACE_PRIORITY]
    return R.priority_group(rules, strict=strict)


def quality_screen(cases: DataFrame, max_missing: float = 0.20, min_share: float = 0.01) -> DataFrame:
    """Unit-year quality of the exposure flag among infant medical reports."""
    c = cases.filter(((F.col("chage") == 0) | (F.col("chage") == 77)) & (F.col("rptsrc") == 2))
    c = c.withColumn("ipse", exposure_flag())
    return Q.quality_flags(c, ["staterr", "subyr"], "ipse", exclude=QUALITY_EXCLUDED,
                           max_missing=max_missing, min_share=min_share)


def prepare_state_cases(cases: DataFrame, quality: DataFrame, first_index: DataFrame | None = None) -> DataFrame:
    """First reports, recoded, on unit-years that pass the quality screen."""
    c = cases.withColumn("st_id", R.paste_key("staterr", "chid"))
    if first_index is not None:
        c = D.keep_indexed(c, first_index, [k for k in first_index.columns if k in c.columns])
    # within each yearly file; reports of one day are told apart by all their columns
    c = D.keep_first(c, ["st_id", "subyr"], ["rptdt"], [D.row_digest(cases.columns)])
    c = c.withColumn("chage", R.replace_value("chage", 77, 0))
    c = c.withColumns({
        "rptsrc": R.code_labels("rptsrc", REPORTER_LABELS, rest_label=REPORTER_OTHER,
                                rest_unless=REPORTER_MISSING),
        "ipse": exposure_flag(),
        "race_ethn": race_group(),
    })
    c = Q.quality_gate(c, quality, ["staterr", "subyr"])
    c = c.select("st_id", "staterr", "subyr", "rptsrc", "ipse", "chage", "race_ethn", "chmal1")
    c = c.withColumns({"chage": R.null_if("chage", 99), "chmal1": R.null_if("chmal1", 9)})
    return c.withColumnsRenamed({"subyr": "year", "chage": "age", "staterr": "state"})


# The targets of the state path and their models; both code columns are factors.
STATE_TARGETS = {
    "rptsrc": {"method": "polyreg"},
    "ipse": {"method": "logreg"},
    "age": {"method": "pmm"},
    "race_ethn": {"method": "polyreg"},
    "chmal1": {"method": "polyreg"},
}


def state_counts(prepared: DataFrame, shares: DataFrame, m: int = 10, seed: int = 57, maxit: int = 5,
                 targets: dict | None = None) -> DataFrame:
    """Chained imputation per year with population shares as predictors, then
    completed counts of infant medical reports by (year, imp, state, group,
    type, flag), zero-filled over the levels found in each year."""
    data = J.natural_left_join(prepared, shares, keys=["state", "year"], null_safe=False)
    share_cols = [c for c in shares.columns if c.startswith("pct_")]
    base = targets or STATE_TARGETS
    names = list(base)
    specs = {}
    for t, spec in base.items():
        preds = [c for c in ["state", *names, *share_cols] if c != t]
        specs[t] = {"predictors": preds, "cells": [["state"]], **spec}
    observed, completed = chained_impute(data, specs, ["st_id", "year"], m, seed, maxit=maxit, by=["year"],
                                         kinds=FACTORS, split=True)
    keep = (F.col("age") == 0) & (F.col("rptsrc") == "medical")
    keys = ["year", "state", "race_ethn", "chmal1", "ipse"]
    # records without imputed values are counted once, not m times
    counts = SV.counts_from_split(observed.filter(keep), completed.filter(keep), keys, m)
    dims = {d: None for d in ["imp", "state", "race_ethn", "chmal1", "ipse"]}
    return RS.complete_grid(counts, dims, fill={"n": 0}, by=["year"])


def state_results(counts: DataFrame, pop_infant: DataFrame, m: int, year: int) -> dict[str, DataFrame]:
    """Balanced panel with totals, one year's rates by state x group, rate ratios."""
    panel = SV.state_panel(counts, pop_infant, m, exclude=RESULT_EXCLUDED, drop_units=PANEL_DROPPED)
    rates = SV.unit_rates(counts, pop_infant, m, year, exclude=RESULT_EXCLUDED, group_levels=GROUP_LEVELS)
    ratios = SV.unit_disparity(rates, REFERENCE_GROUP, ORDER_GROUP)
    return {"panel": panel, "rates": rates, "ratios": ratios}


# ------------------------------------------------------------ national path


def prepare_national_cases(cases: DataFrame) -> DataFrame:
    """Recode: strict race ladder, age 77 -> 0 and > 18 -> missing, reporter
    missing -> 99, prior report as a flag; excluded territories removed."""
    c = cases.withColumn("race_ethn", race_group(strict=True))
    c = c.withColumn("age", R.null_if_above(R.replace_value("chage", 77, 0), 18))
    c = c.withColumn("rptsrc", R.fill_missing("rptsrc", REPORTER_MISSING))
    c = c.withColumn("chprior", R.equals_flag("chprior", 1))
    c = c.filter(R.not_in_keep_null("staterr", NATIONAL_EXCLUDED))
    return c.drop("chage").withColumnsRenamed({"subyr": "year"})


def with_report_key(prepared: DataFrame) -> DataFrame:
    """Person id, and a unique key of each report: a digest of all its columns, numbered within equal reports."""
    keyed = prepared.withColumns({"st_id": R.paste_key("staterr", "chid"), "report": D.row_digest(prepared.columns)})
    return keyed.withColumn("twin", F.row_number().over(Window.partitionBy("report").orderBy("report")))


# The targets and predictors of the national path (ids and type slots are neither).
NATIONAL_TARGETS = {"age": {"method": "pmm"}, "race_ethn": {"method": "polyreg"},
                    "chprior": {"method": "logreg"}, "rptvictim": {"method": "polyreg"}}
NATIONAL_PREDICTORS = ["age", "rptsrc", "race_ethn", "chprior", "rptvictim"]
FACTORS = {"rptsrc": "factor", "chmal1": "factor", "rptvictim": "factor"}


def national_results(prepared: DataFrame, shares: DataFrame, pop_infant: DataFrame, m: int = 10,
                     seed: int = 57, maxit: int = 5, targets: dict | None = None,
                     row_key: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Group rates and type rates of infants (latest report per person and
    imputation within each year); ids and type slots neither predict nor are
    predicted. ``row_key`` identifies a report for the keyed draws (default:
    a digest of all its columns)."""
    sh = shares.withColumnRenamed("state", "staterr")
    data = J.natural_left_join(with_report_key(prepared), sh, keys=["staterr", "year"], null_safe=False)
    share_cols = [c for c in shares.columns if c.startswith("pct_")]
    base = targets or NATIONAL_TARGETS
    predictors = [*NATIONAL_PREDICTORS, *share_cols]
    specs = {t: {"predictors": [p for p in predictors if p != t], "cells": [["staterr"]], **spec}
             for t, spec in base.items()}
    observed, completed = chained_impute(data, specs, list(row_key or ["report", "twin"]), m, seed, maxit=maxit, by=["year"],
                                         kinds={k: v for k, v in FACTORS.items() if k in data.columns}, split=True)
    roles = SV.Roles(row_key="chid", person="st_id", unit="staterr", date="rptdt")
    # persons with no imputed record are the same in every imputation: deduplicate
    # them once; only the others are expanded and deduplicated per imputation
    unstable = completed.select("year", "st_id").distinct()
    stable_rows = observed.join(unstable, ["year", "st_id"], "left_anti")
    expanded_rows = with_imputations(observed.join(unstable, ["year", "st_id"], "left_semi"), m) \
        .unionByName(completed)
    medical = {"medical": R.equals_flag("rptsrc", 2)}
    stable = D.keep_latest(stable_rows.filter(F.col("age") == 0).withColumns(medical),
                           ["year", "st_id"], ["rptdt"], ["report", "twin"])
    expanded = D.keep_latest(expanded_rows.filter(F.col("age") == 0).withColumns(medical),
                             ["imp", "year", "st_id"], ["rptdt"], ["report", "twin"])
    groups = SV.group_rates_split(stable, expanded, pop_infant, m, roles)
    types = SV.type_rates_split(stable, expanded, pop_infant, m, roles)
    return {"group_rates": groups, "type_rates": types}
