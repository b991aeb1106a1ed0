"""Driver contract: entry runs, every query has an oracle unless documented."""

import re

import __spark_entry__ as E

ROWS_ONLY = {"impute_pmm", "impute_chained"}


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"year", "race_ethn", "medical", "n_bar", "rate_bar"} <= set(df.columns)
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    optional = {q for q in qs if q == "pipeline" or re.match(r"op\d+_", q)}  # tested beside their operators
    assert set(qs) - set(sqls) - optional <= ROWS_ONLY


def test_results_do_not_depend_on_session_time_zone(spark):
    from helpers import rows
    sf = "/root/testdata/sf0.001"
    qs = E.queries()
    names = ["filter_mix", "dedup_latest", "group_count"]
    base = {n: rows(qs[n](spark, sf)) for n in names}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        assert {n: rows(qs[n](spark, sf)) for n in names} == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_results_generic_over_column_roles(spark):
    from pyspark.sql import functions as F

    from helpers import rows
    from casetally.plans import standins as S
    from casetally.plans import surveillance as SV
    sf = "/root/testdata/sf0.001"
    # target columns keep their names: the keyed draws include the target name
    names = {"row_key": "report_id", "person": "person_id", "state": "region", "rptdt": "report_date",
             "medical": "is_medical", "chmal1": "type1", "chmal2": "type2", "chmal3": "type3",
             "chmal4": "type4"}
    cases, pop = S.cases(spark, sf), S.population_by_year(spark, sf)
    roles = SV.Roles(row_key="report_id", person="person_id", unit="region", date="report_date",
                     source="is_medical", slots=("type1", "type2", "type3", "type4"))
    imp0 = SV.Imputation(targets=S.TARGETS, m=3, seed=5)
    imp1 = SV.Imputation(targets={"race_ethn": [["region", "year"], ["region"]],
                                  "ipse": [["region", "year"], ["region"]]}, m=3, seed=5)
    a = SV.group_rates(cases, pop, imp0, where=F.col("ipse"))
    b = SV.group_rates(cases.withColumnsRenamed(names), pop.withColumnsRenamed(names), imp1, roles,
                       where=F.col("ipse"))
    assert rows(a) == rows(b.withColumnsRenamed({v: k for k, v in names.items()}).select(*a.columns))
    c0 = SV.state_counts(cases, imp0, where=F.col("medical"))
    c1 = SV.state_counts(cases.withColumnsRenamed(names), imp1, roles, where=F.col("is_medical"))
    assert rows(c0) == rows(c1.withColumnsRenamed({v: k for k, v in names.items()}).select(*c0.columns))
