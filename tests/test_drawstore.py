"""Draw store: long form, one imputation, one year written again, guards."""

import pytest
from pyspark.sql import functions as F

from casetally.sources.drawstore import DrawStore
from helpers import rows

SCHEMA = "year int, k string, a long, b string, x int"
RECORDS = [(2010, "p", 1, "u", 5), (2010, "q", None, "v", None), (2010, None, None, None, 7), (2011, "p", None, "w", 8), (2011, "r", 4, "z", 9),
           (None, "s", 2, None, 1), (2012, "t", 6, "y", 2)]


def completed(spark, records, m, shift=0):
    out = [(y, k, 100 * i + shift if a is None else a, f"d{i}" if b is None else b, x, i)
           for y, k, a, b, x in records if a is None or b is None for i in range(1, m + 1)]
    return spark.createDataFrame(out, SCHEMA + ", imp int")


def long_of(records, m, shift=0):
    return [(y, k, 100 * i + shift if a is None else a, f"d{i}" if b is None else b, x, i) for y, k, a, b, x in records for i in range(1, m + 1)]


COLUMNS = ["year", "k", "a", "b", "x", "imp"]
ordered = lambda found: sorted(found, key=str)


@pytest.fixture
def store(spark, tmp_path):
    s = DrawStore(str(tmp_path / "store"), ["a", "b"], ["k"])
    s.write(spark.createDataFrame(RECORDS, SCHEMA), completed(spark, RECORDS, 3), 3)
    return s


def test_long_form_and_one_imputation(spark, store):
    want = long_of(RECORDS, 3)
    assert ordered(rows(store.long(spark), *COLUMNS)) == ordered(want)
    assert ordered(rows(store.long(spark, imp=2), *COLUMNS)) == ordered(r for r in want if r[-1] == 2)
    assert ordered(rows(store.long(spark, F.col("year") == 2011), *COLUMNS)) == ordered(r for r in want if r[0] == 2011)
    full, done = store.split(spark)
    assert full.count() == 3 and done.count() == 4 * 3


def test_one_year_written_again(spark, store):
    new = [(2011, "r", None, "z", 9), (2011, "n", 3, "o", 1)]
    store.write(spark.createDataFrame(new, SCHEMA), completed(spark, new, 3, shift=7), 3)
    want = long_of([r for r in RECORDS if r[0] != 2011], 3) + long_of(new, 3, shift=7)
    assert ordered(rows(store.long(spark), *COLUMNS)) == ordered(want)
    with pytest.raises(ValueError, match="imputations"):
        store.write(spark.createDataFrame(new, SCHEMA), completed(spark, new, 2), 2)


def test_a_record_without_draws_raises(spark, store):
    new = [(2012, "t", None, "y", 2)]
    store.write(spark.createDataFrame(new, SCHEMA), completed(spark, [], 3), 3)
    with pytest.raises(Exception, match="has no draw"):
        store.long(spark).collect()


def test_years_and_imputations_are_pruned(spark, store):
    _, done = store.split(spark, F.col("year") == 2011, imp=2)
    plan = done._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert len(filters) == 2 and all("2011" in f for f in filters) and any("imp" in f.split("PartitionFilters")[1].split("PushedFilters")[0] for f in filters)


def test_empty_table(spark, tmp_path):
    s = DrawStore(str(tmp_path / "none"), ["a", "b"], ["k"])
    s.write(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA + ", imp int"), 2)
    assert s.long(spark).count() == 0
