"""Property tests (hypothesis): dedup is unique and idempotent, split pooling
equals pooling the expanded long table, pooled bounds are ordered."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casetally.operators import dedup as D
from casetally.operators import pool as PL
from helpers import rows

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

reports = st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.integers(0, 5))),
                   min_size=1, max_size=30)


@SETTINGS
@given(reports)
def test_latest_unique_idempotent_and_equal_to_window(spark, data):
    base = dt.datetime(2019, 1, 1)
    recs = [(p, None if d is None else base + dt.timedelta(days=d), i) for i, (p, d) in enumerate(data)]
    df = spark.createDataFrame(recs, "p string, t timestamp_ntz, rk int")
    once = D.keep_latest(df, ["p"], ["t"], ["rk"])
    assert once.count() == df.select("p").distinct().count()
    assert rows(D.keep_latest(once, ["p"], ["t"], ["rk"])) == rows(once)
    assert rows(once) == rows(D.keep_one_window(df, ["p"], ["t"], ["rk"], latest=True))


cells = st.lists(st.tuples(st.sampled_from("xyz"), st.integers(1, 3)), max_size=25)


@SETTINGS
@given(st.lists(st.sampled_from("xyz"), max_size=15), cells, st.booleans())
def test_split_pool_equals_long_pool(spark, observed, drawn, complete):
    m = 3
    obs = spark.createDataFrame([(k,) for k in observed], "k string")
    dr = spark.createDataFrame(drawn, "k string, imp int")
    long = obs.withColumn("imp", F.explode(F.sequence(F.lit(1), F.lit(m)))).unionByName(dr)
    want = rows(PL.count_and_pool(long, ["k"], m, complete=complete))
    got = rows(PL.sparse_pool(obs, dr, ["k"], m, complete=complete))
    assert got == want
    for _, mean, lo, hi in got:
        assert lo <= mean <= hi
        if complete:  # golden invariant: the pooled mean times m is a whole count
            assert abs(mean * m - round(mean * m)) < 1e-9
