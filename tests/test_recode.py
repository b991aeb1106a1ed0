"""Recoding expressions and the R-vs-SQL missing-value hazards."""

from pyspark.sql import functions as F

from casetally.functions import recode as R
from helpers import rows


def test_tri_flag_three_values(spark):
    df = spark.createDataFrame([(1, (1, 2, 2, 2)), (2, (2, None, 2, None)), (3, (None, 9, None, 9))],
                               "id int, s struct<a:int,b:int,c:int,d:int>").select("id", "s.*")
    out = df.select("id", R.tri_flag(["a", "b", "c", "d"]).alias("f"))
    assert rows(out) == [(1, True), (2, False), (3, None)]


def _race(spark):
    return spark.createDataFrame(
        [(1, 1, None, None, None, None, 1), (2, 0, 0, 0, 0, 1, 1), (3, None, 0, 0, 0, 0, 1)],
        "id int, bl int, ai int, asn int, nh int, eth int, wh int")


def rules():
    return [(F.col("bl") == 1, "Black"), (F.col("ai") == 1, "AIAN"),
            ((F.col("asn") == 1) | (F.col("nh") == 1), "Asian/PI"), (F.col("eth") == 1, "Latinx"),
            (F.col("wh") == 1, "White")]


def test_priority_group_falls_through_nulls(spark):
    out = _race(spark).select("id", R.priority_group(rules()).alias("g"))
    assert rows(out) == [(1, "Black"), (2, "Latinx"), (3, "White")]


def test_priority_group_strict_propagates_nulls(spark):
    out = _race(spark).select("id", R.priority_group(rules(), strict=True).alias("g"))
    assert rows(out) == [(1, "Black"), (2, "Latinx"), (3, None)]


def test_sentinels_state_and_national_age(spark):
    df = spark.createDataFrame([(77,), (99,), (18,), (19,)], "age int")
    state = R.null_if(R.replace_value("age", 77, 0), 99)
    national = R.null_if_above(R.replace_value("age", 77, 0), 18)
    out = df.select("age", state.alias("s"), national.alias("n"))
    assert rows(out) == [(18, 18, 18), (19, 19, None), (77, 0, 0), (99, None, None)]


def test_fill_missing_and_equality_flag(spark):
    df = spark.createDataFrame([(None,), (2,), (3,)], "src int")
    out = df.select(R.fill_missing("src", 99).alias("c"), R.equals_flag("src", 2).alias("med"))
    assert rows(out) == [(2, True), (3, False), (99, None)]


def test_slot_flags_kleene(spark):
    df = spark.createDataFrame([(1, 1, 4, None, None), (2, None, None, None, None), (3, 6, 2, None, None)],
                               "id int, m1 int, m2 int, m3 int, m4 int")
    slots = ["m1", "m2", "m3", "m4"]
    out = df.select("id", R.any_equals(slots, 1).alias("phy"), R.any_in(slots, [2, 3]).alias("neg"),
                    R.any_equals(slots, 4).alias("sex"), R.any_above(slots, 4).alias("oth"))
    assert rows(out) == [(1, True, None, True, None), (2, None, None, None, None),
                         (3, None, True, None, True)]


def test_code_labels_catch_all_and_missing_code(spark):
    df = spark.createDataFrame([(1,), (2,), (8,), (99,), (None,)], "c int")
    out = df.select("c", R.code_labels("c", {1: "social", 2: "medical"}, rest_label="other",
                                       rest_unless=99).alias("l"))
    assert rows(out) == [(None, None), (1, "social"), (2, "medical"), (8, "other"), (99, None)]


def test_paste_key_prints_na(spark):
    df = spark.createDataFrame([("AK", "7"), (None, "7")], "st string, id string")
    assert rows(df.select(R.paste_key("st", "id").alias("k"))) == [("AK7",), ("NA7",)]


def test_not_in_keeps_null_unit(spark):
    df = spark.createDataFrame([("X",), ("Y",), (None,)], "u string")
    assert rows(df.filter(R.not_in_keep_null("u", ["X"]))) == [(None,), ("Y",)]


def test_binary_label_boundary_and_null(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (None,)], "d double")
    out = df.select("d", R.binary_label(F.col("d") > 1, "Greater", "Less or equal").alias("l"))
    assert rows(out) == [(None, None), (1.0, "Less or equal"), (1.5, "Greater")]


def test_level_ordinal(spark):
    df = spark.createDataFrame([("Other",), ("Neglect",), ("zzz",)], "t string")
    out = df.select("t", R.level_ordinal("t", ["Neglect", "Physical abuse", "Sexual abuse", "Other"]).alias("o"))
    assert rows(out) == [("Neglect", 1), ("Other", 4), ("zzz", None)]


def test_h5_codes_compare_numerically(spark):
    df = spark.createDataFrame([(10, None, None, None), (3, None, None, None)], "a int, b int, c int, d int")
    out = df.select("a", R.any_above(["a", "b", "c", "d"], 4).alias("other"))
    assert rows(out) == [(3, None), (10, True)]


def test_h12_sequential_derivations(spark):
    df = spark.createDataFrame([(77,), (99,)], "age int")
    out = df.withColumn("age", R.replace_value("age", 77, 0)).withColumn("age", R.null_if("age", 99)) \
            .withColumn("infant", F.col("age") == 0)
    assert rows(out) == [(None, None), (0, True)]


def test_h13_pivot_drops_null_level(spark):
    from casetally.operators import reshape as RS
    df = spark.createDataFrame([("S", "A", 1.0), ("S", None, 2.0)], "st string, g string, v double")
    wide = RS.pivot_wide(df, ["st"], "g", "v", ["A"], prefix="pct_")
    assert wide.columns == ["st", "pct_A"] and rows(wide) == [("S", 1.0)]


def test_h15_type_flags_overlap(spark):
    from casetally.operators import aggregate as AG
    df = spark.createDataFrame([(1, 2, None, None), (4, 1, None, None)], "a int, b int, c int, d int")
    slots = ["a", "b", "c", "d"]
    flags = df.select(R.any_equals(slots, 1).alias("phy"), R.any_in(slots, [2, 3]).alias("neg"),
                      R.any_equals(slots, 4).alias("sex"))
    sums = AG.flag_sums(flags.withColumn("k", F.lit(1)), ["k"], ["phy", "neg", "sex"]).first()
    assert sums.phy + sums.neg + sums.sex == 4 > df.count()
