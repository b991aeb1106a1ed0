"""Registered queries: each exercises operators on the driver tables.

Every query takes ``(spark, sf_dir)``, reads whole tables and returns a
DataFrame. The equivalent SQL for the DuckDB oracle is in ``plans.oracle``;
column names match one to one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetally.functions import arith as A
from casetally.functions import recode as R
from casetally.operators import aggregate as AG
from casetally.operators import dedup as D
from casetally.operators import joins as J
from casetally.operators import materialize as MT
from casetally.operators import names as NM
from casetally.operators import panel as PN
from casetally.operators import pool as PL
from casetally.operators import quality as Q
from casetally.operators import rates as RT
from casetally.operators import reshape as RS
from casetally.plans import standins as S
from casetally.sources import readers as SRC
from casetally.sources.schemas import CASE_FILE_YEAR
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def query(fn: QueryFn) -> QueryFn:
    REGISTRY[fn.__name__] = fn
    return fn


# --------------------------------------------------------------- rates slice


@query
def rate_per_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by (year, group, source) over customers per group, per 1,000."""
    c = S.cases(spark, sf_dir).withColumn("race_ethn", F.coalesce("race_ethn", F.lit("UNKNOWN")))
    counts = AG.group_count(c, ["year", "race_ethn", "medical"])
    pop = S.population(spark, sf_dir).groupBy("race_ethn").agg(A.strict_sum("pop").alias("pop"))
    out = J.natural_left_join(counts, pop, keys=["race_ethn"], null_safe=False)
    return RT.add_rates(out, {"rate": "n"})


# ---------------------------------------------------------------- projections


@query
def project_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    shouting = o.toDF(*[c.upper() for c in o.columns])  # header in upper case
    df = NM.lower_names(shouting)
    df = NM.select_unique(df, ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
                               "o_totalprice", "o_orderkey"])
    df = NM.rename(df, {"o_orderkey": "orderkey", "o_custkey": "custkey"})
    df = df.withColumn("order_year", F.year("o_orderdate").cast("int"))
    df = df.withColumn("prio_code", F.substring("o_orderpriority", 1, 1).cast("int"))
    df = df.withColumn("price_cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    df = df.withColumn("prio_urgent", R.equals_flag("prio_code", 1))  # sees prio_code
    return df.drop("o_orderdate", "o_orderpriority", "o_totalprice")


@query
def sentinel_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    df = li.select(
        R.null_if("l_linenumber", 7).alias("line_code"),
        R.replace_value("l_linenumber", 6, 0).alias("line_swap"),
        R.null_if_above(F.col("l_quantity").cast("int"), 45).alias("qty_capped"),
        R.fill_missing(R.ladder([(F.col("l_returnflag") == "R", 1),
                                 (F.col("l_returnflag") == "A", 2)]), 99).alias("flag_code"),
        R.equals_flag("l_linenumber", 1).alias("is_first"),
    )
    return df.groupBy("line_code", "line_swap", "flag_code", "is_first").agg(
        F.count(F.lit(1)).alias("n"),
        A.count_missing("qty_capped").alias("n_qty_missing"),
        F.sum("qty_capped").cast("bigint").alias("sum_qty"),
    )


@query
def recode_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    c = S.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = S.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.substring("o_orderpriority", 1, 1).cast("int")
    race = F.col("n_regionkey") + 1
    hisp = F.when(F.col("c_acctbal") < 0, F.lit(1)).otherwise(F.lit(0))
    df = j.select(
        R.code_labels(code, {1: "urgent", 2: "high", 3: "medium"},
                      rest_label="unclassified", rest_unless=5).alias("prio_class"),
        R.ladder([((race == 1) & (hisp == 0), "White"), (race == 2, "Black"), (race == 3, "AIAN"),
                  (race == 4, "Asian/PI"), (hisp == 1, "Latinx")]).alias("pop_group"),
    )
    return AG.group_count(df, ["prio_class", "pop_group"])


def _indicator_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return li.select(
        R.ladder([(F.col("l_returnflag") == "R", 1), (F.col("l_returnflag") == "A", 0)]).alias("bl"),
        F.when(F.col("l_linenumber") == 1, F.lit(1)).when(F.col("l_linenumber") == 7, F.lit(None))
         .otherwise(F.lit(0)).alias("ai"),
        F.when(F.col("l_discount") >= 0.09, F.lit(1)).otherwise(F.lit(0)).alias("asn"),
        F.when(F.col("l_tax") == 0.0, F.lit(1)).when(F.col("l_tax") == 0.08, F.lit(None))
         .otherwise(F.lit(0)).alias("nh"),
        F.when(F.col("l_quantity") <= 5, F.lit(1)).otherwise(F.lit(0)).alias("eth"),
        F.when(F.col("l_linestatus") == "F", F.lit(1)).otherwise(F.lit(0)).alias("wh"),
    )


def _priority_rules():
    c = F.col
    return [(c("bl") == 1, "Black"), (c("ai") == 1, "AIAN"),
            ((c("asn") == 1) | (c("nh") == 1), "Asian/PI"), (c("eth") == 1, "Latinx"),
            (c("wh") == 1, "White")]


@query
def priority_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _indicator_lines(spark, sf_dir).select(R.priority_group(_priority_rules()).alias("race_ethn"))
    return AG.group_count(df, ["race_ethn"])


@query
def priority_group_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _indicator_lines(spark, sf_dir).select(
        R.priority_group(_priority_rules(), strict=True).alias("race_ethn"))
    return AG.group_count(df, ["race_ethn"])


@query
def any_flag_tri(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.line_slots(S.table(spark, sf_dir, "lineitem"))
    df = li.select(F.year("l_shipdate").cast("int").alias("year"),
                   R.tri_flag(["s1", "s2", "s3", "s4"]).alias("flag"))
    return AG.group_count(df, ["year", "flag"])


@query
def multi_slot_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.line_type_slots(S.table(spark, sf_dir, "lineitem"))
    df = li.select(*[e.alias(k) for k, e in S.type_flags(["m1", "m2", "m3", "m4"]).items()])
    return AG.group_count(df, S.TYPE_COLUMNS)


def _flag_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.line_type_slots(S.table(spark, sf_dir, "lineitem"))
    df = li.select(F.year("l_shipdate").cast("int").alias("year"), "l_linestatus",
                   *[e.alias(k) for k, e in S.type_flags(["m1", "m2", "m3", "m4"]).items()])
    return AG.flag_sums(df, ["year", "l_linestatus"], S.TYPE_COLUMNS)


@query
def flag_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flag_sums(spark, sf_dir)


@query
def unpivot_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RS.unpivot_long(_flag_sums(spark, sf_dir), ["year", "l_linestatus"], S.TYPE_COLUMNS,
                           "type", "n")


# -------------------------------------------------------------------- filters


@query
def filter_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    year = F.year("o_orderdate").cast("int")
    # year > 1999 written as a range on the raw column, so the whole
    # disjunction can be pushed into the Parquet scan
    after_1999 = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    keep = (((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))
            | (after_1999 & (F.col("o_totalprice") <= 100000)))
    return o.filter(keep).select("o_orderkey", "o_orderstatus", year.alias("year"))


def _cases_null_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.cases(spark, sf_dir)
    return c.withColumn("state", R.null_if("state", "NATION_3"))


@query
def exclude_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cases_null_state(spark, sf_dir)
    kept = c.filter(R.not_in_keep_null("state", ["NATION_1", "NATION_2"]))
    return AG.group_count(kept, ["state"])


# ---------------------------------------------------------------------- dedup


def _dedup_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cases_null_state(spark, sf_dir)
    return c.withColumn("st_id", R.paste_key("state", "person")).select(
        "st_id", "year", "row_key", "rptdt")


@query
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.keep_first(_dedup_base(spark, sf_dir), ["st_id", "year"], ["rptdt"], ["row_key"])


@query
def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.keep_latest(_dedup_base(spark, sf_dir), ["st_id", "year"], ["rptdt"], ["row_key"])


@query
def first_event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.cases(spark, sf_dir)
    index = c.groupBy("person").agg(F.min("row_key").alias("row_key"))
    kept = D.keep_indexed(c, index, ["person", "row_key"])
    kept = D.keep_first(kept, ["person"], ["rptdt"], ["row_key"])
    return kept.select("person", "row_key", "year")


@query
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.distinct_keys(_cases_null_state(spark, sf_dir), ["state", "year"])


@query
def assert_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return D.uniqueness_summary(li, ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------------- joins


@query
def natural_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cases_null_state(spark, sf_dir)
    left = AG.group_count(c, ["state", "race_ethn", "year"])
    pop = S.population(spark, sf_dir).withColumn("state", R.null_if("state", "NATION_3"))
    pop = pop.withColumn("race_ethn", R.null_if("race_ethn", "HOUSEHOLD"))
    pop = pop.groupBy("state", "race_ethn").agg(F.sum("pop").cast("bigint").alias("pop"))
    return J.natural_left_join(left, pop, null_safe=True)


# ----------------------------------------------------------------- aggregates


@query
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AG.group_count(S.cases(spark, sf_dir), ["race_ethn", "medical"])


@query
def strict_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    df = li.select("l_orderkey", F.when(F.col("l_discount") == 0.0, F.lit(None))
                   .otherwise(F.col("l_quantity")).alias("qty"))
    return df.groupBy("l_orderkey").agg(A.strict_sum("qty").alias("qty_strict"),
                                        F.sum("qty").alias("qty_loose"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.line_slots(S.lines(spark, sf_dir))
    df = li.select("unit", "year", R.tri_flag(["s1", "s2", "s3", "s4"]).alias("flag"))
    return Q.quality_flags(df, ["unit", "year"], "flag", exclude=["NATION_0", "NATION_1"],
                           max_missing=0.15, min_share=0.42)


@query
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir)


@query
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = S.lines(spark, sf_dir).select("unit", "year", "l_orderkey")
    kept = Q.quality_gate(recs, _quality(spark, sf_dir), ["unit", "year"])
    return AG.group_count(kept, ["unit", "year"])


# ------------------------------------------------------ pooled tables + totals


def _pooled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, state, group) counts pooled over priority codes as pseudo-imputations."""
    c = S.cases(spark, sf_dir)
    counts = AG.group_count(c, ["year", "state", "race_ethn", "chmal1"])
    pooled = PL.pool_counts(counts, ["year", "state", "race_ethn"], m=5, imp_col="chmal1",
                            names=("n_mn", "n_min", "n_max"), complete=True)
    out = J.natural_left_join(pooled, S.population(spark, sf_dir), keys=["state", "race_ethn"],
                              null_safe=True)
    return out


def _with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _pooled_units(spark, sf_dir)
    tot = RT.with_total_rows(base, ["year", "state"], "race_ethn", ["n_mn", "n_min", "n_max", "pop"])
    return RT.add_rates(tot, {"r_mn": "n_mn", "r_min": "n_min", "r_max": "n_max"})


@query
def total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Total rows sum floating means: rounded so summation order cannot show
    return _with_totals(spark, sf_dir).withColumns({"n_mn": F.round("n_mn", 6), "r_mn": F.round("r_mn", 6)})


@query
def ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _with_totals(spark, sf_dir).filter(F.col("year") == 2000)
    out = RT.ratio_of_sums(t, ["race_ethn"], "n_mn", "pop", name="rate")
    return out.withColumn("rate", F.round("rate", 6))


@query
def callout_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _with_totals(spark, sf_dir)
    return t.groupBy("year", "race_ethn").agg(
        F.round(F.sum("n_mn"), 6).alias("n_mean"),
        F.sum("n_min").cast("bigint").alias("n_min"),
        F.sum("n_max").cast("bigint").alias("n_max"))


@query
def disparity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _with_totals(spark, sf_dir)
    return RT.rate_ratios(t, ["year", "state"], "race_ethn", S.REFERENCE_GROUP,
                          labels=("Greater than reference rate", "Less than or equal to reference rate"))


@query
def share_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pop = S.population(spark, sf_dir)
    shares = RS.share_of_total(pop, ["state"], "pop", "pct", 100.0).drop("pop")
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = RS.pivot_wide(shares, ["state"], "race_ethn", "pct", segments, prefix="pct_",
                         drop=[S.REFERENCE_GROUP])
    return wide.withColumnsRenamed({"pct_AUTOMOBILE": "pct_auto", "pct_MACHINERY": "pct_mach"})


@query
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = AG.group_count(S.cases(spark, sf_dir), ["state", "year"], name="n_orders")
    b = AG.group_count(S.lines(spark, sf_dir).withColumnRenamed("unit", "state"),
                       ["state", "year"], name="n_lines")
    return RS.stack_by_name([a, b])


@query
def complete_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.cases(spark, sf_dir)
    counts = AG.group_count(c, ["state", "race_ethn", "chmal1", "year"])
    return RS.complete_grid(counts, {"state": None, "race_ethn": None, "chmal1": None, "year": None},
                            fill={"n": 0})


@query
def rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _with_totals(spark, sf_dir).filter(F.col("year") == 2000)
    order = PN.level_order(t, "state", [F.round("r_mn", 9)], where=F.col("race_ethn") == "Total")
    return t.join(order, "state").select("state", "race_ethn", F.round("r_mn", 6).alias("r_mn"), "ord")


@query
def ordered_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _with_totals(spark, sf_dir).filter(F.col("year") == 2000)
    levels = ["Total", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return t.select("state", "race_ethn", R.level_ordinal("race_ethn", levels).alias("group_ord"))


@query
def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _pooled_units(spark, sf_dir)
    kept = PN.keep_full_panel(base, "state", drop_units=[S.DROPPED_UNIT])
    return kept.select("year", "state", "race_ethn", "n_mn", "n_min", "n_max", "pop")


# -------------------------------------------------------------------- sources


# Field layout of the packed customer record (name, width, type).
CUSTOMER_FWF = [("c_custkey", 18, T.LongType()), ("c_nationkey", 2, T.IntegerType()),
                ("bal_sign", 1, T.StringType()), ("bal_cents", 9, T.LongType())]


@query
def fwf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "customer")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    packed = c.select(
        "c_custkey", "c_nationkey",
        F.when(cents < 0, F.lit("-")).otherwise(F.lit("+")).alias("bal_sign"),
        F.abs(cents).alias("bal_cents"),
    ).select(SRC.pack_fixed_width(CUSTOMER_FWF).alias("value"))
    parsed = packed.select(*SRC.fixed_width_columns("value", CUSTOMER_FWF, strict=True))
    return parsed.select(
        "c_custkey", "c_nationkey",
        F.when(F.col("bal_sign") == "-", -F.col("bal_cents")).otherwise(F.col("bal_cents")).alias("bal_cents"))


def _lines(df: DataFrame, header: list[str], sep: str, missing: str) -> DataFrame:
    return df.select(F.array_join(F.array(*[F.coalesce(F.col(h.lower()).cast("string"), F.lit(missing)) for h in header]), sep).alias("value"))


@query
def delimited_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tab-separated lines of two layouts (columns in another order and case), dates as MM/dd/yyyy, parsed and stacked."""
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                                F.date_format("o_orderdate", "MM/dd/yyyy").alias("o_orderdate"))
    o = o.withColumn("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    columns = {"o_orderkey": T.LongType(), "o_custkey": T.LongType(), "o_orderstatus": T.StringType(), "o_orderdate": T.DateType()}
    layouts = [["O_ORDERKEY", "O_CUSTKEY", "O_ORDERSTATUS", "O_ORDERDATE"], ["o_orderdate", "o_orderstatus", "o_orderkey", "o_custkey"]]
    parts = []
    for i, header in enumerate(layouts):
        lines = _lines(o.filter(F.col("o_orderkey") % 2 == i), header, "\t", "")
        parts.append(lines.select(*SRC.delimited_columns("value", header, columns, date_format="MM/dd/yyyy")))
    return RS.stack_by_name(parts).withColumn("year", F.year("o_orderdate"))


@query
def na_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as comma-separated lines with NA for missing values, parsed."""
    c = S.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("cents"),
        F.when(F.col("c_nationkey") != 3, F.col("c_acctbal") > 500).alias("rich"))
    header = ["c_custkey", "rich", "cents", "c_nationkey"]
    columns = {"c_custkey": T.LongType(), "c_nationkey": T.IntegerType(), "cents": T.LongType(), "rich": T.BooleanType()}
    return _lines(c, header, ",", "NA").select(*SRC.delimited_columns("value", header, columns, ",", "NA"))


@query
def delimited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as yearly tab files of two layouts into the shared folder, found by a glob, grouped by header and read back;
    the year comes from the file names."""
    o = S.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("o_custkey"), "o_orderstatus",
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("o_orderdate"), F.year("o_orderdate").alias("year"))
    folder = MT.new_folder(spark)
    SRC.write_delimited_years(o.filter(F.col("year") < 1995), folder, "year", header=["O_ORDERKEY", "O_CUSTKEY", "O_ORDERSTATUS", "O_ORDERDATE"])
    SRC.write_delimited_years(o.filter(F.col("year") >= 1995), folder, "year", header=["o_orderdate", "o_orderstatus", "o_orderkey", "o_custkey"])
    columns = {"o_orderkey": T.LongType(), "o_custkey": T.LongType(), "o_orderstatus": T.StringType(), "o_orderdate": T.DateType()}
    return SRC.read_delimited(spark, f"{folder}/CF*.tab", columns, date_format="MM/dd/yyyy", year_pattern=CASE_FILE_YEAR)


@query
def fixed_width_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as lines of fixed-width fields and read back from the files."""
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    packed = S.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.when(cents < 0, F.lit("-")).otherwise(F.lit("+")).alias("bal_sign"), F.abs(cents).alias("bal_cents"))
    folder = MT.new_folder(spark)
    packed.select(SRC.pack_fixed_width(CUSTOMER_FWF).alias("value")).write.text(folder)
    return SRC.read_fixed_width(spark, folder, CUSTOMER_FWF)


@query
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-year quality shares and flags written as a result CSV with ``NA`` and read back with declared types."""
    flags = REGISTRY["quality_flags"](spark, sf_dir)
    folder = MT.new_folder(spark)
    SRC.write_result_csv(flags, folder)
    return SRC.read_csv_na(spark, folder, {f.name: f.dataType for f in flags.schema.fields})


@query
def checkpoint_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case counts handed over as Parquet by year; 1996 is counted anew for medical reports and written over, the other years stay.
    What is read back is pruned to the years from 1994 on."""
    c = S.cases(spark, sf_dir)
    folder = MT.new_folder(spark)
    SRC.write_checkpoint(AG.group_count(c, ["year", "state", "medical"]), folder)
    SRC.write_checkpoint(AG.group_count(c.filter((F.col("year") == 1996) & F.col("medical")), ["year", "state", "medical"]), folder)
    return SRC.read_checkpoint(spark, folder, F.col("year") >= 1994)


# ----------------------------------------------------------------- imputation

from casetally.functions.draws import uniform_u32  # noqa: E402
from casetally.operators import models as MO  # noqa: E402
from casetally.operators import impute as IM  # noqa: E402
from casetally.plans import surveillance as SV  # noqa: E402

IMPUTATION = SV.Imputation(targets=S.TARGETS, m=S.M, seed=S.SEED)
STATE_QUALITY = {"max_missing": 0.36, "min_share": 0.30}


@query
def impute_hotdeck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell-conditional draws of the missing exposure flag, m per record."""
    c = S.cases(spark, sf_dir)
    drawn = IM.hotdeck_draws(c, "ipse", S.TARGETS["ipse"], ["row_key"], S.M, S.SEED)
    return drawn.select("row_key", "imp", "ipse")


@query
def impute_complete_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``complete(action = "long")``: every record once per imputation."""
    c = S.cases(spark, sf_dir)
    drawn = IM.hotdeck_draws(c, "ipse", S.TARGETS["ipse"], ["row_key"], S.M, S.SEED)
    return IM.complete_long(c, drawn, "ipse", S.M).select("row_key", "imp", "ipse")


@query
def pool_imputations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by (unit, year, flag) pooled over imputations (sparse form)."""
    c = S.cases(spark, sf_dir)
    drawn = IM.hotdeck_draws(c, "ipse", S.TARGETS["ipse"], ["row_key"], S.M, S.SEED)
    observed = c.filter(F.col("ipse").isNotNull())
    return PL.sparse_pool(observed, drawn, ["state", "year", "ipse"], S.M)


@query
def group_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure-2 shape: exposed cases, latest report per person, by year x group x source."""
    return SV.group_rates(S.cases(spark, sf_dir), S.population_by_year(spark, sf_dir), IMPUTATION,
                          where=F.col("ipse") == True, min_year=1995)  # noqa: E712


@query
def type_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure-1 shape: type counts by year x source with labels and level order."""
    return SV.type_rates(S.cases(spark, sf_dir), S.population_by_year(spark, sf_dir), IMPUTATION,
                         where=F.col("ipse") == True)  # noqa: E712


def _state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SV.state_counts(S.cases(spark, sf_dir), IMPUTATION, where=F.col("medical"),
                           quality=STATE_QUALITY)


@query
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_counts(spark, sf_dir)


@query
def state_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = SV.state_panel(_state_counts(spark, sf_dir), S.population_by_year(spark, sf_dir), S.M,
                         exclude=S.EXCLUDED_UNITS, drop_units=[S.DROPPED_UNIT])
    return out.withColumns({"n_mn": F.round("n_mn", 6), "r_mn": F.round("r_mn", 6)})


def _unit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SV.unit_rates(_state_counts(spark, sf_dir), S.population_by_year(spark, sf_dir), S.M,
                         S.FOCUS_YEAR, exclude=S.EXCLUDED_UNITS, group_levels=S.GROUP_LEVELS)


@query
def unit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit_rates(spark, sf_dir).withColumns({"n_mn": F.round("n_mn", 6),
                                                   "r_mn": F.round("r_mn", 6)})


@query
def unit_disparity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SV.unit_disparity(_unit_rates(spark, sf_dir), S.REFERENCE_GROUP, S.ORDER_GROUP,
                             labels=("Greater than reference rate",
                                     "Less than or equal to reference rate"))


@query
def impute_pmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric target by predictive mean matching (5 donors), m draws per missing row."""
    c = S.cases(spark, sf_dir)
    drawn = IM.pmm_draws(c, "amount", numeric=["chmal1"], categorical=["state", "medical"],
                         row_key=["row_key"], m=S.M, seed=S.SEED)
    return drawn.select("row_key", "imp", "amount")


CHAINED_TARGETS = {
    "race_ethn": {"method": "polyreg", "predictors": ["state", "medical", "chmal1", "ipse"],
                  "cells": S.TARGETS["race_ethn"]},
    "ipse": {"method": "logreg", "predictors": ["state", "medical", "chmal1", "race_ethn"],
             "cells": S.TARGETS["ipse"]},
    "amount": {"method": "pmm", "predictors": ["chmal1", "medical", "race_ethn", "ipse"],
               "cells": [["state"]]},
}


@query
def impute_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three targets by chained equations (polytomous, logistic, PMM), m = 10, 5 rounds,
    one independent run per year."""
    from casetally.operators.chained import chained_impute
    c = S.cases(spark, sf_dir).select("row_key", "year", "state", "medical", "chmal1", "race_ethn", "ipse", "amount")
    long = chained_impute(c, CHAINED_TARGETS, ["row_key"], S.M, S.SEED, maxit=5, by=["year"])
    return long.select("row_key", "imp", "race_ethn", "ipse", "amount")


@query
def pmm_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donor search and draw of predictive mean matching with given predictions (one run per year)."""
    c = S.cases(spark, sf_dir).withColumn("__p", (F.col("chmal1") * 8 + F.length("state")).cast("double"))
    tags = [F.lit(1).alias(MO.ALL), F.col("year").cast("string").alias(MO.BY)]
    seen = c.filter(F.col("amount").isNotNull()).select(*tags, "__p", F.col("amount").cast("double").alias("__v"))
    donors = seen.groupBy(*seen.columns).agg(F.count(F.lit(1)).alias(MO.WEIGHT))
    u = uniform_u32(F.lit(S.SEED), "row_key", F.lit(1), F.lit("amount"), F.lit(0))
    need = c.filter(F.col("amount").isNull()).select(*tags, "row_key", (F.col("__p") + 3.25).alias("__p"), u.alias("__u"))
    return MO.match_donors(donors, need, 5, "amount").select("row_key", F.col("amount").cast("int").alias("amount"))


EXACT_M = 2
EXACT_TARGETS = {"amount": ["chmal1", "urgent"], "flag": ["chmal1", "amount"]}


@query
def impute_exact_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round over two targets with exact fits, one run per year: the second fit sees the first target's draws."""
    from casetally.operators.chained import exact_round
    c = S.cases(spark, sf_dir).select("row_key", "year", F.col("chmal1").cast("long").alias("chmal1"), F.col("medical").cast("long").alias("urgent"),
                                      F.col("amount").cast("long").alias("amount"), F.col("ipse").cast("int").cast("long").alias("flag"))
    done = exact_round(c, EXACT_TARGETS, ["row_key"], EXACT_M, S.SEED, by=["year"])
    return done.select("row_key", "imp", "amount", "flag")


# ------------------------------------- draw store, results after chained equations

from casetally.sources.drawstore import DrawStore  # noqa: E402

#: Group (as its place among the levels) and flag, by one exact round a year.
CHAIN_TARGETS = {"grp": ["chmal1", "urgent"], "flag": ["chmal1", "grp"]}
GROUP_CODES = S.GROUP_LEVELS[1:]


def _coded(cases: DataFrame) -> DataFrame:
    return cases.withColumns({"grp": R.level_ordinal("race_ethn", GROUP_CODES).cast("long"), "flag": F.col("ipse").cast("int").cast("long"),
                              "urgent": F.col("medical").cast("long"), "chmal1": F.col("chmal1").cast("long")})


def _stored(spark: SparkSession, cases: DataFrame) -> DrawStore:
    """The cases imputed by chained equations, each year for itself, and written as a draw store."""
    from casetally.operators.chained import exact_round
    coded = MT.materialize(_coded(cases))  # read by the fits and by the store
    done = exact_round(coded.select("row_key", "year", "chmal1", "urgent", "grp", "flag"), CHAIN_TARGETS, ["row_key"], EXACT_M, S.SEED, by=["year"])
    store = DrawStore(MT.new_folder(spark), list(CHAIN_TARGETS), ["row_key"])
    store.write(coded.drop("race_ethn", "ipse"), done, EXACT_M)
    return store


def _decoded(df: DataFrame) -> DataFrame:
    labels = F.array(*[F.lit(g) for g in GROUP_CODES])
    return df.withColumns({"race_ethn": F.get(labels, F.col("grp").cast("int") - 1), "ipse": F.col("flag") == 1, "chmal1": F.col("chmal1").cast("int")})


@query
def imputation_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form rebuilt from a draw store, from 1994 on; 1996 was written again with its medical reports only."""
    store = _stored(spark, S.cases(spark, sf_dir))
    of_1996 = store.split(spark, F.col("year") == 1996)
    again = [df.filter("medical") for df in of_1996]
    records = MT.materialize(again[0].unionByName(_without(again[1].filter(F.col("imp") == 1), store)))
    store.write(records, MT.materialize(again[1]), EXACT_M)
    return store.long(spark, F.col("year") >= 1994).select("row_key", "imp", "year", "grp", "flag")


def _without(completed: DataFrame, store: DrawStore) -> DataFrame:
    """Records of one imputation with all targets missing again: readers take each from the draws."""
    return completed.withColumns({t: F.lit(None).cast("long") for t in store.targets}).drop(store.imp_col)


def _latest_chained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    full, done = _stored(spark, S.cases(spark, sf_dir)).split(spark)
    return SV.latest_of_split(_decoded(full), _decoded(done), EXACT_M, where=F.col("ipse"))


@query
def group_rates_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure-2 shape read from the draw store after chained equations."""
    stable, expanded = _latest_chained(spark, sf_dir)
    return SV.group_rates_split(stable, expanded, S.population_by_year(spark, sf_dir), EXACT_M, min_year=1995)


@query
def type_rates_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure-1 shape read from the draw store after chained equations."""
    stable, expanded = _latest_chained(spark, sf_dir)
    return SV.type_rates_split(stable, expanded, S.population_by_year(spark, sf_dir), EXACT_M)


def _state_counts_chained(spark: SparkSession, sf_dir: str, where=None) -> DataFrame:
    """Unit-years that pass the quality screen, imputed and stored; ``where`` prunes the years that are read."""
    c = S.cases(spark, sf_dir)
    c = Q.quality_gate(c, Q.quality_flags(c, ["state", "year"], "ipse", **STATE_QUALITY), ["state", "year"])
    full, done = _stored(spark, c).split(spark, where)
    return SV.counts_by_year(_decoded(full).filter("medical"), _decoded(done).filter("medical"), EXACT_M)


@query
def state_counts_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_counts_chained(spark, sf_dir)


@query
def state_panel_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = SV.state_panel(_state_counts_chained(spark, sf_dir), S.population_by_year(spark, sf_dir), EXACT_M,
                         exclude=S.EXCLUDED_UNITS, drop_units=[S.DROPPED_UNIT])
    return out.withColumns({"n_mn": F.round("n_mn", 6), "r_mn": F.round("r_mn", 6)})


def _unit_rates_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _state_counts_chained(spark, sf_dir, F.col("year") == S.FOCUS_YEAR)
    return SV.unit_rates(counts, S.population_by_year(spark, sf_dir), EXACT_M, S.FOCUS_YEAR, exclude=S.EXCLUDED_UNITS, group_levels=S.GROUP_LEVELS)


@query
def unit_rates_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit_rates_chained(spark, sf_dir).withColumns({"n_mn": F.round("n_mn", 6), "r_mn": F.round("r_mn", 6)})


@query
def unit_disparity_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SV.unit_disparity(_unit_rates_chained(spark, sf_dir), S.REFERENCE_GROUP, S.ORDER_GROUP,
                             labels=("Greater than reference rate", "Less than or equal to reference rate"))


@query
def logistic_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw of a two-class target from a logit with given coefficients."""
    c = S.cases(spark, sf_dir).filter(F.col("ipse").isNull())
    design = MO.Design(numbers={"chmal1": (1.0, 4.0, False)}, factors={"medical": ["false", "true"]})
    u = uniform_u32(F.lit(S.SEED), "row_key", F.lit(1), F.lit("ipse"), F.lit(0))
    rows = c.select("row_key", F.lit(1).alias(MO.ALL), F.lit("").alias(MO.BY), u.alias("__u"), *design.columns("__x_"))
    given = [0.25, -1.5, 0.75]
    fits = spark.createDataFrame([(1, "", given, given, 0.0)], MO.COEFFICIENTS)
    drawn = MO.draw_classes(rows, design, ["false", "true"], fits, "__u", "drawn")
    return drawn.select("row_key", F.col("drawn").cast("boolean").alias("ipse"))


@query
def pop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons at risk by group over the unit-years that have case records."""
    unit_years = D.distinct_keys(S.cases(spark, sf_dir), ["state", "year"])
    j = J.natural_left_join(unit_years, S.population_by_year(spark, sf_dir), keys=["state", "year"],
                            null_safe=True)
    return AG.strict_sums(j, ["race_ethn"], ["pop"])
