"""The surveillance results as compositions of the operators.

The functions are generic over column roles (``Roles``): any case table with
a person, unit, year, report date, source flag, group, exposure flag and
type-code slots, plus a denominator table keyed by (year, unit, group), can
be run through them.

Scale notes. Imputation multiplies records by m only where it has to:

* national path (``group_rates``, ``type_rates``): the infant-style filter and
  the per-imputation deduplication depend on imputed values, so persons that
  have any record with a missing target are expanded m times; persons whose
  records are all observed give the same result in every imputation and are
  processed once (``pool_split`` adds the two parts per imputation);
* state path (``state_counts``): no filter or dedup depends on imputed
  values, so only records with a missing target are expanded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetally.functions import recode as R
from casetally.operators import aggregate as AG
from casetally.operators import dedup as D
from casetally.operators import impute as IM
from casetally.operators import joins as J
from casetally.operators import materialize as MT
from casetally.operators import panel as PN
from casetally.operators import pool as PL
from casetally.operators import quality as Q
from casetally.operators import rates as RT
from casetally.operators import reshape as RS


@dataclass(frozen=True)
class Roles:
    row_key: str = "row_key"
    person: str = "person"
    unit: str = "state"
    year: str = "year"
    date: str = "rptdt"
    source: str = "medical"
    group: str = "race_ethn"
    flag: str = "ipse"
    slots: tuple[str, ...] = ("chmal1", "chmal2", "chmal3", "chmal4")
    imp: str = "imp"


@dataclass(frozen=True)
class Imputation:
    """Hot-deck targets with their conditioning cells (finest first)."""
    targets: dict = field(default_factory=dict)
    m: int = 10
    seed: int = 57


RATE_NAMES = {"r_mn": "n_mn", "r_min": "n_min", "r_max": "n_max"}
TYPE_FLAGS = ["phy_abuse", "neglect", "sex_abuse", "other"]

# Presentation labels and level orders of the type figure.
TYPE_LABELS = {"neglect": "Neglect", "phy_abuse": "Physical abuse",
               "sex_abuse": "Sexual abuse", "other": "Other"}
TYPE_LEVELS = ["Neglect", "Physical abuse", "Sexual abuse", "Other"]
SOURCE_LABELS = {True: "Medical professionals", False: "All others"}
SOURCE_LEVELS = ["Medical professionals", "All others"]


def _any_missing(cols: Sequence[str]) -> Column:
    out = None
    for c in cols:
        out = F.col(c).isNull() if out is None else (out | F.col(c).isNull())
    return out


# ------------------------------------------------------------ national path


def latest_report_split(cases: DataFrame, imp: Imputation, roles: Roles,
                        where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Latest report per (imputation, year, person) after ``where``.

    Returns (stable, expanded): ``stable`` holds the kept records of persons
    with no missing target in that year (the same in every imputation, no
    ``imp`` column); ``expanded`` holds the kept records, per imputation, of
    the other persons. Their union per imputation equals deduplicating the
    fully completed long table.

    One aggregation per (year, person), partial on the map side, finds both
    whether any record misses a target and the latest record passing
    ``where``; stable persons need nothing else. Records of the other persons
    are fetched by a semi join (which AQE splits if a person is hot), dealt over
    tasks by their number (so a task's sort stays small), expanded m times,
    completed, filtered and deduplicated by a partial ``min_by``.
    """
    r = roles
    miss = _any_missing(list(imp.targets))
    ok = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    marked = cases.withColumns({"__miss": miss.cast("int"), "__ok": ok})
    ordering = D.ordering_key(marked, [r.date], [r.row_key], latest=True, first=[~F.col("__ok")])
    if ordering is None:
        raise ValueError(f"report date {r.date} must be a date, timestamp or number")
    per = marked.groupBy(r.year, r.person).agg(
        F.max("__miss").alias("__unstable"),
        F.min_by(F.struct(*[F.col(c) for c in cases.columns], F.col("__ok")), ordering).alias("__row"))
    stable = (per.filter((F.col("__unstable") == 0) & F.col("__row.__ok"))
                 .select("__row.*").drop("__ok"))
    unstable_keys = per.filter(F.col("__unstable") == 1).select(r.year, r.person)
    unstable = cases.join(unstable_keys, [r.year, r.person], "left_semi")
    unstable = MT.spread_repeated(unstable, imp.m, cases.count())
    long_u = IM.hotdeck_complete(unstable, imp.targets, [r.row_key], imp.m, imp.seed,
                                 imp_col=r.imp, donors=cases)
    if where is not None:
        long_u = long_u.filter(where)
    expanded = D.keep_latest(long_u, [r.imp, r.year, r.person], [r.date], [r.row_key])
    return stable, expanded


def latest_of_split(observed: DataFrame, completed: DataFrame, m: int, roles: Roles = Roles(),
                    where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The same pair from records that are imputed already: ``observed`` without a missing target, ``completed`` the others
    per imputation (chained equations or a draw store). Only records of persons with a completed one are repeated."""
    r = roles
    keys = [r.year, r.person]
    open_ = completed.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.col(r.year).eqNullSafe(F.col(f"__{r.year}")) & F.col(r.person).eqNullSafe(F.col(f"__{r.person}"))
    stable = observed.join(open_, same, "left_anti")
    expanded = IM.with_imputations(observed.join(open_, same, "left_semi"), m, r.imp).unionByName(completed)
    if where is not None:
        stable, expanded = stable.filter(where), expanded.filter(where)
    return (D.keep_latest(stable, keys, [r.date], [r.row_key]),
            D.keep_latest(expanded, [r.imp, *keys], [r.date], [r.row_key]))


def group_rates(cases: DataFrame, pop: DataFrame, imp: Imputation, roles: Roles = Roles(),
                where: Column | None = None, min_year: int | None = None) -> DataFrame:
    """Pooled counts and rates per 1,000 by (year, group, source) (figure 2 shape)."""
    stable, expanded = latest_report_split(cases, imp, roles, where)
    return group_rates_split(stable, expanded, pop, imp.m, roles, min_year)


def group_rates_split(stable: DataFrame, expanded: DataFrame, pop: DataFrame, m: int,
                      roles: Roles = Roles(), min_year: int | None = None) -> DataFrame:
    """Figure-2 tail: kept records shared by all imputations (``stable``) plus
    kept records per imputation (``expanded``) -> pooled counts -> rates."""
    r = roles
    keys = [r.year, r.group, r.source]
    s_counts = AG.group_count(stable, keys)
    e_counts = AG.group_count(expanded, keys + [r.imp])
    pooled = PL.pool_split(s_counts, e_counts, keys, m, imp_col=r.imp,
                           names=("n_bar", "n_min", "n_max"))
    if min_year is not None:
        pooled = pooled.filter(F.col(r.year) > min_year)
    pop_g = pop.groupBy(r.year, r.group).agg(F.sum("pop").cast("bigint").alias("pop"))
    out = J.natural_left_join(pooled, pop_g, keys=[r.year, r.group], null_safe=True)
    return RT.add_rates(out, {"rate_max": "n_max", "rate_min": "n_min", "rate_bar": "n_bar"})


def type_rates(cases: DataFrame, pop: DataFrame, imp: Imputation, roles: Roles = Roles(),
               where: Column | None = None) -> DataFrame:
    """Pooled counts and rates by (year, source, type) with labels (figure 1 shape).

    Type flags are non-exclusive, so type counts do not add up to records.
    """
    stable, expanded = latest_report_split(cases, imp, roles, where)
    return type_rates_split(stable, expanded, pop, imp.m, roles)


def type_rates_split(stable: DataFrame, expanded: DataFrame, pop: DataFrame, m: int,
                     roles: Roles = Roles()) -> DataFrame:
    """Figure-1 tail on the stable/expanded split of kept records."""
    r = roles
    flags = _type_flags(r.slots)
    keys = [r.year, r.source]
    s_sums = AG.flag_sums(stable.withColumns(flags), keys, TYPE_FLAGS)
    e_sums = AG.flag_sums(expanded.withColumns(flags), keys + [r.imp], TYPE_FLAGS)
    s_long = RS.unpivot_long(s_sums, keys, TYPE_FLAGS, "type", "n")
    e_long = RS.unpivot_long(e_sums, keys + [r.imp], TYPE_FLAGS, "type", "n")
    pooled = PL.pool_split(s_long, e_long, keys + ["type"], m, imp_col=r.imp,
                           names=("n_mean", "n_min", "n_max"))
    pop_y = pop.groupBy(r.year).agg(F.sum("pop").cast("bigint").alias("pop"))
    out = J.natural_left_join(pooled, pop_y, keys=[r.year], null_safe=True)
    out = RT.add_rates(out, {"rate_mean": "n_mean", "rate_min": "n_min", "rate_max": "n_max"})
    return _label_types(out, r)


def group_rates_from_long(latest: DataFrame, pop: DataFrame, m: int, roles: Roles = Roles()) -> DataFrame:
    """Figure-2 shape from already deduplicated long records (one row per
    kept record and imputation)."""
    r = roles
    keys = [r.year, r.group, r.source]
    counts = AG.group_count(latest, keys + [r.imp])
    pooled = PL.pool_counts(counts, keys, m, imp_col=r.imp, names=("n_bar", "n_min", "n_max"))
    pop_g = pop.groupBy(r.year, r.group).agg(F.sum("pop").cast("bigint").alias("pop"))
    out = J.natural_left_join(pooled, pop_g, keys=[r.year, r.group], null_safe=True)
    return RT.add_rates(out, {"rate_max": "n_max", "rate_min": "n_min", "rate_bar": "n_bar"})


def type_rates_from_long(latest: DataFrame, pop: DataFrame, m: int, roles: Roles = Roles()) -> DataFrame:
    """Figure-1 shape from already deduplicated long records."""
    r = roles
    keys = [r.year, r.source]
    sums = AG.flag_sums(latest.withColumns(_type_flags(r.slots)), keys + [r.imp], TYPE_FLAGS)
    long = RS.unpivot_long(sums, keys + [r.imp], TYPE_FLAGS, "type", "n")
    pooled = PL.pool_counts(long, keys + ["type"], m, imp_col=r.imp, names=("n_mean", "n_min", "n_max"))
    pop_y = pop.groupBy(r.year).agg(F.sum("pop").cast("bigint").alias("pop"))
    out = J.natural_left_join(pooled, pop_y, keys=[r.year], null_safe=True)
    out = RT.add_rates(out, {"rate_mean": "n_mean", "rate_min": "n_min", "rate_max": "n_max"})
    return _label_types(out, r)


def _label_types(out: DataFrame, r: Roles) -> DataFrame:
    src = F.col(r.source)
    out = out.withColumn(r.source, R.ladder([(src == True, SOURCE_LABELS[True]),  # noqa: E712
                                             (src == False, SOURCE_LABELS[False])]))  # noqa: E712
    out = out.withColumn("type", R.code_labels("type", TYPE_LABELS))
    return out.withColumns({"type_ord": R.level_ordinal("type", TYPE_LEVELS),
                            "source_ord": R.level_ordinal(r.source, SOURCE_LEVELS)})


def _type_flags(slots: Sequence[str]) -> dict:
    return {
        "phy_abuse": R.any_equals(slots, 1),
        "neglect": R.any_in(slots, [2, 3]),
        "sex_abuse": R.any_equals(slots, 4),
        "other": R.any_above(slots, 4),
    }


# --------------------------------------------------------------- state path


def state_counts(cases: DataFrame, imp: Imputation, roles: Roles = Roles(),
                 where: Column | None = None, quality: dict | None = None) -> DataFrame:
    """Completed counts by (year, imp, unit, group, first slot, flag), zero-filled.

    Unit-years failing the quality screen of the flag are removed first (when
    ``quality`` gives thresholds). Records without missing targets are counted
    once and added to every imputation; only records with a missing target are
    expanded m times. The key grid (levels found in the counts) is completed
    with zeros within each year, as ``tidyr::complete`` does per yearly file.
    """
    r = roles
    if quality is not None:
        qf = Q.quality_flags(cases, [r.unit, r.year], r.flag, **quality)
        cases = Q.quality_gate(cases, qf, [r.unit, r.year])
    miss = _any_missing(list(imp.targets))
    observed = cases.filter(~miss)
    if where is not None:
        observed = observed.filter(where)
    long_m = IM.hotdeck_complete(cases.filter(miss), imp.targets, [r.row_key], imp.m, imp.seed,
                                 imp_col=r.imp, donors=cases)
    if where is not None:
        long_m = long_m.filter(where)
    return counts_by_year(observed, long_m, imp.m, r)


def counts_by_year(observed: DataFrame, completed: DataFrame, m: int, roles: Roles = Roles()) -> DataFrame:
    """Zero-filled counts from records without imputed values and completed long records."""
    r = roles
    keys = [r.year, r.unit, r.group, r.slots[0], r.flag]
    counts = counts_from_split(observed, completed, keys, m, r.imp)
    # completed within each year over the levels found in that year
    dims = {d: None for d in [r.imp, r.unit, r.group, r.slots[0], r.flag]}
    return RS.complete_grid(counts, dims, fill={"n": 0}, by=[r.year]).select(*keys, r.imp, "n")


def counts_from_split(observed: DataFrame, completed: DataFrame, keys: Sequence[str], m: int,
                      imp_col: str = "imp") -> DataFrame:
    """Record counts per (keys, imputation) from records without imputed values
    (counted once, added to every imputation) and completed long records.

    The observed counts are replicated over imputations only after
    aggregation, so the replication is bounded by the key grid.
    """
    obs_counts = AG.group_count(observed, keys)
    drawn_counts = AG.group_count(completed, list(keys) + [imp_col], name="__d")
    obs_per_imp = IM.with_imputations(obs_counts, m, imp_col)
    both = J.natural_left_join(obs_per_imp, drawn_counts, keys=list(keys) + [imp_col], null_safe=True,
                               how="full", broadcast_max_bytes=None)
    return both.select(*keys, imp_col, (F.coalesce(F.col("n"), F.lit(0))
                                        + F.coalesce(F.col("__d"), F.lit(0))).cast("bigint").alias("n"))


def _pool_units(counts: DataFrame, pop: DataFrame, keys: Sequence[str], m: int,
                roles: Roles) -> DataFrame:
    r = roles
    per_imp = counts.groupBy(*keys, r.imp).agg(F.sum("n").cast("bigint").alias("n"))
    pooled = PL.pool_counts(per_imp, keys, m, imp_col=r.imp, names=("n_mn", "n_min", "n_max"),
                            complete=True)
    out = J.natural_left_join(pooled, pop, keys=[r.year, r.unit, r.group], null_safe=True)
    return RT.add_rates(out, RATE_NAMES)


def state_panel(counts: DataFrame, pop: DataFrame, m: int, roles: Roles = Roles(),
                exclude: Sequence[str] = (), drop_units: Sequence[str] = ()) -> DataFrame:
    """Balanced unit panel by (year, unit, flag, group) with Total rows (figure 3 shape)."""
    r = roles
    if exclude:
        counts = counts.filter(R.not_in_keep_null(r.unit, list(exclude)))
    units = _pool_units(counts, pop, [r.flag, r.group, r.year, r.unit], m, r)
    panel = PN.keep_full_panel(units, r.unit, drop_units)
    base = panel.select(r.year, r.unit, r.flag, r.group, "n_mn", "n_min", "n_max", "pop")
    sums = AG.column_range(base, "n_mn", "pop")  # across(n_mn:pop, sum)
    total = RT.with_total_rows(base, [r.year, r.unit, r.flag], r.group, sums)
    return RT.add_rates(total, RATE_NAMES)


def unit_rates(counts: DataFrame, pop: DataFrame, m: int, year: int, roles: Roles = Roles(),
               exclude: Sequence[str] = (),
               group_levels: Sequence[str] | None = None) -> DataFrame:
    """Exposed-flag rates for one year by unit x group plus Total (figure 4 shape).

    Adds ``state_ord`` (units ordered by the Total rate) and ``group_ord``
    (explicit level order of the groups).
    """
    r = roles
    if exclude:
        counts = counts.filter(R.not_in_keep_null(r.unit, list(exclude)))
    c = counts.filter((F.col(r.flag) == True) & (F.col(r.year) == year))  # noqa: E712
    units = _pool_units(c, pop, [r.group, r.year, r.unit], m, r)
    base = units.select(r.year, r.unit, r.group, "n_mn", "n_min", "n_max", "pop")
    sums = AG.column_range(base, "n_mn", "pop")  # across(n_mn:pop, sum)
    total = RT.add_rates(RT.with_total_rows(base, [r.year, r.unit], r.group, sums), RATE_NAMES)
    # rounded so that float noise in summed Total means cannot flip the order
    order = PN.level_order(total, r.unit, [F.round("r_mn", 9)], ord_col="state_ord",
                           where=F.col(r.group) == "Total")
    out = total.join(order, r.unit, "left")
    if group_levels is not None:
        out = out.withColumn("group_ord", R.level_ordinal(r.group, list(group_levels)))
    return out


def unit_disparity(rates: DataFrame, reference: str, order_group: str, roles: Roles = Roles(),
                   labels: tuple[str, str] = ("Greater than white rate",
                                              "Less than or equal to white rate")) -> DataFrame:
    """Rate ratios against the reference group (figure 5 shape).

    ``state_ord`` orders units by the ratio of ``order_group``.
    """
    r = roles
    base = rates.drop("state_ord", "group_ord")
    d = RT.rate_ratios(base, [r.year, r.unit], r.group, reference, labels=labels)
    order = PN.level_order(d, r.unit, ["d"], ord_col="state_ord",
                           where=F.col(r.group) == order_group)
    return d.join(order, r.unit, "left")
