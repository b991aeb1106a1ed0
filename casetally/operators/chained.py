"""Multiple imputation by chained equations on Spark.

Rows with no missing target are the same in every imputation; they are never
replicated: models see them once, weighted by pattern, under every
imputation's coefficients. Rows with a missing target are expanded m times,
initialised by hot-deck, then for ``maxit`` rounds each target is re-drawn
from a model fitted, per imputation (and ``by`` group), on the currently
completed data:

* categorical targets: multinomial logit by Newton's method, with
  pseudo-observations against separated classes (``logreg``, two classes, draws its coefficients from their posterior
  before predicting; ``polyreg`` predicts with the estimates);
* numeric targets (``pmm``): Bayesian linear regression and predictive mean
  matching with the nearest donors.

Fits and donor search are distributed (``operators.models``): no group of
rows is gathered, all imputations and groups are fitted in the same passes.
Draws use the keyed hash with the round number. The records are written once,
then after each drawn target the rows that miss it, and no others, to the
shared checkpoint folder to cut the lineage. Coefficients are rounded
to ten digits before use, so the order in which Spark adds up partial sums
does not show in the draws.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetally.functions.draws import uniform_u32
from casetally.operators import models as MO
from casetally.operators.impute import IMP, hotdeck_complete, with_imputations
from casetally.operators.joins import natural_left_join
from casetally.operators.materialize import REPEATED_ROWS, discard, materialize

KINDS = ("factor", "number")
#: Which targets a record missed, as bits.
GAPS = "__gaps"


def methods_from_schema(df: DataFrame, targets: Sequence[str], kinds: dict[str, str] | None = None) -> dict[str, str]:
    """Default method per target: boolean -> ``logreg``, text or a declared factor -> ``polyreg``, numeric -> ``pmm``."""
    out = {}
    for t in targets:
        dt = df.schema[t].dataType
        factor = (kinds or {}).get(t, "factor" if MO.is_factor(dt) else "number") == "factor"
        out[t] = "logreg" if isinstance(dt, T.BooleanType) else ("polyreg" if factor else "pmm")
    return out


def _key(seed: int, target: str, draw_round: int, imp: int, by: str) -> list[int]:
    return [seed, imp, draw_round, zlib.crc32(target.encode()), zlib.crc32(by.encode())]


def chained_impute(df: DataFrame, targets: dict[str, dict], row_key: Sequence[str], m: int, seed: int,
                   maxit: int = 5, imp_col: str = IMP, donors: int = 5, by: Sequence[str] = (),
                   kinds: dict[str, str] | None = None, split: bool = False):
    """Completed long data (every record once per imputation).

    ``targets`` maps each target to ``{"method": "logreg"|"polyreg"|"pmm",
    "predictors": [...], "cells": [...]}``; ``predictors`` is the row of the
    predictor matrix (ids and excluded columns are simply not listed),
    ``cells`` the hot-deck cells used for initialisation (default: whole
    table); a missing ``method`` is taken from the column's kind. ``kinds``
    declares columns as ``"factor"`` or ``"number"`` where the type does not
    tell (a factor held as codes). A predictor that is not a target may have
    missing values: a level of their own (factor) or an indicator (number).
    ``by`` columns (e.g. the year) split the data into independent imputation
    runs: every model is fitted per (imputation, by) group. Targets without
    missing values are left as they are. ``row_key`` must be unique.

    With ``split=True`` the result is ``(observed, completed)``: the records
    without any missing target once (the same in every imputation), and the
    completed long rows of the other records, so callers can avoid
    replicating the observed majority m times.
    """
    if bad := set((kinds or {}).values()) - set(KINDS):
        raise ValueError(f"unknown kinds {sorted(bad)}")
    defaults = methods_from_schema(df, list(targets), kinds)
    targets = {t: {"method": defaults[t], **spec} for t, spec in targets.items()}
    names = list(targets)
    any_missing = reduce(lambda a, b: a | b, [F.col(t).isNull() for t in names])
    df = materialize(df)  # read by every aggregate below
    full = df.filter(~any_missing)
    by_key = F.to_json(F.struct(*by)) if by else F.lit("")
    bit = {t: 1 << i for i, t in enumerate(names)}
    gaps = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(t).isNull(), bit[t]).otherwise(0) for t in names])
    part = materialize(df.filter(any_missing).withColumns({GAPS: gaps, MO.BY: by_key}))
    of_group = part.groupBy(MO.BY).agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(~_observed(bit[t])).alias(t) for t in names])
    missing = of_group.agg(F.max("__rows").alias("__most"), F.sum("__rows").alias("__rows"), *[F.sum(t).alias(t) for t in names]).first()
    active = [t for t in names if missing[t]]
    init = hotdeck_complete(part, {t: targets[t].get("cells", [[]]) for t in names}, row_key, m, seed,
                            imp_col=imp_col, donors=df)
    cur = _dealt(init.withColumn(MO.ALL, F.col(imp_col).cast("int")).drop(imp_col), row_key, m, missing["__rows"] or 0, missing["__most"] or 0)
    # every row lies in one layer: that of the last target drawn for it
    layers = [(materialize(cur), 0)]
    schema = {f.name: f.dataType for f in df.schema.fields}
    kind = {c: (kinds or {}).get(c, "factor" if MO.is_factor(schema[c]) else "number") for c in schema}
    every = MO.Design.of(df, list(dict.fromkeys(p for t in active for p in targets[t]["predictors"])), kind)
    design = {t: every.only(targets[t]["predictors"]) for t in active}
    value = {t: (MO.text(t) if targets[t]["method"] != "pmm" else F.col(t).cast("double")).alias("__y") for t in active}
    classes = {t: sorted(r[0] for r in df.filter(F.col(t).isNotNull()).select(MO.text(t)).distinct().collect())
               for t in active if targets[t]["method"] != "pmm"}  # bounded by the target's domain
    # the patterns of complete records never change
    fixed = {}
    parts_of_by = [F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)]
    by_of_pattern = F.to_json(F.struct(*[F.col(f"__by_{i}").alias(c) for i, c in enumerate(by)])) if by else F.lit("")
    for t in active:
        seen = full.select(*parts_of_by, *design[t].columns(), value[t])
        counts = seen.groupBy(*seen.columns).agg(F.count(F.lit(1)).alias(MO.WEIGHT))
        fixed[t] = materialize(counts.select(F.lit(0).alias(MO.ALL), by_of_pattern.alias(MO.BY), *seen.columns[len(by):], MO.WEIGHT))
    fits: dict[str, DataFrame] = {}
    for it in range(1, maxit + 1 if active else 1):
        for t in active:
            spec, d = targets[t], design[t]
            cur = _rows_of(layers)
            known = cur.filter(_observed(bit[t])).select(MO.ALL, MO.BY, *d.columns(), value[t])
            known = materialize(known.groupBy(*known.columns).agg(F.count(F.lit(1)).alias(MO.WEIGHT)))
            rows = fixed[t].unionByName(known)
            u = uniform_u32(F.lit(seed), *[F.col(k) for k in row_key], F.col(MO.ALL), F.lit(t), F.lit(it))
            need = cur.filter(~_observed(bit[t])).withColumn("__u", u).select("*", *d.columns("__x_"))
            if spec["method"] == "pmm":
                drawn = _matched(rows, need, d, t, m, seed, it, donors)
            elif len(classes[t]) == 1:
                drawn = need.withColumn("__drawn", F.lit(classes[t][0]))
            else:
                key = partial(_key, seed, t, it) if spec["method"] == "logreg" else None
                fits[t] = MO.fit_logit(rows, d, "__y", classes[t], m, fits.get(t), key)
                drawn = MO.draw_classes(need, d, classes[t], fits[t], "__u", "__drawn")
            # a group without any observed value keeps its hot-deck draw
            drawn = drawn.withColumn(t, F.coalesce(F.col("__drawn").cast(schema[t]), F.col(t)))
            layers = _redrawn(layers, materialize(drawn.select(*cur.columns)), bit[t], sum(bit[a] for a in active))
    done = _rows_of(layers).select(*df.columns, F.col(MO.ALL).alias(imp_col))
    if split:
        return full, done
    return with_imputations(full, m, imp_col).unionByName(done)


def _dealt(long: DataFrame, row_key: Sequence[str], m: int, rows: int, most: int) -> DataFrame:
    """The ``m`` rows of each of ``rows`` records (``most`` in one group), an imputation's rows in tasks of their own of about
    ``REPEATED_ROWS`` and a group's in few of them: a task counts the patterns of few models."""
    tasks = max(-(-rows * m // REPEATED_ROWS), long.sparkSession.sparkContext.defaultParallelism)
    each = -(-tasks // m)  # of an imputation
    pieces = max(-(-4 * each * most // max(rows, 1)), 1)  # of a group, so that none fills a task
    piece = F.pmod(F.xxhash64(*row_key), F.lit(pieces))
    return long.repartitionById(each * m, ((F.col(MO.ALL) - 1) * each + F.pmod(F.xxhash64(F.col(MO.BY), piece), F.lit(each))).cast("int"))


def _observed(targets: int) -> Column:
    """Was none of these targets (bits) missing in the record?"""
    return F.col(GAPS).bitwiseAND(targets) == 0


def _rows_of(layers: list[tuple[DataFrame, int]]) -> DataFrame:
    """The current rows: a layer's rows without those that miss one of the targets drawn since."""
    return reduce(DataFrame.unionByName, [df.filter(_observed(since)) if since else df for df, since in layers])


def _redrawn(layers: list[tuple[DataFrame, int]], drawn: DataFrame, target: int, active: int) -> list[tuple[DataFrame, int]]:
    """The layers once ``drawn`` holds all rows that miss ``target``. One that has lost the rows of every target is empty; its files go."""
    kept = []
    for df, since in layers:
        if since | target == active:
            discard(df)
        else:
            kept.append((df, since | target))
    return [*kept, (drawn, 0)]


def _matched(rows: DataFrame, need: DataFrame, design: MO.Design, target: str, m: int, seed: int, draw_round: int,
             donors: int) -> DataFrame:
    """``need`` with the value of a donor with a near prediction in ``__drawn``."""
    fits = MO.fit_linear(rows, design, "__y", m, partial(_key, seed, target, draw_round))
    # rows with equal predictors have one prediction: of them no more can be drawn, whatever the imputations add
    outer = MO.outer_donors(rows.withColumnRenamed("__y", "__v"), [MO.ALL, MO.BY, *design.numbers, *design.factors], donors)
    pool = MO.predicted(outer, design, fits, "beta", ["__v", MO.WEIGHT])
    pool = materialize(pool.groupBy(MO.ALL, MO.BY, "__p", "__v").agg(F.sum(MO.WEIGHT).alias(MO.WEIGHT)))
    # rows of a key with equal predictors have the same nearest donors: these are searched once, a row draws among them
    keys = [MO.ALL, MO.BY, *[f"__x_{p}" for p in [*design.numbers, *design.factors]]]
    points = materialize(need.select(*keys).distinct())
    points = MO.predicted(points, design, fits, "drawn", keys[2:], "__x_", shared=False)
    near = materialize(MO.match_donors(pool, points, donors, "__near", None))
    found = natural_left_join(need, near, keys=keys, null_safe=True, broadcast_max_bytes=None)
    place = F.floor(F.col("__u") / F.lit(MO.U32) * F.size("__near")).cast("int")
    return found.withColumn("__drawn", F.get("__near", place))


def exact_round(df: DataFrame, targets: dict[str, Sequence[str]], row_key: Sequence[str], m: int, seed: int, imp_col: str = IMP,
                donors: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """One round of predictive mean matching in visiting order, with fits that any exact engine can replay.

    ``targets`` maps integer targets, in visiting order, to integer predictors: complete columns or targets visited before.
    Least squares are exact (``models.fit_exact``), donors and recipients are predicted with the estimates (no posterior
    draw), a fit sees observed records once and completed ones by imputation. Returns the records with a missing target,
    once per imputation, completed. A group without an observed value leaves its target missing."""
    any_missing = reduce(lambda a, b: a | b, [F.col(t).isNull() for t in targets])
    by_key = F.to_json(F.struct(*by)) if by else F.lit("")
    tagged = df.withColumn(MO.BY, by_key)
    full = tagged.filter(~any_missing).withColumn(MO.ALL, F.lit(0))
    part = with_imputations(tagged.filter(any_missing), m, imp_col).withColumn(MO.ALL, F.col(imp_col).cast("int"))
    cur = materialize(part.withColumns({f"__m_{t}": F.col(t).isNull() for t in targets}))
    for t, predictors in targets.items():
        cols = [MO.ALL, MO.BY, *predictors, F.col(t).cast("long").alias("__v")]
        seen = full.select(*cols).unionByName(cur.filter(F.col(t).isNotNull()).select(*cols))
        rows = materialize(seen.groupBy(*seen.columns).agg(F.count(F.lit(1)).alias(MO.WEIGHT)))
        fits = MO.fit_exact(rows, predictors, "__v", m)
        pool = MO.predicted_exact(rows, predictors, fits, ["__v", MO.WEIGHT])
        pool = pool.groupBy(MO.ALL, MO.BY, "__p", F.col("__v").cast("double").alias("__v")).agg(F.sum(MO.WEIGHT).alias(MO.WEIGHT))
        u = uniform_u32(F.lit(seed), *[F.col(k) for k in row_key], F.col(imp_col), F.lit(t), F.lit(0))
        need = cur.filter(f"__m_{t}").withColumn("__u", u)
        asked = MO.predicted_exact(need, predictors, fits, [c for c in need.columns if c not in (MO.ALL, MO.BY)])
        drawn = MO.match_donors(pool, asked, donors, "__drawn")
        drawn = drawn.withColumn(t, F.col("__drawn").cast(df.schema[t].dataType))
        cur = materialize(cur.filter(~F.col(f"__m_{t}")).unionByName(drawn.select(*cur.columns)))
    return cur.select(*df.columns, imp_col)
