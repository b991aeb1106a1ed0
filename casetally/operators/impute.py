"""Multiple imputation of missing categories on Spark.

Every random choice is a keyed hash draw (``functions.draws``), so the m
completed data sets are reproducible, independent of partitioning and of
task retries, and replayable in SQL.

Hot-deck (``hotdeck_draws``): a missing value is drawn from the observed
distribution of the target within its cell (e.g. unit x year). Empty cells
back off to coarser cells, then to the whole table. The distribution tables
are aggregated in one pass per target, the backoff is resolved on the small
table (one row per cell, the value list bounded by the number of levels), and
it is attached to the missing rows by one equi-join on the finest cell keys,
broadcast when its materialised row count is within bounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetally.functions.draws import scaled, uniform_u32
from casetally.operators import models as MO
from casetally.operators.joins import natural_left_join
from casetally.operators.materialize import materialize, saved_with_stats, spread_small

IMP = "imp"
#: Entries of a distribution that are compared one after the other.
SHORT = 8


def with_imputations(df: DataFrame, m: int, imp_col: str = IMP) -> DataFrame:
    """m tagged copies of each row (narrow: ``explode``, no shuffle)."""
    return df.withColumn(imp_col, F.explode(F.sequence(F.lit(1), F.lit(m))))


def _levels(cells: Sequence[Sequence[str]]) -> list[list[str]]:
    levels = [list(c) for c in cells]
    if not levels or levels[-1]:
        levels.append([])
    finest = set(levels[0])
    for lv in levels[1:]:
        if not set(lv) <= finest:
            raise ValueError(f"backoff cell {lv} is not nested in the finest cell {levels[0]}")
    return levels


def cell_distribution(counts: DataFrame, target: str, cell: Sequence[str], tag: str) -> DataFrame:
    """Per cell: observed values with cumulative counts, as one sorted array.

    ``counts`` holds observed counts ``__c`` per (finer cell, value); they are
    summed up to ``cell``. Output: the cell keys, ``{tag}_thr`` =
    array<struct<hi, v>> (``hi`` = cumulative count up to and including value
    ``v``, values ascending) and ``{tag}_tot`` = observed rows in the cell.
    """
    per = counts.groupBy(*cell, target).agg(F.sum("__c").alias("__c"))
    w = Window.partitionBy(*cell).orderBy(F.col(target).asc()) if cell else Window.orderBy(F.col(target).asc())
    per = per.withColumn("__hi", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return per.groupBy(*cell).agg(
        F.sort_array(F.collect_list(F.struct(F.col("__hi").alias("hi"), F.col(target).alias("v")))).alias(f"{tag}_thr"),
        F.sum("__c").cast("bigint").alias(f"{tag}_tot"),
    )


def backoff_table(cells_needed: DataFrame, donors: DataFrame, targets: dict[str, Sequence[Sequence[str]]]) -> DataFrame:
    """Donor distributions with backoff applied, one row per needed finest cell.

    All ``targets`` must share the finest cell. Donors are aggregated once per
    target at the finest cell (one pass over the records, map-side combined);
    coarser cells are sums of that small table. For every cell in
    ``cells_needed`` the finest level with donors is chosen, giving columns
    ``{t}_thr`` and ``{t}_tot`` per target. The size is bounded by the number
    of cells, not by the number of records.
    """
    finest = None
    table = cells_needed
    for t, cells in targets.items():
        levels = _levels(cells)
        if finest is None:
            finest = levels[0]
        elif levels[0] != finest:
            raise ValueError("targets in one backoff table must share the finest cell")
        fine = (donors.filter(F.col(t).isNotNull())
                      .groupBy(*levels[0], t).agg(F.count(F.lit(1)).alias("__c")))
        thr_cols, tot_cols = [], []
        for i, cell in enumerate(levels):
            tag = f"__{t}_l{i}"
            dist = cell_distribution(fine, t, cell, tag)
            if cell:
                table = natural_left_join(table, dist, keys=cell, null_safe=True, broadcast_max_bytes=None)
            else:  # the whole-table distribution: one row, attached by a constant key
                table = (table.withColumn("__all", F.lit(0))
                              .join(dist.withColumn("__all", F.lit(0)), "__all", "left").drop("__all"))
            thr_cols.append(F.col(f"{tag}_thr"))
            tot_cols.append(F.col(f"{tag}_tot"))
        table = table.withColumns({f"{t}_thr": F.coalesce(*thr_cols), f"{t}_tot": F.coalesce(*tot_cols)})
        table = table.select(*finest, *[c for c in table.columns
                                        if c.endswith(("_thr", "_tot")) and not c.startswith("__")])
    return table


def with_draw(df: DataFrame, out: str, thr: str, tot: str, u: Column, max_len: int) -> DataFrame:
    """Add column ``out`` = the value drawn from threshold array ``thr``.

    The drawn entry is the first with ``hi > floor(u * total / 2**32)``. Up to
    ``SHORT`` entries are compared one after the other, in code compiled with
    the plan; longer arrays are searched by binary lifting over the bits of
    the position: ``bit_length(max_len)`` steps per row. Integers only; totals
    may reach 2**47.
    """
    arr, r, size = F.col(thr), F.col("__r"), max(int(max_len), 1)
    # columns of their own, so a row's hash is taken once and not in every step of the search
    df = df.withColumn("__h", u).withColumn("__r", scaled(F.col("__h"), F.col(tot)))
    # p = number of entries with hi <= r; the drawn entry is the next one
    if size <= SHORT:
        p = reduce(lambda a, b: a + b, [F.when(F.get(arr, F.lit(i))["hi"] <= r, 1).otherwise(0) for i in range(size)])
    else:
        n, bits = F.size(arr), F.array(*[F.lit(1 << b) for b in range(size.bit_length() - 1, -1, -1)])

        def step(p, bit):
            nxt = p + bit
            ok = (nxt <= n) & (F.element_at(arr, F.least(nxt, F.greatest(n, F.lit(1))))["hi"] <= r)
            return F.when(ok, nxt).otherwise(p)
        p = F.aggregate(bits, F.lit(0), step)
    return df.withColumn(out, F.when(r.isNotNull(), F.get(arr, p)["v"])).drop("__h", "__r")


def _saved(table: DataFrame) -> tuple[DataFrame, dict]:
    """The materialised table and the longest array per column."""
    thr_cols = [c for c in table.columns if c.endswith("_thr")]
    stats = {c: F.coalesce(F.max(F.size(c)), F.lit(0)) for c in thr_cols}
    small = saved_with_stats(table, stats)
    return small, {c: int(stats[c]) for c in thr_cols}


def _attached(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the materialised table (Spark broadcasts it if its files are small)."""
    if not keys:  # whole-table distribution only: one row, constant key
        return (df.withColumn("__all", F.lit(0))
                  .join(small.withColumn("__all", F.lit(0)), "__all", "left").drop("__all"))
    return natural_left_join(df, small, keys=list(keys), null_safe=True, broadcast_max_bytes=None)


def _attach(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, dict]:
    small, lengths = _saved(table)
    return _attached(df, small, keys), lengths


def hotdeck_draws(df: DataFrame, target: str, cells: Sequence[Sequence[str]], row_key: Sequence[str],
                  m: int, seed: int, imp_col: str = IMP, draw_round: int = 0,
                  observed: DataFrame | None = None) -> DataFrame:
    """Rows with a missing ``target``, one per imputation, with the value drawn.

    ``cells`` lists conditioning key sets from finest to coarsest (each nested
    in the finest); the whole table is always the last fallback. Donor
    distributions come from ``observed`` (default: ``df``). The missing rows
    are joined to the small backoff table once (broadcast when its files are
    small), then expanded to m imputations.
    """
    donors = observed if observed is not None else df
    finest = _levels(cells)[0]
    missing = spread_small(df.filter(F.col(target).isNull()))
    table = backoff_table(missing.select(*finest).distinct(), donors, {target: cells})
    attached, lengths = _attach(missing, table, finest)
    out = with_imputations(attached, m, imp_col)
    u = uniform_u32(F.lit(seed), *[F.col(k) for k in row_key], F.col(imp_col), F.lit(target), F.lit(draw_round))
    out = with_draw(out, "__drawn", f"{target}_thr", f"{target}_tot", u, lengths[f"{target}_thr"])
    out = out.withColumn(target, F.col("__drawn").cast(df.schema[target].dataType))
    return out.select(*df.columns, imp_col)


def complete_long(df: DataFrame, drawn: DataFrame, target: str, m: int, imp_col: str = IMP) -> DataFrame:
    """``mice::complete(action = "long")`` for one target.

    Observed rows are repeated for every imputation, missing rows take their
    draws; the original (incomplete) data is not included.
    """
    observed = with_imputations(df.filter(F.col(target).isNotNull()), m, imp_col)
    return observed.unionByName(drawn.select(*df.columns, imp_col))


def hotdeck_complete(df: DataFrame, targets: dict[str, Sequence[Sequence[str]]], row_key: Sequence[str],
                     m: int, seed: int, imp_col: str = IMP, donors: DataFrame | None = None) -> DataFrame:
    """Completed long data for several targets, each drawn from its own cells.

    Rows with no missing target are repeated m times without any join; rows
    with at least one missing target are joined once per group of targets
    sharing a finest cell (one small broadcast table), expanded m times, and
    get every missing target drawn (cell keys must be observed columns).
    Donor distributions come from ``donors`` (default ``df``), so a subset of
    the records can be completed with the distributions of the whole table.
    """
    pool = donors if donors is not None else df
    any_missing = None
    for t in targets:
        any_missing = F.col(t).isNull() if any_missing is None else (any_missing | F.col(t).isNull())
    full = with_imputations(spread_small(df.filter(~any_missing)), m, imp_col)
    part_rows = spread_small(df.filter(any_missing))
    groups: dict[tuple, dict] = {}
    for t, cells in targets.items():
        groups.setdefault(tuple(_levels(cells)[0]), {})[t] = cells
    lengths: dict[str, int] = {}
    tables = {}
    for finest, group in groups.items():
        tables[finest], found = _saved(backoff_table(part_rows.select(*finest).distinct(), pool, group))
        lengths.update(found)
    # long distributions go only with the rows that draw from them
    branches: list[tuple[DataFrame, list[str]]] = [(part_rows, [])]
    for finest, group in groups.items():
        wanted = reduce(lambda a, b: a | b, [F.col(t).isNull() for t in group])
        whole = max(lengths[f"{t}_thr"] for t in group) <= SHORT
        branches = [b for rows, drawn in branches for b in
                    [(_attached(rows if whole else rows.filter(wanted), tables[finest], finest), [*drawn, *group]), *([] if whole else [(rows.filter(~wanted), drawn)])]]
    u_cols = [F.lit(seed), *[F.col(k) for k in row_key], F.col(imp_col)]
    done = [full]
    for part, drawn in branches:
        part = with_imputations(part, m, imp_col)
        for t in sorted(drawn, key=lambda t: -lengths[f"{t}_thr"]):
            u = F.when(F.col(t).isNull(), uniform_u32(*u_cols, F.lit(t), F.lit(0)))
            part = with_draw(part, "__drawn", f"{t}_thr", f"{t}_tot", u, lengths[f"{t}_thr"])
            part = part.withColumn(t, F.coalesce(F.col(t), F.col("__drawn").cast(df.schema[t].dataType))).drop("__drawn", f"{t}_thr", f"{t}_tot")
        done.append(part.select(*df.columns, imp_col))
    return reduce(DataFrame.unionByName, done)


# -------------------------------------------------- predictive mean matching


def pmm_draws(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str],
              row_key: Sequence[str], m: int, seed: int, donors: int = 5, imp_col: str = IMP,
              draw_round: int = 0) -> DataFrame:
    """Predictive mean matching for a numeric target, m draws per missing row.

    Observed rows are scored with the fitted coefficients, missing rows with a
    posterior draw per imputation. Observed rows are compressed to donor groups
    (predicted value, observed value, count); each recipient takes its
    ``donors`` nearest donors by predicted value, found in a distributed sort
    of donors and recipients (``models.match_donors``), and the keyed hash
    picks one of them.
    """
    kinds = {**{c: "number" for c in numeric}, **{c: "factor" for c in categorical}}
    design = MO.Design.of(df, list(kinds), kinds)
    value = F.col(target).cast("double")
    tags = [F.lit(0).alias(MO.ALL), F.lit("").alias(MO.BY)]
    seen = df.filter(value.isNotNull()).select(*tags, *design.columns(), value.alias("__y"))
    rows = materialize(seen.groupBy(*seen.columns).agg(F.count(F.lit(1)).alias(MO.WEIGHT)))
    target_code = zlib.crc32(target.encode())
    fits = MO.fit_linear(rows, design, "__y", m, lambda imp, _: [seed, imp, draw_round, target_code])
    pool = MO.predicted(rows.withColumnRenamed("__y", "__v"), design, fits, "beta", ["__v", MO.WEIGHT])
    pool = pool.groupBy(MO.ALL, MO.BY, "__p", "__v").agg(F.sum(MO.WEIGHT).alias(MO.WEIGHT))
    missing = with_imputations(spread_small(df.filter(value.isNull())), m, imp_col)
    u = uniform_u32(F.lit(seed), *[F.col(c) for c in row_key], F.col(imp_col), F.lit(target), F.lit(draw_round))
    need = missing.withColumns({MO.ALL: F.col(imp_col), MO.BY: F.lit(""), "__u": u}).select("*", *design.columns("__x_"))
    asked = MO.predicted(need, design, fits, "drawn", [*df.columns, imp_col, "__u"], "__x_", shared=False)
    found = MO.match_donors(pool, asked, donors, "__drawn")
    return found.withColumn(target, F.col("__drawn").cast(df.schema[target].dataType)).select(*df.columns, imp_col)
