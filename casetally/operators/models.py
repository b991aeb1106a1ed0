"""Model fits for imputation, distributed by sufficient statistics.

No data-sized group is ever gathered, and nothing of a fit passes through the
driver. A fit is a few passes over the rows: every task sums its rows'
contribution to the normal equations (linear) or to gradient and information
(multinomial logit, one pass per Newton step); the sums meet in a tree by key
(imputation and ``by`` group), and the task that adds the last of them solves
the system. Coefficients are a table of one row per key, written to the shared
folder and joined back to the rows, without a closure or a forced broadcast,
whatever their number; predictions and draws are column expressions over them.
The driver reads one number per pass: how far the furthest key still has to
go. Where the distinct rows of the model matrix of every ``by`` group are few
(``GROUP``), one task makes all steps of a group's fits, in one pass in all.

All imputations and all ``by`` groups are fitted in the same passes. Rows
without a missing value are the same in every imputation; they come once
(imputation 0) and are evaluated under every imputation's coefficients.

Separated classes: every logit fit has weighted pseudo-observations, for each
class and predictor one below and one above the predictor's mean by its
standard deviation, the others at their means, all of them together weighing
as much as ``width`` observations. They keep the coefficients finite; a weak
ridge decides between collinear columns.

Predictive mean matching sorts donors and recipients together by predicted
value with a range partitioning; a recipient's nearest donors then lie in its
partition or among the few donors at the edges of its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetally.operators.materialize import materialize

U32 = float(1 << 32)
#: Prior precision of a logit coefficient (columns are scaled to 0..1): decides between collinear columns.
RIDGE = 1e-3
#: Newton stops after a step whose squared length, in posterior standard deviations, was below this (what is left to go
#: is then of the order of its square).
TOLERANCE = 1e-2
MAX_STEPS = 50
ALL, BY, WEIGHT = "__imp", "__by", "__n"
#: Coefficients of one key: estimates, the ones to predict with (drawn from their posterior where asked) and the last Newton decrement.
COEFFICIENTS = f"{ALL} int, {BY} string, beta array<double>, drawn array<double>, far double"
#: First level of the tree that adds up the sums: so many tasks per key.
FAN = 16
#: Numbers of a block's model matrix and bytes of a block's rows at most (at least one row).
BLOCK = 1 << 19
#: Rows that a task of a model fit has on the average.
FIT_ROWS = 1 << 16
#: Numbers of the model matrix of a ``by`` group at most that one task fits whole.
GROUP = 1 << 22
#: Where all steps are made in one task: a step of this squared length is the last, what is left is below the coefficients' ten digits.
SETTLED = 1e-12
#: Rows of sorted donors and recipients that a task of the donor search holds at once.
PIECE = 1 << 17


def is_factor(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.BooleanType))


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@dataclass
class Design:
    """Columns of the model matrix: intercept, numbers scaled by their range (with an indicator where some are
    missing), one 0/1 column per factor level but the first (a missing value is a level)."""

    numbers: dict[str, tuple[float, float, bool]] = field(default_factory=dict)
    factors: dict[str, list[str | None]] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, predictors: Sequence[str], kinds: dict[str, str]) -> Design:
        """Ranges and levels by one aggregate; levels are bounded by the factors' domains, not by the rows."""
        aggs, out = [F.lit(0).alias("__")], cls()
        for p in predictors:
            aggs.append(F.count_if(F.col(p).isNull()).alias(f"nulls_{p}"))
            if kinds[p] == "factor":
                aggs.append(F.sort_array(F.collect_set(text(p))).alias(f"levels_{p}"))
            else:
                aggs += [F.min(F.col(p).cast("double")).alias(f"min_{p}"), F.max(F.col(p).cast("double")).alias(f"max_{p}")]
        row = df.agg(*aggs).first()
        for p in predictors:
            if kinds[p] == "factor":
                out.factors[p] = [*row[f"levels_{p}"], *([None] if row[f"nulls_{p}"] else [])]
            else:
                lo = row[f"min_{p}"] or 0.0
                span = (row[f"max_{p}"] or 0.0) - lo
                out.numbers[p] = (lo, span or 1.0, bool(row[f"nulls_{p}"]))
        return out

    def columns(self, rename: str = "") -> list[Column]:
        """What ``matrix`` needs of a row."""
        return [F.col(p).cast("double").alias(rename + p) for p in self.numbers] + [text(p).alias(rename + p) for p in self.factors]

    def only(self, predictors: Sequence[str]) -> Design:
        """The design of some of the predictors, in their order."""
        return Design({p: self.numbers[p] for p in predictors if p in self.numbers}, {p: self.factors[p] for p in predictors if p in self.factors})

    def levels(self, rename: str = "") -> dict[str, Column]:
        """What ``product`` needs besides the columns: each factor's place among its levels (-1: none of them)."""
        out = {}
        for p, levels in self.factors.items():
            known = [F.lit(v) for v in levels if v is not None]
            place = F.array_position(F.array(*known), F.col(rename + p)).cast("int") - 1 if known else F.when(F.col(rename + p).isNotNull(), F.lit(-1))
            out[f"__k_{p}"] = F.coalesce(place, F.lit(len(levels) - 1))
        return out

    def product(self, c: Column, start: int = 0, rename: str = "") -> Column:
        """A row of ``matrix`` times the ``width`` coefficients from ``start`` in the array ``c``, the columns of ``levels`` being there."""
        total, at = F.get(c, F.lit(start)), start + 1
        for p, (lo, span, nulls) in self.numbers.items():
            v = F.col(rename + p)
            unknown = F.get(c, F.lit(at + 1)) if nulls else F.raise_error(F.lit(f"predictor {p} has missing values that its design does not know")).cast("double")
            total = total + F.when(v.isNull() | F.isnan(v), unknown).otherwise((v - F.lit(float(lo))) / F.lit(float(span)) * F.get(c, F.lit(at)))
            at += 1 + nulls
        for p, levels in self.factors.items():
            if len(levels) > 1:
                place = F.col(f"__k_{p}")
                total = total + F.when(place >= 1, F.get(c, place + F.lit(at - 1))).otherwise(F.lit(0.0))
                at += len(levels) - 1
        return total

    @property
    def width(self) -> int:
        return 1 + sum(1 + n[2] for n in self.numbers.values()) + sum(max(len(v) - 1, 0) for v in self.factors.values())

    def matrix(self, pdf: pd.DataFrame, rename: str = "") -> np.ndarray:
        cols = [np.ones(len(pdf))]
        for p, (lo, span, nulls) in self.numbers.items():
            v = pdf[rename + p].to_numpy(float)
            missing = np.isnan(v)
            if missing.any() and not nulls:
                raise ValueError(f"predictor {p} has missing values that its design does not know")
            cols.append(np.where(missing, 0.0, (v - lo) / span))
            if nulls:
                cols.append(missing.astype(float))
        for p, levels in self.factors.items():
            v = pd.Index(levels[:-1] if levels and levels[-1] is None else levels).get_indexer(pdf[rename + p])
            v = np.where(pdf[rename + p].isna(), len(levels) - 1, v)
            cols += list((v[None, :] == np.arange(1, len(levels))[:, None]).astype(float))
        return np.column_stack(cols)


Key = tuple[int, str]
Draw = Callable[[int, str], Sequence[int]]


def steady(x: np.ndarray) -> np.ndarray:
    """Ten significant digits: what summation order changes in the last ones does not reach the draws."""
    return np.array([float(f"{v:.10g}") for v in np.ravel(x)]).reshape(np.shape(x))


# ------------------------------------------------------------------ blocks


def clustered(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges of (imputation, by, a hash of the rest): a task has few keys, a key with many rows several tasks.

    Blocks of one key are full then, and a pass sends about one sum per key, not one per key and task."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FIT_ROWS))
    return rows.repartitionByRange(tasks, ALL, BY, F.xxhash64(*rows.columns))


def model_blocks(rows: DataFrame, design: Design, target: str, classes: Sequence[str] | None = None) -> DataFrame:
    """The rows' model matrix, target (class number or value) and weight as blocks of one key.

    ``rows``: imputation (0: all), by, weight, the design's columns and ``target``."""
    number = {c: i for i, c in enumerate(classes or ())}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, w = design.matrix(pdf), pdf[WEIGHT].to_numpy(float)
            y = pdf[target].map(number).to_numpy(float) if classes is not None else pdf[target].to_numpy(float)
            step = max(BLOCK // x.shape[1], 1)
            made = [(imp, by, x[part].tobytes(), y[part].tobytes(), w[part].tobytes())
                    for (imp, by), at in pdf.groupby([ALL, BY], sort=True).indices.items() for part in np.split(at, range(step, len(at), step))]
            if made:
                yield pd.DataFrame(made, columns=[ALL, BY, "x", "y", "w"]).astype({ALL: np.int32})
    return rows.mapInPandas(run, f"{ALL} int, {BY} string, x binary, y binary, w binary")


def _row_blocks(rows: DataFrame) -> DataFrame:
    """Whole rows as Arrow blocks of one key, to be joined with that key's coefficients."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            made, step = [], max(b.num_rows * BLOCK * 4 // max(b.nbytes, 1), 1)
            for (imp, by), at in b.select([ALL, BY]).to_pandas().groupby([ALL, BY], sort=True).indices.items():
                for part in np.split(at, range(step, len(at), step)):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, b.schema) as out:
                        out.write_batch(b.take(pa.array(part)))
                    made.append((imp, by, sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.string()),
                                              pa.array([m[2] for m in made], pa.binary())], names=[ALL, BY, "rows"])
    return rows.mapInArrow(run, f"{ALL} int, {BY} string, rows binary")


def _with_coefficients(blocks: DataFrame, fits: DataFrame | None, column: str) -> DataFrame:
    """Blocks with the coefficients ``column`` of all imputations of their group, as a list of (imputation, values)."""
    one = F.struct(F.col(ALL).alias("i"), F.col(column).alias("c"))
    if fits is None:
        return blocks.withColumn("fits", F.array().cast("array<struct<i:int,c:array<double>>>"))
    none = F.array().cast(f"array<struct<i:int,c:{fits.schema[column].dataType.simpleString()}>>")
    lists = fits.groupBy(BY).agg(F.sort_array(F.collect_list(one)).alias("fits"))  # one entry per imputation
    joined = blocks.join(lists, BY, "left")
    mine = F.filter("fits", lambda f: (F.col(ALL) == 0) | (f["i"] == F.col(ALL)))
    return joined.withColumn("fits", F.coalesce(mine, none))


def _each_block(blocks: DataFrame, fits: DataFrame, column: str, schema: T.StructType,
                make: Callable[[pd.DataFrame, Key, dict], Iterator[pd.DataFrame]], read: Callable = lambda c: np.asarray(c, float)) -> DataFrame:
    """``make(rows, key, coefficients by imputation)`` of every block of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for imp, by, body, found in zip(pdf[ALL], pdf[BY], pdf["rows"], pdf["fits"], strict=True):
                rows = pa.ipc.open_stream(body).read_all().to_pandas(date_as_object=True)
                yield from make(rows, (int(imp), by), {f["i"]: read(f["c"]) for f in found})
    return _with_coefficients(blocks, fits, column).mapInPandas(run, schema)


# ------------------------------------------------------------- statistics


def _added(finish: Callable[[Key, np.ndarray], list] | None = None) -> Callable:
    """Sums of statistics by key within a task; the last level turns a sum into a row of coefficients."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[Key, np.ndarray] = {}
        for pdf in batches:
            for imp, by, stats in zip(pdf[ALL], pdf[BY], pdf["stats"], strict=True):
                sums[imp, by] = sums[imp, by] + stats if (imp, by) in sums else np.asarray(stats, float)
        keys = sorted(sums)
        if not keys:
            return
        if finish is None:
            yield pd.DataFrame({ALL: np.array([k[0] for k in keys], np.int32), BY: [k[1] for k in keys], "salt": np.int32(0), "stats": [sums[k] for k in keys]})
        else:
            made = [(*k, *finish((int(k[0]), k[1]), sums[k])) for k in keys]
            yield pd.DataFrame(made, columns=[ALL, BY, "beta", "drawn", "far"]).astype({ALL: np.int32})
    return run


def _solved(blocks: DataFrame, fits: DataFrame | None, m: int, one: Callable[..., np.ndarray], width: int,
            finish: Callable[[Key, np.ndarray], list], tasks: int) -> tuple[DataFrame, float]:
    """One pass: the sum over all blocks of ``one(x, y, w, coefficients)`` by key, and ``finish(key, sum)`` of each.

    Returns the coefficient table and the largest ``far``. The sums of more than ``FAN`` ``tasks`` meet by (key, salt) first,
    then by key; only arrays of the size of the statistics travel."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        sums: dict[Key, np.ndarray] = {}
        for pdf in batches:
            for imp, by, x, y, w, found in zip(pdf[ALL], pdf[BY], pdf["x"], pdf["y"], pdf["w"], pdf["fits"], strict=True):
                x, y, w = np.frombuffer(x).reshape(-1, width), np.frombuffer(y), np.frombuffer(w)
                known = {f["i"]: np.asarray(f["c"], float) for f in found}
                same = one(x, y, w, None) if not known else None
                for i in range(1, m + 1) if imp == 0 else [imp]:
                    s = one(x, y, w, known.get(i)) if same is None else same
                    sums[i, by] = sums[i, by] + s if (i, by) in sums else s
        if sums:
            salt = TaskContext.get().partitionId() % FAN
            yield pd.DataFrame({ALL: np.array([k[0] for k in sums], np.int32), BY: [k[1] for k in sums], "salt": np.int32(salt), "stats": list(sums.values())})

    schema = f"{ALL} int, {BY} string, salt int, stats array<double>"
    parts = _with_coefficients(blocks, fits, "beta").mapInPandas(partial, schema)
    if tasks > FAN:  # else a key has no more sums than one task of a level adds up anyway
        parts = parts.repartition(ALL, BY, "salt").mapInPandas(_added(), schema)
    solved = parts.repartition(ALL, BY).mapInPandas(_added(finish), COEFFICIENTS)
    seen = Observation()
    table = materialize(solved.observe(seen, F.max("far").alias("far")))
    return table, seen.get["far"] or 0.0


def _small_groups(rows: DataFrame, width: int) -> bool:
    """Is the model matrix of every ``by`` group below ``GROUP`` numbers? (Only the largest count reaches the driver.)"""
    if rows.count() * width <= GROUP:
        return True
    seen = Observation()
    rows.groupBy(BY).agg(F.count(F.lit(1)).alias("n")).observe(seen, F.max("n").alias("n")).write.format("noop").mode("overwrite").save()
    return (seen.get["n"] or 0) * width <= GROUP


def _each_group(rows: DataFrame, fit: Callable[[pd.DataFrame, str], list], columns: str) -> DataFrame:
    """``fit(rows, by)`` of every ``by`` group as rows of ``columns``; a group's rows are in one task. Rows without a group are left out."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fit(pdf, pdf[BY].iloc[0]), columns=names).astype({ALL: np.int32})
    # an explicit number: small groups are dealt over all cores all the same
    dealt = rows.filter(F.col(BY).isNotNull()).repartition(rows.sparkSession.sparkContext.defaultParallelism, BY)
    return dealt.groupBy(BY).applyInPandas(run, columns)


def _imputations(imp: np.ndarray, m: int) -> list[int]:
    """Imputations that a group's rows belong to (0: all of them)."""
    found = {int(i) for i in np.unique(imp)}
    return sorted((found | set(range(1, m + 1)) if 0 in found else found) - {0})


def fit_linear(rows: DataFrame, design: Design, target: str, m: int, draw: Draw) -> DataFrame:
    """Coefficient table of the normal linear model; ``drawn`` comes from its posterior, by the generator key ``draw(imp, by)``.

    ``rows``: imputation (0: all), by, weight, the design's columns and the target as double."""
    p = design.width

    def one(x: np.ndarray, y: np.ndarray, w: np.ndarray, _: np.ndarray | None) -> np.ndarray:
        xw = x * w[:, None]
        return np.concatenate([(xw.T @ x).ravel(), xw.T @ y, [(w * y * y).sum(), w.sum()]])

    def finish(key: Key, s: np.ndarray) -> list:
        xtx, xty, yy, n = s[:p * p].reshape(p, p), s[p * p:p * p + p], s[-2], int(s[-1])
        inverse = np.linalg.inv(xtx + 1e-5 * max(np.trace(xtx) / p, 1.0) * np.eye(p))
        beta = inverse @ xty
        rss = max(float(yy - 2 * beta @ xty + beta @ xtx @ beta), 0.0)
        spread = np.linalg.cholesky((inverse + inverse.T) / 2 + 1e-12 * np.eye(p))
        rng = np.random.default_rng(draw(*key))
        sigma = np.sqrt(rss / rng.chisquare(max(n - p, 1)))
        beta = steady(beta)
        return [beta, steady(beta + sigma * spread @ rng.standard_normal(p)), 0.0]

    # equal rows of the model matrix enter the sums once
    y, w = F.col(target), F.col(WEIGHT).cast("double")
    sums = materialize(rows.groupBy(ALL, BY, *design.numbers, *design.factors).agg(F.sum(w).alias("__w"), F.sum(w * y).alias("__wy"), F.sum(w * y * y).alias("__wyy")))
    if not _small_groups(sums, p):
        blocks = materialize(model_blocks(clustered(rows), design, target))
        return _solved(blocks, None, m, one, p, finish, blocks.rdd.getNumPartitions())[0]

    def fit(pdf: pd.DataFrame, by: str) -> list:
        x, imp = design.matrix(pdf), pdf[ALL].to_numpy()
        n, ny, nyy = (pdf[c].to_numpy(float) for c in ("__w", "__wy", "__wyy"))

        def total(at: np.ndarray) -> np.ndarray:
            return np.concatenate([((x[at] * n[at, None]).T @ x[at]).ravel(), x[at].T @ ny[at], [nyy[at].sum(), n[at].sum()]])
        shared = total(imp == 0)
        return [(i, by, *finish((i, by), shared + total(imp == i))) for i in _imputations(imp, m)]
    return materialize(_each_group(sums, fit, COEFFICIENTS))


def class_probabilities(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Softmax; the first class is the baseline. ``beta``: (classes - 1, width)."""
    eta = np.column_stack([np.zeros(len(x)), x @ beta.T])
    eta -= eta.max(axis=1, keepdims=True)
    prob = np.exp(eta)
    return prob / prob.sum(axis=1, keepdims=True)


def _gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and information of the multinomial log likelihood at ``beta`` (classes - 1, width)."""
    return _counted_gradient(x, (y[:, None] == np.arange(1, len(beta) + 1)[None, :]) * w[:, None], w, beta)


def _counted_gradient(x: np.ndarray, hits: np.ndarray, w: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_gradient`` of rows with weights ``w``, of which ``hits`` are of the classes but the first."""
    k, p = beta.shape
    prob = class_probabilities(x, beta)[:, 1:]
    info = np.zeros((k, p, k, p))
    for a in range(k):
        for b in range(a, k):
            block = (x * (w * prob[:, a] * ((a == b) - prob[:, b]))[:, None]).T @ x
            info[a, :, b], info[b, :, a] = block, block.T
    return ((hits - prob * w[:, None]).T @ x).ravel(), info.reshape(k * p, k * p)


def pseudo_observations(mean: np.ndarray, sd: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Model matrix, class numbers and weights of the pseudo-observations (the first column is the intercept)."""
    p = len(mean)
    at = np.tile(mean, (2 * (p - 1), 1))
    for j in range(1, p):
        at[2 * j - 2, j] -= sd[j]
        at[2 * j - 1, j] += sd[j]
    x = np.repeat(at, classes, axis=0)
    return x, np.tile(np.arange(classes, dtype=float), len(at)), np.full(len(x), p / max(len(x), 1))


def fit_logit(rows: DataFrame, design: Design, target: str, classes: Sequence[str], m: int, start: DataFrame | None = None,
              draw: Draw | None = None, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> DataFrame:
    """Coefficient table of the multinomial logit by Newton's method, all imputations and by groups at once, one pass per step
    (small groups: one pass in all, with the same steps).

    ``start``: a table of earlier coefficients of the same design and classes. With ``draw`` the coefficients ``drawn`` come
    from the normal approximation of their posterior, else they are the estimates. Stops when every key's next step is below
    the tolerance; raises if that is not reached in ``max_steps``.
    """
    p, k = design.width, len(classes)
    size = p * (k - 1)

    def one(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray | None, gradient: Callable = _gradient) -> np.ndarray:
        beta = np.zeros(size) if beta is None else beta
        grad, info = gradient(x, y, w, beta.reshape(k - 1, p))
        xw = x * w[:, None]
        # the coefficients come along, weighted like the rows, so the solving task knows where the step starts
        return np.concatenate([grad, info.ravel(), xw.sum(axis=0), (xw * x).sum(axis=0), beta * w.sum()])

    def finish(key: Key, s: np.ndarray) -> list:
        grad, info, rest = s[:size], s[size:size + size * size].reshape(size, size), s[size + size * size:]
        n = rest[0]  # the intercept's sum
        mean, beta = rest[:p] / n, rest[2 * p:] / n
        sd = np.sqrt(np.maximum(rest[p:2 * p] / n - mean * mean, 0.0))
        if p > 1:
            more, extra = _gradient(*pseudo_observations(mean, sd, k), beta.reshape(k - 1, p))
            grad, info = grad + more, info + extra
        grad, info = grad - RIDGE * beta, info + RIDGE * np.eye(size)
        step = np.linalg.solve(info, grad)
        far = float(grad @ step)
        beta = steady(beta + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-300)))
        if draw is None:
            return [beta, beta, far]
        covariance = np.linalg.inv(info)
        chol = np.linalg.cholesky((covariance + covariance.T) / 2 + 1e-12 * np.eye(size))
        return [beta, steady(beta + chol @ np.random.default_rng(draw(*key)).standard_normal(size)), far]

    if _small_groups(rows, p):
        return _fit_groups(rows, design, target, classes, m, start, one, finish, tolerance, max_steps)
    blocks, fits = materialize(model_blocks(clustered(rows), design, target, classes)), start
    tasks = blocks.rdd.getNumPartitions()
    for _ in range(max_steps):
        fits, far = _solved(blocks, fits, m, one, p, finish, tasks)
        if far < tolerance:
            return fits
    raise RuntimeError(f"the logit model of {target} did not converge in {max_steps} steps")


def _fit_groups(rows: DataFrame, design: Design, target: str, classes: Sequence[str], m: int, start: DataFrame | None,
                one: Callable, finish: Callable, tolerance: float, max_steps: int) -> DataFrame:
    """All steps of a ``by`` group's fits in one task. Every key makes as many steps as the one that needs most, as in passes:
    a task keeps the steps from the first below the tolerance to the one after which nothing moves."""
    k, cols = len(classes), [*design.numbers, *design.factors]
    number = {c: i for i, c in enumerate(classes)}
    seen = rows.select(ALL, BY, *cols, F.col(target).alias("__class"), F.col(WEIGHT).cast("double").alias("__w"), F.lit(None).cast("array<double>").alias("beta"))
    if start is not None:
        seen = seen.unionByName(start.select(ALL, BY, "beta"), allowMissingColumns=True)

    def fit(pdf: pd.DataFrame, by: str) -> list:
        begun = pdf["beta"].notna().to_numpy()
        begin = {int(i): np.asarray(b, float) for i, b in zip(pdf[ALL][begun], pdf["beta"][begun], strict=True)}
        pdf = pdf[~begun]
        if not len(pdf):
            return []
        imp, y, w = pdf[ALL].to_numpy(), pdf["__class"].map(number).to_numpy(float), pdf["__w"].to_numpy(float)
        points, at = np.unique(design.matrix(pdf), axis=0, return_inverse=True)
        at = at.ravel()

        def counted(of: np.ndarray) -> np.ndarray:
            """Weight of every point, then of each class there but the first."""
            return np.column_stack([np.bincount(at[own], w[own], len(points)) for own in (of, *(of & (y == c) for c in range(1, k)))])
        shared, made = counted(imp == 0), []
        for i in _imputations(imp, m):
            counts = shared + counted(imp == i)
            there = counts[:, 0] > 0
            x, weight, hits = points[there], counts[there, 0], counts[there, 1:]
            beta, enough, steps = begin.get(i), 0, []
            for step in range(1, max_steps + 1):
                beta, drawn, far = finish((i, by), one(x, hits, weight, beta, _counted_gradient))
                enough = enough or (step if far < tolerance else 0)
                if enough:
                    steps.append((step, beta, drawn, far))
                    if far < SETTLED:
                        break
            if not enough:
                enough, steps = max_steps + 1, [(max_steps, beta, drawn, far)]
            made += [(i, by, step, steps[-1][0], enough, *found) for step, *found in steps]
        return made
    counted_steps = Observation()
    table = _each_group(seen, fit, f"{ALL} int, {BY} string, step int, last int, enough int, beta array<double>, drawn array<double>, far double")
    table = materialize(table.observe(counted_steps, F.max("enough").alias("steps")))
    steps = counted_steps.get["steps"] or 0
    if steps > max_steps:
        raise RuntimeError(f"the logit model of {target} did not converge in {max_steps} steps")
    return table.filter(F.col("step") == F.least(F.col("last"), F.lit(steps))).select(ALL, BY, "beta", "drawn", "far")


def draw_classes(rows: DataFrame, design: Design, classes: Sequence[str], fits: DataFrame, u: str, out: str) -> DataFrame:
    """``rows`` with the class drawn by the uniform integer in column ``u``; the design's columns are prefixed ``__x_``.

    A key without coefficients draws nothing (null), rows without a group are left out. The softmax over the classes (the
    first is the baseline) is a column expression over the key's coefficients."""
    kept = [c for c in rows.columns if not c.startswith("__x_") and c != u]
    names, c, p = list(classes), F.col("__c"), design.width
    rows = rows.filter(F.col(BY).isNotNull()).join(fits.select(ALL, BY, F.col("drawn").alias("__c")), [ALL, BY], "left")
    rows = rows.withColumns(design.levels("__x_"))
    rows = rows.withColumns({"__e_0": F.lit(0.0)} | {f"__e_{k}": design.product(c, (k - 1) * p, "__x_") for k in range(1, len(names))})
    rows = rows.withColumn("__top", F.greatest(F.lit(0.0), F.lit(0.0), *[F.col(f"__e_{k}") for k in range(1, len(names))]))
    rows = rows.withColumns({f"__w_{k}": F.exp(F.col(f"__e_{k}") - F.col("__top")) for k in range(len(names))})
    rows = rows.withColumns({"__all": _sum([F.col(f"__w_{k}") for k in range(len(names))]), "__at": F.col(u) / F.lit(U32)})
    upto = [_sum([F.col(f"__w_{j}") / F.col("__all") for j in range(k + 1)]) for k in range(len(names) - 1)]
    pick = F.lit(names[-1])
    for name, to in reversed(list(zip(names, upto, strict=False))):
        pick = F.when(to > F.col("__at"), F.lit(name)).otherwise(pick)
    return rows.select(*kept, F.when(c.isNotNull(), pick).alias(out))


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def predicted(rows: DataFrame, design: Design, fits: DataFrame, column: str, keep: Sequence[str], prefix: str = "", shared: bool = True) -> DataFrame:
    """Imputation, by, columns ``keep`` and the linear predictor ``__p`` by the coefficients ``column``; rows of imputation
    0 (``shared``: there may be such) once for every imputation. Other rows of a key without coefficients have ``__p`` 0,
    rows without a group are left out."""
    found = fits.select(ALL, BY, F.col(column).alias("__c"))

    def by_key(joined: DataFrame) -> DataFrame:
        return joined.withColumns(design.levels(prefix)).select(ALL, BY, *keep, F.coalesce(design.product(F.col("__c"), 0, prefix), F.lit(0.0)).alias("__p"))
    own = by_key(rows.filter(F.col(BY).isNotNull() & (F.col(ALL) != 0)).join(found, [ALL, BY], "left"))
    return own.unionByName(by_key(rows.filter(F.col(ALL) == 0).drop(ALL).join(found, BY))) if shared else own


# ------------------------------------------------- exact least squares


def rational_solution(matrix: list[list[int]], right: list[int]) -> list[int]:
    """Integers (numerators, then their common positive denominator) that solve the normal equations ``matrix`` x = ``right``.

    Elimination in fractions; a column that depends on earlier ones gets coefficient 0."""
    size, found = len(right), {}
    rows = [[Fraction(v) for v in r] + [Fraction(y)] for r, y in zip(matrix, right, strict=True)]
    for j in range(size):
        pivot = next((r for r in rows if r[j]), None)
        if pivot is None or any(pivot[:j]):
            continue
        rows.remove(pivot)
        pivot = [v / pivot[j] for v in pivot]
        rows = [[a - r[j] * b for a, b in zip(r, pivot, strict=True)] for r in rows]
        found[j] = pivot
    x = [Fraction(0)] * size
    for j in sorted(found, reverse=True):
        x[j] = found[j][-1] - sum(found[j][i] * x[i] for i in range(j + 1, size))
    whole = math.lcm(*[v.denominator for v in x])
    return [*[int(v * whole) for v in x], whole]


def fit_exact(rows: DataFrame, predictors: Sequence[str], target: str, m: int) -> DataFrame:
    """Least squares of an integer target on integer predictors without rounding, by imputation and by group.

    Sums are decimals of 38 digits in built-in aggregates (an overflow raises); the small systems are solved in fractions,
    one key at a time, where the sums lie. ``beta`` holds the numerators and their common denominator as text."""
    names = ["__one", *predictors]
    full = rows.withColumns({c: F.col(c).cast("decimal(18,0)") for c in (*predictors, target)}).withColumn("__one", F.lit(1).cast("decimal(18,0)"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    weight = F.col(WEIGHT).cast("decimal(18,0)")
    total = lambda a, b: F.sum((F.col(a) * F.col(b) * weight).cast("decimal(38,0)")).cast("decimal(38,0)")
    sums = {f"s{i}_{j}": total(names[i], names[j]) for i, j in pairs} | {f"y{i}": total(names[i], target) for i in range(len(names))}
    by_key = full.groupBy(ALL, BY).agg(*[c.alias(n) for n, c in sums.items()])
    # what all imputations share is counted once and added to each of them
    each = by_key.withColumn(ALL, F.explode(F.when(F.col(ALL) == 0, F.sequence(F.lit(1), F.lit(m))).otherwise(F.array(F.col(ALL)))))
    whole = each.groupBy(ALL, BY).agg(*[F.sum(n).cast("decimal(38,0)").cast("string").alias(n) for n in sums])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for r in pdf.to_dict("records"):
                matrix = [[int(r[f"s{min(i, j)}_{max(i, j)}"]) for j in range(len(names))] for i in range(len(names))]
                found.append([str(v) for v in rational_solution(matrix, [int(r[f"y{i}"]) for i in range(len(names))])])
            yield pd.DataFrame({ALL: pdf[ALL], BY: pdf[BY], "beta": found})
    return materialize(whole.mapInPandas(solve, f"{ALL} int, {BY} string, beta array<string>"))


def predicted_exact(rows: DataFrame, predictors: Sequence[str], fits: DataFrame, keep: Sequence[str], resolution: int = 1000) -> DataFrame:
    """Like ``predicted`` with the coefficients of ``fit_exact``: ``__p`` is the floor of ``resolution`` times the prediction."""
    schema = T.StructType([*rows.select(ALL, BY, *keep).schema.fields, T.StructField("__p", T.DoubleType())])

    def make(pdf: pd.DataFrame, key: Key, found: dict[int, list[int]]) -> Iterator[pd.DataFrame]:
        points, at = np.unique(pdf[list(predictors)].to_numpy(np.int64), axis=0, return_inverse=True)
        for i in sorted(found) if key[0] == 0 else [key[0]]:
            p = np.zeros(len(pdf))
            if i in found:
                *b, whole = found[i]
                value = [resolution * (b[0] + sum(n * int(x) for n, x in zip(b[1:], point, strict=True))) // whole for point in points]
                p = np.array(value, float)[at.ravel()]
            yield pdf[[ALL, BY, *keep]].assign(**{ALL: np.int32(i), "__p": p})
    return _each_block(_row_blocks(rows), fits, "beta", schema, make, read=lambda c: [int(v) for v in c])


def _ranked_donors(x: float | np.ndarray, ys: np.ndarray, ns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For every recipient at ``x``: places of donor groups in order of nearness, and how many of ``k`` donors they count up to each.

    Donor groups (``ys`` with counts ``ns``) are in order of prediction, then value. The ``k`` groups below ``x`` and the ``k``
    at or above it are ranked by distance, prediction and value, and taken until they count ``k`` donors."""
    position = np.searchsorted(ys, x, side="left")
    at = position[:, None] + np.arange(-k, k)[None, :]
    # equal predictions right of the position come in order; those left of it are all smaller
    valid = (at >= 0) & (at < len(ys))
    at = np.clip(at, 0, len(ys) - 1)
    distance = np.where(valid, np.abs(ys[at] - x[:, None]), np.inf)
    order = np.argsort(distance, axis=1, kind="stable")
    at = np.take_along_axis(at, order, axis=1)
    n = np.where(np.take_along_axis(valid, order, axis=1), ns[at], 0)
    return at, np.minimum(np.cumsum(n, axis=1), k)


def _donor_at(at: np.ndarray, upto: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return np.take_along_axis(at, (upto <= wanted[:, None]).sum(axis=1)[:, None], axis=1)[:, 0]


def nearest_donors(x: float | np.ndarray, ys: np.ndarray, vs: np.ndarray, ns: np.ndarray, u: np.ndarray, k: int) -> np.ndarray:
    """For every recipient at ``x``: one of the ``k`` nearest donors (``_ranked_donors``); the uniform integer ``u`` picks among them."""
    at, upto = _ranked_donors(x, ys, ns, k)
    return vs[_donor_at(at, upto, np.floor(u / U32 * upto[:, -1]).astype(np.int64))]


def all_nearest_donors(x: float | np.ndarray, ys: np.ndarray, vs: np.ndarray, ns: np.ndarray, k: int) -> list[np.ndarray]:
    """For every recipient at ``x``: the values of the donors among which ``nearest_donors`` picks, in its order."""
    at, upto = _ranked_donors(x, ys, ns, k)
    size = upto[:, -1]
    places = [_donor_at(at, upto, np.minimum(place, np.maximum(size - 1, 0))) for place in range(k)]
    return [v[:n] for v, n in zip(vs[np.column_stack(places)], size, strict=True)]


def outer_donors(donors: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The donors with the ``k`` smallest and the ``k`` largest values ``__v`` of each combination of ``keys``.

    ``donors``: one row per distinct combination of keys and value."""
    same = Window.partitionBy(*keys)
    ranked = donors.withColumns({"__up": F.row_number().over(same.orderBy(F.asc("__v"))), "__down": F.row_number().over(same.orderBy(F.desc("__v")))})
    return ranked.filter(F.least("__up", "__down") <= k).drop("__up", "__down")


def match_donors(donors: DataFrame, recipients: DataFrame, k: int, out: str, u: str | None = "__u") -> DataFrame:
    """``recipients`` with the drawn donor's value in column ``out`` (double); without ``u`` the values of all donors that can be
    drawn there, in order, as an array.

    ``donors``: imputation, by, ``__p`` (prediction), ``__v`` (value), weight, one row per distinct combination.
    ``recipients``: any columns, among them imputation, by, ``__p`` and the uniform integer ``u``.
    Of the donors with one prediction only the ``k`` smallest and the ``k`` largest values can be drawn; the others go first
    (every task keeps its own candidates before the shuffle). Rows are range-partitioned by (imputation, by, prediction,
    donors first, value, u), so equal predictions spread too, and stored in that order, ``PIECE`` rows a file. A task holds
    one piece at a time, as Arrow columns, whatever the size of its partition. The first and last ``2 k`` donors of each
    key in every piece (a table bounded by the number of pieces and keys) give a piece its neighbours', so a prediction cut
    by an edge is whole on both sides.
    """
    every, u = u is None, u or "__u"
    if every:
        recipients = recipients.withColumn(u, F.lit(0).cast("bigint"))
    same = Window.partitionBy(ALL, BY, "__p")
    ends_of = [donors.withColumn("__r", F.row_number().over(same.orderBy(o))).filter(F.col("__r") <= k).drop("__r") for o in (F.asc("__v"), F.desc("__v"))]
    donors = ends_of[0].unionByName(ends_of[1]).distinct()
    order = [ALL, BY, "__p", "__kind", "__v", u]
    both = donors.withColumns({"__kind": F.lit(0), u: F.lit(0).cast("bigint")}).unionByName(
        recipients.withColumns({"__kind": F.lit(1), "__v": F.lit(None).cast("double"), WEIGHT: F.lit(0).cast("bigint")}), allowMissingColumns=True)
    # the number says partition and place in it, so one number is one file of the writer
    number = F.floor(F.monotonically_increasing_id() / F.lit(PIECE)).cast("bigint")
    ranged = materialize(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__piece", number), PIECE)
    pool = [ALL, BY, "__p", "__v", WEIGHT]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            at = [i for lo, hi in _key_runs(piece) for i in (range(lo, hi) if hi - lo <= 4 * k else [*range(lo, lo + 2 * k), *range(hi - 2 * k, hi)])]
            yield from piece.select(pool).take(pa.array(at)).to_batches()

    edge = ranged.filter("__kind = 0").select(*pool, "__piece").mapInArrow(ends, f"{ALL} int, {BY} string, __p double, __v double, {WEIGHT} bigint").toPandas()
    known = {key: tuple(g[c].to_numpy() for c in pool[2:]) for key, g in edge.sort_values(["__p", "__v"], kind="stable").groupby([ALL, BY], sort=False)}
    kept = [c for c in recipients.columns if c not in ("__p", u)]
    schema = T.StructType([*recipients.select(*kept).schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()) if every else T.DoubleType())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            kind, p, v, n, draw = (piece[c].to_numpy() for c in ("__kind", "__p", "__v", WEIGHT, u))
            for lo, hi in _key_runs(piece):
                first = lo + np.flatnonzero(kind[lo:hi] == 0)
                who = lo + np.flatnonzero(kind[lo:hi] == 1)
                key = piece[ALL][lo].as_py(), piece[BY][lo].as_py()
                if not len(who) or None in key:  # rows without a group are not matched
                    continue
                own = _with_neighbours((p[first], v[first], n[first]), known.get(key), p[who], k)
                if every:
                    values = pa.array(all_nearest_donors(p[who], *own, k) if len(own[0]) else [None] * len(who), pa.list_(pa.float64()))
                else:
                    found = nearest_donors(p[who], *own, draw[who], k) if len(own[0]) else np.full(len(who), np.nan)
                    values = pa.array(found, pa.float64(), mask=np.isnan(found))
                yield from piece.select(kept).take(pa.array(who)).append_column(out, values).to_batches()

    return ranged.mapInArrow(match, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one ``__piece`` after the other; a piece lies in one file and comes whole."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        number = b.column("__piece").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and number[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = number[lo]
    if held:
        yield pa.Table.from_batches(held)


def _key_runs(piece: pa.Table) -> list[tuple[int, int]]:
    """First row and end of every run of one (imputation, by) in sorted rows."""
    new = np.ones(piece.num_rows, bool)
    imp, by = piece[ALL].to_numpy(), piece[BY].combine_chunks().dictionary_encode()
    by = by.combine_chunks() if isinstance(by, pa.ChunkedArray) else by
    code = by.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    new[1:] = (np.diff(imp) != 0) | (np.diff(code) != 0)
    at = np.flatnonzero(new).tolist()
    return list(zip(at, [*at[1:], piece.num_rows], strict=True))


def _with_neighbours(own: tuple, known: tuple | None, asked: np.ndarray, k: int) -> tuple:
    """A piece's donors (predictions, values, counts) and those of its neighbours that recipients at ``asked`` can reach.

    A missing prediction comes last, as in the search."""
    if known is None:
        return own
    low, high = np.searchsorted(known[0], asked, "left"), np.searchsorted(known[0], asked, "right")
    p, v, n = (np.concatenate([a, b[max(low.min() - 2 * k, 0):high.max() + 2 * k]]) for a, b in zip(own, known, strict=True))
    order = np.lexsort((v, p))
    p, v, n = p[order], v[order], n[order]
    new = np.ones(len(p), bool)
    new[1:] = ((p[1:] != p[:-1]) & ~(np.isnan(p[1:]) & np.isnan(p[:-1]))) | (np.diff(v) != 0)
    return p[new], v[new], n[new]
