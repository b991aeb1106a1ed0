"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Words are compared by the gap-weighted subsequence kernel of order 3: the
common subsequences of three letters, each weighing ``DECAY`` to the length it
spans, normalised. Inserted letters stretch spans and gapped spelling
(``i.d i-o t``: punctuation is dropped, spaced single letters are joined)
vanishes, so a disguised insult stays near the plain one. Over an alphabet of
32 symbols the kernel's feature space has 32**3 dimensions, small enough to
write a word's features out, so kernel values are exact.

Training (``fit``) sees labelled texts as bags of words. Words that occur in
toxic texts far beyond chance (a likelihood-ratio test over distinct texts, and
again over the different words they follow, so that copied passages do not
count) are positive examples, joined by variants with an inserted letter; common words and the
words most like the positive ones, from clean texts, are negative ones.
Landmarks are drawn from both, words are mapped through the inverse root of
the landmarks' kernel matrix (Nyström), and a squared-hinge support vector
machine is fitted there. A text scores through a logistic link, fitted on the
labelled texts, over its three most toxic distinct words and the number and
share of its words on the toxic side.

Defined cases: null, empty or word-free texts score like a text of clean
words; null labels are ignored, of several labels of a document the highest
counts; without labels of both kinds, or without a word beyond chance, every
text scores the share of toxic labels; words of fewer than three letters say
nothing; longer ones than ``LONGEST`` are read in overlapping windows; an
empty table gives an empty result. Input columns named like a result are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetally.llm.common import keep_columns, store

ORDER, DECAY, SYMBOLS = 3, 0.7, 32
LONGEST = 24
#: Bounds of the labelled sample (expected rows of either label) and of what the driver sees of it.
MAX_TOXIC, MAX_CLEAN = 4000, 8000
MAX_POSITIVE, MAX_NEGATIVE, LANDMARKS = 200, 4000, 128
#: Likelihood ratio beyond which a word's share of toxic texts is no accident, and that share's least value.
BEYOND_CHANCE, LEAST_SHARE = 25.0, 0.5
#: Distinct words that a task holds scores of, and texts scored at once.
CACHE, TEXTS = 300_000, 500
FLOOR = -1.0

_SPACED = re.compile(r"(?<!\S)\w(?:[ \t]+\w){2,}(?!\S)")
_NO_LETTER = re.compile(r"[\W_]+")
_LEET = str.maketrans("013457@$", "oieastas")


def words(text: str | None) -> set[str]:
    """Distinct lower-case chunks between white space; spaced single letters also as one word."""
    if not text:
        return set()
    low = text.lower()
    found = set(low.split())
    for m in _SPACED.finditer(low):
        found.add("".join(m.group().split()))
    return found


@lru_cache(maxsize=1)
def _symbol() -> dict[int, int]:
    return {ord(c): i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}


def pieces(word: str) -> list[str]:
    """The letters of a word (digits as the letters they stand for); long words in overlapping windows."""
    w = _NO_LETTER.sub("", word.translate(_LEET))
    if len(w) <= LONGEST:
        return [w]
    return [w[i:i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]


@lru_cache(maxsize=LONGEST + 1)
def _spans(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All index triples of a word of n letters and their weights."""
    at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


def _codes(same_length: list[str]) -> np.ndarray:
    """(words, letters) symbols."""
    sym = _symbol()
    flat = [sym.get(ord(c), 26 + ord(c) % 6) for w in same_length for c in w]
    return np.array(flat, np.int64).reshape(len(same_length), -1)


def _features(same_length: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, triples) feature numbers, their weights, and each word's norm."""
    c = _codes(same_length)
    at, weight = _spans(c.shape[1])
    code = (c[:, at[:, 0]] * SYMBOLS + c[:, at[:, 1]]) * SYMBOLS + c[:, at[:, 2]]
    order = np.argsort(code, axis=1)
    ordered, heavy = np.take_along_axis(code, order, 1), weight[order]
    new = np.ones(ordered.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    sums = np.add.reduceat(heavy.ravel(), np.flatnonzero(new.ravel()))
    row = np.repeat(np.arange(len(c)), new.sum(axis=1))
    return code, weight, np.sqrt(np.bincount(row, sums * sums, len(c)))


def kernel_with(table: np.ndarray, some: Iterable[str]) -> np.ndarray:
    """``table`` has a row per feature; returns each word's normalised features times ``table`` (words x columns)."""
    some = list(some)
    out = np.zeros((len(some), table.shape[1]))
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(some):
        by_length.setdefault(len(w), []).append(i)
    for n, at in by_length.items():
        if n < ORDER:
            continue
        step = max(1, 2_000_000 // (len(_spans(n)[1]) * max(1, table.shape[1])))
        for lo in range(0, len(at), step):
            part = at[lo:lo + step]
            code, weight, norm = _features([some[i] for i in part])
            out[part] = np.einsum("wtc,t->wc", table[code], weight) / norm[:, None]
    return out


def feature_table(landmarks: list[str]) -> np.ndarray:
    """Normalised features of the landmarks, a column each."""
    out = np.zeros((SYMBOLS ** ORDER, len(landmarks)))
    for j, w in enumerate(landmarks):
        code, weight, norm = _features([w])
        np.add.at(out[:, j], code[0], weight / norm[0])
    return out


@dataclass
class Model:
    """A word's decision value is its normalised features times ``direction`` plus ``offset``; ``link`` turns a text's
    pooled values into a probability (its last coefficient is the intercept)."""

    direction: np.ndarray | None
    offset: float
    link: np.ndarray

    def word_values(self, some: list[str]) -> np.ndarray:
        parts = [pieces(w) for w in some]
        flat = [p for ps in parts for p in ps]
        values = kernel_with(self.direction[:, None], flat)[:, 0] + self.offset
        values[[len(p) < ORDER for p in flat]] = FLOOR
        at = np.cumsum([0, *map(len, parts[:-1])])
        return np.maximum(np.maximum.reduceat(values, at), FLOOR)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(np.asarray(pooled).reshape(-1, POOLED) @ self.link[:-1] + self.link[-1], -30, 30)))


#: A text's pooled values: the largest three word values, log(1 + words over 0), the square root of their share.
POOLED = 5


def pool(values: list[float]) -> list[float]:
    over = sorted(v for v in values if v > FLOOR)
    top = [*over[:-4:-1], FLOOR, FLOOR, FLOOR][:3]
    n = sum(v > 0 for v in over)
    return [*top, math.log1p(n), math.sqrt(n / max(1, len(values)))]


def _pooled(model: Model, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
    bags = [words(t) for t in texts]
    new = [w for w in set().union(*bags) if w not in cache]
    if len(cache) + len(new) > CACHE:
        cache.clear()
        new = list(set().union(*bags))
    for lo in range(0, len(new), 50_000):
        part = new[lo:lo + 50_000]
        cache.update(zip(part, model.word_values(part).tolist(), strict=True))
    return np.array([pool([cache[w] for w in b]) for b in bags]).reshape(-1, POOLED)


def _mapped(rows: DataFrame, model: Model, kept: list[str], text: str, name: str, kind: str, finish) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                b = whole.slice(lo, TEXTS)
                pooled = _pooled(model, b.column(len(kept)).to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], finish(pooled)], names=[*kept, name])
    schema = rows.select(*kept, F.lit(None).cast(kind).alias(name)).schema
    return rows.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str) -> DataFrame:
    """(t, y, weight): a bounded sample of distinct labelled texts of either kind, chosen by the text's hash. The kinds
    have rates of their own; ``weight`` undoes them (a text's inverse rate, in units of a toxic text's)."""
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("i")).agg((F.max(label) > 0).cast("int").alias("y"))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).filter(F.col("t").isNotNull())
    texts = store(rows.select("i", "h").join(known, "i").groupBy("h").agg(F.max("y").alias("y"), F.min("i").alias("i")))  # no texts move
    share = texts.groupBy("y").agg(F.least(F.lit(1.0), F.when(F.col("y") == 1, float(MAX_TOXIC)).otherwise(float(MAX_CLEAN)) / F.count("*")).alias("p"))
    rate = {r.y: r.p for r in share.collect()}  # two rows
    p = F.when(F.col("y") == 1, rate.get(1, 1.0)).otherwise(rate.get(0, 1.0))
    draw = F.xxhash64(F.lit("toxic"), "h") / F.lit(2.0**64) + 0.5
    chosen = texts.filter(draw <= p).select("i", "h", "y", (F.lit(rate.get(1, 1.0)) / p).alias("weight"))
    found = rows.join(F.broadcast(chosen), ["i", "h"])  # as many rows as the bounds say
    return store(found.groupBy("h").agg(*[F.first(c).alias(c) for c in ("t", "y", "weight")]).select("t", "y", "weight"))


def _word_counts(sample: DataFrame, only: set[str] | None = None) -> DataFrame:
    """(w, n1, n0): in how many toxic and clean texts of the sample a word occurs; with ``only``, after how many
    different words each of those occurs in toxic and in clean texts (copied passages repeat their word pairs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if only is None:
                    found = {(p, "") for x in words(t) for p in pieces(x) if len(p) >= ORDER}
                else:
                    row = t.lower().split()
                    found = {(p, prior) for prior, x in zip(["", *row], row, strict=False) for p in pieces(x) if p in only}
                for w in found:
                    seen.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array([w[i] for w in seen], pa.string()) for i in (0, 1)]
                                             + [pa.array([n[i] for n in seen.values()], pa.int64()) for i in (1, 0)], names=["w", "prior", "n1", "n0"])
    found = sample.mapInArrow(run, "w string, prior string, n1 long, n0 long")
    if only is not None:
        found = found.groupBy("w", "prior").agg((F.sum("n1") > 0).cast("int").alias("n1")).withColumn("n0", 1 - F.col("n1"))
    return found.groupBy("w").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _beyond_chance(base: float):
    """Likelihood ratio of a word's share of toxic texts against the base share."""
    n1, n0 = F.col("n1"), F.col("n0")
    n = n1 + n0
    part = lambda k, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0)
    return 2 * (part(n1, base) + part(n0, 1 - base))


def _variants(word: str) -> list[str]:
    """The word with a letter inserted: a doubled one, an x, between any two letters."""
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in (word[i], "x")]


def _support_vectors(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Linear squared-hinge machine in the primal, by Newton steps on the active set; last coefficient: offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(100):
        active = y * (x @ w) < 1
        xa, c = x[active], penalty * weight[active]
        new = np.linalg.solve(ridge + (xa * c[:, None]).T @ xa, xa.T @ (c * y[active]))
        done = np.abs(new - w).max() < 1e-9
        w = new
        if done:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Coefficients and intercept of a weighted ridge logistic regression (Newton steps)."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (y - p)) - ridge @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _spread(ordered: list[str], some: int, alike: float = 0.8) -> list[str]:
    """The first words of which none is too like another."""
    chosen: list[str] = []
    near = kernel_with(feature_table(ordered), ordered)
    left = np.ones(len(ordered), bool)
    for i, w in enumerate(ordered):
        if left[i] and len(chosen) < some:
            chosen.append(w)
            left &= near[i] < alike
    return chosen


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on the labelled ones of ``docs``; the driver sees a bounded number of words and of scores."""
    sample = _sample(docs, labels, id_col, text, label)
    n1, n, clean = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*"), F.max(F.when(F.col("y") == 0, F.col("weight")))).first()
    drawn = (n1 + 1) / (n + 2)  # the share of toxic texts in the sample, which chance is measured against
    clean = 1.0 if clean is None else clean
    base = (n1 + 1) / (n1 + 1 + (n - n1 + 1) * clean)  # and in all labelled texts
    nothing = Model(None, FLOOR, np.r_[np.zeros(POOLED), np.log(base / (1 - base))])
    if not 0 < n1 < n:
        return nothing
    def tested(counts: DataFrame) -> DataFrame:
        return counts.withColumn("g", _beyond_chance(drawn)).withColumn("share", F.col("n1") / (F.col("n1") + F.col("n0") * clean))

    def most(counts: DataFrame, limit: int) -> list[str]:
        beyond = counts.filter((F.col("g") >= BEYOND_CHANCE) & (F.col("share") >= LEAST_SHARE))
        return [r.w for r in beyond.orderBy(F.desc("g"), "w").limit(limit).collect()]

    counts = tested(_word_counts(sample))
    suspects = set(most(counts, 20 * MAX_POSITIVE))
    positive = most(tested(_word_counts(sample, suspects)), MAX_POSITIVE) if suspects else []
    if not positive:
        return nothing
    table = feature_table(positive)

    def likest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = kernel_with(table, b.column(0).to_pylist()).max(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near)], names=["w", "n", "near"])

    usual = counts.filter((F.col("share") < base) | (F.col("n1") == 0)).select("w", F.col("n0").alias("n"))
    alike = [r.w for r in usual.mapInArrow(likest, "w string, n long, near double").orderBy(F.desc("near"), "w").limit(MAX_NEGATIVE // 2).collect()]
    common = [r.w for r in usual.orderBy(F.desc("n"), "w").limit(MAX_NEGATIVE // 2).collect()]
    negative = sorted(set(alike) | set(common))
    extra = [v for w in positive for v in _variants(w)]

    half = LANDMARKS // 2
    landmarks = list(dict.fromkeys([*_spread(positive, half), *_spread(alike[:500], half // 2), *_spread(common[:500], half // 2)]))
    table = feature_table(landmarks)
    kernel = kernel_with(table, landmarks)
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])  # the Nyström map: kernel values times this
    x = kernel_with(table, [*positive, *extra, *negative]) @ root
    y = np.r_[np.ones(len(positive) + len(extra)), -np.ones(len(negative))]
    weight = np.r_[np.full(len(positive), 4.0 / len(positive)), np.full(len(extra), 1.0 / max(1, len(extra))),
                   np.full(len(negative), 5.0 / max(1, len(negative)))]
    w = _support_vectors(x, y, weight * len(y), 1.0)
    model = Model(table @ (root @ w[:-1]), float(w[-1]), nothing.link)
    numbers = lambda pooled: pa.array(pooled.tolist(), pa.list_(pa.float64()))
    scored = _mapped(sample, model, ["y", "weight"], "t", "pooled", "array<double>", numbers).collect()  # a few numbers for each row of the sample
    model.link = _logistic(*[np.array([r[c] for r in scored]) for c in ("pooled", "y", "weight")])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` and above)."""
    kept = keep_columns(docs, ["score", "predicted"])
    if model.direction is None:
        scored = docs.select(*kept, F.lit(float(model.probability(np.zeros(POOLED))[0])).alias("score"))
    else:
        scored = _mapped(docs, model, kept, text, "score", "double", lambda pooled: pa.array(model.probability(pooled)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
