"""Language identification by rank-order profiles.

Every language has a profile: its most frequent letter n-grams (one to three
letters, words padded with a boundary mark), in order of frequency. A document
is ranked in the same way, over its whole text, and goes to the language with
the smallest out-of-place distance: the sum over the document's n-grams of the
difference between the two ranks, ``size`` for n-grams the profile lacks.

Defined cases: a null text or one without letters is ``und`` with score 0;
rows with a null language teach nothing; with no learnable row every document
is ``und``; ties between languages go to the smaller name, ties between
n-grams to the smaller code; repeated rows each get the same answer; an empty
table gives an empty result. Input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetally.llm.common import keep_columns, sliced

PROFILE_SIZE = 300
#: Bound of the labelled sample that profiles are learnt from, per language (expected rows).
MAX_ROWS_PER_LANG = 3000
UNKNOWN = "und"
#: Letters counted at once; longer texts are counted piece by piece.
PIECE = 1 << 20


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """By code point. No letter of Unicode lies above 18 bits."""
    return np.fromiter((chr(i).isalpha() for i in range(1 << 18)), bool, 1 << 18)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; runs of anything else become one 0, also at both ends."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _is_letter()[np.minimum(cp, (1 << 18) - 1)] & (cp < 1 << 18)
    out = np.zeros(len(cp) + 2, np.int64)
    out[1:-1][letter] = cp[letter]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (ascending) and counts of all n-grams of a text."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    parts = []
    for lo in range(0, len(text), PIECE):
        # two letters of overlap: every n-gram starts in exactly one piece
        c = _codes(text) if len(text) <= PIECE else _codes_between(text, lo)
        n = len(c)
        a, b, t = c[: n - 2], c[1 : n - 1], c[2:]
        uni = c[c != 0]
        bi = (1 << 54) | c[:-1] << 18 | c[1:]
        tri = ((2 << 54) | a << 36 | b << 18 | t)[b != 0]
        if n > 2:
            parts.append(np.unique(np.concatenate([uni, bi, tri]), return_counts=True))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _codes_between(text: str, lo: int) -> np.ndarray:
    """The piece of a very long text from ``lo``, moved on to the next word boundary at both ends."""
    def boundary(i: int) -> int:
        while 0 < i < len(text) and text[i - 1].isalpha() and text[i].isalpha():
            i += 1
        return min(i, len(text))
    return _codes(text[boundary(lo):boundary(lo + PIECE)])


def top_grams(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first; ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
                 size: int = PROFILE_SIZE, max_rows_per_lang: int = MAX_ROWS_PER_LANG) -> dict[str, np.ndarray]:
    """Profiles by language, learnt from a sample of at most about ``max_rows_per_lang`` rows each.

    The sample is chosen by a hash of the id, so it is the same on every run.
    What comes to the driver is ``size`` codes for each language.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).filter(
        F.col("l").isNotNull() & F.col("t").isNotNull())
    share = rows.groupBy("l").agg(F.least(F.lit(1.0), F.lit(float(max_rows_per_lang)) / F.count("*")).alias("p"))
    draw = (F.xxhash64(F.lit("profile"), "i") / F.lit(2.0**64)) + 0.5
    sample = rows.join(F.broadcast(share), "l").filter(draw <= F.col("p")).select("l", "t")  # a row per language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            found: dict[str, list] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(name, []).append(gram_counts(t))
            for name, parts in found.items():
                codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["l", "g", "n"])

    grams = sample.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))
    found = grams.withColumn("r", rank).filter(F.col("r") <= size).select("l", "g", "r").collect()
    out: dict[str, list] = {}
    for row in sorted(found, key=lambda x: (x.l, x.r)):
        out.setdefault(row.l, []).append(row.g)
    return {k: np.array(v, np.int64) for k, v in out.items()}


class Ranker:
    """Out-of-place distances of a text to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE_SIZE):
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([profiles[n] for n in self.names])) if self.names else np.empty(0, np.int64)
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for i, n in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.grams, profiles[n])] = np.arange(len(profiles[n]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        top = top_grams(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, top), max(len(self.grams) - 1, 0))
        at[self.grams[at] != top] = len(self.grams)
        known = self.ranks[:, at]
        far = np.where(known < 0, self.size, np.abs(known - np.arange(len(top)))).sum(axis=1)
        best = int(far.argmin())
        return self.names[best], 1.0 - float(far[best]) / (self.size * len(top))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", size: int = PROFILE_SIZE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, higher: closer to the profile)."""
    kept = keep_columns(docs, ["lang_pred", "score"])
    sent = [*kept] if text in kept else [*kept, text]  # the text goes to Python once
    at, width = sent.index(text), len(kept)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles, size)
        for b in sliced(batches, at):
            found = [ranker(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:width], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*kept, "lang_pred", "score"])

    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.select(*sent).mapInArrow(predict, schema)
