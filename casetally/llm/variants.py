"""Grouping of spelling variants by blocked Gram matrices.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. Their letter counts then differ by one (insertion) or by one
up and one down (replacement), so the squared distance of the count vectors is
at most two. Words lie in blocks of equal length, and within a length by the
counts of ``GROUPS`` letter groups: a near word lies in the same block, in one
that has a letter of one group more, or in one that trades a letter between
two groups, so no other blocks meet and no link is lost. A block is cut into
tiles of bounded size; every tile (the host) meets the words of its neighbour
blocks (the guests) as a stream: the product of the two matrices of letter
counts gives all squared distances of a slice at once, pairs at most two apart
are verified on the code points.

A tile's guests are dealt out in chunks too, so one block with a third of all
words spreads over many tasks; memory is one tile and one slice. A word's near
words are bounded by its length and alphabet, not by the table.

A word's *form* is its near word of largest count (ties: smallest in
code-point order), if that count is at least ``ratio`` times its own; its
*root* is where its forms lead. Counts grow by the ratio at every step, which
bounds the chains, and pointers are doubled.

Defined cases: null and empty words are no words; a word without a near word
has ``n_near`` 0, no form and itself as root; words of any length and any
code points are compared whole; equal words are one word with one count; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetally.llm.common import store

GROUPS = 5
#: Words of a tile and of a slice of guests at most, fewer where words are very long.
TILE = 2048
#: Code points of a tile at most (at least one word).
TILE_CHARS = 1 << 21
#: Tiles of guests that one task meets at most for one host tile.
SPAN = 16
#: Verified pairs of one Arrow batch.
BATCH = 50_000
KEY = [f"c{i}" for i in range(GROUPS)]
HOST = [f"h{i}" for i in range(GROUPS)]
DIMENSIONS = 64


def count_words(words: DataFrame, min_chars: int = 6, min_count: int = 5, word: str = "word") -> DataFrame:
    """``word`` and its number ``n`` of rows, for words of at least ``min_chars`` code points and ``min_count`` rows."""
    w = F.col(word).alias("word")
    counted = words.select(w).filter(F.length("word") >= max(min_chars, 1)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of equal length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """A row of counts for each word. Letters that share a column only weaken the filter."""
    n = len(codes)
    # below 128 a letter keeps a column of its own, the others share 32
    column = np.where(codes < 128, codes & 31, 32 + (codes & 31)).astype(np.int64) + (np.arange(n) * DIMENSIONS)[:, None]
    counts = np.bincount(column.ravel(), minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    return counts.astype(np.float32 if codes.shape[1] < 2000 else np.float64)  # squares stay exact


def close_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows whose squared distance is at most two."""
    squared = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    squared -= 2.0 * (a @ b.T)
    return np.nonzero(squared <= 2.5)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: does one replacement (equal lengths) or one insertion into ``a`` (``b`` one longer) make ``b``?"""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(axis=1) == 1
    front, back = a != b[:, :size], a != b[:, 1:]
    ahead = np.where(front.any(axis=1), front.argmax(axis=1), size)
    behind = np.where(back.any(axis=1), back[:, ::-1].argmax(axis=1), size)
    return ahead + behind >= size


class Words:
    """Words of equal length with their code points and letter counts."""

    def __init__(self, words: list[str]):
        self.words, self.codes = words, _codes(words)
        self.counts = letter_counts(self.codes)

    def near(self, other: Words, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of near words (own: each pair once)."""
        i, j = close_pairs(self.counts, other.counts)
        if own:
            i, j = i[i < j], j[i < j]
        step = max(TILE_CHARS // max(self.codes.shape[1], 1), 1)
        for lo in range(0, len(i), step):
            x, y = i[lo:lo + step], j[lo:lo + step]
            ok = one_edit(self.codes[x], other.codes[y])
            yield x[ok], y[ok]


def _signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the counts of their letter groups (the code point modulo the number of groups)."""
    for b in batches:
        words = b.column(0).to_pylist()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        at = np.repeat(np.arange(len(words)), sizes) * GROUPS + codes % GROUPS
        counts = np.bincount(at, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(counts[:, g])) for g in range(GROUPS))],
                                         names=["word", "n", *KEY])


def _steps() -> list[tuple[int, ...]]:
    """From a block to the blocks it hosts: itself, one letter more, a letter traded (one of the two directions)."""
    out = [(0,) * GROUPS]
    out += [tuple(int(g == x) for g in range(GROUPS)) for x in range(GROUPS)]
    out += [tuple((g == x) - (g == y) for g in range(GROUPS)) for x in range(GROUPS) for y in range(x + 1, GROUPS)]
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream of rows sorted by tile, chunk, role (hosts first) and length; pairs of near words."""
    names = ["a", "n_a", "b", "n_b"]
    found: list[list] = [[], [], [], []]
    here: tuple | None = None
    host: Words | None = None
    held: tuple[list, list] = ([], [])  # hosts of the tile that is being read

    def keep(x: Words, nx: list, y: Words, ny: list, own: bool = False) -> None:
        for i, j in x.near(y, own):
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                found[0].append(x.words[p])
                found[1].append(nx[p])
                found[2].append(y.words[q])
                found[3].append(ny[q])

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.int64()),
                                           pa.array(found[2], pa.string()), pa.array(found[3], pa.int64())], names=names)
        for x in found:
            x.clear()
        return made

    def ready() -> None:
        """All hosts of the tile are there: compare them with each other once."""
        nonlocal host
        if host is None and held[0]:
            host = Words(held[0])
            if here[-1] == 0:  # a tile comes once for each chunk of guests
                keep(host, held[1], host, held[1], own=True)

    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy() for i in range(GROUPS + 4)]  # host block, tile, chunk, role, length
        new = np.ones(b.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        words, counts = b.column(GROUPS + 4).to_pylist(), b.column(GROUPS + 5).to_pylist()
        bounds = [*np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            key = tuple(int(c[lo]) for c in columns[:GROUPS + 2])
            role, size = int(columns[-2][lo]), int(columns[-1][lo])
            if key != here:
                ready()
                here, host, held = key, None, ([], [])
            if role == 0:
                held[0].extend(words[lo:hi])
                held[1].extend(counts[lo:hi])
                continue
            ready()
            if host is not None:
                step = max(min(TILE, TILE_CHARS // max(size, 1)), 1)
                for s in range(lo, hi, step):
                    e = min(s + step, hi)
                    keep(host, held[1], Words(words[s:e]), counts[s:e])
                    if len(found[0]) >= BATCH:
                        yield flush()
        if len(found[0]) >= BATCH:
            yield flush()
    ready()
    if found[0]:
        yield flush()


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of near words, each pair once. ``words``: distinct ``word`` with its count ``n``."""
    known = words.filter(F.length("word") > 0).select("word", F.col("n").cast("long").alias("n"))
    schema = "word string, n long, " + ", ".join(f"{c} int" for c in KEY)
    signed = store(known.mapInArrow(_signature, schema))
    length = sum((F.col(c) for c in KEY[1:]), F.col(KEY[0])).cast("long")
    tile_words = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_CHARS) / length)))
    blocks = store(signed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
                   .select(*KEY, F.ceil(F.col("size") / tile_words).cast("int").alias("tiles")))
    steps = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(KEY, s, strict=True)]) for s in _steps()])
    hosted = (blocks.select(*[F.col(c).alias(h) for c, h in zip(KEY, HOST, strict=True)], F.col("tiles").alias("host_tiles"),
                            F.explode(steps).alias("s"))
              .select(*HOST, "host_tiles", *[(F.col(h) + F.col(f"s.{c}")).alias(c) for c, h in zip(KEY, HOST, strict=True)])
              .join(blocks, KEY))
    own = [F.col(c) == F.col(h) for c, h in zip(KEY, HOST, strict=True)]
    hosted = store(hosted.withColumn("own", sum((o.cast("int") for o in own[1:]), own[0].cast("int")) == GROUPS))
    chunks = hosted.groupBy(*HOST).agg(F.max("host_tiles").alias("tiles"), F.max(F.ceil(F.col("tiles") / SPAN)).cast("int").alias("chunks"))
    of = lambda tiles: F.pmod(F.xxhash64("word"), F.col(tiles)).cast("int")
    hosts = (signed.join(chunks.withColumnsRenamed(dict(zip(HOST, KEY, strict=True))), KEY)
             .select(*[F.col(c).alias(h) for c, h in zip(KEY, HOST, strict=True)], of("tiles").alias("tile"),
                     F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "word", "n"))
    guest = signed.join(hosted, KEY).withColumn("g", of("tiles"))
    met = F.when(~F.col("own"), F.sequence(F.lit(0), F.col("host_tiles") - 1)).when(F.col("g") > 0, F.sequence(F.lit(0), F.col("g") - 1))
    guests = guest.select(*HOST, F.explode(met).alias("tile"), F.floor(F.col("g") / SPAN).cast("int").alias("chunk"), F.lit(1).alias("role"), "word", "n")
    rows = hosts.unionByName(guests).select(*HOST, "tile", "chunk", "role", F.length("word").alias("size"), "word", "n")
    placed = rows.repartition(*HOST, "tile", "chunk").sortWithinPartitions(*HOST, "tile", "chunk", "role", "size")
    return placed.mapInArrow(_meet, "a string, n_a long, b string, n_b long")


def group(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Every word with ``form``, ``root``, ``n``, ``n_near`` and ``form_n``. ``words``: distinct ``word`` with its count ``n``."""
    words = store(words.filter(F.length("word") > 0).select("word", F.col("n").cast("long").alias("n")))
    pairs = store(near_pairs(words))
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("top"))
    full = words.join(best, "word", "left")
    is_form = -F.col("top.m") >= ratio * F.col("n")
    full = store(full.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("top.near")).alias("form"),
                             F.when(is_form, -F.col("top.m")).alias("form_n"), F.when(is_form, F.col("top.near")).alias("up")))
    longest = full.agg(F.max("n").alias("n")).first()["n"] or 1
    steps = int(math.log(longest, ratio)) + 1 if ratio > 1 else 0
    if ratio <= 1:
        raise ValueError("the ratio must be above 1, or forms could lead in circles")
    upward = full.filter(F.col("up").isNotNull()).select("word", "up")
    for _ in range(max(steps - 1, 0).bit_length()):  # every round doubles the way a pointer covers
        ahead = upward.select(F.col("word").alias("up"), F.col("up").alias("next"))
        upward = store(upward.join(ahead, "up", "left").select("word", F.coalesce("next", "up").alias("up")))
    done = full.drop("up").join(upward, "word", "left")
    return done.select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")
