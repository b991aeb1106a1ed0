"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

A fingerprint's bit is set if it is set in over half the XXH64 hashes (seed
42) of the text's word shingles. Equal fingerprints are one node. Nodes are
dealt into tiles by the population counts of the fingerprint's eight bytes: a
flipped bit changes one count by one, so two fingerprints within ``radius``
bits lie in tiles whose counts differ by no more than ``radius`` in sum; every
other pair of tiles is skipped. Within the tile pairs that remain, numpy
compares all fingerprints (exclusive-or and bit count), so no link is lost.
A task returns a spanning forest of the links it finds, not all pairs, and the
components follow in ``graph.components``.

Defined cases: a text of fewer words than a shingle is one shingle, a text
without words (or null) has fingerprint 0 and is linked like any other; rows
with a null id get a fingerprint and the smallest non-null id of their
component, null where it has none; repeated rows are linked like any equal
texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetally.llm.common import partitions, row_key, sliced, store
from casetally.llm.graph import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Shingles hashed at once, and pairs compared at once.
CHUNK, PAIRS = 1 << 16, 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts = ends - size
    n = max(len(words) - shingle + 1, 1)
    first, last = starts[:n].tolist(), (ends[-n:] - 1).tolist()
    if len(words) < shingle:
        last = [len(joined)]
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, CHUNK):
        spans = map(slice, first[lo:lo + CHUNK], last[lo:lo + CHUNK])
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), "<u8", min(CHUNK, n - lo))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, d, k, fp) for every row; d and k are ``row_key``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 3):
            fp = [fingerprint(t, shingle) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp, pa.int64())], names=["doc_id", "d", "k", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(F.col(id_col), F.col(text)), F.col(text).alias("t"))
    return rows.mapInArrow(run, "doc_id long, d long, k long, fp long")


@lru_cache(maxsize=4)
def _offsets(radius: int) -> np.ndarray:
    """Differences of eight counts of at most ``radius`` in sum, one of each pair (x, -x), and zero first."""
    found = {(0,) * 8}
    for _ in range(radius):
        found |= {tuple(x + s * (i == j) for j, x in enumerate(v)) for v in found for i in range(8) for s in (1, -1)}
    half = sorted(v for v in found if v > (0,) * 8)
    return np.array([(0,) * 8, *half], np.int64)


#: Tiles are numbered in base 16, counts moved up so that none is below zero.
_BASE = 16 ** np.arange(8, dtype=np.int64)


def _tiles(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = _offsets(radius)
        for b in batches:
            fp = b.column(0).to_numpy()
            for lo in range(0, len(fp), 2000):
                own = np.ascontiguousarray(fp[lo:lo + 2000])
                counts = np.bitwise_count(own.view(np.uint8).reshape(-1, 8)).astype(np.int64)
                to = counts[:, None, :] + offsets[None, :, :]
                fits = ((to >= 0) & (to <= 8)).all(axis=2)  # a byte has no other count
                tile = (to * _BASE).sum(axis=2)
                at, which = np.nonzero(fits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile[at, which]), pa.array((which > 0).astype(np.int8)), pa.array(own[at])], names=["tile", "guest", "fp"])
    return run


class _Forest:
    """Spanning forest of links seen so far (union-find)."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _compare(radius: int):
    """Compares the rows of each tile; they come sorted by tile, those at home first."""
    def links(homes: np.ndarray, others: np.ndarray, same: bool) -> Iterator[tuple[int, int]]:
        step = max(1, PAIRS // max(len(homes), 1))
        for lo in range(0, len(others), step):
            near = np.bitwise_count(homes[:, None] ^ others[None, lo:lo + step]) <= radius
            i, j = np.nonzero(near)
            if same:
                i, j = i[i < j + lo], j[i < j + lo]
            yield from zip(homes[i].tolist(), others[j + lo].tolist(), strict=True)

    def small(tile: np.ndarray, guest: np.ndarray, fp: np.ndarray) -> Iterator[tuple[int, int]]:
        """All tiles of a batch at once: each row against the homes of its tile."""
        start = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        size = np.diff(np.r_[start, len(tile)])
        home = np.add.reduceat((guest == 0).astype(np.int64), start)
        at = np.repeat(start, size)
        many = np.where(guest == 1, np.repeat(home, size), np.arange(len(tile)) - at)  # homes: those before it
        bounds = np.cumsum(many)
        lo = 0
        while lo < len(tile):
            hi = max(lo + 1, int(np.searchsorted(bounds, (bounds[lo - 1] if lo else 0) + PAIRS, "right")))
            n = many[lo:hi]
            row = np.repeat(np.arange(lo, hi), n)
            other = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            near = np.bitwise_count(fp[row] ^ fp[other]) <= radius
            yield from zip(fp[other[near]].tolist(), fp[row[near]].tolist(), strict=True)
            lo = hi

    def out(found: Iterator[tuple[int, int]]) -> pa.RecordBatch:
        forest = _Forest()
        kept = [x for x in found if forest.add(*x)]
        return pa.RecordBatch.from_arrays([pa.array(np.array([x[i] for x in kept], np.uint64).view(np.int64)) for i in (0, 1)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, of = [], None  # the homes of the tile that goes on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            tile, guest, fp = (b.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)  # bit counts of signed integers are those of their absolute values
            on = int(np.searchsorted(tile, of, "right")) if of is not None and tile[0] == of else 0
            if on:  # rows of that tile against the homes of earlier batches
                for block in homes:
                    yield out(links(block, fp[:on], False))
            yield out(small(tile, guest, fp))
            last = int(np.searchsorted(tile, tile[-1], "left"))
            own = fp[last:][guest[last:] == 0]
            homes, of = ([*homes, own] if on and last == 0 and tile[-1] == of else [own]), tile[-1]
    return run


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between the distinct fingerprints of ``nodes``; enough of them to join every component."""
    spark = nodes.sparkSession
    rows = nodes.select("fp").mapInArrow(_tiles(radius), "tile long, guest byte, fp long")
    placed = rows.repartition(partitions(spark), "tile").sortWithinPartitions("tile", "guest", "fp")
    return placed.mapInArrow(_compare(radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, d, k, fp, root, component_id) for every row: a fingerprint that names its component, and the smallest id
    reachable over links of at most ``radius`` bits."""
    rows = store(fingerprints(docs, shingle, id_col, text))
    nodes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    star = store(components(links(nodes, radius)))
    linked = star.select(F.col("node").alias("fp"), "root").unionByName(star.select(F.col("root").alias("fp"), "root").distinct())
    of = linked.join(nodes, "fp")
    whole = of.join(of.groupBy("root").agg(F.min("first").alias("least")), "root").select("fp", "root", "least")
    found = store(nodes.join(whole, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id")))
    return rows.join(found, "fp").select("doc_id", "d", "k", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id (null last), of equal ids that with the smallest text hash."""
    rows = store(near_duplicates(docs, shingle, radius, id_col, text).select("d", "k", "root"))
    each = rows.groupBy("root", "d", "k").agg(F.count("*").alias("n"))
    best = rows.groupBy("root").agg(F.min(F.struct("d", "k")).alias("b"))
    is_best = (F.col("b.d") == F.col("d")) & (F.col("b.k") == F.col("k"))
    judged = store(each.join(best, "root").select("d", "k", "n", is_best.alias("best")))
    twice = judged.filter(F.col("best") & (F.col("n") > 1)).select(F.col("d").alias("__d"), F.col("k").alias("__k"))
    gone = judged.filter(~F.col("best") | (F.col("n") > 1)).select(F.col("d").alias("__d"), F.col("k").alias("__k"))
    d, k = row_key(F.col(id_col), F.col(text))
    keyed = docs.withColumns({"__d": d, "__k": k})
    once = keyed.join(gone, ["__d", "__k"], "left_anti")
    more = keyed.join(twice, ["__d", "__k"], "left_semi").dropDuplicates(["__d", "__k"])
    return once.unionByName(more).select(*docs.columns)
