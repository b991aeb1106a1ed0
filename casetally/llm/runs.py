"""Periodic runs of words, by longest common extensions in suffix trees.

A run is a stretch of words with a smallest period ``q`` (words ``q`` apart are
equal), at least two periods long, that no neighbouring word extends. For every
word position and for both orders of the words, the longest Lyndon word that
starts there (it ends before the next smaller suffix) is a candidate root:
every run holds a candidate whose length is its period. A candidate is
extended to the right by the longest common extension of its two ends in the
suffix tree of the document, to the left in the tree of the reversed document.
Trees are built by Ukkonen's algorithm over word numbers; a depth-first Euler
tour of string depths turns an extension into a range minimum, answered in
constant time from a table of power-of-two ranges, for all candidates at once.

Before a tree is built, a necessary condition is tested: a run repeats six
words at least, and all of its words but the last period stand in a stretch
of repeated six-word strings whose next occurrences are no further than the
period. A document without such a stretch has no run.

Documents do not meet: there is no shuffle. A task holds one document's tree
(about 0.4 KB a word of that document) and results of a few MB.

Defined cases: a null or blank text has no words, no runs and an empty
collapsed text; words are split at ASCII white space only; texts of any length
are treated whole; rows with equal ids or texts each get their own, equal
result; an empty table gives an empty result; input columns named like a
result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetally.llm.common import keep_columns

#: Shortest run: the contract's, and what the test before the trees relies on (a period of q leaves 12 - q >= 6 or q equal words).
MIN_LENGTH = 12
GRAM = 6
#: Rows taken from a batch at once, and bytes of collapsed text after which a batch of results goes out.
ROWS, BYTES = 64, 4 << 20
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class SuffixTree:
    """Ukkonen's tree of a word-number sequence (numbers 1 and up; a 0 is put at its end)."""

    def __init__(self, numbers: list[int]):
        text = [*numbers, 0]
        self.size, self.width = len(text), max(text) + 1
        self._grow(text)
        self._tour()

    def _grow(self, text: list[int]) -> None:
        n, width = self.size, self.width
        edge: dict[int, int] = {}  # node * width + first word -> child
        begin, end, link, suffix = [0], [0], [0], [-1]
        node = at = length = pending = 0  # active point and suffixes still to insert
        for i, word in enumerate(text):
            pending += 1
            waiting = 0  # inner node without a link yet
            while pending:
                if not length:
                    at = i
                key = node * width + text[at]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(begin)
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    suffix.append(i - pending + 1)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    first = begin[child]
                    span = end[child] - first
                    if end[child] == n:
                        span = i + 1 - first
                    if length >= span:
                        node, at, length = child, at + span, length - span
                        continue
                    if text[first + length] == word:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    inner = len(begin)
                    edge[key] = inner
                    begin += (first, i)
                    end += (first + length, n)
                    link += (0, 0)
                    suffix += (-1, i - pending + 1)
                    edge[inner * width + word] = inner + 1
                    begin[child] = first + length
                    edge[inner * width + text[first + length]] = child
                    if waiting:
                        link[waiting] = inner
                    waiting = inner
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - pending + 1
        self.edge, self.begin, self.end, self.suffix = edge, begin, end, suffix

    def _tour(self) -> None:
        """Euler tour with children in word order: suffixes by rank, and the tour's least string depth between neighbours."""
        keys = np.fromiter(self.edge.keys(), np.int64, len(self.edge))
        children = np.fromiter(self.edge.values(), np.int64, len(self.edge))
        order = np.argsort(keys)
        parents, children = keys[order] // self.width, children[order].tolist()
        first = np.searchsorted(parents, np.arange(len(self.begin) + 1)).tolist()
        span = (np.array(self.end) - np.array(self.begin)).tolist()
        depth = [0] * len(self.begin)
        suffix, tour, leaves, places = self.suffix, [], [], []
        del self.edge, self.begin, self.end
        todo = [0]
        while todo:
            v = todo.pop()
            if v < 0:  # back at an inner node, between two children
                tour.append(depth[~v])
                continue
            d = depth[v]
            if suffix[v] >= 0:
                leaves.append(suffix[v])
                places.append(len(tour))
            else:
                kids = children[first[v]:first[v + 1]]
                for c in kids:
                    depth[c] = d + span[c]
                back = [~v] * (2 * len(kids) - 1)
                back[::2] = kids[::-1]
                todo += back
            tour.append(d)
        del self.suffix
        self.rank = np.empty(self.size, np.int64)
        self.rank[np.array(leaves)] = np.arange(self.size)
        # what a question between two leaves sees of the tour between neighbouring leaves is its least depth
        low = np.minimum.reduceat(np.array(tour, np.int32), np.array(places))[:-1] if self.size > 1 else np.empty(0, np.int32)
        self.table = [low]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension of the suffixes at ``a`` and at ``b`` (never the same): string depth of their LCA."""
        x, y = self.rank[a], self.rank[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.floor(np.log2(hi - lo)).astype(np.int64)
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.table[k][lo[at]], self.table[k][hi[at] - (1 << int(k))])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For every position the next one with a smaller rank (its own number of positions if there is none)."""
    out, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return out


def may_have_runs(numbers: np.ndarray) -> bool:
    """The necessary condition of the module's text (True if in doubt: a hash may confuse two strings)."""
    n = len(numbers) - GRAM + 1
    if n < 2:
        return False
    factor = np.uint64(0x9E3779B97F4A7C15)
    code, words = np.zeros(n, np.uint64), numbers.astype(np.uint64)
    for k in range(GRAM):
        code = (code ^ (code >> np.uint64(29))) * factor + words[k:k + n]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return False
    ahead = np.zeros(n, np.int64)  # distance to the next occurrence; 0: none
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    repeated = ahead > 0
    starts = np.flatnonzero(repeated & ~np.r_[False, repeated[:-1]])
    ends = np.flatnonzero(repeated & ~np.r_[repeated[1:], False]) + 1
    nearest = np.minimum.reduceat(np.where(repeated, ahead, n), np.c_[starts, ends].ravel()[: 2 * len(starts) - (ends[-1] == n)])[::2]
    return bool((ends - starts >= np.maximum(nearest, GRAM) - GRAM + 1).any())


def find_runs(numbers: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``min_length`` words, by start, then period.

    ``numbers``: words as numbers from 1. ``min_length`` may not be below 12."""
    if min_length < MIN_LENGTH:
        raise ValueError(f"runs below {MIN_LENGTH} words are not searched")
    n = len(numbers)
    if n < min_length or not may_have_runs(numbers):
        return np.empty((0, 3), np.int64)
    words = numbers.tolist()
    forward = SuffixTree(words)
    rank = forward.rank
    at = np.arange(n)
    # the second order turns the first round, the end mark included: a larger rank is then the smaller suffix
    candidates = [np.array(next_smaller(r.tolist()), np.int64)[:n] for r in (rank, -rank)]
    start = np.concatenate([at, at])
    period = np.concatenate(candidates) - start
    keep = start + period < n
    start, period = start[keep], period[keep]
    right = forward.extension(start, start + period)
    del forward
    keep = right > 0  # a run's first root starts in its first period, so the word after it repeats too
    start, period, right = start[keep], period[keep], right[keep]
    if not len(start):
        return np.empty((0, 3), np.int64)
    backward = SuffixTree(words[::-1])
    left = backward.extension(n - start, n - start - period)
    length = left + period + right
    keep = (length >= 2 * period) & (length >= min_length)
    found = np.stack([start - left, length, period], axis=1)[keep]
    return np.unique(found, axis=0)


def by_start(found: np.ndarray) -> np.ndarray:
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words outside the repeats: of every run its first period stays."""
    if not len(found):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join([w for w, on in zip(words, keep.tolist(), strict=True) if on])


def document_runs(text: str | None, min_length: int = MIN_LENGTH) -> tuple[int, np.ndarray, str]:
    """Number of words, runs and collapsed text of a document."""
    words = (text or "").encode("utf-8", "replace").split()  # bytes split at ASCII white space
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known) + 1) for w in words), np.int64, len(words))
    found = by_start(find_runs(numbers, min_length))
    return len(words), found, collapsed(words, found).decode()


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_words``, ``runs`` (start, length, period) and the text ``collapsed``."""
    kept = [c for c in keep_columns(docs, ["n_words", "runs", "collapsed"]) if keep is None or c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(lo: int, hi: int) -> pa.RecordBatch:
            offsets = np.r_[0, np.cumsum([len(r) for _, r, _ in results])].astype(np.int32)
            every = np.concatenate([r for _, r, _ in results])
            fields = [pa.array(np.ascontiguousarray(every[:, j])) for j in range(3)]
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            return pa.RecordBatch.from_arrays(
                [*(b.column(j).slice(lo, hi - lo) for j in range(len(kept))), pa.array([x[0] for x in results], pa.int64()), runs,
                 pa.array([x[2] for x in results], pa.string())], names=[*kept, "n_words", "runs", "collapsed"])

        for b in batches:
            done, results, held = 0, [], 0
            for lo in range(0, b.num_rows, ROWS):
                for t in b.column(len(kept)).slice(lo, ROWS).to_pylist():
                    results.append(document_runs(t, min_length))
                    held += len(results[-1][2])
                if held >= BYTES:
                    yield made(done, done + len(results))
                    done, results, held = done + len(results), [], 0
            if results:
                yield made(done, done + len(results))

    source = docs.select(*kept, F.col(text).alias("__text"))
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
                           T.StructField("collapsed", T.StringType())])
    return source.mapInArrow(run, schema)
