"""Removal of repeated byte strings by a distributed, hash-compared suffix sort.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a
document with a smaller id is marked. The work is cut into independent suffix
sorts:

1. *Anchors.* In every window of ``LENGTH`` bytes the ``GRAM``-byte string
   with the smallest hash is an anchor, so equal windows have equal anchors at
   the same place. Anchor hashes are counted over the corpus (packed,
   by bucket of the hash); only those seen in two documents go on.
2. *Contexts.* Around each such anchor lie all windows that hold it. They are
   sent to a bucket by the hash of the anchor; equal contexts of a block of
   documents travel once, with the smallest and largest id that has them.
3. *Suffix sort.* A bucket's suffixes (from the anchor on) are merge-sorted
   per anchor. Two suffixes are compared by prefix polynomial hashes: a binary
   search finds the length of their common extension, the byte after it
   decides. Neighbours' common extensions cut the order into runs that share
   the part of a window right of the anchor; within a run the hash of the part
   left of it groups equal windows. Every group is verified on its bytes, and
   grouped by its bytes where hashes collided. A group's smallest id answers.
4. The answers go back to the blocks, which mark the bytes.

Texts travel packed, by block and compressed.

Defined cases: a null text is empty; a null id is larger than any other; ids
that are equal are not smaller than each other, so repeated rows do not remove
one another; texts shorter than ``LENGTH`` keep every byte; an empty table
gives an empty result. Offsets are bytes of the UTF-8 text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetally.llm.common import partitions, row_key, store

LENGTH, GRAM = 50, 20
WIDE = LENGTH - GRAM + 1  # places of an anchor in a window
#: Bytes of a block of documents, of a counting bucket, and of the pieces in which a block is hashed.
BLOCK, BUCKET, CHUNK = 4 << 20, 16 << 20, 1 << 20
#: Contexts sorted at once (a whole group at least).
SORTED = 100_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)

#: Bytes of a context left and right of the anchor's start; a window begins at most LEFT bytes before it.
LEFT, RIGHT = WIDE - 1, LENGTH
WIDTH = LEFT + RIGHT + 2  # and how many of them lie in the document, on either side


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, inverse = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:] = np.multiply.accumulate(np.full(n - 1, BASE))
    inverse[1:] = np.multiply.accumulate(np.full(n - 1, np.uint64(pow(int(BASE), -1, 1 << 64))))
    return up, inverse


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def _prefix_hashes(x: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of a byte string, modulo 2**64."""
    up, _ = _powers(CHUNK + 4 * LENGTH)
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:len(x)], out=out[1:])
    return out


def _string_hashes(prefix: np.ndarray, start: np.ndarray | slice, length: int) -> np.ndarray:
    """Hashes of the strings of one length that begin at ``start``, alike wherever a string stands."""
    _, inverse = _powers(CHUNK + 4 * LENGTH)
    if isinstance(start, slice):
        return _mixed((prefix[length:] - prefix[:-length]) * inverse[:len(prefix) - length])
    return _mixed((prefix[start + length] - prefix[start]) * inverse[start])


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbours, by doubling."""
    f = np.minimum if least else np.maximum
    size = 1
    while 2 * size <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def anchors(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of documents laid end to end in ``x``; ``ends``: where each ends."""
    places, hashes = [], []
    for lo in range(0, len(x), CHUNK):
        part = x[lo:lo + CHUNK + 2 * LENGTH]
        if len(part) < LENGTH:
            break
        h = _string_hashes(_prefix_hashes(part), slice(None), GRAM)
        end = ends[np.searchsorted(ends, lo + np.arange(len(h)), "right")] - lo
        inside = np.arange(len(h)) + GRAM <= end
        h_in = np.where(inside, h, np.uint64(2**64 - 1))
        least = _sliding(h_in, WIDE, True)
        n = len(least)
        least[np.arange(n) + LENGTH > end[:n]] = 0  # windows that leave their document
        if lo + CHUNK < len(x):
            least = least[:CHUNK]  # the rest begins in the next piece
        padded = np.concatenate([np.zeros(WIDE - 1, np.uint64), least, np.zeros(WIDE - 1, np.uint64)])
        most = _sliding(padded, WIDE, False)  # of all windows that hold a place
        m = min(len(most), len(h))
        at = np.flatnonzero((most[:m] == h[:m]) & inside[:m])
        places.append(at + lo)
        hashes.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _laid_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])


def _squeeze(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), codec="zstd", asbytes=True)


def _unsqueeze(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    size = n * sum(np.dtype(k).itemsize for k in kinds)
    raw, out, at = pa.decompress(data, size, codec="zstd", asbytes=True), [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _planes(h: np.ndarray) -> list[np.ndarray]:
    """The upper 48 bits of sorted hashes, 16 at a time (the uppermost compress well). What is cut off only lets a few
    more anchors through."""
    return [((h >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.uint16) for s in (48, 32, 16)]


def _from_planes(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(48) | b.astype(np.uint64) << np.uint64(32) | c.astype(np.uint64) << np.uint64(16)


UPPER48 = np.uint64(2**64 - 2**16)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """By lower ones of the 48 bits."""
    return ((h >> np.uint64(16)) * MIX >> np.uint64(33)) % np.uint64(buckets)


def _split(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of the runs of a sorted array."""
    if not len(part):
        return []
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return list(zip(part[at].tolist(), at.tolist(), [*at[1:].tolist(), len(part)], strict=True))


def _count_anchors(buckets: int):
    """(bucket, n, data) of a batch: its anchors' hashes, the block each lies in, and whether two documents of it have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            x, ends = _laid_out(b.column(2).to_pylist())
            at, h = anchors(x, ends)
            if not len(at):
                continue
            h = h & UPPER48
            owner = np.searchsorted(ends, at, "right")
            blocks, ids = block[owner], d[owner]
            order = np.lexsort((ids, blocks, h, _bucket(h, buckets)))
            h, blocks, ids = h[order], blocks[order], ids[order]
            first = np.r_[True, (h[1:] != h[:-1]) | (blocks[1:] != blocks[:-1])]
            start = np.flatnonzero(first)
            many = np.maximum.reduceat(ids, start) != np.minimum.reduceat(ids, start)
            h, blocks = h[start], blocks[start].astype(np.uint32)
            rows = [(v, hi - lo, _squeeze(*_planes(h[lo:hi]), blocks[lo:hi], many[lo:hi].astype(np.uint8)))
                    for v, lo, hi in _split(_bucket(h, buckets))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "n", "data"])
    return run


ANSWER = "block long, kind int, bucket long, n long, data binary"


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: [r[i] for r in rows] for i, n in enumerate(names)}, columns=names)


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's hashes that two documents have, for each block that has them."""
    parts = [_unsqueeze(data, n, "u2", "u2", "u2", "u4", "u1") for n, data in zip(rows["n"], rows["data"], strict=True)]
    h = np.concatenate([_from_planes(*p[:3]) for p in parts])
    block, many = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
    order = np.argsort(h)
    h, block, many = h[order], block[order], many[order]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[start, len(h)])
    again = np.repeat((size > 1) | (np.maximum.reduceat(many, start) > 0), size)
    h, block = h[again], block[again]
    order = np.lexsort((h, block))
    h, block = h[order], block[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (block[1:] != block[:-1])] if len(h) else np.empty(0, bool)
    h, block = h[new], block[new]
    found = [(v, 0, 0, hi - lo, _squeeze(*_planes(h[lo:hi]))) for v, lo, hi in _split(block)]
    return _frame(found, ["block", "kind", "bucket", "n", "data"])


class _Contexts:
    """The contexts of a block's repeated anchors: distinct ones, and where each occurs. ``parts``: the buckets they are
    sent to, as (bucket, from, to) of ``order``."""

    def __init__(self, x: np.ndarray, ends: np.ndarray, ids: np.ndarray, at: np.ndarray, h: np.ndarray, buckets: int):
        owner = np.searchsorted(ends, at, "right")
        begin = np.r_[0, ends[:-1]][owner]
        before, after = np.minimum(at - begin, LEFT), np.minimum(ends[owner] - at, RIGHT)
        self.at, self.ids = at, ids[owner]
        rows = np.zeros((len(at), WIDTH), np.uint8)
        near = np.arange(-LEFT, RIGHT)
        for lo in range(0, len(at), SORTED):
            part = slice(lo, lo + SORTED)
            inside = (near >= -before[part, None]) & (near < after[part, None])
            rows[part, :-2] = np.where(inside, x[np.clip(at[part, None] + near, 0, max(len(x) - 1, 0))], 0)
        rows[:, -2], rows[:, -1] = before, after
        whole = rows.view(f"V{WIDTH}").ravel() if len(rows) else np.empty(0, f"V{WIDTH}")
        _, first, self.which = np.unique(whole, return_index=True, return_inverse=True)
        self.rows = rows[first]
        bucket = (h[first] % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.parts = _split(bucket[self.order])
        self.least, self.most = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(self.least, self.which, self.ids)
        np.maximum.at(self.most, self.which, self.ids)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, n, size, data): the documents of a batch by block, compressed."""
    for b in batches:
        if not b.num_rows:
            continue
        b = b.take(pa.compute.sort_indices(b.column(0)))
        missing = np.array([v is None for v in b.column(1).to_pylist()], np.uint8)
        numbers = [b.column(1).fill_null(0).to_numpy(), missing, *(b.column(i).to_numpy() for i in (2, 3))]
        raw = [(t or "").encode("utf-8", "replace") for t in b.column(4).to_pylist()]
        sizes = np.array([len(r) for r in raw], np.int64)
        rows = [(v, hi - lo, int(sizes[lo:hi].sum()), _squeeze(*(c[lo:hi] for c in (*numbers, sizes)), np.frombuffer(b"".join(raw[lo:hi]), np.uint8)))
                for v, lo, hi in _split(b.column(0).to_numpy())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())],
                                         names=["block", "n", "size", "data"])


class _Block:
    """A block's documents, in order of id and text hash: their bytes laid end to end, where each ends, and their keys."""

    def __init__(self, packs: pd.DataFrame):
        parts, texts = [], []
        for n, size, data in zip(packs["n"], packs["size"], packs["data"], strict=True):
            raw = pa.decompress(data, n * 33 + size, codec="zstd", asbytes=True)
            part = [np.frombuffer(raw, k, n, at * n) for k, at in (("i8", 0), ("u1", 8), ("i8", 9), ("i8", 17), ("i8", 25))]
            ends = np.cumsum(part[-1]) + n * 33
            texts += [raw[e - s:e] for e, s in zip(ends.tolist(), part[-1].tolist(), strict=True)]
            parts.append(part)
        self.doc_id, missing, self.d, self.k, size = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.lexsort((self.k, self.d))
        self.doc_id, self.d, self.k, self.missing = self.doc_id[order], self.d[order], self.k[order], missing[order] == 1
        self.x = np.frombuffer(b"".join([texts[i] for i in order]), np.uint8)
        self.ends = np.cumsum(size[order])


def _opened(block: _Block, answers: pd.DataFrame, buckets: int) -> _Contexts:
    """The contexts of a block's repeated anchors, in the same order whenever it is opened."""
    x, ends, ids = block.x, block.ends, block.d
    mine = answers[answers["kind"] == 0]
    known = np.unique(np.concatenate([np.empty(0, np.uint64), *(
        _from_planes(*_unsqueeze(data, n, "u2", "u2", "u2")) for n, data in zip(mine["n"], mine["data"], strict=True))]))
    at, h = anchors(x, ends)
    if len(known):
        place = np.minimum(np.searchsorted(known, h & UPPER48), len(known) - 1)
        again = known[place] == h & UPPER48
    else:
        again = np.zeros(len(at), bool)
    return _Contexts(x, ends, ids, at[again], h[again], buckets)


def _send_contexts(buckets: int):
    def run(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "block", "n", "data"]
        if not len(packs):
            return _frame([], names)
        c = _opened(_Block(packs), answers, buckets)
        return _frame([(v, int(packs["block"].iloc[0]), hi - lo, _squeeze(c.rows[own], c.least[own], c.most[own] - c.least[own]))
                       for v, lo, hi in c.parts for own in [c.order[lo:hi]]], names)
    return run


def _common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows a and b, by binary search over their prefix hashes (rows x (length + 1))."""
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), prefix.shape[1] - 1)
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = prefix[a, mid] == prefix[b, mid]
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
    return lo


def suffix_sort(suffixes: np.ndarray, prefix: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of the rows of ``suffixes`` within each run of equal ``group``: a bottom-up merge sort, all runs of a
    level at once. A row's place in the merged run is its place in its own run plus its rank in the other, found by
    binary search; each comparison looks for the common extension and decides by the symbol after it."""
    n, length = len(suffixes), suffixes.shape[1]
    order = np.arange(n)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, n])
    begin, end = np.repeat(start, size), np.repeat(start + size, size)
    width = 1
    while width < size.max(initial=0):
        at = np.flatnonzero(end - begin > width)
        g0, g1 = begin[at], end[at]
        run = (at - g0) // width
        other = g0 + (run ^ 1) * width
        lo, hi = np.minimum(other, g1), np.minimum(other + width, g1)
        floor, own, right = lo.copy(), order[at], run % 2 == 1
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            a, b = order[mid], own[open_]
            common = np.minimum(_common_extension(prefix, a, b), length - 1)
            x, y = suffixes[a, common], suffixes[b, common]
            less = (x < y) | ((x == y) & right[open_])  # equal ones: those of the left run first
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        merged = order.copy()
        merged[g0 + (run // 2) * 2 * width + (at - g0) % width + (lo - floor)] = own
        order = merged
        width *= 2
    return order


def _horner(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    for j in range(rows.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + rows[:, j] + np.uint64(1)
    return out


def _first_owners(rows: np.ndarray, key: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(contexts, offsets): the smallest id that has the window beginning that many bytes before the anchor; the
    largest integer where a context has no such window. ``key`` is sorted."""
    left, first, last = LEFT, 0, LEFT
    body, before, after = rows[:, :-2].astype(np.uint16) + 1, rows[:, -2], rows[:, -1]
    place = np.arange(-LEFT, RIGHT)
    body[(place < -before[:, None].astype(np.int64)) | (place >= after[:, None])] = 0  # beyond the document
    suffixes = body[:, left:]
    prefix, back = _horner(suffixes), _horner(body[:, :left][:, ::-1])
    order = suffix_sort(suffixes, prefix, key)
    common = np.zeros(len(order), np.int64)  # with the row before
    common[1:] = np.where(key[order[1:]] == key[order[:-1]], _common_extension(prefix, order[:-1], order[1:]), -1)
    common[0] = -1
    out = np.full((len(rows), last - first + 1), np.iinfo(np.int64).max)
    for o in range(first, last + 1):
        run = np.cumsum(common < LENGTH - o).astype(np.uint64)  # equal right of the anchor
        has = (before[order] >= o) & (after[order] >= LENGTH - o)
        own, name = order[has], _mixed(run[has] * MIX + back[order[has], o])
        by = np.argsort(name, kind="stable")
        own, name = own[by], name[by]
        if not len(own):
            continue
        start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        size = np.diff(np.r_[start, len(own)])
        window = body[:, left - o:left - o + LENGTH]
        good = (window[own] == window[np.repeat(own[start], size)]).all(axis=1)
        if not good.all():  # hashes collided: these groups by their bytes
            bad = np.repeat(np.logical_or.reduceat(~good, start), size)
            raw = np.ascontiguousarray(window[own]).view(f"V{2 * LENGTH}").ravel()
            _, number = np.unique(raw, return_inverse=True)
            by = np.lexsort((np.where(bad, number, 0), np.repeat(np.arange(len(start)), size)))
            own, number, bad = own[by], number[by], bad[by]
            whole = np.repeat(np.arange(len(start)), size)
            start = np.flatnonzero(np.r_[True, (whole[1:] != whole[:-1]) | (bad[1:] & (number[1:] != number[:-1]))])
            size = np.diff(np.r_[start, len(own)])
        out[own, o - first] = np.repeat(np.minimum.reduceat(least[own], start), size)
    return out


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's contexts: which windows of each occur in a smaller document, for the blocks that sent them."""
    parts = [_unsqueeze(data, n, f"V{WIDTH}", "i8", "i8") for n, data in zip(rows["n"], rows["data"], strict=True)]
    raw = np.concatenate([p[0] for p in parts])
    key = _mixed(_horner(np.frombuffer(raw.tobytes(), np.uint8).reshape(-1, WIDTH)[:, LEFT:LEFT + GRAM])[:, -1])  # of the anchor
    block = np.repeat(rows["block"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
    order = np.argsort(key, kind="stable")
    key, block, raw = key[order], block[order], raw[order]
    least, more = (np.concatenate([p[i] for p in parts])[order] for i in (1, 2))
    most, number = least + more, np.concatenate([np.arange(n) for n in rows["n"]])[order]
    start = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
    found, lo = [], 0
    while lo < len(start) - 1:
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + SORTED, "right")) - 1)
        part = slice(start[lo], start[hi])
        lo = hi
        smallest = _first_owners(np.frombuffer(raw[part].tobytes(), np.uint8).reshape(-1, WIDTH), key[part], least[part])
        useful = smallest < most[part][:, None]
        fresh = useful & np.c_[np.ones(len(useful), bool), (smallest[:, 1:] != smallest[:, :-1]) | ~useful[:, :-1]]
        row, col = np.nonzero(fresh)  # runs of offsets with the same answer
        flat_run = np.cumsum(fresh.ravel())[np.flatnonzero(useful.ravel())]
        length = np.bincount(flat_run, minlength=len(row) + 1)[1:] if len(row) else np.empty(0, np.int64)
        found.append((block[part][row], number[part][row], col, col + length - 1, smallest[row, col]))
    block, number, o_lo, o_hi, smallest = (np.concatenate([f[i] for f in found]) for i in range(5))
    order = np.argsort(block, kind="stable")
    out, bucket = [], int(rows["bucket"].iloc[0])
    for v, lo, hi in _split(block[order]):
        own = order[lo:hi]
        out.append((v, 1, bucket, hi - lo, _squeeze(smallest[own], number[own].astype(np.uint32), o_lo[own].astype(np.uint8), o_hi[own].astype(np.uint8))))
    return _frame(out, ["block", "kind", "bucket", "n", "data"])


RESULT = "doc_id long, d long, k long, n_bytes long, removed array<struct<start:long,end:long>>, kept_sha256 string"


def _mark(buckets: int):
    names = ["doc_id", "d", "k", "n_bytes", "removed", "kept_sha256"]

    def run(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(packs):
            return _frame([], names)
        block = _Block(packs)
        c = _opened(block, answers, buckets)
        edge = np.zeros(len(block.x) + 1, np.int32)
        by = np.argsort(c.which, kind="stable")
        bounds = np.searchsorted(c.which[by], np.arange(len(c.rows) + 1))
        sent = {v: c.order[lo:hi] for v, lo, hi in c.parts}
        mine = answers[answers["kind"] == 1]
        for bucket, n, data in zip(mine["bucket"], mine["n"], mine["data"], strict=True):
            smallest, number, o_lo, o_hi = _unsqueeze(data, n, "i8", "u4", "u1", "u1")
            number = sent[bucket][number]
            many = bounds[number + 1] - bounds[number]
            row = np.repeat(np.arange(len(number)), many)
            own = by[np.repeat(bounds[number], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            hit = c.ids[own] > smallest[row]
            at, row = c.at[own[hit]], row[hit]
            np.add.at(edge, at - o_hi[row], 1)
            np.add.at(edge, at - o_lo[row] + LENGTH, -1)
        covered = np.cumsum(edge[:-1]) > 0
        rows, begin = [], 0
        for doc_id, missing, d, k, end in zip(*(v.tolist() for v in (block.doc_id, block.missing, block.d, block.k, block.ends)), strict=True):
            mask, own = covered[begin:end], block.x[begin:end]
            turn = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
            spans = [{"start": a, "end": b} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]
            kept = own[~mask].tobytes() if len(turn) else own.tobytes()
            rows.append((None if missing else doc_id, d, k, end - begin, spans, hashlib.sha256(kept).hexdigest()))
            begin = end
        out = _frame(rows, names)
        out["doc_id"] = pd.array([r[0] for r in rows], "Int64")
        return out
    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, d, k, n_bytes, removed, kept_sha256) for every row: the maximal runs of bytes to remove (start, end), and
    the SHA-256 of the bytes that stay."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK))
    buckets = max(3 * partitions(spark), -(-total // BUCKET))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(F.col(id_col), F.col(text)), F.col(text).alias("t"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("d", "k"), F.lit(blocks)))
    counted = rows.select("block", "d", "t").mapInArrow(_count_anchors(buckets), "bucket long, n long, data binary")
    repeated = store(counted.groupBy("bucket").applyInPandas(_repeated, ANSWER))
    packs = rows.select("block", "doc_id", "d", "k", "t").mapInArrow(_packed, "block long, n long, size long, data binary")
    texts = packs.groupBy("block")
    sent = texts.cogroup(repeated.groupBy("block")).applyInPandas(_send_contexts(buckets), "bucket long, block long, n long, data binary")
    answers = sent.groupBy("bucket").applyInPandas(_answer, ANSWER)
    return texts.cogroup(repeated.unionByName(answers).groupBy("block")).applyInPandas(_mark(buckets), RESULT)
