"""Line deduplication with keep bitmaps.

A line's key is the line stripped of ASCII white space and lower-cased in A-Z;
it travels as a 128-bit hash. The rows (hash, document, position) are
range-partitioned by hash *and document* and sorted, so one very common line
spreads over many partitions, and each partition is streamed once: a run of
equal hashes is counted by documents, its first occurrence comes first. Only
the runs at a partition's two ends can go on next door; their counts (two rows
per partition) are summed and joined back to the few rows still undecided.
What returns to a document is a compressed bitmap of the lines to keep.

A key found in at least ``min_docs`` documents is common. ``keep_first=False``
drops all its lines, ``keep_first=True`` all but the very first (by document
id, then position). With ``min_docs=1, keep_first=True`` every line survives once.

Defined cases: a null or empty text is one empty line; keys shorter than
``min_chars`` code points are never common; rows with the same id and text are
one document and get the same bitmap; a null id sorts last; an empty table
gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetally.llm.common import keep_columns, partitions, row_key, sliced, store

BLANK = b" \t\n\x0b\x0c\r"
ROWS = "h1 long, h2 long, d long, k long, pos int"
DROP, OPEN, COUNT = 0, 1, 2
#: Rows of one Arrow batch that a task emits.
BATCH = 100_000


def line_keys(text: str | None) -> list[bytes]:
    return [x.strip(BLANK).lower() for x in (text or "").encode("utf-8", "replace").split(b"\n")]


def _explode(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in sliced(batches, 2):
            d, k = (b.column(i).to_numpy() for i in (0, 1))
            hashes, owner, pos, held = [], [], [], 0
            for i, text in enumerate(b.column(2).to_pylist()):
                keys = line_keys(text)
                if min_chars > 1:
                    at = [j for j, x in enumerate(keys) if len(x.decode()) >= min_chars]
                else:
                    at = [j for j, x in enumerate(keys) if x]
                if at:
                    hashes.append(b"".join([digest(keys[j]) for j in at]))
                    owner.append(np.full(len(at), i))
                    pos.append(np.array(at, np.int32))
                    held += len(at)
                if held >= BATCH:
                    yield _batch(hashes, owner, pos, d, k)
                    hashes, owner, pos, held = [], [], [], 0
            if held:
                yield _batch(hashes, owner, pos, d, k)
    return run


def _batch(hashes, owner, pos, d, k) -> pa.RecordBatch:
    h, o = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2), np.concatenate(owner)
    columns = [np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), d[o], k[o], np.concatenate(pos)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "d", "k", "pos"])


def _stream(min_docs: int, keep_first: bool):
    """One pass over sorted rows; see the module's text. State between batches: the run that is still going on."""
    names = ["h1", "h2", "d", "k", "pos", "state", "n"]

    def out(rows: np.ndarray, pos: np.ndarray, state: int, n: int = 0) -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(rows[:, j])) for j in range(4)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(pos), pa.array(np.full(len(pos), state, np.int32)), pa.array(np.full(len(pos), n, np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_run = True
        held: tuple[np.ndarray, np.ndarray] | None = None  # undecided rows of the run that goes on
        seen, last, head = 0, None, None  # its documents, the last of them, its first row
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(j).to_numpy() for j in range(4)], axis=1)
            pos = b.column(4).to_numpy()
            new_key = np.ones(len(pos), bool)
            new_key[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            new_doc = new_key.copy()
            new_doc[1:] |= (rows[1:, 2:] != rows[:-1, 2:]).any(axis=1)
            if last is not None:
                new_key[0] = (rows[0, :2] != last[:2]).any()
                new_doc[0] = new_key[0] or (rows[0, 2:] != last[2:]).any()
            starts = np.flatnonzero(new_key)
            edge = int(starts[0]) if len(starts) else len(pos)
            if edge:  # the run that was going on goes on
                rows_on, pos_on = rows[:edge], pos[:edge]
                seen += int(new_doc[:edge].sum())
                if held is not None:
                    rows_on, pos_on = np.concatenate([held[0], rows_on]), np.concatenate([held[1], pos_on])
                    held = None
                if seen >= min_docs:
                    if len(pos_on):
                        yield from decided(rows_on, pos_on, head, first_run)
                else:
                    held = (rows_on, pos_on)
            if len(starts):
                if last is not None:  # that run ends here
                    if first_run:
                        yield from ending(head, seen, held)
                    first_run, held = False, None
                bounds = np.append(starts, len(pos))
                docs = np.add.reduceat(new_doc[edge:].astype(np.int64), starts - edge)
                inner = np.arange(len(starts)) >= (1 if last is None else 0)
                inner[-1] = False
                if last is None and len(starts) > 1:  # the partition's first run ends in this batch
                    lo, hi = bounds[0], bounds[1]
                    head, held = (rows[lo], pos[lo]), (rows[lo:hi], pos[lo:hi])
                    if docs[0] >= min_docs:
                        yield from decided(*held, head, True)
                        held = None
                    yield from ending(head, int(docs[0]), held)
                    first_run, held = False, None
                common = inner & (docs >= min_docs)
                if common.any():
                    mark = np.repeat(common, np.diff(bounds))
                    if keep_first:
                        mark[starts[common] - edge] = False
                    take = np.flatnonzero(mark) + edge
                    if len(take):
                        yield out(rows[take], pos[take], DROP)
                lo = bounds[-2]  # the batch's last run may go on
                seen, head, held = int(docs[-1]), (rows[lo], pos[lo]), (rows[lo:], pos[lo:])
                if seen >= min_docs:
                    yield from decided(*held, head, first_run)
                    held = None
            last = rows[-1]
        if last is not None:
            yield from ending(head, seen, held)

    def decided(rows, pos, head, first_run):
        """Rows of a run that is common for certain."""
        if not keep_first:
            yield out(rows, pos, DROP)
            return
        is_head = (rows[0] == head[0]).all() and pos[0] == head[1]
        if is_head and first_run:  # it may have begun next door
            yield out(rows[:1], pos[:1], OPEN)
        if len(pos) > is_head:
            yield out(rows[int(is_head):], pos[int(is_head):], DROP)

    def ending(head, seen, held):
        """A run at a partition's end: its count, and the rows it has not decided."""
        yield out(head[0][None, :], np.array([head[1]], np.int32), COUNT, seen)
        if held is not None:
            yield out(*held, OPEN)

    return run


def common_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_chars: int = 1,
                 id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (d, k, pos) for every line to drop; d and k are ``row_key`` of its document."""
    spark = docs.sparkSession
    rows = docs.select(*row_key(F.col(id_col), F.col(text)), F.col(text).alias("t"))
    # equal rows are one document: they differ in nothing, so their lines fall together in the sort
    lines = rows.mapInArrow(_explode(min_chars), ROWS)
    placed = lines.repartitionByRange(partitions(spark), "h1", "h2", "d", "k").sortWithinPartitions("h1", "h2", "d", "k", "pos")
    streamed = store(placed.mapInArrow(_stream(min_docs, keep_first), f"{ROWS}, state int, n long"))
    spot = F.struct("d", "k", "pos")
    whole = streamed.filter(F.col("state") == COUNT).groupBy("h1", "h2").agg(F.sum("n").alias("whole"), F.min(spot).alias("head"))
    undecided = streamed.filter(F.col("state") == OPEN).join(F.broadcast(whole), ["h1", "h2"])  # two rows per partition
    wanted = F.col("whole") >= min_docs
    if keep_first:
        wanted &= (spot != F.col("head"))
    return (streamed.filter(F.col("state") == DROP).select("d", "k", "pos")
            .unionByName(undecided.filter(wanted).select("d", "k", "pos")))


def pack(dropped, n_lines: int) -> bytes:
    keep = np.ones(n_lines, bool)
    if dropped is not None and len(dropped):
        keep[np.asarray(dropped, np.int64)] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def kept_text(text: str | None, bitmap: bytes, n_lines: int) -> str:
    keep = unpack(bitmap, n_lines)
    if keep.all():
        return text or ""
    return "\n".join([x for x, on in zip((text or "").split("\n"), keep.tolist(), strict=True) if on])


NEW = ["n_lines", "n_dropped", "keep_bitmap"]


def _with_gone(docs: DataFrame, min_docs: int, keep_first: bool, min_chars: int, id_col: str, text: str) -> DataFrame:
    """``docs`` with ``__n`` lines and ``__gone``, the positions of the lines to drop (null: none)."""
    gone = common_lines(docs, min_docs, keep_first, min_chars, id_col, text).groupBy(
        F.col("d").alias("__d"), F.col("k").alias("__k")).agg(F.collect_set("pos").alias("__gone"))
    d, k = row_key(F.col(id_col), F.col(text))
    body = F.coalesce(F.col(text), F.lit(""))
    lines = (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return docs.withColumns({"__d": d, "__k": k, "__n": lines}).join(gone, ["__d", "__k"], "left").drop("__d", "__k")


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_chars: int = 1,
                 id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` (long) and ``keep_bitmap`` (zlib-packed bits, a 1 for each line kept)."""
    @F.pandas_udf("binary")
    def bitmap(dropped: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([pack(x, int(m)) for x, m in zip(dropped, n, strict=True)])

    full = _with_gone(docs, min_docs, keep_first, min_chars, id_col, text)
    return full.select(*keep_columns(docs, NEW), F.col("__n").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
                       bitmap("__gone", "__n").alias("keep_bitmap"))


def dedup(docs: DataFrame, new: str = "text", min_docs: int = 10, keep_first: bool = False, min_chars: int = 1,
          id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep_bitmaps(docs)`` with ``new``, the lines that the bitmap keeps, made in one Python step."""
    full = _with_gone(docs, min_docs, keep_first, min_chars, id_col, text)
    names, kept = full.columns, keep_columns(docs, [*NEW, new])
    t, gone, lines, at = names.index(text), names.index("__gone"), names.index("__n"), [names.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, t):
            dropped, n = b.column(gone).to_pylist(), b.column(lines).to_pylist()
            maps = [pack(x, m) for x, m in zip(dropped, n, strict=True)]
            made = [kept_text(*x) for x in zip(b.column(t).to_pylist(), maps, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(j) for j in at), b.column(lines), pa.array([len(x or ()) for x in dropped], pa.int64()),
                 pa.array(maps, pa.binary()), pa.array(made, pa.string())], names=[*kept, *NEW, new])

    extra = [F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.lit(b"").alias("keep_bitmap"), F.lit("").alias(new)]
    return full.mapInArrow(run, docs.select(*kept, *extra).schema)


def _each_text(docs: DataFrame, text: str, new: str, kind: str, make) -> DataFrame:
    """``docs`` with column ``new``, made from text, bitmap and line count."""
    names = docs.columns
    t, m, n = (names.index(c) for c in (text, "keep_bitmap", "n_lines"))
    kept = keep_columns(docs, [new])
    at = [names.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(kept_text(*x)) for x in zip(*(b.column(j).to_pylist() for j in (t, m, n)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in at), pa.array(made, pa.string())], names=[*kept, new])

    return docs.mapInArrow(run, docs.select(*kept, F.lit("").cast(kind).alias(new)).schema)


def with_kept_text(marked: DataFrame, text: str = "text", new: str = "kept_text") -> DataFrame:
    """The lines that the bitmap keeps, joined by line breaks."""
    return _each_text(marked, text, new, "string", lambda x: x)


def with_kept_sha256(marked: DataFrame, text: str = "text", new: str = "kept_sha256") -> DataFrame:
    return _each_text(marked, text, new, "string", lambda x: hashlib.sha256(x.encode("utf-8", "replace")).hexdigest())
