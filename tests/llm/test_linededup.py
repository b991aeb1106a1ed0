import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casetally.llm import linededup as D
from casetally.llm.common import sliced

BIG = 2**63 - 1


def brute(rows, min_docs, keep_first, min_chars=1):
    """{(id, text): lines kept} by a plain loop; equal rows are one document."""
    docs = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    owners, first = defaultdict(set), {}
    for doc in docs:
        for pos, key in enumerate(D.line_keys(doc[1])):
            if len(key.decode()) >= min_chars:
                owners[key].add(doc)
                first.setdefault(key, (doc, pos))
    out = {}
    for doc in docs:
        lines = (doc[1] or "").split("\n")
        out[doc] = [pos for pos, key in enumerate(D.line_keys(doc[1]))
                    if not (key in owners and len(owners[key]) >= min_docs and not (keep_first and first[key] == (doc, pos)))]
        assert len(lines) >= len(out[doc])
    return out


@pytest.mark.parametrize("min_docs,keep_first", [(10, False), (2, False), (10, True)])
def test_matches_brute_force(hard_docs, hard_rows, min_docs, keep_first):
    marked = D.with_kept_sha256(D.with_kept_text(D.keep_bitmaps(hard_docs, min_docs, keep_first)))
    rows = marked.collect()
    want = brute([r[:2] for r in hard_rows], min_docs, keep_first)
    assert len(rows) == len(hard_rows)
    for r in rows:
        kept = np.flatnonzero(D.unpack(r.keep_bitmap, r.n_lines)).tolist()
        assert kept == want[r.doc_id, r.text]
        lines = (r.text or "").split("\n")
        assert (r.n_lines, r.n_dropped) == (len(lines), len(lines) - len(kept))
        assert r.kept_text == "\n".join(lines[j] for j in kept)
        assert r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest()


def test_dedup_in_one_step(hard_docs, no_docs):
    """The same rows as bitmaps first and texts after."""
    want = D.with_kept_text(D.keep_bitmaps(hard_docs, 2, True), new="kept")
    found = D.dedup(hard_docs, new="kept", min_docs=2, keep_first=True)
    assert found.columns == want.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    texts = D.dedup(hard_docs, min_docs=2, keep_first=True).collect()
    assert sorted(r.text for r in texts) == sorted(r.kept for r in want.collect())
    assert D.dedup(no_docs).count() == 0


def test_slices_are_bounded_and_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * n for n in (0, 5, 900, 3, 3, 0, 2000, 1, 40)])], names=["i", "t"])
    pieces = list(sliced([batch.slice(0, 4), batch.slice(4), batch.slice(0, 0)], 1, 100))
    assert [i for p in pieces for i in p.column(0).to_pylist()] == list(range(9))
    assert all(p.num_rows == 1 or p.column(1).nbytes <= 100 for p in pieces)


def test_empty_table(no_docs):
    assert D.keep_bitmaps(no_docs).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6), st.integers(0, 2)), max_size=60, unique=True),
       st.lists(st.integers(0, 60), max_size=6), st.lists(st.integers(0, 60), max_size=6), st.integers(1, 4), st.booleans())
def test_streaming_over_any_cuts(rows, parts, batches, min_docs, keep_first):
    """However the sorted rows fall into partitions (a document's rows of a hash stay together) and batches."""
    rows = sorted(rows)
    cuts = sorted({c for c in parts if 0 < c < len(rows) and rows[c][:2] != rows[c - 1][:2]})
    out = []
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        inner = sorted({c for c in batches if lo < c < hi})
        def feed():
            for a, b in zip([lo, *inner], [*inner, hi]):
                part = np.array(rows[a:b], np.int64).reshape(-1, 3)
                cols = [part[:, 0], part[:, 0], part[:, 1], np.zeros(len(part), np.int64), part[:, 2].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["h1", "h2", "d", "k", "pos"])
        for b in D._stream(min_docs, keep_first)(feed()):
            out += [tuple(r.values()) for r in b.to_pylist()]
    docs = defaultdict(set)
    for h, d, _ in rows:
        docs[h].add(d)
    head = {h: min(r for r in rows if r[0] == h) for h in docs}
    want = {r for r in rows if len(docs[r[0]]) >= min_docs and not (keep_first and r == head[r[0]])}
    whole, heads = defaultdict(int), {}
    for h, _, d, _, pos, state, n in out:
        if state == D.COUNT:
            whole[h] += n
            heads[h] = min(heads.get(h, (d, pos)), (d, pos))
    got = [(h, d, pos) for h, _, d, _, pos, state, _ in out
           if state == D.DROP or state == D.OPEN and whole[h] >= min_docs and not (keep_first and (d, pos) == heads[h])]
    assert len(got) == len(set(got)) and set(got) == want
