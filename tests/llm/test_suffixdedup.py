import hashlib
import random

import numpy as np
import pytest

from casetally.llm import suffixdedup as S


def brute(rows):
    """{(id, text): (removed spans, sha)}; windows of documents with a smaller id (null: the largest)."""
    order = lambda r: (r[0] is None, r[0] or 0)
    docs = sorted({r[:2] for r in rows}, key=order)
    out, seen, waiting, now = {}, set(), [], None
    for i, t in docs:
        if now is not None and order((i, t)) != now:
            for w in waiting:
                seen |= w
            waiting = []
        now = order((i, t))
        b = (t or "").encode()
        mask, own = np.zeros(len(b), bool), set()
        for p in range(len(b) - 49):
            own.add(b[p:p + 50])
            if b[p:p + 50] in seen:
                mask[p:p + 50] = True
        waiting.append(own)
        turn = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(int)))
        out[i, t] = (list(zip(turn[::2].tolist(), turn[1::2].tolist())), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest())
    return out


def check(df, rows):
    want = brute(rows)
    found = S.repeated_spans(df).collect()
    got = sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.removed], r.kept_sha256) for r in found), key=str)
    assert got == sorted(((i, len((t or "").encode()), *want[i, t]) for i, t, *_ in rows), key=str)
    assert sum(len(r.removed) for r in found)


@pytest.fixture
def tiny(monkeypatch):
    """Many blocks, buckets, pieces and sorted parts."""
    for name, size in (("BLOCK", 3000), ("BUCKET", 5000), ("SORTED", 40)):
        monkeypatch.setattr(S, name, size)


def test_hard_documents(hard_docs, hard_rows, no_docs):
    check(hard_docs, hard_rows)
    assert S.repeated_spans(no_docs).count() == 0


def test_small_blocks(hard_docs, hard_rows, tiny):
    check(hard_docs, hard_rows)


def test_spliced_passages(spark, tiny):
    """Passages of 40 to 120 bytes copied between documents, low-entropy text, zero bytes."""
    rng = random.Random(1)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randint(40, 120))) for _ in range(12)] + ["z" * 70, "\x00" * 60, "é" * 30, "ab" * 40]
    rows = [(i, "".join(rng.choice([rng.choice(pool), "".join(rng.choice("abcdefgh \x00") for _ in range(rng.randint(1, 90)))]) for _ in range(rng.randint(0, 9))))
            for i in range(60)]
    rows += [(7, rows[9][1]), (None, rows[3][1]), rows[20], (200, "x" * 49), (201, "x" * 49), (202, "y" * 50), (203, "y" * 50), (204, "y" * 51)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_every_window_has_an_anchor_that_depends_on_it_alone(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 256)
    rng = np.random.default_rng(0)
    x = rng.integers(97, 100, 3000).astype(np.uint8)
    x[1000:1300] = x[100:400]
    S._powers.cache_clear()
    at, h = S.anchors(x, np.array([700, 730, 2000, 3000]))
    S._powers.cache_clear()
    monkeypatch.undo()
    whole, h2 = S.anchors(x, np.array([700, 730, 2000, 3000]))
    assert np.array_equal(at, whole) and np.array_equal(h, h2)
    for lo, hi in ((0, 700), (730, 2000), (2000, 3000)):
        for p in range(lo, hi - 49):
            assert ((at >= p) & (at <= p + S.LENGTH - S.GRAM)).any()
    assert [p for p in at.tolist() if 700 <= p < 730] == []
    inner = lambda lo: {p - lo for p in at.tolist() if lo + 50 <= p <= lo + 220}
    assert inner(100) == inner(1000)


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(2)
    rows = rng.integers(1, 4, (500, 12)).astype(np.uint16)
    rows[100:200] = rows[200:300]
    group = np.sort(rng.integers(0, 9, 500)).astype(np.uint64)
    order = S.suffix_sort(rows, S._horner(rows), group)
    keys = [(int(group[i]), rows[i].tolist()) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(500))


def test_hash_collisions_are_caught(hard_docs, hard_rows, monkeypatch):
    """With a hash that says little, groups are told apart by their bytes."""
    monkeypatch.setattr(S, "_mixed", lambda h: h & np.uint64(7))
    rng = np.random.default_rng(3)
    left, right, first, last = S.LEFT, S.RIGHT, 0, S.LEFT
    rows = np.zeros((200, left + right + 2), np.uint8)
    rows[:, :left + right] = rng.integers(97, 99, (200, left + right))
    rows[:, left + 5:left + right] = 97
    rows[:, -2], rows[:, -1] = left, right
    ids = rng.integers(0, 50, 200)
    got = S._first_owners(rows, np.zeros(200, np.uint64), ids)
    for o in range(first, last + 1):
        window = [rows[i, left - o:left - o + 50].tobytes() for i in range(200)]
        assert got[:, o - first].tolist() == [min(ids[j] for j in range(200) if window[j] == window[i]) for i in range(200)]
