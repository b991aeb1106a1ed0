"""Spelling variants against brute force over all pairs."""

import random

import numpy as np
import pytest

from casetally.llm import variants as V


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_group(counts, ratio):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if x != w and brute_near(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= ratio * n else None, n, len(near))
    for w, (form, n, k) in list(out.items()):
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (form, root, n, k, counts[form] if form else None)
    return out


def _grouped(spark, counts, ratio=5):
    found = V.group(spark.createDataFrame(list(counts.items()), "word string, n long"), ratio).collect()
    assert len(found) == len(counts)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}


def _random_counts(rng, n):
    stems = ["".join(rng.choice("abcdeéß\U00010348") for _ in range(rng.randint(1, 9))) for _ in range(n // 6)]
    out = {}
    for _ in range(n):
        w = list(rng.choice(stems))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w) + 1)
            w[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é", "z"])
        if w:
            out["".join(w)] = rng.choice([1, 2, 5, 7, 30, 36, 180, 900])
    return out


def test_groups_equal_brute_force(spark):
    counts = _random_counts(random.Random(3), 500)
    assert _grouped(spark, counts) == brute_group(counts, 5)


def test_small_tiles_and_chunks_lose_no_link(spark, monkeypatch):
    """One block with most words, cut into many tiles and chunks."""
    for name, value in (("TILE", 7), ("SPAN", 2), ("TILE_CHARS", 60)):
        monkeypatch.setattr(V, name, value)
    rng = random.Random(4)
    counts = {"".join(rng.sample("abcdefgh", 8)): rng.choice([1, 5, 25]) for _ in range(150)} | _random_counts(rng, 150)
    assert _grouped(spark, counts) == brute_group(counts, 5)


def test_long_chain_of_forms_and_ties(spark):
    counts = {"a" * i: 5 ** (11 - i) for i in range(1, 11)} | {"xxb": 50, "xxa": 50, "xx": 1}
    found = _grouped(spark, counts)
    assert found == brute_group(counts, 5)
    assert found["a" * 10][1] == "a" and found["xx"][0] == "xxa"


def test_count_words_and_odd_rows(spark):
    rows = [("abcdef",)] * 5 + [("abcde",)] * 9 + [(None,)] * 9 + [("",)] * 9 + [("zzzzzz",)] * 4
    words = spark.createDataFrame([(*r, 1) for r in rows], "word string, n int")
    assert [tuple(r) for r in V.count_words(words, 6, 5).collect()] == [("abcdef", 5)]
    assert V.group(V.count_words(words.limit(0))).count() == 0
    odd = spark.createDataFrame([(None, 3, "x"), ("", 4, "y"), ("q" * 30_000, 2, "z"), ("q" * 29_999, 20, "z")], "word string, n int, form string")
    found = {r.word: r for r in V.group(odd).collect()}
    assert set(found) == {"q" * 30_000, "q" * 29_999} and found["q" * 30_000].root == "q" * 29_999
    with pytest.raises(ValueError):
        V.group(odd, ratio=1)


def test_gram_filter_keeps_every_near_pair():
    rng = random.Random(9)
    for _ in range(300):
        a = "".join(rng.choice("abÿßä") for _ in range(rng.randint(1, 8)))
        i = rng.randrange(len(a) + 1)
        b = a[:i] + rng.choice("abcÿœ") + a[i + rng.randint(0, 1):]
        if a == b:
            continue
        a, b = sorted((a, b), key=len)
        pairs = [(i.tolist(), j.tolist()) for i, j in V.Words([a]).near(V.Words([b]))]
        assert (pairs == [([0], [0])]) == brute_near(a, b)
    assert (V.letter_counts(V._codes(["abca"])).sum(axis=1) == np.array([4])).all()


def test_stepping_blocks_reach_every_neighbour():
    steps = {s for s in V._steps()}
    for x in range(V.GROUPS):
        for y in range(V.GROUPS):
            move = tuple((g == x) - (g == y) for g in range(V.GROUPS))
            assert move in steps or tuple(-m for m in move) in steps


def test_query_edit_on_hard_documents(spark, hard_docs, hard_rows, tmp_path):
    import re
    import zlib

    from casetally.llm.queries import op13_spelling_variants
    hard_docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    counts = {}
    for i, t, *_ in hard_rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 5}
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in op13_spelling_variants(spark, str(tmp_path)).collect()}
    assert found == brute_group(counts, 5) and counts
