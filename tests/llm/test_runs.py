"""Periodic runs against brute force over all starts and periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from casetally.llm import runs as R


def brute(words):
    n, out = len(words), []
    for s in range(n):
        for q in range(1, n // 2 + 1):
            if s + q < n and words[s] == words[s + q] and not (s and words[s - 1] == words[s - 1 + q]):
                e = s
                while e + q < n and words[e] == words[e + q]:
                    e += 1
                size = e - s + q
                if size >= max(12, 2 * q) and not any(words[s:s + size - d] == words[s + d:s + size] for d in range(1, q)):
                    out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, found):
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return [w for i, w in enumerate(words) if i not in gone]


def _random_words(rng):
    k = rng.choice([1, 2, 2, 3, 4, 9])
    words = [f"w{rng.randint(1, k)}" for _ in range(rng.randint(0, 45))]
    if words and rng.random() < 0.6:
        a = rng.randrange(len(words))
        words = words[:a] + words[a:a + rng.randint(1, 9)] * rng.randint(1, 6) + [f"w{rng.randint(1, k)}" for _ in range(rng.randint(0, 14))]
    return words


def test_runs_equal_brute_force():
    rng, total = random.Random(11), 0
    for _ in range(1500):
        words = _random_words(rng)
        n, found, text = R.document_runs("\n".join(words))
        want = brute(words)
        total += len(want)
        assert [tuple(r) for r in found.tolist()] == want and n == len(words)
        assert text == " ".join(kept(words, want))
    assert total > 500


def test_extension_is_the_longest_common_prefix():
    rng = random.Random(2)
    for _ in range(60):
        s = [rng.randint(1, 3) for _ in range(rng.randint(2, 40))]
        tree = R.SuffixTree(s)
        a, b = zip(*[(i, j) for i in range(len(s)) for j in range(len(s) + 1) if i != j], strict=True)
        want = []
        for i, j in zip(a, b, strict=True):
            k = 0
            while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            want.append(k)
        assert tree.extension(np.array(a), np.array(b)).tolist() == want
        assert np.argsort(tree.rank).tolist() == sorted(range(len(s) + 1), key=lambda i: [*s[i:], 0])


def test_a_long_text_of_one_word_and_of_a_long_period():
    assert R.find_runs(np.ones(60_000, np.int64)).tolist() == [[0, 60_000, 1]]
    words = np.random.default_rng(0).integers(1, 5000, 30_000)
    words[10_000:] = np.resize(words[10_000:19_000], 20_000)
    assert R.find_runs(words).tolist() == [[10_000, 20_000, 9_000]]
    with pytest.raises(ValueError):
        R.find_runs(words, 11)


def test_hard_documents(spark, hard_docs, hard_rows, no_docs):
    extra = spark.createDataFrame([(1, "a b c " * 9, 5)], "doc_id long, text string, runs int")
    assert R.periodic_runs(extra).collect()[0].runs[0].asDict() == {"start": 0, "length": 27, "period": 3}
    found = R.periodic_runs(hard_docs)
    assert set(found.columns) == set(hard_docs.columns) | {"n_words", "runs", "collapsed"}
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect())
    want = []
    for i, t, *_ in hard_rows:
        words = [w.decode() for w in (t or "").encode().split()]
        r = [] if len(words) > 5000 else brute(words)
        want.append((str(i), len(words), r, " ".join(kept(words, r))))
    assert got == sorted(want)
    assert R.periodic_runs(no_docs).count() == 0


def test_query_edit(spark, hard_docs, hard_rows, tmp_path):
    from casetally.llm.queries import op12_periodic_runs
    short = [r for r in hard_rows if len(r[1] or "") < 5000]
    spark.createDataFrame([(r[0], r[1]) for r in short], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t, *_ in short:
        words = [w.decode() for w in (t or "").encode().split()]
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j if j < a else a + (j - a) % p] for j in range(n)]
        r = brute(words)
        top = min(r, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((str(i), len(r), *map(str, top), str(1000 * top[1] // top[2]) if r else "None", sha("".join(f"{s},{size},{q}\n" for s, size, q in r)),
                     sha(" ".join(kept(words, r)))))
    got = [(str(r.doc_id), r.n_runs, *map(str, (r.start, r.length, r.period, r.exponent_milli)), r.runs_sha256, r.collapsed_sha256)
           for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and any(x[1] for x in want)
