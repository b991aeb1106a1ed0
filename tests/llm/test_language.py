from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from casetally.llm import language as L
from casetally.llm.common import held_out, table


def brute_counts(text):
    """n-grams by a plain loop over words."""
    n = Counter()
    word = []
    for c in text.lower() + " ":
        if c.isalpha():
            word.append(c)
            continue
        if word:
            padded = ["", *word, ""]
            n.update((x,) for x in word)
            n.update(zip(padded, padded[1:]))
            n.update(zip(padded, padded[1:], padded[2:]))
        word = []
    return n


def code(gram):
    v = [ord(c) if c else 0 for c in gram]
    if len(v) == 1:
        return v[0]
    return (1 << 54 | v[0] << 18 | v[1]) if len(v) == 2 else (2 << 54 | v[0] << 36 | v[1] << 18 | v[2])


def test_gram_counts_and_distance_match_brute_force(hard_rows):
    texts = [r[1] for r in hard_rows if r[1]]
    for t in texts:
        codes, counts = L.gram_counts(t)
        want = Counter()
        for g, n in brute_counts(t).items():
            want[code(g)] += n
        assert dict(zip(codes.tolist(), counts.tolist())) == dict(want)
    profiles = {"a": L.top_grams(*L.gram_counts(texts[0]), 50), "b": L.top_grams(*L.gram_counts(texts[1]), 50)}
    ranker = L.Ranker(profiles, 50)
    for t in texts:
        top = [c for c, _ in sorted(((code(g), n) for g, n in brute_counts(t).items()), key=lambda x: (-x[1], x[0]))][:50]
        if not top:
            assert ranker(t) == ("und", 0.0)
            continue
        far = {n: sum(abs(p.tolist().index(c) - i) if c in p else 50 for i, c in enumerate(top)) for n, p in profiles.items()}
        best = min(far, key=lambda n: (far[n], n))
        assert ranker(t) == (best, 1 - far[best] / (50 * len(top)))


def test_long_texts_are_counted_whole(monkeypatch, hard_rows):
    text = max((r[1] or "" for r in hard_rows), key=len)
    whole = L.gram_counts(text)
    monkeypatch.setattr(L, "PIECE", 1000)
    parts = L.gram_counts(text)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_defined_cases(spark, hard_docs, hard_rows, no_docs):
    profiles = L.fit_profiles(hard_docs)
    found = L.identify(hard_docs, profiles)
    assert found.columns[-2:] == ["lang_pred", "score"] and found.columns.count("score") == 1
    rows = found.collect()
    assert len(rows) == len(hard_rows)
    for r in rows:
        empty = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == empty and 0 <= r.score <= 1 and (not empty or r.score == 0)
    assert L.fit_profiles(no_docs) == {}
    assert L.identify(no_docs, profiles).count() == 0
    assert {r.lang_pred for r in L.identify(hard_docs, {}).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = held_out(F.col("doc_id"))
    found = L.identify(docs, L.fit_profiles(docs.filter(~out))).filter(out)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
