from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from casetally.llm import toxicity as T
from casetally.llm.common import held_out, table


def brute_kernel(a, b):
    """Gap-weighted common subsequences of three symbols, normalised."""
    def features(w):
        out = {}
        for at in combinations(range(len(w)), 3):
            key = tuple(w[i] for i in at)
            out[key] = out.get(key, 0) + T.DECAY ** (at[-1] - at[0] + 1)
        return out
    x, y = features(a), features(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_kernel_matches_brute_force():
    some = ["idiot", "idxiot", "iidiott", "trash", "thrash", "abcabcabc", "worthless", "aaa", "zzzzzzzzzz"]
    values = T.kernel_with(T.feature_table(some), some)
    assert values == pytest.approx(np.array([[brute_kernel(a, b) for b in some] for a in some]))


def test_disguises():
    assert T.pieces("i.d-i_o!t") == ["idiot"] and T.pieces("1d10t") == ["idiot"]
    assert "idiot" in T.words("you I D I O T there") and "idiot" not in T.words("a b idi ot")
    assert [len(p) <= T.LONGEST for p in T.pieces("x" * 100)] and "".join(dict.fromkeys(T.pieces("abc"))) == "abc"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    out = held_out(F.col("doc_id"))
    return T.fit(docs.filter(~out), labels.filter(~out)), docs, labels


def test_held_out_accuracy(fitted):
    model, docs, labels = fitted
    scored = T.score(docs.select("doc_id", "text").filter(held_out(F.col("doc_id"))), model).join(labels, "doc_id")
    rows = scored.select("score", "predicted", "toxic").collect()
    y, p = np.array([r.toxic for r in rows]), np.array([r.predicted for r in rows])
    score = np.array([r.score for r in rows])
    wins = (score[y == 1][:, None] > score[y == 0][None, :]).mean() + 0.5 * (score[y == 1][:, None] == score[y == 0][None, :]).mean()
    assert (y == p).mean() > 0.95 and wins > 0.9 and p[y == 1].mean() > 0.75


def test_gapped_insults_score_high(spark, fitted):
    model = fitted[0]
    texts = ["the for and onerst", "the idiot and the moron of the trash", "the i.d.i.o.t and the m o r o n of the tr*ash", "the idiiot and the moroon of the traash"]
    rows = T.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.predicted for r in rows] == [0, 1, 1, 1]


def test_defined_cases(spark, fitted, hard_docs, hard_rows, no_docs):
    model = fitted[0]
    found = T.score(hard_docs, model)
    assert found.columns == [c for c in hard_docs.columns if c != "score"] + ["score", "predicted"]
    rows = found.collect()
    assert len(rows) == len(hard_rows) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert T.score(no_docs, model).count() == 0
    none = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    for labels in (none, none.limit(0)):
        flat = T.fit(hard_docs, labels)
        assert len({r.score for r in T.score(hard_docs, flat).collect()}) == 1
    assert T.score(hard_docs, T.fit(no_docs, none)).count() == len(hard_rows)


def test_bounds_of_the_sample_do_not_move_the_scores(spark, monkeypatch):
    """A tenth of the texts is toxic, by chance: every score is about a tenth, also where a bound cuts one kind only."""
    rows = [(i, f"{'abcdefghij'[i % 7]}lpha beta{'klmnopqrst'[i % 10]} gamma number{i}", int(i % 10 == 3)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    def mean_score():
        return T.score(docs, T.fit(docs, docs)).agg(F.avg("score")).first()[0]
    whole = mean_score()
    monkeypatch.setattr(T, "MAX_TOXIC", 150)
    monkeypatch.setattr(T, "MAX_CLEAN", 300)  # both bounds bite: half of the drawn texts would have counted as toxic ones
    assert whole == pytest.approx(0.1, abs=0.02) and mean_score() == pytest.approx(whole, abs=0.03)
