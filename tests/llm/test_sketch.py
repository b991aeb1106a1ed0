import hashlib

import pytest
from pyspark.sql import functions as F

from casetally.llm import sketch as K


def pieces(text):
    return {p for line in (text or "").split("\n") for p in [line[i:i + K.PIECE] for i in range(0, len(line), K.PIECE)]}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_matches_brute_force(hard_docs, hard_rows):
    rows = K.fingerprints(hard_docs).collect()
    docs = sorted({r[:2] for r in hard_rows}, key=lambda r: (r[0] is None, r[0] or 0))
    ids = [r[0] for r in docs]
    assert len(rows) == len(hard_rows)
    assert len({r.fingerprint for r in rows}) == len({frozenset(pieces(t)) for _, t in docs})
    for r in rows:
        if ids.count(r.doc_id) > 1 or ids.count(ids[(ids.index(r.doc_id) + 1) % len(ids)]) > 1:
            continue  # equal ids are ordered by text hash
        at = ids.index(r.doc_id)
        text, after = docs[at][1] or "", docs[(at + 1) % len(docs)][1] or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(pieces(text), pieces(edited)))
        assert r.near_next == pytest.approx(jaccard(pieces(text), pieces(after)))


def test_one_document_and_no_document(spark, no_docs):
    one = spark.createDataFrame([(4, "some\ntext " * 9)], "doc_id long, text string")
    assert [(r.n_chars, r.near_next) for r in K.fingerprints(one).collect()] == [(90, 1.0)]
    assert K.fingerprints(no_docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4, 10, 40, 400, 5000])
def test_peeling_recovers_the_difference(spark, n):
    """Both sides, whatever their size; larger sketches until all is recovered."""
    sets = spark.range(1).select(F.lit(1).alias("id"), F.transform(F.sequence(F.lit(1), F.lit(n + 700)), lambda i: F.xxhash64(i)).alias("a"),
                                 F.transform(F.sequence(F.lit(n + 1), F.lit(2 * n + 700)), lambda i: F.xxhash64(i)).alias("b"))
    if n == 0:
        assert sets.select(K.is_empty(K.subtract(K.sketch(F.col("a")), K.sketch(F.col("b"))))).first()[0]
    found = K.differences(sets, ["id"]).select(F.explode("found").alias("f")).select("f.n", "f.x")
    a, b = (set(sets.select(F.explode(c)).toPandas().iloc[:, 0].tolist()) for c in "ab")
    got = [(r.n, r.x) for r in found.collect()]
    assert sorted(got) == sorted([(1, x) for x in a - b] + [(-1, x) for x in b - a])


def test_short_texts_keep_likeness(spark):
    """One line of 48 to 200 code points is like a version that keeps its first three quarters."""
    text = lambda i, n: "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(n))
    docs = spark.createDataFrame([(i, text(i, n)) for i, n in enumerate((48, 60, 90, 128, 170, 200))], "doc_id long, text string")
    assert all(r.near_edited > 0 for r in K.fingerprints(docs).collect())


def test_only_keys_are_stored(spark, monkeypatch, hard_docs, hard_rows):
    """No text, digest or cell is written to disk to be read back: what does not peel is recovered in its row."""
    kept = []
    monkeypatch.setattr(K, "store", lambda df, stored=K.store: kept.extend(df.dtypes) or stored(df))
    assert K.fingerprints(hard_docs).count() == len(hard_rows)
    assert {kind for _, kind in kept} <= {"bigint", "int"}


def test_recovery_in_the_row(spark):
    """Empty sides, equal sides, neighbours that differ in one bit, extreme digests and many digests; each side is told apart."""
    big = [(i * 0x9E3779B97F4A7C15 + 7) % 2**64 - 2**63 for i in range(3000)]
    ends = [-2**63, 2**63 - 1, 0, -1, 1, 2, 3, 1 << 62]
    pairs = [([], []), ([5], []), ([], [5]), (ends, ends[::-1]), (ends, []), (ends[:4], ends[4:]), (big, big[:-1]), (big[:1500], big[1500:]), (big[:2000], big[1000:]),
             ([1 << i for i in range(63)], [3 << i for i in range(61)]), (big, ends)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a array<bigint>, b array<bigint>")
    got = {r.id: sorted((f.n, f.x) for f in r.found) for r in rows.select("id", K.recovered(F.col("a"), F.col("b")).alias("found")).collect()}
    assert got == {i: sorted([(1, x) for x in set(a) - set(b)] + [(-1, x) for x in set(b) - set(a)]) for i, (a, b) in enumerate(pairs)}
