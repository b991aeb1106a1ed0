import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from casetally.llm import mixing as M


def brute_targets(sizes, ratio, weights, max_epochs):
    """Water filling round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, ratio * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > max_epochs * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = max_epochs * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def brute_key(i, weight):
    u = (int(hashlib.md5(f"1:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / weight


@pytest.mark.parametrize("buckets", [1, 8, 4096])
def test_matches_brute_force(spark, hard_docs, hard_rows, buckets, monkeypatch):
    monkeypatch.setattr(M, "BUCKETS", buckets)
    quality = spark.createDataFrame([(i, 2.0 if i % 3 else 0.5) for i in range(12)] + [(1, 3.0), (2, None), (None, 9.0), (4, -1.0)], "i long, q double")
    weight = {i: 2.0 if i % 3 else 0.5 for i in range(12)} | {1: 3.0}
    rows = M.plan(hard_docs, quality).collect()
    size = lambda t: len((t or "").encode().split())
    sizes, docs = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for i, t, _, s, _ in hard_rows:
        sizes[s] += size(t)
        docs[s][i, t] += 1
    target = brute_targets(sizes, 1.5, M.SOURCE_WEIGHTS, 2.0)
    assert len(rows) == len(hard_rows)
    taken = defaultdict(int)
    for r in rows:
        s = None if r.none else r.s
        assert (r.source_size, pytest.approx(r.target)) == (sizes[s], target[s])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[s] += r.taken
    copies = {(None if r.none else r.s, r.id, r.d, r.k): r.copies for r in rows}
    by_key = {}
    for r in rows:
        by_key.setdefault((None if r.none else r.s, r.id, r.size), set()).add(copies[None if r.none else r.s, r.id, r.d, r.k])
    for s, own in docs.items():
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, upto = target[s] - epochs * sizes[s], 0
        for (i, t), n in sorted(own.items(), key=lambda x: brute_key(x[0][0], weight.get(x[0][0], 1.0))):
            upto += n * size(t)
            extra = int(upto - size(t) / 2 <= rest) if sizes[s] else 0
            if sum(j == i for j, _ in own) == 1 and size(t):  # equal keys are ordered by text hash
                assert by_key[s, i, size(t)] == {epochs + extra}
        assert abs(taken[s] - target[s]) <= max([size(t) * n for (_, t), n in own.items()], default=0)


def test_mix_keeps_columns_and_rerun_agrees(spark, hard_docs, no_docs):
    mixed = M.mix(hard_docs)
    assert mixed.columns == [c for c in hard_docs.columns if c not in M.RESULTS] + M.RESULTS
    again = M.mix(hard_docs.repartition(5))
    key = lambda df: sorted(map(str, df.select("doc_id", "text", "source", "copies", "taken").collect()))
    assert key(mixed) == key(again) and key(mixed)
    assert M.mix(no_docs).count() == 0 and M.plan(no_docs).count() == 0
    blank = hard_docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r.target, r.taken) for r in M.plan(blank).collect()} == {(0.0, 0)}
