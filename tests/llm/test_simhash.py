import numpy as np
import pytest
import xxhash

from casetally.llm import graph
from casetally.llm import simhash as S


def brute_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_components(values, radius):
    """Index of the first member of each value's component."""
    v = np.array(values, np.int64).view(np.uint64)
    root = list(range(len(v)))
    changed = True
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= radius
    while changed:
        new = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(v))]
        changed, root = new != root, new
    return root


def test_whole_operator_matches_brute_force(hard_docs, hard_rows):
    rows = S.near_duplicates(hard_docs).collect()
    assert len(rows) == len(hard_rows)
    ids = [r[0] for r in hard_rows]
    values = [brute_fingerprint(r[1]) for r in hard_rows]
    root = brute_components(values, 2)
    least = {g: min((i for i, r in zip(ids, root) if r == g and i is not None), default=None) for g in set(root)}
    want = sorted(((i, v, least[g]) for i, v, g in zip(ids, values, root)), key=str)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in rows), key=str) == want
    kept = S.keep_one(hard_docs)
    assert kept.columns == hard_docs.columns
    assert kept.count() == len(set(root))


def test_empty_table(no_docs):
    assert S.near_duplicates(no_docs).count() == 0 and S.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_tiles_lose_no_link(spark, radius, monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 50)
    rng = np.random.default_rng(radius)
    base = rng.integers(-2**63, 2**63 - 1, 60)
    near = [b ^ (1 << int(x)) ^ (1 << int(y)) for b in base[:40].tolist() for x, y in rng.integers(0, 63, (6, 2))]
    values = sorted({*base.tolist(), *near, 0, -1, 1, 3})
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    star = {r.node: r.root for r in graph.components(S.links(nodes, radius)).collect()}
    root = brute_components(values, radius)
    assert [star.get(v, v) for v in values] == [values[g] for g in root]


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, j) for j in range(200, 260)] + [(5, 5), (300, 299), (299, 300)]
    star = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert star == {**{i: 100 for i in range(101, 161)}, **{j: 1 for j in range(200, 260)}, 300: 299}


def test_fingerprint_in_pieces(monkeypatch, hard_rows):
    text = max((r[1] or "" for r in hard_rows), key=len)
    monkeypatch.setattr(S, "CHUNK", 100)
    assert S.fingerprint(text) == brute_fingerprint(text)
