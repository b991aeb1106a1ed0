"""The pipeline, stage by stage, each judged on its own input by brute force."""

import re
from collections import defaultdict

import corpus_pipeline as P
from test_decontaminate import brute as leaks
from test_linededup import brute as kept_lines
from pyspark.sql import functions as F
from test_simhash import brute_components, brute_fingerprint

from casetally.llm import language as L
from casetally.llm.common import held_out, store, table
from casetally.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in REGISTRY) == list(range(1, 14))
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]


def check(spark, docs):
    stages = dict(P.STAGES)
    rows = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    known = store(stages["language_id"](spark, docs, SF))
    before, now = rows(docs), rows(known)
    scored = L.identify(docs, L.fit_profiles(docs.filter(~held_out(F.col("doc_id"))))).collect()
    far = {(r.doc_id, r.text) for r in scored if r.score < P.MIN_LANGUAGE_SCORE}
    assert sorted(map(str, now)) == sorted(str(r) for r in before if r[:2] not in far)
    assert all(len({c for c in t or "" if c.isalpha()}) < 3 for _, t in far)  # nothing that reads like words goes

    lines = store(stages["line_dedup"](spark, known, SF))
    want = kept_lines([r[:2] for r in now], 10, True)
    assert sorted(((i, "\n".join(t.split("\n")[j] for j in want[i, t])) for i, t, _ in now), key=str) == sorted((r[:2] for r in rows(lines)), key=str)
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    one = store(stages["simhash_near_dedup"](spark, lines, SF))
    now = rows(lines)
    root = brute_components([brute_fingerprint(t) for _, t, _ in now], 2)
    groups = defaultdict(list)
    for (i, t, _), g in zip(now, root):
        groups[g].append((i is None, i or 0))
    assert sorted((r[0] is None, r[0] or 0) for r in rows(one)) == sorted(min(g) for g in groups.values())

    clean = store(stages["benchmark_decontamination"](spark, one, SF))
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {(d, t) for d, t, _ in leaks(rows(one), items, 0.8)}
    assert sorted(map(str, rows(clean))) == sorted(str(r) for r in rows(one) if r[:2] not in bad)
    for df in (known, lines, one, clean):
        assert df.columns == COLUMNS

    mixed = stages["mixing"](spark, clean, SF).collect()
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in mixed:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.size == len(r.text.split()) and 0 < r.taken <= 2 * r.size
    for r in clean.collect():
        longest[r.source] = max(longest[r.source], len((r.text or "").split()))
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)


def test_documents(spark):
    check(spark, table(spark, SF, "documents"))


def test_hard_documents(spark, hard_docs):
    check(spark, hard_docs.select(*COLUMNS))


def test_empty_table(spark, no_docs):
    docs = no_docs.select(*COLUMNS)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
