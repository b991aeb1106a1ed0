import re

from casetally.llm import decontaminate as D

SCHEMA = "item_id long, text string, d int, i string, h string"


def tokens(text):
    return [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]


def brute(docs, items, threshold):
    out = {}
    for i, t in {x[:2] for x in items}:
        w = tokens(t)
        size = min(5, len(w))
        want = {tuple(w[j:j + size]) for j in range(len(w) - size + 1)} if size else set()
        for d, x in {r[:2] for r in docs}:
            v = tokens(x)
            shared = want & {tuple(v[j:j + size]) for j in range(len(v) - size + 1)} if want else set()
            if want and len(shared) / len(want) >= threshold:
                out[d, x, i] = (len(want), len(shared), len(shared) / len(want))
    return out


def items_of(rows):
    body = [r[1] for r in rows if r[1] and len(r[1].split()) > 60]
    cut = [" ".join(t.split()[10:40]) for t in body[:6]]
    part = [" ".join(body[6].split()[:24]) + " words that no document has in it", " ".join(body[7].split()[:40]) + " x",
            " ".join(body[8].split()[:30]) + " and then a tail of quite other words that is too long to count"]
    return [(i, t, 1, "i", "h") for i, t in enumerate([*cut, *part, cut[0].upper() + "!!!", "a", "common line", None, "", "?!", cut[1]])] + [
        (None, cut[2], 1, "i", "h"), (0, cut[0], 1, "i", "h")]


def test_matches_brute_force(spark, hard_docs, hard_rows):
    items = items_of(hard_rows)
    table = spark.createDataFrame(items, SCHEMA)
    for threshold in (0.8, 0.5):
        found = D.leaks(hard_docs, table, threshold=threshold).collect()
        want = brute(hard_rows, items, threshold)
        texts = {}
        for i, t, *_ in hard_rows:
            texts.setdefault(i, set()).add(t)
        got = sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared, round(r.containment, 9)) for r in found), key=str)
        assert got == sorted(((d, i, n, m, round(c, 9)) for (d, _, i), (n, m, c) in want.items()), key=str)
    clean = D.clean(hard_docs, table)
    assert clean.columns == hard_docs.columns
    bad = {(d, t) for d, t, _ in brute(hard_rows, items, 0.8)}
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted((r[:2] for r in hard_rows if r[:2] not in bad), key=str)


def test_empty_tables(spark, hard_docs, no_docs, hard_rows):
    some = spark.createDataFrame(items_of(hard_rows), SCHEMA)
    none = spark.createDataFrame([(1, None, 1, "i", "h")], SCHEMA)
    assert D.leaks(no_docs, some).count() == 0
    assert D.leaks(hard_docs, none).count() == 0
    assert D.leaks(hard_docs, some.limit(0)).columns == D.leaks(hard_docs, some).columns
    assert D.clean(hard_docs, none).count() == len(hard_rows)
