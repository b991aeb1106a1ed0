import hashlib
import random
import re
from collections import defaultdict

from casetally.llm import secretscan as X
from casetally.llm.queries import op5_secret_scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    """The contract's patterns, read literally."""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def values(text):
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return sorted(out)


def brute(rows):
    """A text belongs to the owner of its copy with the smallest id; a value counts texts and their owners."""
    origin = {}
    for i, t, s in rows:
        at = (i is None, i or 0)
        if t not in origin or at < origin[t][0]:
            origin[t] = (at, s)
    texts = defaultdict(set)
    for t in origin:
        for v in values(t or ""):
            texts[v[3]].add(t)
    live = {v: len({(origin[t][1],) for t in found}) <= 1 and len(found) <= X.MAX_REPOSITORIES for v, found in texts.items()}
    out = []
    for i, t, _ in rows:
        all_, base = values(t or ""), base_spans(t or "")
        shown = [(a, k, ["assign", "access", "hex", "live"][k], e, v) for a, k, e, v in all_
                 if k < 3 or live[v] and not any(b[0] < e and a < b[3] for b in base)]
        out.append((i, ",".join(f"{n}:{a}:{e}" for a, _, n, e, _ in sorted(shown)), sum(live[x[4]] for x in shown)))
    return sorted(out, key=str)


def rows_with_secrets():
    rng = random.Random(9)
    token = lambda n, a="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(rng.choice(a) for _ in range(n))
    shared = [token(24) + "7z", token(40, "0123456789abcdef"), "AKIA" + token(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")]
    shapes = [lambda: f"password = {token(14)}", lambda: f"Secret: secret: {token(13)}", lambda: f"API_KEY='{token(9)}'", lambda: f'"token" : "{token(30)}"',
              lambda: "AKIA" + token(13, "ABC123"), lambda: "AKIAAKIA" + token(14, "ABC123"), lambda: token(15, "0123456789abcdef") + "g",
              lambda: token(64, "0123456789abcdef"), lambda: token(22) + "1a", lambda: "é" * 5 + "\U0001f600", lambda: "passwd=token=abcdefghijklmnop",
              lambda: "ghp_" + token(36), lambda: "plain words here", lambda: rng.choice(shared), lambda: "apikey  =  \"" + shared[0] + "\"",
              lambda: "TOKEN:\n" + token(20), lambda: "ſecret=" + token(20)]
    body = [(i, " ".join(rng.choice(shapes)() + rng.choice([" ", "\n", ", ", ""]) for _ in range(rng.randint(0, 12))), f"s{i % 4}") for i in range(60)]
    long = (90, ("x " + token(20) + " ") * 3000, "s1")
    return body + [(70, None, "s1"), (71, "", None), (None, "token=" + token(15), None), (72, "token=" + shared[0], None), long, body[3], body[3], (3, body[3][1], "s9")]


def test_matches_brute_force(spark, tmp_path):
    rows = rows_with_secrets()
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, d int, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op5_secret_scan(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.spans, r.n_live) for r in found), key=str) == brute(rows)
    base = sorted(((i, *[sum(s[1] == k for s in base_spans(t or "")) for k in range(3)],
                    hashlib.sha256(",".join(f"{n}:{a}:{e}" for a, _, n, e in base_spans(t or "")).encode()).hexdigest()) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found), key=str) == base
    assert sum(b[1] for b in base) and sum(b[2] for b in base) and sum(b[3] for b in base) and any("live" in r.spans for r in found)


def test_defined_cases(hard_docs, hard_rows, no_docs):
    assert X.scan(hard_docs).count() == len(hard_rows)
    assert X.scan(no_docs).count() == 0


def test_copies_make_no_example_and_many_texts_do(spark):
    key, wide, two = "Zq9xKf7wLm3pTs8vBn2cRd", "Ab1Ab2Ab3Ab4Ab5Ab6Ab7Ab8", "Qw1Er2Ty3Ui4Op5As6Df7Gh8"
    copies = [(i, f"copied with {key} inside", f"s{i % 3}") for i in range(40)]
    many = [(100 + i, f"text {i} holds {wide}", "s1") for i in range(X.MAX_REPOSITORIES + 1)]
    shared = [(200, f"one {two}", "s1"), (201, f"other {two}", "s2")]
    found = X.scan(spark.createDataFrame(copies + many + shared, "doc_id long, text string, source string")).collect()
    spans = {r.doc_id: r.spans for r in found}
    assert all(len(spans[i]) == 1 and (spans[i][0].repositories, spans[i][0].owners, spans[i][0].live) == (1, 1, True) for i, *_ in copies)
    assert not any(spans[i] for i, *_ in many + shared)
