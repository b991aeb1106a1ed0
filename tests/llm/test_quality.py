"""Quality rules against brute force; junk goes, clean prose stays."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casetally.llm import quality as Q

BLANK = " \t\n\x0b\x0c\r"


def brute_base(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def classes(text):
    out = [0] * 7
    for c in text or "":
        kind = unicodedata.category(c)
        at = 1 if c in BLANK else 0 if kind == "Ll" else 2 if kind == "Lu" else 3 if kind[0] in "LM" else 4 if kind[0] == "N" else 5 if kind[0] == "P" else 6
        out[at] += 1
    return out


def letters(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def divergence(p, q):
    return sum(x * math.log2(x / ((a + b) / 2)) / 2 for a, b in zip(p, q, strict=True) for x in (a, b) if x > 0)


def brute_distances(text, r):
    c, w = classes(text), letters(text)
    char = divergence([x / sum(c) for x in c], r.classes) if sum(c) >= Q.MIN_CHARS_JUDGED else None
    n = Counter(x if x in r.words else None for x in w)
    word = divergence([n[x] / len(w) for x in (*r.words, None)], [*r.shares, max(0, 1 - sum(r.shares))]) if len(w) >= Q.MIN_WORDS_JUDGED else None
    return char, word


def _prose(rng, n):
    vocabulary = ["the", "of", "and", "in", "is"]
    words = [rng.choice(vocabulary) if rng.random() < 0.4 else "".join(rng.choice("abdefghiklmnorst") for _ in range(rng.randint(3, 9))) for _ in range(n)]
    return " ".join(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w for i, w in enumerate(words))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    good = [(i, _prose(rng, rng.randint(80, 400)), "en") for i in range(40)]
    junk = [(100, " ".join(w + "&&&" for w in _prose(rng, 200).split()), "en"), (101, _prose(rng, 200).upper().replace(" ", "!! "), "en"),
            (102, " | ".join("".join(rng.choice("qwxzjkvy") for _ in range(8)) for _ in range(200)), "en"), (103, "7 " * 9 + "1 2 3 4 5 6 7 " * 40, "en")]
    other = [(200, _prose(rng, 200), None), (201, junk[0][1], None), (202, "word " * 300, "xx"), (203, _prose(rng, 60), "xx")]
    return good + junk + other


def test_clean_stays_and_junk_goes(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    refs = Q.fit_references(docs)
    assert [r.lang for r in refs] == ["en"] and set(refs[0].words) >= {"the", "of", "and", "in", "is"}
    found = {r.doc_id: r for r in Q.judge(docs, refs).collect()}
    assert all(found[i].kept for i, *_ in corpus[:40]) and found[200].kept and found[203].kept
    assert not any(found[i].kept for i in (100, 101, 102, 103, 201, 202))
    assert found[202].reference is None and found[200].reference == "en"
    for i, t, lang in corpus:
        if lang != "xx":
            for got, want in zip((found[i].char_distance, found[i].word_distance), brute_distances(t, refs[0]), strict=True):
                assert (got is None) == (want is None) and (want is None or abs(got - math.sqrt(max(want, 0))) < 1e-5)


def test_references_equal_brute_force(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    ref = Q.fit_references(docs)[0]
    texts = [t for _, t, lang in corpus if lang == "en"]
    total = [sum(x) for x in zip(*map(classes, texts), strict=True)]
    assert ref.classes == pytest.approx([x / sum(total) for x in total])
    n = Counter(w for t in texts for w in letters(t))
    size = sum(n.values())
    assert dict(zip(ref.words, ref.shares, strict=True)) == pytest.approx({w: k / size for w, k in n.items() if k >= size / Q.COMMON})
    assert len(ref.words) <= Q.COMMON


def test_base_rules_on_hard_documents(spark, hard_docs, hard_rows, no_docs):
    repeat = " ".join(["x y z", "p q r s"] * 30)
    rows = [(r[0], r[1]) for r in hard_rows] + [(500, repeat), (501, "a b"), (502, "a a a a"), (503, "one two three one two three"), (504, "l\nl\n\n \nl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), *tuple(r[c] for c in Q.BASE)) for r in Q.with_base(docs).collect())
    assert got == sorted((str(i), *brute_base(t)) for i, t in rows)
    judged = Q.judge(hard_docs, Q.fit_references(hard_docs, min_words=50))
    assert set(judged.columns) == set(hard_docs.columns) | set(Q.RESULT) and judged.count() == len(hard_rows)
    assert judged.filter(F.col("kept").isNull()).count() == 0
    assert Q.fit_references(no_docs) == [] and Q.judge(no_docs, []).count() == 0
    alone = Q.judge(docs.withColumn("lang", F.lit(None).cast("string")), [])
    assert alone.filter(F.col("kept") == F.col("base_failed")).count() == 0


def test_common_words_are_bounded(spark):
    docs = spark.createDataFrame([(1, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)) * 5, "en")], "doc_id long, text string, lang string")
    refs = Q.fit_references(docs)
    assert refs[0].words == () or len(refs[0].words) <= Q.COMMON
    assert Q.judge(docs, refs).count() == 1


def test_texts_without_repeats_are_done_after_the_hashes(spark):
    """Distinct window hashes end the count before anything is sorted; the counts are those of brute force either way."""
    rng = random.Random(4)
    texts = [" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(300)) + " w0 w1 w2", "a b c", "a b", "", " ".join(rng.choice("abc") for _ in range(400)),
             "x y z x y z", "ab c d a bc d", " ".join(rng.choice("abcdefghijklmno") for _ in range(900))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = F.array_remove(F.split("text", Q.BLANK), "")
    got = docs.select("doc_id", words.alias("w")).select("doc_id", Q.repeated_words(F.col("w")).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: brute_base(t)[4] for i, t in enumerate(texts)}
    plan = str(Q.repeated_words(F.col("w")))
    assert 0 <= plan.find("array_distinct") < plan.find("sort_array")


def test_one_match_a_word(spark):
    """A match of the word pattern takes the letters of one word and what stands behind it: the search never stands on a blank."""
    texts = ["the cat, andthe  and! the", " ... the", "über ands\nand", "\U0001f600the\U0001f600 é and", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = Q.with_words(docs, "text", ["and", "the"]).select("doc_id", "__n", "__kinds", "__counts").collect()
    got = {i: (n, dict(zip(kinds, counts, strict=True))) for i, n, kinds, counts in rows}
    assert got == {i: (len(letters(t)), {w: letters(t).count(w) for w in ("and", "the") if w in letters(t)}) for i, t in enumerate(texts)}
