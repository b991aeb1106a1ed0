"""Small corpora for the operators. ``hard_docs`` has nulls in every column, empty and blank texts, repeated rows, equal
ids with different texts, one long text, and columns named like things the operators make."""

import random

import pytest

WORDS = "the of and to in is that for it was on with as by be at are from this have nicht und der die das".split()
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, d long, k string, score string, size int, w string, "
          "h1 int, t string, fp int, taken int, spans string, block int")
EXTRA = (1, "k", "s", 2, "w", 3, "t", 4, 5, "sp", 6)


def words(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ung", "tion", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    rng = random.Random(5)
    body = [(i, words(rng, rng.randint(3, 120)) + "\nCommon line.\n" + words(rng, 30), "en" if i % 2 else "de", f"s{i % 3}") for i in range(24)]
    body[5] = (5, body[4][1], "en", "s0")  # an exact copy
    odd = [(None, None, None, None), (100, None, "en", None), (101, "", None, "s1"), (102, " \t\n ", "en", "s1"), (103, "a", "en", "s2"),
           (104, "\n\n\n", None, "s0"), (105, "!!! ??? 12 34", "de", "s0"), (None, words(rng, 40), "de", "s1"), (106, "é è à ñ " * 30, "fr", None),
           (107, words(rng, 12000), "en", "s2"), (108, body[3][1] + " x", "en", "s1"), (109, "\U0001f600 " * 20 + "z\x00\x0b\x0cq", "en", "s1")]
    rows = body + odd + [body[7], body[7], (7, "another text under the same id", "en", "s1"), odd[0]]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in hard_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
