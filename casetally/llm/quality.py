"""Quality rules by distribution divergence, in built-in functions only.

A language's reference is the distribution of its character classes and of its
common words over all documents that carry its label. A document is compared
with it by the Jensen-Shannon distance (the root of the divergence in bits, 0
to 1) of its own two histograms. It passes if its two divergences, each in
units of its cut, add up to at most 1. Short texts scatter: the divergence that
sampling alone gives a text of n items in k classes, (k - 1) / (8 n ln 2), is
added to the cut, and below a least number of items a histogram is not judged.

*Character classes*: lower-case letters, white space, upper-case letters, other
letters and marks, digits, punctuation, the rest. *Common words*: words (runs of
letters, lower-cased) that make up at least 1/``COMMON`` of their language's
words, hence at most ``COMMON`` of them, and one class for all others. A language
has a reference if it holds 1/``LANGUAGES`` of all labelled words and
``MIN_REFERENCE`` words, so at most ``LANGUAGES`` references exist; they go into
the plan as literals. Neither the references nor the verdicts need a shuffle
of texts: sums by language, and counts of words, are pre-aggregated.

A document is compared with its own language; without a label, with every
reference, and the nearest counts. A language without a reference judges
nobody.

Defined cases: a null or empty text has no words and fails the base rules;
a histogram below its least size passes; without any reference only the base
rules judge; rows with equal ids or texts each get the same answer; texts of
any length are treated whole (a row holds its words and word windows as
arrays, about 60 bytes a word); an empty table gives an empty result; input
columns named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetally.llm.common import computed_once, keep_columns, store

#: Base rules: least words; highest share of repeated words.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
COMMON, LANGUAGES, MIN_REFERENCE = 200, 100, 1000
#: Cuts of the two divergences (squared distances, in bits) beyond what sampling gives.
MAX_CHAR_DIVERGENCE, MAX_WORD_DIVERGENCE = 0.05, 0.2
#: Least characters and words of a histogram that is judged.
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 100, 30
#: What is taken away, one class after the other, leaves the next classes.
CLASSES = [r"\p{Ll}+", r"[\x20\x09-\x0D]+", r"\p{Lu}+", r"[\p{L}\p{M}]+", r"\p{N}+", r"\p{P}+"]
#: The bits of a position among the words of a text.
POSITION = (1 << 31) - 1
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
RESULT = [*BASE, "kept", "reference", "char_distance", "word_distance"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def with_classes(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the number of characters of each class in ``__c`` and, in ``__left``, what is left before punctuation goes."""
    kept, left = docs.columns, [f"__left{i}" for i in range(len(CLASSES) + 1)]
    out = docs.withColumn(left[0], F.coalesce(F.col(text), F.lit("")))
    for before, after, pattern in zip(left, left[1:], CLASSES, strict=False):
        out = out.withColumn(after, F.regexp_replace(before, pattern, ""))
    sizes = [F.length(c) for c in left]
    counts = F.array(*[(a - b).cast("long") for a, b in zip(sizes, sizes[1:], strict=False)], sizes[-1].cast("long"))
    return out.select(*kept, counts.alias("__c"), F.col(left[-2]).alias("__left"))


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def letter_words(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.array_remove(F.split(lowered(text), r"[^\p{L}]+"), "")


def repeated_words(words: Column, size: int = 3) -> Column:
    """Number of words that stand in a window of ``size`` words found twice or more.

    A text whose windows all have other hashes repeats none and is done. Otherwise 33 bits of a window's hash and its
    position make one number; sorted, possible repeats are neighbours. Only these are compared by 96 bits, again in
    sorted order, so the work is that of a sort, whatever repeats."""
    def hashed(i: Column) -> list[Column]:
        return [F.get(words, (i + k).cast("int")) for k in range(size)]

    def low(x: Column) -> Column:
        return x.bitwiseAND(F.lit(POSITION))

    def high(x: Column) -> Column:
        return F.shiftright(x, 31)

    def likely(numbers: Column) -> Column:
        near = lambda x, y: high(x.bitwiseXOR(y)) == 0  # noqa: E731  (null at the ends: not near)
        return F.filter(numbers, lambda x, i: near(x, F.get(numbers, i + 1)) | near(x, F.get(numbers, i - 1)))

    def twins(found: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            y = F.get(found, i)
            return F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))
        return F.sort_array(F.transform(F.filter(found, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(at, i + 1) - p, F.lit(size))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def verified(some: Column) -> Column:
        return F.sort_array(F.transform(some, lambda x: F.struct(F.xxhash64(*hashed(low(x))).alias("h"), F.hash(*hashed(low(x))).alias("g"), low(x).alias("p"))))

    n = F.size(words) - size + 1
    def counted(hashes: Column) -> Column:
        numbers = F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~POSITION)).bitwiseOR(i.cast("long")))
        found = _let(_let(_let(F.sort_array(numbers), likely), lambda some: _let(verified(some), twins)), covered)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.slice(words, F.lit(1), n), lambda w, i: F.xxhash64(w, *hashed(i)[1:]))
    return F.when(n > 1, _let(windows, counted)).otherwise(F.lit(0).cast("long"))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of the base rules, ``base_failed`` and the class counts ``__c``."""
    kept = keep_columns(docs, BASE)
    body = F.coalesce(F.col("__t"), F.lit(""))
    full = with_classes(docs.select(*kept, F.col(text).alias("__t")), "__t").withColumns({
        "__w": F.array_remove(F.split(body, BLANK), ""),
        "__l": F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))})
    counted = full.select(
        *kept, "__c", F.size("__w").cast("long").alias("n_words"), (F.length(body) - F.get("__c", F.lit(1))).cast("long").alias("word_chars"),
        (F.length("__left") - F.length(F.regexp_replace("__left", SYMBOLS, ""))).cast("long").alias("n_symbols"),  # no letter, digit or blank is one
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("__w")).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return computed_once(counted.withColumn("base_failed", failed))


@dataclass(frozen=True)
class Reference:
    lang: str
    classes: tuple[float, ...]
    words: tuple[str, ...]
    shares: tuple[float, ...]


def fit_references(docs: DataFrame, text: str = "text", lang: str = "lang", min_words: int = MIN_REFERENCE) -> list[Reference]:
    """References of the labelled languages, over all documents. At most ``LANGUAGES`` rows of ``COMMON`` words come back."""
    rows = docs.select(F.col(lang).alias("l"), F.col(text).alias("t")).filter(F.col("l").isNotNull() & F.col("t").isNotNull())
    counts = store(rows.select("l", F.explode(letter_words(F.col("t"))).alias("w")).groupBy("l", "w").agg(F.count(F.lit(1)).alias("m")))
    totals = counts.groupBy("l").agg(F.sum("m").alias("n"))
    share = F.sum("n").over(Window.partitionBy(F.lit(0))) / LANGUAGES  # one row per language
    known = totals.withColumn("least", share).filter((F.col("n") >= F.col("least")) & (F.col("n") >= min_words)).select("l", "n")
    found = {r["l"]: r["n"] for r in known.collect()}  # at most LANGUAGES rows
    if not found:
        return []
    least = F.element_at(F.create_map(*[x for k, n in found.items() for x in (F.lit(k), F.lit(n / COMMON))]), F.col("l"))
    common: dict[str, list] = {k: [] for k in found}
    for r in counts.filter(F.col("l").isin(*found)).filter(F.col("m") >= least).collect():  # at most COMMON words a language
        common[r["l"]].append((r["w"], r["m"] / found[r["l"]]))
    sums = [F.sum(F.get("__c", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    chars = {r["l"]: list(r[1:]) for r in with_classes(rows.filter(F.col("l").isin(*found)), "t").groupBy("l").agg(*sums).collect()}
    out = []
    for k in sorted(found):
        top = sorted(common[k])
        out.append(Reference(k, tuple(c / sum(chars[k]) for c in chars[k]), tuple(w for w, _ in top), tuple(s for _, s in top)))
    return out


def _term(p: Column, q: Column) -> Column:
    """What a class with shares p and q adds to the divergence."""
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m) / 2).otherwise(0.0)
    return _let(F.struct(p.alias("p"), q.alias("q"), ((p + q) / 2).alias("m")), lambda s: half(s["p"], s["m"]) + half(s["q"], s["m"]))


def word_pattern(words: list[str]) -> str:
    """A pattern of the given words as a tree of letters, so a long list costs no more than a short one."""
    branches: dict[str, list[str]] = {}
    for w in words:
        branches.setdefault(w[:1], []).append(w[1:])
    ends = branches.pop("", None) is not None
    inner = "|".join(first + word_pattern(rest) for first, rest in sorted(branches.items()))
    return "" if not inner else f"(?:{inner}){'?' if ends else ''}"


def with_words(docs: DataFrame, text: str, common: list[str]) -> DataFrame:
    """``docs`` with the number of words ``__n``, and those of ``common`` that occur in ``__kinds`` with their counts.

    One pattern finds all words (runs of letters), names the common ones and passes over what follows a word."""
    kept = docs.columns
    pattern = rf"(?:({word_pattern(common)})(?!\p{{L}})|\p{{L}}++)\P{{L}}*+" if common else r"\p{L}++()"
    upto = lambda i: F.coalesce(F.array_position("__at", F.get("__kinds", i + 1)), F.size("__at") + 1)
    return (docs.withColumn("__words", F.regexp_extract_all(lowered(F.col(text)), F.lit(pattern), F.lit(1)))
            .withColumn("__at", F.sort_array(F.array_remove("__words", ""))).withColumn("__kinds", F.array_distinct("__at"))
            .select(*kept, F.size("__words").alias("__n"), "__kinds",
                    F.transform("__kinds", lambda k, i: upto(i) - F.array_position("__at", k)).alias("__counts")))


def char_divergence(reference: Column) -> Column:
    """Jensen-Shannon divergence in bits of the class counts ``__c`` from reference shares."""
    return _total(F.zip_with("__c", reference, lambda c, q: _term(c / F.col("__chars"), q)))


def word_divergence(words: Column, shares: Column) -> Column:
    """The same of the document's words, from the shares of a language's common words and of all others.

    Only the classes that the document has are visited: one that it lacks adds half its share."""
    def added(kind: Column, i: Column) -> Column:
        at = F.array_position(words, kind)
        share = F.when(at > 0, F.get(shares, (at - 1).cast("int")))
        p = F.get("__counts", i) / F.col("__n")
        return F.struct(F.when(share.isNotNull(), _term(p, share) - share / 2).otherwise(0.0).alias("d"), F.when(share.isNotNull(), p).otherwise(0.0).alias("p"))

    def with_rest(parts: Column) -> Column:
        rest, own = F.greatest(F.lit(0.0), 1 - _total(shares)), F.greatest(F.lit(0.0), 1 - _total(F.transform(parts, lambda x: x["p"])))
        return _total(F.transform(parts, lambda x: x["d"])) + _term(own, rest) - rest / 2 + 0.5
    return _let(F.transform("__kinds", added), with_rest)


def _literal(references: list[Reference]) -> Column:
    row = lambda r: F.struct(F.lit(r.lang).alias("lang"), *[F.lit(list(x)).cast(f"array<{k}>").alias(n) for n, x, k in (
        ("classes", r.classes, "double"), ("words", r.words, "string"), ("shares", r.shares, "double"))])
    return F.array(*[row(r) for r in references])


def judge(docs: DataFrame, references: list[Reference], text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with the base counts, ``kept``, the ``reference`` compared with and the two distances (null: not judged)."""
    kept = keep_columns(docs, RESULT)
    rows = with_base(docs.select(*kept, F.col(text).alias("__text"), F.col(lang).alias("__lang")), "__text")
    if not references:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("reference", "string"), ("char_distance", "double"), ("word_distance", "double"))]
        return rows.select(*kept, *BASE, (~F.col("base_failed")).alias("kept"), *none)
    noise = lambda k, n: (k - 1) / (8 * math.log(2) * F.greatest(n, F.lit(1)))
    rows = with_words(rows.withColumn("__chars", F.length(F.coalesce(F.col("__text"), F.lit("")))), "__text", sorted({w for r in references for w in r.words}))

    def compared(r: Column) -> Column:
        """The two divergences in units of their cuts may add up to 1."""
        char = F.when(F.col("__chars") >= MIN_CHARS_JUDGED, char_divergence(r["classes"]))
        word = F.when(F.col("__n") >= MIN_WORDS_JUDGED, word_divergence(r["words"], r["shares"]))
        return F.struct(char.alias("c"), word.alias("w"), r["lang"].alias("lang"), F.size(r["words"]).alias("k"))

    def ranked(d: Column) -> Column:
        excess = (F.coalesce(d["c"] / (MAX_CHAR_DIVERGENCE + noise(len(CLASSES) + 1, F.col("__chars"))), F.lit(0.0))
                  + F.coalesce(d["w"] / (MAX_WORD_DIVERGENCE + noise(d["k"] + 1, F.col("__n"))), F.lit(0.0)))
        return F.struct(excess.alias("excess"), d["lang"].alias("lang"), d["c"].alias("c"), d["w"].alias("w"))

    asked = F.filter(_literal(references), lambda r: F.col("__lang").isNull() | (r["lang"] == F.col("__lang")))
    judged = computed_once(rows.select(*kept, *BASE, F.array_min(F.transform(F.transform(asked, compared), ranked)).alias("__best")))
    distance = lambda c: F.round(F.sqrt(F.when(F.col(f"__best.{c}") < 0, 0.0).otherwise(F.col(f"__best.{c}"))), 6)
    passes = ~F.col("base_failed") & F.coalesce(F.col("__best.excess") <= 1, F.lit(True))
    return judged.select(*kept, *BASE, passes.alias("kept"), F.col("__best.lang").alias("reference"),
                         distance("c").alias("char_distance"), distance("w").alias("word_distance"))
