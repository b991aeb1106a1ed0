"""Benchmark decontamination by size-partitioned MinHash containment.

A test item is short, a document may be long, so the measure is containment:
the share of the item's distinct five-word shingles that the document holds.
Items are partitioned by their number of shingles n. A partition's MinHash
sketch is an item's k smallest shingle hashes, k = floor((1 - t) n) + margin
(at most n): a document that holds a share t of the item lacks at most
floor((1 - t) n) shingles, so it meets at least k - floor((1 - t) n) of the
sketch. That count makes a candidate and no leak is missed. Candidates are
verified on the shingles' words.

Words are runs of letters and digits, lower-cased, so case, punctuation and
line breaks do not hide a leak. Everything is DataFrame functions; items meet
documents in equi-joins on shingle hashes.

Defined cases: an item of fewer than five words is one shingle of all its
words; an item or document without words (null, empty, symbols) matches
nothing; rows with the same id and text are one document (or item); null ids
are carried through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetally.llm.common import row_key, store

WORDS, THRESHOLD, MARGIN = 5, 0.8, 3


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _windows(size: int, make) -> Column:
    """make(position) for every window of ``size`` elements of column ``w``; empty where there is none."""
    n = F.size("w")
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), make)).otherwise(F.array())


def shingle_hashes(size: int) -> Column:
    """Hash of each window over the word hashes in column ``w``."""
    return _windows(size, lambda i: F.xxhash64(F.lit(size), *[F.get(F.col("w"), i + j) for j in range(size)]))


def shingle_texts(size: int) -> Column:
    return _windows(size, lambda i: F.concat_ws(" ", *[F.get(F.col("w"), i + j) for j in range(size)]))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("w", F.transform("w", lambda x: F.xxhash64(x)))


def _items(items: DataFrame, item_id: str, text: str, shingle: int) -> DataFrame:
    """(item, i, size, w): distinct items with their words and shingle length."""
    rows = items.select(F.col(item_id).alias("item"), F.xxhash64(F.col(item_id), F.col(text)).alias("i"), words(F.col(text)).alias("w"))
    return rows.filter(F.size("w") > 0).dropDuplicates(["i"]).withColumn("size", F.least(F.size("w"), F.lit(shingle)))


def _by_length(rows: DataFrame, lengths: list[int], make, name: str) -> DataFrame:
    """Distinct windows of every length in use, one row each."""
    found = F.array_distinct(F.flatten(F.array(*[make(n) for n in lengths])))
    return rows.select("*", F.explode(found).alias(name)).drop("w")


def sketches(items: DataFrame, threshold: float, margin: int) -> DataFrame:
    """(i, h, need): the items' smallest hashes and how many of them a document must meet. ``items`` has i and all hashes."""
    n = F.size("all")
    spare = F.floor((1.0 - threshold) * n + 1e-9).cast("int")  # shingles that may be missing
    k = F.least(n, spare + margin)
    return items.select("i", (k - spare).alias("need"), F.explode(F.slice(F.array_sort("all"), F.lit(1), k)).alias("h"))


def leaks(docs: DataFrame, items: DataFrame, shingle: int = WORDS, threshold: float = THRESHOLD, margin: int = MARGIN,
          id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, d, k, item_id, n_item, n_shared, containment) of every document and item it holds; d and k are ``row_key``."""
    bench = store(_items(items, item_id, item_text, shingle))
    lengths = sorted(r.size for r in bench.select(F.col("size")).distinct().collect())  # at most ``shingle`` numbers
    keyed = docs.select(F.col(id_col).alias("doc_id"), *row_key(F.col(id_col), F.col(text)), F.col(text).alias("t"))
    result = "doc_id", "d", "k", "item_id", "n_item", "n_shared", "containment"
    if not lengths:
        empty = keyed.limit(0).select("doc_id", "d", "k", F.lit(None).cast(dict(items.dtypes)[item_id]).alias("item_id"))
        return empty.select("*", F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared"),
                            F.lit(0.0).alias("containment"))
    own = F.coalesce(*[F.when(F.col("size") == n, F.array_distinct(shingle_hashes(n))) for n in lengths])
    sketch = store(sketches(_hashed(bench).select("i", own.alias("all")), threshold, margin))

    hashed = _hashed(keyed.select("d", "k", words(F.col("t")).alias("w")))
    met = _by_length(hashed, lengths, shingle_hashes, "h").join(sketch, "h")
    candidates = store(met.groupBy("d", "k", "i").agg(F.count("*").alias("met"), F.first("need").alias("need"))
                       .filter(F.col("met") >= F.col("need")).select("d", "k", "i"))

    own = F.coalesce(*[F.when(F.col("size") == n, F.array_distinct(shingle_texts(n))) for n in lengths])
    whole = store(bench.select("i", F.col("item").alias("item_id"), own.alias("all")).select(
        "i", "item_id", F.size("all").cast("long").alias("n_item"), F.explode("all").alias("shingle")))
    suspects = keyed.join(candidates.select("d", "k").distinct(), ["d", "k"], "left_semi").dropDuplicates(["d", "k"])
    exact = _by_length(suspects.select("doc_id", "d", "k", words(F.col("t")).alias("w")), lengths, shingle_texts, "shingle")
    shared = exact.join(whole, "shingle").groupBy("doc_id", "d", "k", "i", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_item")
    return (shared.join(candidates, ["d", "k", "i"], "left_semi").withColumn("containment", share)
            .filter(F.col("containment") >= threshold).select(*result))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without those that hold an item."""
    bad = store(leaks(docs, items, id_col=id_col, text=text, **options).select(F.col("d").alias("__d"), F.col("k").alias("__k")).distinct())
    d, k = row_key(F.col(id_col), F.col(text))
    return docs.withColumns({"__d": d, "__k": k}).join(bad, ["__d", "__k"], "left_anti").select(*docs.columns)
