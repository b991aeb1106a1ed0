"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, long ones cut every ``PIECE`` code points;
the distinct 64-bit digests go into a sketch of ``CELLS`` cells, three hash
functions on a third of the cells each. A cell holds a count, the exclusive-or
of its digests and that of their check sums. The sketches of two versions are
subtracted cell by cell, what they share cancels, and peeling recovers the
digests that differ: a cell with one digest left gives it away, which frees
other cells. Where peeling stops short, or the sets are too large for their
difference to fit, the digests are dealt over a larger sketch of one table
with about one cell for ``LOAD`` digests: a subtracted cell with one digest
left gives it away, and cells with more are split by further bits of their
digests until all is recovered. The likeness of two versions is their Jaccard
index, from the two counts and the recovered difference.

All of it is array functions within a row: no cell is ever shuffled or stored,
and the work of a document grows with its length.

Defined cases: a null or empty text has no paragraph, an all-zero sketch, and
likeness 1 to another such; equal texts have equal fingerprints; rows with the
same id and text are one document and each get its result; a null id comes
last in the order of ids; a single document is its own next; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetally.llm.common import computed_once, partitions, row_key, store

#: What two versions share is told apart in pieces of this size.
PIECE = 32
TABLES, WIDTH = 3, 10
CELLS = TABLES * WIDTH
#: Digests (of both sides) that a part is planned for, and times that a part may be split.
LOAD, SPLITS = 4, 32
ROUNDS = 10
DIGESTS, FOUND = "array<bigint>", "array<struct<n:int,x:bigint>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (an expression used inside a lambda is computed anew at every call)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^\n]{1,%d}" % PIECE), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(x: Column) -> Column:
    return F.xxhash64(x, F.lit("check")).bitwiseAND(0xFFFFFFFF)


def _cell(x: Column, table: int) -> Column:
    return (F.pmod(F.xxhash64(x, F.lit(table)), F.lit(WIDTH)) + table * WIDTH).cast("int")


def _entry(x: Column, sign: Column) -> Column:
    """A digest with its sign, check sum and cells."""
    return F.struct(sign.alias("n"), x.alias("x"), _check(x).alias("c"), *[_cell(x, t).alias(f"t{t}") for t in range(TABLES)])


def _put(cell: Column, e: Column, times: int) -> Column:
    return F.struct((cell["n"] + e["n"] * times).alias("n"), cell["x"].bitwiseXOR(e["x"]).alias("x"), cell["c"].bitwiseXOR(e["c"]).alias("c"))


def _fill(cells: Column, entries: Column, times: int) -> Column:
    """``cells`` with the entries added (or taken out); each half of a table looks through its own entries only."""
    half = WIDTH // 2

    def some_cells(before: Column, some: Column, t: int, first: int, n: int) -> Column:
        own = F.filter(some, lambda e: e[f"t{t}"] < first + n if first == t * WIDTH else e[f"t{t}"] >= first)
        one = lambda mine, i: F.aggregate(F.filter(mine, lambda e: e[f"t{t}"] == i), F.get(before, F.lit(i)), lambda acc, e: _put(acc, e, times))
        return _let(own, lambda mine: F.array(*[one(mine, i) for i in range(first, first + n)]))
    halves = [(t, t * WIDTH + at, n) for t in range(TABLES) for at, n in ((0, half), (half, WIDTH - half))]
    return _let(cells, lambda before: _let(entries, lambda some: F.concat(*[some_cells(before, some, *h) for h in halves])))


def _zero() -> Column:
    cell = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("c"))
    return F.array_repeat(cell, CELLS)


def _signed(x: Column, sign: int) -> Column:
    return F.transform(x, lambda e: _entry(e, F.lit(sign)))


def sketch(x: Column) -> Column:
    """The cells of a set of digests."""
    return _fill(_zero(), _signed(x, 1), 1)


def subtract(a: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.struct(
        (z["a"]["n"] - z["b"]["n"]).alias("n"), z["a"]["x"].bitwiseXOR(z["b"]["x"]).alias("x"), z["a"]["c"].bitwiseXOR(z["b"]["c"]).alias("c")))


def peel(cells: Column) -> Column:
    """struct(cells, found): what cannot be peeled, and the recovered (n, x): n is 1 for the first version's, -1 for the second's."""
    def step(state: Column, _: Column) -> Column:
        sure = F.filter(state["cells"], lambda c: F.when(F.abs(c["n"]) == 1, c["c"] == _check(c["x"])).otherwise(False))
        pure = lambda own: F.array_distinct(F.transform(own, lambda c: _entry(c["x"], c["n"])))
        found = lambda e: F.struct(e["n"].alias("n"), e["x"].alias("x"))
        after = lambda some: F.struct(_fill(state["cells"], some, -1).alias("cells"),
                                      F.concat(state["found"], F.transform(some, found)).alias("found"))
        return _let(sure, lambda own: F.when(F.size(own) == 0, state).otherwise(_let(pure(own), after)))
    start = F.struct(cells.alias("cells"), F.array().cast(FOUND).alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def is_empty(cells: Column) -> Column:
    return ~F.exists(cells, lambda c: (c["n"] != 0) | (c["x"] != 0) | (c["c"] != 0))


def fingerprint(cells: Column) -> Column:
    """The cells as text: count, digest and check sum in hexadecimal, 28 digits a cell."""
    return F.array_join(F.transform(cells, lambda c: F.lower(F.concat(
        F.right(F.hex(c["n"].cast("long") + (1 << 32)), F.lit(4)), F.lpad(F.hex(c["x"]), 16, "0"), F.lpad(F.hex(c["c"]), 8, "0")))), "")


def _cuts(some: Column, shift: Column, fan: Column) -> Column:
    """A sorted array cut into ``fan`` (a power of two) arrays by the bits from ``shift`` on, which change in sorted order."""
    def cut(keys: Column) -> Column:
        length = lambda lo, j, back: F.size(some) + 2 - lo - F.array_position(back, j)
        piece = lambda j, back: _let(F.array_position(keys, j).cast("int"), lambda lo: F.when(lo == 0, F.array().cast(DIGESTS)).otherwise(
            F.slice(some, lo, length(lo, j, back).cast("int"))))
        return _let(F.reverse(keys), lambda back: F.transform(F.sequence(F.lit(0), fan - 1), lambda j: piece(j.cast("bigint"), back)))
    return _let(F.transform(some, lambda x: F.call_function("shiftright", x, shift).bitwiseAND((fan - 1).cast("bigint"))), cut)


def _dealt(a: Column, b: Column) -> Column:
    """The sets dealt over parts planned for ``LOAD`` digests, by their leading bits in two steps; parts that are equal
    on both sides have equal sketches and are left out. array<struct<a, b>>, sorted."""
    some = lambda c, shift, bits: _cuts(c, shift, F.call_function("shiftleft", F.lit(1), bits))
    pairs = lambda a, b, shift, bits: F.filter(F.zip_with(
        some(a, shift, bits), some(b, shift, bits), lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda p: p["a"] != p["b"])
    bits = F.greatest(F.ceil(F.log2((F.size(a) + F.size(b) + 1) / LOAD)), F.lit(2)).cast("int")

    def two(all_bits: Column, first: Column) -> Column:
        coarse = pairs(a, b, 64 - first, first)
        return F.flatten(F.transform(coarse, lambda p: pairs(p["a"], p["b"], 64 - all_bits, all_bits - first)))
    return _let(bits, lambda n: _let(F.shiftright(n, 1), lambda first: two(n, first)))


def _given(a: Column, b: Column) -> Column:
    """What the subtracted cell of a part gives away: struct(n, x), or null if not exactly one digest is left in it.

    No other cell shows a wrong digest here, so the check sums have 64 bits."""
    def cell(both: Column, n: Column) -> Column:
        check = lambda x: F.xxhash64(x, F.lit("check"))
        folded = lambda body: F.aggregate(both, F.lit(0).cast("bigint"), lambda c, x: c.bitwiseXOR(body(x)))
        left = lambda x: F.struct(n.alias("n"), x.alias("x"))
        sure = _let(folded(lambda x: x), lambda x: F.when(folded(check) == check(x), left(x)))
        return F.when(F.size(both) == 1, left(F.get(both, F.lit(0)))).otherwise(sure)  # one digest is its cell
    return _let(F.size(a) - F.size(b), lambda n: F.when(F.abs(n) == 1, _let(F.concat(a, b), lambda both: cell(both, n))))


def recovered(a: Column, b: Column) -> Column:
    """The digests of a not in b (n = 1) and of b not in a (n = -1), array<struct<n, x>>.

    The sets are dealt over as many cells as a sketch of their size needs. A subtracted cell with one digest left gives
    it away; the others are split by further bits of the digests, again and again until all is recovered. Two digests
    differ in one of their 64 bits, so ``SPLITS`` times are enough."""
    bits = 64 // SPLITS
    split = lambda p, level: F.transform(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda bit: F.struct(*[F.filter(
        p[c], lambda x: F.call_function("shiftright", x, level).bitwiseAND((1 << bits) - 1) == bit).alias(c) for c in "ab"]))

    def tried(parts: Column, found: Column) -> Column:
        tries = F.transform(parts, lambda p: F.struct(_given(p["a"], p["b"]).alias("x"), p.alias("p")))
        return _let(tries, lambda some: F.struct(
            F.transform(F.filter(some, lambda r: r["x"].isNull()), lambda r: r["p"]).alias("open"),
            F.concat(found, F.filter(F.transform(some, lambda r: r["x"]), lambda x: x.isNotNull())).alias("found")))

    def again(state: Column, level: Column) -> Column:
        parts = F.filter(F.flatten(F.transform(state["open"], lambda p: split(p, level))), lambda p: p["a"] != p["b"])
        return F.when(F.size(state["open"]) == 0, state).otherwise(tried(parts, state["found"]))
    parts = _let(F.sort_array(a), lambda s: _let(F.sort_array(b), lambda t: _dealt(s, t)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63), F.lit(bits)), tried(parts, F.array().cast(FOUND)), again, lambda state: state["found"])


def differences(pairs: DataFrame, key: list[str], counts: bool = False) -> DataFrame:
    """(key, found): the digests of a not in b (n = 1) and of b not in a (n = -1), for rows (key, a, b); with
    ``counts``, only how many were found."""
    found = recovered(F.col("a"), F.col("b"))
    return pairs.select(*key, (F.size(found) if counts else found).alias("found"))


def _in_order(keys: DataFrame) -> DataFrame:
    """(d, k, n) with the key of the next row (nd, nk) in ascending order, the first after the last.

    Range partitions are numbered in order; what follows a partition's last
    row is the first row of the next one that has any (one row per partition)."""
    spark = keys.sparkSession
    placed = store(keys.repartitionByRange(partitions(spark), "d", "k").withColumn("b", F.spark_partition_id()))
    own = F.lead(F.struct("d", "k")).over(Window.partitionBy("b").orderBy("d", "k"))
    heads = placed.groupBy("b").agg(F.min(F.struct("d", "k")).alias("head"))
    by_place = Window.orderBy("b")
    after = F.coalesce(F.lead("head").over(by_place), F.first("head").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    after = heads.withColumn("after", after).select("b", "after")
    rows = placed.withColumn("own", own).join(F.broadcast(after), "b")
    return rows.withColumn("next", F.coalesce("own", "after")).select("d", "k", "n", F.col("next.d").alias("nd"), F.col("next.k").alias("nk"))


def edited_versions(docs: DataFrame, id_col: str = "doc_id", text: str = "text", divisor: int = 4) -> DataFrame:
    """(d, k, n, edited_sha256, a, e, x): each distinct document's length, the hash of its edited text (its last
    n / ``divisor`` code points replaced by the first ones of the next document), and the digests of the text, the
    edited text and the next text."""
    d, k = row_key(F.col(id_col), F.col(text))
    texts = docs.select(d, k, F.coalesce(F.col(text), F.lit("")).alias("t")).dropDuplicates(["d", "k"])
    order = store(_in_order(docs.select(d, k, F.length(F.coalesce(F.col(text), F.lit(""))).alias("n")).distinct()))
    cut = F.floor(F.col("n") / divisor).cast("int")
    wanted = order.select(F.col("d").alias("pd"), F.col("k").alias("pk"), "n", F.col("nd").alias("d"), F.col("nk").alias("k"))
    lent = texts.join(wanted, ["d", "k"]).select(F.col("pd").alias("d"), F.col("pk").alias("k"), "n",
                                                 F.substring("t", F.lit(1), cut).alias("head"), digests(F.col("t")).alias("x"))
    both = texts.join(lent, ["d", "k"])
    edited = F.concat(F.substring("t", F.lit(1), F.col("n") - cut), F.col("head"))
    made = both.withColumn("edited", edited)
    return made.select("d", "k", F.col("n").cast("long").alias("n"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       digests(F.col("t")).alias("a"), digests(F.col("edited")).alias("e"), "x")


def likeness(size_a: Column, size_b: Column, different: Column) -> Column:
    """Jaccard index of two sets from their sizes and the size of their symmetric difference."""
    union = (size_a + size_b + different) / 2
    return F.when(union == 0, 1.0).otherwise((size_a + size_b - different) / 2 / union)


def compare(versions: DataFrame) -> DataFrame:
    """(d, k, n, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of ``edited_versions``."""
    versions = computed_once(versions)
    cells = computed_once(versions.select("*", *[sketch(F.col(c)).alias(f"s{c}") for c in "ae"]))

    def different(c: str) -> Column:
        """First from the two fingerprints; from a larger sketch where they cannot hold the difference or do not peel."""
        other = F.col(f"s{c}") if c == "e" else sketch(F.col(c))
        first = _let(peel(subtract(F.col("sa"), other)), lambda p: F.when(is_empty(p["cells"]), F.size(p["found"])))
        larger = F.size(recovered(F.col("a"), F.col(c)))
        return F.when(F.size("a") + F.size(c) <= 2 * CELLS, F.coalesce(first, larger)).otherwise(larger)
    full = computed_once(cells.select("d", "k", "n", "edited_sha256", fingerprint(F.col("sa")).alias("fingerprint"),
                                       fingerprint(F.col("se")).alias("edited_fingerprint"), *[F.size(c).alias(f"n{c}") for c in "aex"],
                                       *[different(c).alias(f"d{c}") for c in "ex"]))
    near = [likeness(F.col("na"), F.col(f"n{c}"), F.col(f"d{c}")).alias(name) for c, name in (("e", "near_edited"), ("x", "near_next"))]
    return full.select("d", "k", "n", "edited_sha256", "fingerprint", "edited_fingerprint", *near)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row."""
    found = compare(edited_versions(docs, id_col, text))
    d, k = row_key(F.col(id_col), F.col(text))
    every = docs.select(F.col(id_col).alias("doc_id"), d, k)
    return every.join(found, ["d", "k"]).select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
