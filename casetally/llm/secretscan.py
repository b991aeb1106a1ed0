"""Secret scan with corpus-wide ownership frequency.

Candidates are found by patterns, with their positions: matches and the gaps
between them (``split`` by the same pattern) give running sums of lengths. The
base kinds are password-like assignments, access keys and long hexadecimal
runs; a fourth kind is any long run of key characters that mixes letters and
digits. Every candidate value is hashed and counted over the whole corpus by
distinct repositories and owners. A repository is a distinct text: copies of
one document are one repository, whose owner is the source of the copy with the
smallest id, so copying a document makes no example of what it holds. A value
looks live if it has one owner only and stands in few repositories; one that
several owners have, or that stands in many texts of one owner, is a widely
copied example. Base spans are always reported; the fourth kind only where its
value looks live and no base span covers it.

Defined cases: a null or empty text has no span; a null owner is an owner of
its own; of copies with the same id (or none) the owner with the smallest hash
owns the text; rows with the same id, text and owner are one document and each
get its result; positions are code points, ends exclusive; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetally.llm.common import row_key, store

#: kind: pattern, group that holds the value, least length of the value. In the order in which kinds are listed.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # a shorter run never fits, so the least length can stand in the pattern
    "live": (r"[A-Za-z0-9+/_-]{20,}", 0, 20),
}
MAX_OWNERS = 1
#: More distinct texts than this with a value make it an example, whoever owns them.
MAX_REPOSITORIES = 10


def _found(kind: str) -> Column:
    return F.regexp_extract_all(F.col("t"), F.lit(KINDS[kind][0]), F.lit(0))


def _parts(kind: str) -> Column:
    """One struct (gap, length, value_length, value_hash) for each match in column ``kind``; gaps lie before the matches."""
    pattern, group, _ = KINDS[kind]
    values = F.regexp_extract_all(F.col("t"), F.lit(pattern), F.lit(group)) if group else F.col(kind)
    gaps = F.transform(F.split("t", pattern, -1), lambda g: F.length(g))
    rows = F.transform(F.arrays_zip(gaps.alias("gap"), F.col(kind).alias("match"), values.alias("value")), lambda x: F.struct(
        x["gap"].alias("gap"), F.length(x["match"]).alias("length"), F.length(x["value"]).alias("value_length"),
        F.xxhash64(F.lit("secret"), x["value"]).alias("value"),
        (x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")).alias("mixed")))
    return F.when(F.size(kind) > 0, F.slice(rows, F.lit(1), F.size(kind)))


def candidates(docs: DataFrame, id_col: str, text: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, d, k, owner), and a row (d, k, owner, body, kind, start, end, value) for every candidate; ``body``: the text's hash."""
    d, k = row_key(F.col(id_col), F.col(text))
    rows = docs.select(F.col(id_col).alias("doc_id"), d, k, F.xxhash64(F.col(owner).cast("string"), F.col(owner).isNull()).alias("owner"),
                       F.xxhash64(F.lit("body"), F.col(text)).alias("body"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    scanned = rows.select("*", *[_found(x).alias(x) for x in KINDS])
    scanned = store(scanned.select("doc_id", "d", "k", "owner", "body", *[_parts(x).alias(x) for x in KINDS]))
    some = scanned.filter(F.coalesce(*KINDS).isNotNull()).dropDuplicates(["d", "k", "owner"])
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(x).alias("m")) for i, x in enumerate(KINDS)]))
    each = some.select("d", "k", "owner", "body", named.alias("x")).select("d", "k", "owner", "body", "x.kind", F.posexplode("x.m").alias("i", "m"))
    upto = F.sum(F.col("m.gap") + F.col("m.length")).over(Window.partitionBy("d", "k", "owner", "kind").orderBy("i"))
    least = F.get(F.array(*[F.lit(v[2]) for v in KINDS.values()]), F.col("kind"))
    spans = each.withColumn("end", upto).filter(F.col("m.value_length") >= least).filter((F.col("kind") < 3) | F.col("m.mixed"))
    return scanned.select("doc_id", "d", "k", "owner"), spans.select(
        "d", "k", "owner", "body", "kind", (F.col("end") - F.col("m.length")).alias("start"), "end", F.col("m.value").alias("value"))


def ownership(spans: DataFrame) -> DataFrame:
    """(value, repositories, owners): in how many distinct texts, and of how many owners, each candidate value occurs."""
    per_text = spans.groupBy("value", "body").agg(F.min(F.struct("d", "owner"))["owner"].alias("owner"))
    per_owner = per_text.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("value").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, id_col: str = "doc_id",
         text: str = "text", owner: str = "source") -> DataFrame:
    """(doc_id, spans) for every row; spans: array of (start, kind, kind_name, end, repositories, owners, live), in order."""
    every, spans = candidates(docs, id_col, text, owner)
    spans = store(spans)
    known = spans.join(store(ownership(spans)), "value")
    name = F.get(F.array(*[F.lit(x) for x in KINDS]), F.col("kind"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    entry = F.struct("start", "kind", name.alias("kind_name"), "end", "repositories", "owners", live.alias("live"))
    per = known.select("d", "k", "owner", entry.alias("s")).groupBy("d", "k", "owner").agg(F.sort_array(F.collect_list("s")).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < 3)
    covered = lambda s: F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    shown = F.filter("all", lambda s: (s["kind"] < 3) | (s["live"] & ~covered(s)))
    per = per.withColumn("base", base).select("d", "k", "owner", shown.alias("spans"))
    empty = F.array().cast(per.schema["spans"].dataType)
    return every.join(per, ["d", "k", "owner"], "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind_name"], s["start"], s["end"])), ",")
