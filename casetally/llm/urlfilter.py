"""URL filtering: a blocked Bloom filter before an exact hash join.

A listed canonical URL is a host and a path prefix (``example.net/en/``) with
an action. It fits its host and all subdomains if the URL's path starts with
its path; the longest fitting one decides. A URL is looked up under every
suffix of its host and every prefix of its path that a listed one can equal.
These candidates are first tested against a blocked Bloom filter (each key
sets eight bits, one in each word of one 512-bit block), a table of blocks
with a fixed upper size that is broadcast; what passes goes to an exact join
with the list, so false positives vanish. Distinct URLs are looked up once.

Defined cases: a null URL, or one without ``://``, has empty host and path and
fits nothing; null or empty listed URLs are ignored; if a URL is listed twice,
block wins, as it does between equally long ones (then the smaller text);
repeated rows each get the verdict; empty tables give an empty result or an
empty list. Input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetally.llm.common import keep_columns, store

BITS_PER_KEY, WORDS = 16, 8
#: The filter never has more blocks: 72 bytes each, 75 MB at most. A longer list only passes more false hits on.
MAX_BLOCKS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ["host", "path", "rule", "verdict"]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """One bit of each word, six bits of a second hash telling which."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7): at most ``blocks`` rows."""
    marked = keys.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(candidates: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``candidates`` whose key may be in the filter."""
    asked = candidates.withColumn("block", _block(F.col(key), blocks)).join(F.broadcast(bloom), "block")
    for i, m in enumerate(_masks(F.col(key))):
        asked = asked.filter(F.col(f"w{i}").bitwiseAND(m) == m)
    return asked.select(*candidates.columns)


def _listed(listed: DataFrame, url: str, action: str) -> DataFrame:
    """(rule, rank, action, host, path): distinct, hosts lower-cased."""
    u = F.col(url)
    host = F.translate(F.regexp_extract(u, r"(?s)^([^/]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(u, r"(?s)^[^/]*(.*)", 1)
    rows = listed.filter(u.isNotNull() & (host != "")).select(F.concat(host, path).alias("rule"), F.col(action).alias("action"),
                                                               host.alias("host"), path.alias("path"))
    blocks = F.max(F.when(F.col("action") == "block", 1).otherwise(0)) == 1
    return rows.groupBy("rule", "host", "path").agg(F.when(blocks, "block").otherwise("allow").alias("action"))


def _candidates(labels: int, longest: int, odd: list[int]) -> Column:
    """All (host suffix + path prefix) that can be listed: at most ``labels`` labels and ``longest`` characters of
    path; prefixes end with a slash or have one of the lengths ``odd``."""
    parts = F.split("host", r"\.")
    n = F.size(parts)
    hosts = F.transform(F.sequence(F.greatest(n - labels + 1, F.lit(1)), n),
                        lambda j: F.array_join(F.slice(parts, j, n), "."))
    head = F.substring("path", 1, longest)
    steps = F.split(head, "/")
    whole = F.when(F.size(steps) > 1, F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda j: F.concat(
        F.array_join(F.slice(steps, F.lit(1), j), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    cut = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in odd]
    paths = F.array_compact(F.array_distinct(F.concat(whole, F.array(*cut).cast("array<string>"))))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", listed_url: str = "rule", action: str = "action",
                default: str = "allow", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the listed URL that decides, else null) and ``verdict``."""
    rules = store(_listed(listed, listed_url, action))
    odd = F.when(~F.col("path").endswith("/"), F.length("path"))
    shape = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"),
                      F.max(F.length("path")).alias("longest"), F.collect_set(odd).alias("odd")).first()  # numbers up to a URL's length
    kept = keep_columns(pages, RESULTS)
    parsed = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not shape.n:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = min(max_blocks, max(1, -(-shape.n * BITS_PER_KEY // (64 * WORDS))))
    urls = parsed.filter(F.col("host") != "").select("host", "path").distinct()
    asked = urls.select("host", "path", F.explode(_candidates(shape.labels, shape.longest, sorted(shape.odd))).alias("rule"))
    possible = possible_hits(asked, "rule", store(bloom_filter(rules, "rule", blocks)), blocks)
    fits = (possible.join(rules.select("rule", "action"), "rule").groupBy("host", "path")
            .agg(F.min(F.struct(-F.length("rule"), F.col("action") != "block", "rule", "action")).alias("best")))
    found = store(fits.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict")))
    return parsed.join(found, ["host", "path"], "left").select(
        *kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
