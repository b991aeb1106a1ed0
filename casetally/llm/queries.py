"""The registered queries of the corpus operators and their DuckDB SQL.

Each query applies its operator, with production parameters, to the whole
table and derives the digest columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetally.llm import (
    decontaminate,
    language,
    linededup,
    mixing,
    quality,
    runs,
    secretscan,
    simhash,
    sketch,
    suffixdedup,
    toxicity,
    urlfilter,
    variants,
)
from casetally.llm.common import held_out, table


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.fit_profiles(docs.filter(~held_out(F.col("doc_id"))))
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontaminate.leaks(docs, items, shingle=5, threshold=0.8)
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


OP1_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id AS i, text AS t FROM documents), b AS (SELECT DISTINCT item_id AS i, text AS t FROM benchmark),
dw AS (SELECT i, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM d),
bw AS (SELECT i, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM b),
bs AS (SELECT DISTINCT i, least(len(w), 5) AS size, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS s
       FROM (SELECT i, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bs),
ds AS (SELECT DISTINCT i, size, array_to_string(w[p:p + size - 1], ' ') AS s
       FROM (SELECT i, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM dw, sizes WHERE len(w) >= size)),
n AS (SELECT i, count(*) AS n_item FROM bs GROUP BY i)
SELECT ds.i AS doc_id, bs.i AS item_id, any_value(n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_shared,
  count(*)::DOUBLE / any_value(n_item) AS containment
FROM ds JOIN bs ON ds.s = bs.s AND ds.size = bs.size JOIN n ON n.i = bs.i
GROUP BY ds.i, bs.i HAVING count(*)::DOUBLE / any_value(n_item) >= 0.8
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"))
    model = toxicity.fit(docs.filter(~out), table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~out))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


#: The contract's rules (fixed values).
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = spark.createDataFrame(URL_RULES, "rule string, action string")
    return urlfilter.filter_urls(pages, listed, default="allow").select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH p AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r (h, q, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT p.*, h || q AS rule, r.verdict FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM m GROUP BY page_id, host, path
"""


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secretscan.scan(docs)
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secretscan.joined(base).cast("binary"), 256).alias("base_sha256"), secretscan.joined(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))


#: The operator's patterns, written for an engine whose case folding knows more letters than A-Z.
_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_SECRET_KINDS = {
    "assign": (rf"""(?:{_ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
    "live": ("[A-Za-z0-9+/_-]{20,}", 0, 20),
}
_SECRET_PARTS = " UNION ALL ".join(f"""
SELECT doc_id, source, t, {i} AS kind, '{name}' AS name, {least} AS least, regexp_extract_all(t, '{pattern}') AS m,
  regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g FROM d"""
                                   for i, (name, (pattern, group, least)) in enumerate(_SECRET_KINDS.items()))
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
parts AS ({_SECRET_PARTS}),
each AS (SELECT doc_id, source, t, kind, name, least, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS gap, unnest(range(len(m))) AS i
  FROM parts WHERE len(m) > 0),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM each),
spans AS (SELECT doc_id, source, t, kind, name, v, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM placed
  WHERE length(v) >= least AND (kind < 3 OR regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]'))),
texts AS (SELECT v, t, first(coalesce('s' || source, '') ORDER BY doc_id) AS owner FROM spans GROUP BY v, t),
known AS (SELECT v, count(*) <= {secretscan.MAX_REPOSITORIES} AND count(DISTINCT owner) <= {secretscan.MAX_OWNERS} AS live FROM texts GROUP BY v),
shown AS (SELECT s.*, k.live, concat_ws(':', s.name, s.start, s.stop) AS item FROM spans s JOIN known k USING (v)
  WHERE s.kind < 3 OR (k.live AND NOT EXISTS (SELECT 1 FROM spans b
    WHERE b.doc_id = s.doc_id AND b.kind < 3 AND b.start < s.stop AND s.start < b.stop))),
per AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS k, count(*) FILTER (WHERE kind = 2) AS h,
  string_agg(item, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(item, ',' ORDER BY start, kind) AS spans,
  count(*) FILTER (WHERE live) AS n_live FROM shown GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN per USING (doc_id)"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of labelled documents: 2 if the quality is 1, a half if it is 0."""
    q = F.col("quality")
    return table(spark, sf_dir, "labels").select("doc_id", F.when(q == 1, 2.0).when(q == 0, 0.5).otherwise(1.0).alias("weight"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    planned = mixing.plan(docs, quality_weights(spark, sf_dir), ratio=1.5, weights=(5, 2, 1), max_epochs=2.0, seed=1)
    return planned.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  CASE q.q WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS quality
  FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce(w * max(CASE WHEN level * w <= cap THEN level END) OVER (), cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
k AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest,
  -ln((('0x' || substr(md5('1:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / quality AS key
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN source_size > 0 AND
  sum(size) OVER (PARTITION BY source ORDER BY key, doc_id) - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM k
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = linededup.keep_bitmaps(docs, min_docs=10, min_chars=1)
    return linededup.with_kept_sha256(marked).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


#: A-Z lower-cased and ASCII white space stripped, as in the operator.
_LINE_KEY = """translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

OP9_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT doc_id, pos, line, {_LINE_KEY} AS line_key FROM lines),
common AS (SELECT line_key FROM keyed WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(c.line_key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY pos) FILTER (WHERE c.line_key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.line_key = c.line_key GROUP BY k.doc_id
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = quality.judge(docs, quality.fit_references(docs))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reference",
                        "char_distance", "word_distance")


def _term(p: str, q: str) -> str:
    """What a class with shares p and q adds to the Jensen-Shannon divergence, in SQL."""
    m = f"((({p}) + ({q})) / 2)"
    return " + ".join(f"(CASE WHEN ({x}) > 0 THEN ({x}) * log2(({x}) / {m}) / 2 ELSE 0.0 END)" for x in (p, q))


def _noise(k: str, n: str) -> str:
    return f"({k} - 1) / (8 * ln(2.0::DOUBLE) * {n})"


OP11_SQL = rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, text IS NOT NULL AS has, lang FROM documents),
d AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}]+'), lambda x: x <> '') AS v,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM a),
win AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win),
  (VALUES (0), (1), (2)) x (k) WHERE c > 1 GROUP BY doc_id),
s1 AS (SELECT doc_id, t, regexp_replace(t, '\p{{Ll}}+', '', 'g') AS t1 FROM d),
s2 AS (SELECT *, regexp_replace(t1, '[\x20\x09-\x0D]+', '', 'g') AS t2 FROM s1),
s3 AS (SELECT *, regexp_replace(t2, '\p{{Lu}}+', '', 'g') AS t3 FROM s2),
s4 AS (SELECT *, regexp_replace(t3, '[\p{{L}}\p{{M}}]+', '', 'g') AS t4 FROM s3),
s5 AS (SELECT *, regexp_replace(t4, '\p{{N}}+', '', 'g') AS t5 FROM s4),
s6 AS (SELECT *, regexp_replace(t5, '\p{{P}}+', '', 'g') AS t6 FROM s5),
cl AS (SELECT doc_id, length(t) AS size, [length(t) - length(t1), length(t1) - length(t2), length(t2) - length(t3), length(t3) - length(t4),
  length(t4) - length(t5), length(t5) - length(t6), length(t6)] AS c FROM s6),
b AS (SELECT d.doc_id, lang, has, v, size, c, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d JOIN cl USING (doc_id) LEFT JOIN rep USING (doc_id)),
tot AS (SELECT lang, sum(len(v)) AS n, [sum(c[1]), sum(c[2]), sum(c[3]), sum(c[4]), sum(c[5]), sum(c[6]), sum(c[7])] AS c
  FROM b WHERE lang IS NOT NULL AND has GROUP BY lang),
known AS (SELECT lang AS ref, n, list_transform(c, lambda x: x / list_sum(c)) AS q FROM (SELECT *, sum(n) OVER () AS total FROM tot)
  WHERE n >= total / {quality.LANGUAGES} AND n >= {quality.MIN_REFERENCE}),
words AS (SELECT doc_id, lang, word, count(*) AS m FROM (SELECT doc_id, lang, unnest(v) AS word FROM b) GROUP BY ALL),
common AS (SELECT ref, word, sum(m) / any_value(n) AS q FROM words JOIN known ON lang = ref GROUP BY ref, word
  HAVING sum(m) >= any_value(n) / {quality.COMMON}),
other AS (SELECT ref, count(word) AS k, greatest(0.0, 1 - coalesce(sum(common.q), 0)) AS rest FROM known LEFT JOIN common USING (ref) GROUP BY ref),
cand AS (SELECT b.doc_id, b.size, b.c, len(b.v) AS nv, known.ref, known.q, k, rest FROM b JOIN known ON b.lang = known.ref OR b.lang IS NULL JOIN other USING (ref)),
seen AS (SELECT cand.doc_id, cand.ref, sum({_term("m / nv", "common.q")} - common.q / 2) AS part, sum(m) AS n
  FROM cand JOIN words USING (doc_id) JOIN common ON common.ref = cand.ref AND common.word = words.word GROUP BY ALL),
div AS (SELECT doc_id, ref, size, nv, k,
  CASE WHEN size >= {quality.MIN_CHARS_JUDGED} THEN list_sum(list_transform(range(1, 8), lambda i: {_term("c[i] / size", "q[i]")})) END AS cd,
  CASE WHEN nv >= {quality.MIN_WORDS_JUDGED} THEN coalesce(part, 0) + {_term("1 - coalesce(seen.n, 0) / nv", "rest")} - rest / 2 + 0.5 END AS wd
  FROM cand LEFT JOIN seen USING (doc_id, ref)),
ex AS (SELECT *, coalesce(cd / ({quality.MAX_CHAR_DIVERGENCE} + {_noise("7", "size")}), 0)
  + coalesce(wd / ({quality.MAX_WORD_DIVERGENCE} + {_noise("(k + 1)", "nv")}), 0) AS excess FROM div),
best AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY excess, ref) = 1),
j AS (SELECT b.*, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(excess <= 1, true) AS kept,
  ref AS reference, round(sqrt(CASE WHEN cd < 0 THEN 0 ELSE cd END), 6) AS char_distance, round(sqrt(CASE WHEN wd < 0 THEN 0 ELSE wd END), 6) AS word_distance
FROM j LEFT JOIN best USING (doc_id)
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    # one document in ten gets a periodic end (the contract's edit); the others keep their text
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    cut = docs.withColumns({"g": g, "w": words}).withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail, times = F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    edited = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(F.flatten(F.array_repeat(tail, times)), F.lit(1), F.col("n") - F.col("a")))
    docs = cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))
    found = runs.periodic_runs(docs, keep=["doc_id"])
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    ranked = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    return (found.withColumn("top", ranked).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.s").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.p").alias("period"),
        F.floor(F.lit(1000) * -F.col("top.l") / F.col("top.p")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


def _crc32(text: str) -> str:
    """crc32 of a text in SQL: bit by bit over its UTF-8 bytes."""
    octets = f"list_transform(range(strlen({text})), lambda p: ('0x' || substr(hex({text}), 2 * p + 1, 2))::BIGINT)"
    octet = "list_reduce(list_prepend(xor(c, b), range(8)), lambda z, s: xor(z >> 1, 3988292384 * (z & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {octet}))"


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  {_crc32("doc_id::VARCHAR")} AS h FROM documents),
x AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM d),
y AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM x),
z AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM y),
e AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END])
  ELSE w END AS w FROM z),
six AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 5)) AS i FROM e)),
apart AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM six l JOIN six r ON l.doc_id = r.doc_id AND l.s = r.s AND r.i > l.i),
isle AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM apart),
many AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM isle GROUP BY doc_id, q, k HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
r AS (SELECT * FROM many m WHERE NOT EXISTS (SELECT 1 FROM many o WHERE o.doc_id = m.doc_id AND o.q < m.q AND o.start <= m.start
  AND o.start + o.length >= m.start + m.length)),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM e),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
sums AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS t FROM r GROUP BY doc_id),
top AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, q) = 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, top.length::BIGINT AS length, top.q::BIGINT AS period,
  (1000 * top.length // top.q)::BIGINT AS exponent_milli, sha256(coalesce(sums.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM e LEFT JOIN sums USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's edit: a run loses a letter if this number divides its hash.
LETTER_LOSS = 199


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", UPPER, LOWER).alias("t"))
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("t", F.lit("[a-z\u00C0-\u00FF]+"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))  # null for a null id: no edit
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.filter(F.length("run") >= 6).select(F.when(h % LETTER_LOSS == 0, shorter).otherwise(F.col("run")).alias("word"))
    return variants.group(variants.count_words(words, min_chars=6, min_count=5), ratio=5)


OP13_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT i, run, count(*) AS k FROM (SELECT doc_id AS i, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY i, run),
h AS (SELECT run, k, {_crc32("(i || ':' || run)")} AS h FROM r),
e AS (SELECT CASE WHEN h % {LETTER_LOSS} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
m AS (SELECT word, n, p, word[:p - 1] || '?' || word[p + 1:] AS mask, word[:p - 1] || word[p + 1:] AS gone
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
g AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM m a JOIN m b ON a.mask = b.mask AND a.word <> b.word
  UNION SELECT m.word, w.word, w.n FROM m JOIN w ON m.gone = w.word UNION SELECT w.word, m.word, m.n FROM m JOIN w ON m.gone = w.word),
f AS (SELECT word, w.n, count(b)::BIGINT AS n_near, arg_max(b, (g.n, -o)) AS best, max(g.n) AS top
  FROM w LEFT JOIN (SELECT *, row_number() OVER (ORDER BY b) AS o FROM g) g ON a = word GROUP BY word, w.n),
s AS (SELECT word, n, n_near, CASE WHEN top >= 5 * n THEN best END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n FROM f),
u AS (SELECT word, word AS root, form AS up FROM s
  UNION ALL SELECT u.word, s.word, s.form FROM u JOIN s ON u.up = s.word)
SELECT s.word, s.form, u.root, s.n, s.n_near, s.form_n FROM s JOIN u ON u.word = s.word AND u.up IS NULL
"""


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_secret_scan": op5_secret_scan,
    "op6_mixing": op6_mixing,
    "op7_fingerprints": op7_fingerprints,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_quality_rules": op11_quality_rules,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op4_url_filter": OP4_SQL,
    "op5_secret_scan": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_quality_rules": OP11_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
