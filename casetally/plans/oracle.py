"""ANSI SQL (DuckDB dialect) equivalents of the registered queries.

Written independently of the Spark code from the stated semantics; used by
the driver's correctness gate and by ``tools/check_oracle.py``. Integer sums
and counts are cast to BIGINT, years to INTEGER, division by zero is NULL.
"""

from __future__ import annotations

CASES = """
cases AS (
  SELECT o.o_orderkey AS row_key, o.o_custkey AS person, n.n_name AS state,
         CAST(year(o.o_orderdate) AS INTEGER) AS year,
         CASE WHEN o.o_orderstatus = 'P' AND o.o_orderpriority = '5-LOW' THEN NULL
              ELSE CAST(o.o_orderdate AS DATE) END AS rptdt,
         o.o_orderpriority = '1-URGENT' AS medical,
         CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND o.o_orderstatus <> 'F' THEN NULL
              ELSE c.c_mktsegment END AS race_ethn,
         CASE WHEN o.o_orderstatus = 'F' THEN TRUE WHEN o.o_orderstatus = 'O' THEN FALSE END AS ipse,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS chmal1,
         CASE WHEN o.o_orderstatus = 'O' THEN 2 WHEN o.o_orderstatus = 'F' THEN 6 END AS chmal2,
         CASE WHEN o.o_totalprice >= 400000 THEN 4 END AS chmal3,
         CASE WHEN day(o.o_orderdate) = 1 THEN 3 END AS chmal4
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

POP = """
pop AS (
  SELECT n.n_name AS state, c.c_mktsegment AS race_ethn, count(*) AS pop
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY n.n_name, c.c_mktsegment)"""

LINES = """
lines AS (
  SELECT l.*, n.n_name AS unit, CAST(year(l.l_shipdate) AS INTEGER) AS year
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

# four code slots for the three-valued flag
SLOTS_SQL = """
  CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 2 END AS s1,
  CASE WHEN l_linestatus = 'O' THEN 2 WHEN l_quantity > 45 THEN 1 ELSE 9 END AS s2,
  CASE WHEN l_discount = 0.1 THEN 1 WHEN l_discount = 0.0 THEN NULL ELSE 9 END AS s3,
  CASE WHEN l_tax = 0.08 THEN 1 WHEN l_tax = 0.0 THEN 2 END AS s4"""

TRI_SQL = """CASE WHEN s1 = 1 OR s2 = 1 OR s3 = 1 OR s4 = 1 THEN TRUE
             WHEN s1 = 2 OR s2 = 2 OR s3 = 2 OR s4 = 2 THEN FALSE END"""

TYPE_SLOTS_SQL = """
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS m1,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(round(l_discount * 100) AS INTEGER) % 6 + 1 END AS m2,
  CASE WHEN l_quantity > 30 THEN CAST(l_quantity AS INTEGER) % 7 + 1 END AS m3,
  CASE WHEN l_tax >= 0.07 THEN 4 WHEN l_tax = 0.0 THEN 5 END AS m4"""

TYPE_FLAGS_SQL = """
  (m1 = 1 OR m2 = 1 OR m3 = 1 OR m4 = 1) AS phy_abuse,
  (m1 IN (2, 3) OR m2 IN (2, 3) OR m3 IN (2, 3) OR m4 IN (2, 3)) AS neglect,
  (m1 = 4 OR m2 = 4 OR m3 = 4 OR m4 = 4) AS sex_abuse,
  (m1 > 4 OR m2 > 4 OR m3 > 4 OR m4 > 4) AS other"""


def rate(n: str, pop: str = "pop") -> str:
    return f"CAST({n} AS DOUBLE) / NULLIF(CAST({pop} AS DOUBLE), 0) * 1000.0"


def ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


FLAG_SUMS = f"""
fs_slots AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_linestatus, {TYPE_SLOTS_SQL} FROM lineitem),
fs_flags AS (SELECT year, l_linestatus, {TYPE_FLAGS_SQL} FROM fs_slots),
flag_sums AS (
  SELECT year, l_linestatus,
         CAST(count(*) FILTER (WHERE phy_abuse) AS BIGINT) AS phy_abuse, CAST(count(*) FILTER (WHERE neglect) AS BIGINT) AS neglect,
         CAST(count(*) FILTER (WHERE sex_abuse) AS BIGINT) AS sex_abuse, CAST(count(*) FILTER (WHERE other) AS BIGINT) AS other
  FROM fs_flags GROUP BY year, l_linestatus)"""

# (year, state, group) counts pooled over the five priority codes, completed
# with zeros for absent codes; joined to the population NULL-safely.
POOLED_UNITS = f"""
pu_counts AS (SELECT year, state, race_ethn, chmal1, count(*) AS n FROM cases GROUP BY ALL),
pu_pooled AS (
  SELECT year, state, race_ethn,
         CAST(sum(n) AS BIGINT) / 5.0 AS n_mn,
         CAST(CASE WHEN count(*) < 5 THEN 0 ELSE min(n) END AS BIGINT) AS n_min,
         CAST(max(n) AS BIGINT) AS n_max
  FROM pu_counts GROUP BY year, state, race_ethn),
pooled_units AS (
  SELECT p.year, p.state, p.race_ethn, p.n_mn, p.n_min, p.n_max, pop.pop
  FROM pu_pooled p LEFT JOIN pop ON p.state IS NOT DISTINCT FROM pop.state
                              AND p.race_ethn IS NOT DISTINCT FROM pop.race_ethn)"""

STRICT = "CASE WHEN count(*) FILTER (WHERE {c} IS NULL) > 0 THEN NULL ELSE sum({c}) END"

WITH_TOTALS = f"""
tot_base AS (
  SELECT year, state, race_ethn, n_mn, n_min, n_max, pop FROM pooled_units
  UNION ALL
  SELECT year, state, 'Total' AS race_ethn,
         {STRICT.format(c='n_mn')} AS n_mn,
         CAST({STRICT.format(c='n_min')} AS BIGINT) AS n_min,
         CAST({STRICT.format(c='n_max')} AS BIGINT) AS n_max,
         CAST({STRICT.format(c='pop')} AS BIGINT) AS pop
  FROM pooled_units GROUP BY year, state),
with_totals AS (
  SELECT *, {rate('n_mn')} AS r_mn, {rate('n_min')} AS r_min, {rate('n_max')} AS r_max
  FROM tot_base)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


SQL: dict[str, str] = {}

SQL["rate_per_1000"] = with_(CASES, POP, """
counts AS (SELECT year, coalesce(race_ethn, 'UNKNOWN') AS race_ethn, medical, count(*) AS n
           FROM cases GROUP BY ALL)""", """
pop_g AS (SELECT race_ethn, CAST(sum(pop) AS BIGINT) AS pop FROM pop GROUP BY race_ethn)""") + f"""
SELECT c.year, c.race_ethn, c.medical, c.n, p.pop, {rate('c.n', 'p.pop')} AS rate
FROM counts c LEFT JOIN pop_g p ON c.race_ethn = p.race_ethn"""

SQL["project_basic"] = """
SELECT o_orderkey AS orderkey, o_custkey AS custkey,
       CAST(year(o_orderdate) AS INTEGER) AS order_year,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio_code,
       CAST(round(o_totalprice * 100) AS BIGINT) AS price_cents,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) = 1 AS prio_urgent
FROM orders"""

SQL["sentinel_recode"] = """
WITH r AS (
  SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS line_code,
         CASE WHEN l_linenumber = 6 THEN 0 ELSE l_linenumber END AS line_swap,
         CASE WHEN CAST(l_quantity AS INTEGER) > 45 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS qty_capped,
         coalesce(CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 2 END, 99) AS flag_code,
         l_linenumber = 1 AS is_first
  FROM lineitem)
SELECT line_code, line_swap, flag_code, is_first, count(*) AS n,
       CAST(count(*) FILTER (WHERE qty_capped IS NULL) AS BIGINT) AS n_qty_missing,
       CAST(sum(qty_capped) AS BIGINT) AS sum_qty
FROM r GROUP BY ALL"""

SQL["recode_ladder"] = """
WITH j AS (
  SELECT CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS code, n.n_regionkey + 1 AS race,
         CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END AS hisp
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey),
r AS (
  SELECT CASE WHEN code = 1 THEN 'urgent' WHEN code = 2 THEN 'high' WHEN code = 3 THEN 'medium'
              WHEN code <> 5 THEN 'unclassified' END AS prio_class,
         CASE WHEN race = 1 AND hisp = 0 THEN 'White' WHEN race = 2 THEN 'Black'
              WHEN race = 3 THEN 'AIAN' WHEN race = 4 THEN 'Asian/PI' WHEN hisp = 1 THEN 'Latinx' END AS pop_group
  FROM j)
SELECT prio_class, pop_group, count(*) AS n FROM r GROUP BY ALL"""

INDICATORS = """
ind AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 END AS bl,
         CASE WHEN l_linenumber = 1 THEN 1 WHEN l_linenumber = 7 THEN NULL ELSE 0 END AS ai,
         CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END AS asn,
         CASE WHEN l_tax = 0.0 THEN 1 WHEN l_tax = 0.08 THEN NULL ELSE 0 END AS nh,
         CASE WHEN l_quantity <= 5 THEN 1 ELSE 0 END AS eth,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS wh
  FROM lineitem)"""

SQL["priority_group"] = with_(INDICATORS, """
g AS (SELECT CASE WHEN bl = 1 THEN 'Black' WHEN ai = 1 THEN 'AIAN'
                  WHEN asn = 1 OR nh = 1 THEN 'Asian/PI' WHEN eth = 1 THEN 'Latinx'
                  WHEN wh = 1 THEN 'White' END AS race_ethn FROM ind)""") + """
SELECT race_ethn, count(*) AS n FROM g GROUP BY ALL"""

SQL["priority_group_strict"] = with_(INDICATORS, """
g AS (SELECT
  CASE WHEN bl IS NULL THEN NULL WHEN bl = 1 THEN 'Black' ELSE
   CASE WHEN ai IS NULL THEN NULL WHEN ai = 1 THEN 'AIAN' ELSE
    CASE WHEN (asn = 1 OR nh = 1) IS NULL THEN NULL WHEN asn = 1 OR nh = 1 THEN 'Asian/PI' ELSE
     CASE WHEN eth IS NULL THEN NULL WHEN eth = 1 THEN 'Latinx' ELSE
      CASE WHEN wh IS NULL THEN NULL WHEN wh = 1 THEN 'White' ELSE NULL END END END END END AS race_ethn
  FROM ind)""") + """
SELECT race_ethn, count(*) AS n FROM g GROUP BY ALL"""

SQL["any_flag_tri"] = f"""
WITH s AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, {SLOTS_SQL} FROM lineitem)
SELECT year, {TRI_SQL} AS flag, count(*) AS n FROM s GROUP BY ALL"""

SQL["multi_slot_flags"] = f"""
WITH s AS (SELECT {TYPE_SLOTS_SQL} FROM lineitem), f AS (SELECT {TYPE_FLAGS_SQL} FROM s)
SELECT phy_abuse, neglect, sex_abuse, other, count(*) AS n FROM f GROUP BY ALL"""

SQL["flag_sums"] = with_(FLAG_SUMS) + "\nSELECT * FROM flag_sums"

SQL["unpivot_types"] = with_(FLAG_SUMS) + """
SELECT year, l_linestatus, 'phy_abuse' AS type, phy_abuse AS n FROM flag_sums
UNION ALL SELECT year, l_linestatus, 'neglect', neglect FROM flag_sums
UNION ALL SELECT year, l_linestatus, 'sex_abuse', sex_abuse FROM flag_sums
UNION ALL SELECT year, l_linestatus, 'other', other FROM flag_sums"""

SQL["filter_mix"] = """
SELECT o_orderkey, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
   OR (CAST(year(o_orderdate) AS INTEGER) > 1999 AND o_totalprice <= 100000)"""

CASES_NS = CASES + """,
cases_ns AS (SELECT * REPLACE (CASE WHEN state = 'NATION_3' THEN NULL ELSE state END AS state) FROM cases)"""

SQL["exclude_set"] = with_(CASES_NS) + """
SELECT state, count(*) AS n FROM cases_ns
WHERE NOT coalesce(state IN ('NATION_1', 'NATION_2'), FALSE) GROUP BY state"""

DEDUP_BASE = CASES_NS + """,
dd AS (SELECT concat_ws('', coalesce(state, 'NA'), CAST(person AS VARCHAR)) AS st_id, year, row_key, rptdt
       FROM cases_ns)"""

SQL["dedup_first"] = with_(DEDUP_BASE) + """
SELECT st_id, year, row_key, rptdt FROM (
  SELECT *, row_number() OVER (PARTITION BY st_id, year ORDER BY rptdt ASC NULLS LAST, row_key ASC) AS rn
  FROM dd) WHERE rn = 1"""

SQL["dedup_latest"] = with_(DEDUP_BASE) + """
SELECT st_id, year, row_key, rptdt FROM (
  SELECT *, row_number() OVER (PARTITION BY st_id, year ORDER BY rptdt DESC NULLS LAST, row_key ASC) AS rn
  FROM dd) WHERE rn = 1"""

SQL["first_event_index"] = with_(CASES, """
idx AS (SELECT person, min(row_key) AS row_key FROM cases GROUP BY person)""", """
kept AS (SELECT * FROM cases c WHERE EXISTS (
  SELECT 1 FROM idx i WHERE i.person = c.person AND i.row_key = c.row_key))""") + """
SELECT person, row_key, year FROM (
  SELECT *, row_number() OVER (PARTITION BY person ORDER BY rptdt ASC NULLS LAST, row_key ASC) AS rn
  FROM kept) WHERE rn = 1"""

SQL["distinct_keys"] = with_(CASES_NS) + "\nSELECT DISTINCT state, year FROM cases_ns"

SQL["assert_unique"] = """
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys,
       CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS n_dup_keys,
       CAST(coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0) AS BIGINT) AS n_extra_rows
FROM k"""

SQL["natural_join"] = with_(CASES_NS, POP, """
lft AS (SELECT state, race_ethn, year, count(*) AS n FROM cases_ns GROUP BY ALL)""", """
rgt AS (SELECT CASE WHEN state = 'NATION_3' THEN NULL ELSE state END AS state,
               CASE WHEN race_ethn = 'HOUSEHOLD' THEN NULL ELSE race_ethn END AS race_ethn,
               pop FROM pop)""", """
rgt2 AS (SELECT state, race_ethn, CAST(sum(pop) AS BIGINT) AS pop FROM rgt GROUP BY ALL)""") + """
SELECT l.state, l.race_ethn, l.year, l.n, r.pop
FROM lft l LEFT JOIN rgt2 r ON l.state IS NOT DISTINCT FROM r.state
                           AND l.race_ethn IS NOT DISTINCT FROM r.race_ethn"""

SQL["group_count"] = with_(CASES) + """
SELECT race_ethn, medical, count(*) AS n FROM cases GROUP BY ALL"""

SQL["strict_sum"] = """
WITH q AS (SELECT l_orderkey, CASE WHEN l_discount = 0.0 THEN NULL ELSE l_quantity END AS qty FROM lineitem)
SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE qty IS NULL) > 0 THEN NULL ELSE sum(qty) END AS qty_strict,
       sum(qty) AS qty_loose
FROM q GROUP BY l_orderkey"""

QUALITY = LINES + f""",
q_slots AS (SELECT unit, year, {SLOTS_SQL} FROM lines),
q_flag AS (SELECT unit, year, {TRI_SQL} AS flag FROM q_slots),
quality AS (
  SELECT unit, year,
         CAST(count(*) FILTER (WHERE flag IS NULL) AS DOUBLE) / count(*) AS prop_missing,
         CAST(count(*) FILTER (WHERE flag) AS DOUBLE) / count(*) AS share_true,
         CAST(count(*) FILTER (WHERE flag) AS BIGINT) AS n_true
  FROM q_flag GROUP BY unit, year),
quality_f AS (
  SELECT *, prop_missing <= 0.15 AND share_true >= 0.42 AS flag_1 FROM quality
  WHERE NOT coalesce(unit IN ('NATION_0', 'NATION_1'), FALSE))"""

SQL["quality_flags"] = with_(QUALITY) + "\nSELECT * FROM quality_f"

SQL["quality_gate"] = with_(QUALITY) + """
SELECT l.unit, l.year, count(*) AS n FROM lines l
WHERE EXISTS (SELECT 1 FROM quality_f q WHERE q.flag_1 AND q.unit = l.unit AND q.year = l.year)
GROUP BY l.unit, l.year"""

TOTALS = (CASES, POP, POOLED_UNITS, WITH_TOTALS)

SQL["total_rows"] = with_(*TOTALS) + """
SELECT year, state, race_ethn, round(n_mn, 6) AS n_mn, n_min, n_max, pop, round(r_mn, 6) AS r_mn, r_min, r_max
FROM with_totals"""

SQL["ratio_of_sums"] = with_(*TOTALS) + f"""
SELECT race_ethn, round({rate('sum(n_mn)', 'sum(pop)')}, 6) AS rate
FROM with_totals WHERE year = 2000 GROUP BY race_ethn"""

SQL["callout_totals"] = with_(*TOTALS) + """
SELECT year, race_ethn, round(sum(n_mn), 6) AS n_mean, CAST(sum(n_min) AS BIGINT) AS n_min,
       CAST(sum(n_max) AS BIGINT) AS n_max
FROM with_totals GROUP BY year, race_ethn"""

SQL["disparity"] = with_(*TOTALS, """
ref AS (SELECT year, state, r_mn AS wht_mn, r_min AS wht_min, r_max AS wht_max
        FROM with_totals WHERE race_ethn = 'BUILDING')""") + f"""
SELECT t.*, r.wht_mn, r.wht_min, r.wht_max,
       {ratio('t.r_mn', 'r.wht_mn')} AS d, {ratio('t.r_min', 'r.wht_max')} AS d_min,
       {ratio('t.r_max', 'r.wht_min')} AS d_max,
       CASE WHEN {ratio('t.r_min', 'r.wht_max')} > 1 THEN 'Greater than reference rate'
            WHEN NOT ({ratio('t.r_min', 'r.wht_max')} > 1) THEN 'Less than or equal to reference rate'
       END AS grt1
FROM with_totals t LEFT JOIN ref r ON t.year = r.year AND t.state = r.state
WHERE t.race_ethn NOT IN ('BUILDING', 'Total') AND t.race_ethn IS NOT NULL"""

SQL["share_pivot"] = with_(POP, """
sh AS (SELECT state, race_ethn, CAST(pop AS DOUBLE) / NULLIF(sum(pop) OVER (PARTITION BY state), 0) * 100.0 AS pct
       FROM pop)""") + """
SELECT state,
       max(CASE WHEN race_ethn = 'AUTOMOBILE' THEN pct END) AS pct_auto,
       max(CASE WHEN race_ethn = 'FURNITURE' THEN pct END) AS pct_FURNITURE,
       max(CASE WHEN race_ethn = 'HOUSEHOLD' THEN pct END) AS pct_HOUSEHOLD,
       max(CASE WHEN race_ethn = 'MACHINERY' THEN pct END) AS pct_mach
FROM sh GROUP BY state"""

SQL["union_by_name"] = with_(CASES, LINES) + """
SELECT state, year, count(*) AS n_orders, CAST(NULL AS BIGINT) AS n_lines FROM cases GROUP BY ALL
UNION ALL
SELECT unit AS state, year, CAST(NULL AS BIGINT) AS n_orders, count(*) AS n_lines FROM lines GROUP BY ALL"""

SQL["complete_zero"] = with_(CASES, """
cnt AS (SELECT state, race_ethn, chmal1, year, count(*) AS n FROM cases GROUP BY ALL)""", """
grid AS (SELECT * FROM (SELECT DISTINCT state FROM cases) CROSS JOIN (SELECT DISTINCT race_ethn FROM cases)
         CROSS JOIN (SELECT DISTINCT chmal1 FROM cases) CROSS JOIN (SELECT DISTINCT year FROM cases))""") + """
SELECT g.state, g.race_ethn, g.chmal1, g.year, coalesce(c.n, 0) AS n
FROM grid g LEFT JOIN cnt c ON g.state IS NOT DISTINCT FROM c.state AND g.race_ethn IS NOT DISTINCT FROM c.race_ethn
 AND g.chmal1 IS NOT DISTINCT FROM c.chmal1 AND g.year IS NOT DISTINCT FROM c.year"""

SQL["rank_order"] = with_(*TOTALS, """
t AS (SELECT * FROM with_totals WHERE year = 2000)""", """
ord AS (SELECT state, CAST(row_number() OVER (ORDER BY round(r_mn, 9) ASC NULLS LAST, state ASC NULLS LAST) AS INTEGER) AS ord
        FROM t WHERE race_ethn = 'Total')""") + """
SELECT t.state, t.race_ethn, round(t.r_mn, 6) AS r_mn, o.ord FROM t JOIN ord o ON t.state = o.state"""

SQL["ordered_levels"] = with_(*TOTALS) + """
SELECT state, race_ethn,
       CASE WHEN race_ethn = 'Total' THEN 1 WHEN race_ethn = 'AUTOMOBILE' THEN 2 WHEN race_ethn = 'BUILDING' THEN 3
            WHEN race_ethn = 'FURNITURE' THEN 4 WHEN race_ethn = 'HOUSEHOLD' THEN 5
            WHEN race_ethn = 'MACHINERY' THEN 6 END AS group_ord
FROM with_totals WHERE year = 2000"""

SQL["full_panel"] = with_(CASES, POP, POOLED_UNITS, """
per_unit AS (SELECT state, count(*) AS n FROM pooled_units GROUP BY state)""") + """
SELECT year, state, race_ethn, n_mn, n_min, n_max, pop FROM pooled_units
WHERE state IN (SELECT state FROM per_unit WHERE n = (SELECT max(n) FROM per_unit))
  AND state <> 'NATION_5'"""

SQL["fwf_roundtrip"] = """
WITH c AS (SELECT c_custkey, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer),
p AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 18, '0') || lpad(CAST(c_nationkey AS VARCHAR), 2, '0')
             || CASE WHEN cents < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(cents) AS VARCHAR), 9, '0') AS value
      FROM c)
SELECT CAST(substr(value, 1, 18) AS BIGINT) AS c_custkey, CAST(substr(value, 19, 2) AS INTEGER) AS c_nationkey,
       CASE WHEN substr(value, 21, 1) = '-' THEN -CAST(substr(value, 22, 9) AS BIGINT)
            ELSE CAST(substr(value, 22, 9) AS BIGINT) END AS bal_cents
FROM p"""


# ---------------------------------------------------------------- imputation
# Oracles use the plain long form: every record repeated m times, draws
# attached, then counted. The Spark side avoids replicating observed records;
# equal results check that shortcut.

M, SEED = 10, 57
U32 = 4294967296
IMPS = f"(SELECT CAST(unnest(generate_series(1, {M})) AS INTEGER) AS imp)"


def u_sql(row_key: str, imp: str, target: str) -> str:
    text = (f"concat_ws('|', CAST({SEED} AS VARCHAR), CAST({row_key} AS VARCHAR), "
            f"CAST({imp} AS VARCHAR), '{target}', '0')")
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def hotdeck_ctes(t: str, src: str) -> str:
    """Draws of target ``t`` for rows of ``src`` where it is missing.

    Cells (state, year), then (state), then the whole table; within a cell the
    value whose cumulative count range contains u / 2^32 of the total.
    """
    def dist(name, keys):
        k = ", ".join(keys)
        part = f"PARTITION BY {k} " if keys else ""
        sel = f"{k}, " if keys else ""
        return f"""
{name}_c AS (SELECT {sel}{t} AS v, count(*) AS cnt FROM {src} WHERE {t} IS NOT NULL GROUP BY ALL),
{name} AS (SELECT {sel}v, cnt,
       CAST(sum(cnt) OVER ({part}ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hi,
       CAST(sum(cnt) OVER ({part.strip()}) AS BIGINT) AS tot FROM {name}_c)"""

    def rng(a):
        return (f"({a}.hi - {a}.cnt) * {U32} <= m.u * {a}.tot AND m.u * {a}.tot < {a}.hi * {U32}")

    return ",".join([
        dist(f"{t}_d0", ["state", "year"]), dist(f"{t}_d1", ["state"]), dist(f"{t}_d2", []),
        f"""
{t}_m AS (SELECT s.row_key, s.state, s.year, g.imp, {u_sql('s.row_key', 'g.imp', t)} AS u
          FROM {src} s CROSS JOIN {IMPS} g WHERE s.{t} IS NULL),
{t}_draw AS (
  SELECT m.row_key, m.imp, coalesce(a.v, b.v, z.v) AS v FROM {t}_m m
  LEFT JOIN {t}_d0 a ON a.state = m.state AND a.year = m.year AND {rng('a')}
  LEFT JOIN {t}_d1 b ON b.state = m.state AND {rng('b')}
  LEFT JOIN {t}_d2 z ON {rng('z')})"""])


def long_cte(src: str, name: str = "long") -> str:
    return hotdeck_ctes("race_ethn", src) + "," + hotdeck_ctes("ipse", src) + f""",
{name} AS (
  SELECT c.* REPLACE (coalesce(c.race_ethn, r.v) AS race_ethn, coalesce(c.ipse, i.v) AS ipse), g.imp
  FROM {src} c CROSS JOIN {IMPS} g
  LEFT JOIN race_ethn_draw r ON r.row_key = c.row_key AND r.imp = g.imp
  LEFT JOIN ipse_draw i ON i.row_key = c.row_key AND i.imp = g.imp)"""


POPY = """
popy AS (
  SELECT year, state, race_ethn, count(*) AS pop FROM (
    SELECT DISTINCT CAST(year(o.o_orderdate) AS INTEGER) AS year, n.n_name AS state,
           c.c_mktsegment AS race_ethn, o.o_custkey
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey) GROUP BY ALL)"""

SQL["impute_hotdeck"] = with_(CASES, hotdeck_ctes("ipse", "cases")) + """
SELECT row_key, imp, v AS ipse FROM ipse_draw"""

SQL["impute_complete_long"] = with_(CASES, hotdeck_ctes("ipse", "cases")) + f"""
SELECT c.row_key, g.imp, coalesce(c.ipse, d.v) AS ipse
FROM cases c CROSS JOIN {IMPS} g LEFT JOIN ipse_draw d ON d.row_key = c.row_key AND d.imp = g.imp"""

SQL["pool_imputations"] = with_(CASES, hotdeck_ctes("ipse", "cases"), f"""
lng AS (SELECT c.state, c.year, coalesce(c.ipse, d.v) AS ipse, g.imp
        FROM cases c CROSS JOIN {IMPS} g LEFT JOIN ipse_draw d ON d.row_key = c.row_key AND d.imp = g.imp)""", """
cnt AS (SELECT state, year, ipse, imp, count(*) AS n FROM lng GROUP BY ALL)""") + """
SELECT state, year, ipse, CAST(sum(n) AS DOUBLE) / count(*) AS n_mean, min(n) AS n_min, max(n) AS n_max
FROM cnt GROUP BY state, year, ipse"""

NATIONAL = (CASES, POPY, long_cte("cases"), """
dd AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY imp, year, person ORDER BY rptdt DESC NULLS LAST, row_key ASC) AS rn
  FROM long WHERE ipse) WHERE rn = 1)""")

SQL["group_rates"] = with_(*NATIONAL, """
cnt AS (SELECT year, race_ethn, medical, imp, count(*) AS n FROM dd GROUP BY ALL)""", """
pooled AS (SELECT year, race_ethn, medical, CAST(sum(n) AS DOUBLE) / count(*) AS n_bar,
                  min(n) AS n_min, max(n) AS n_max FROM cnt GROUP BY year, race_ethn, medical)""", """
pop_g AS (SELECT year, race_ethn, CAST(sum(pop) AS BIGINT) AS pop FROM popy GROUP BY ALL)""") + f"""
SELECT p.*, g.pop, {rate('p.n_max', 'g.pop')} AS rate_max, {rate('p.n_min', 'g.pop')} AS rate_min,
       {rate('p.n_bar', 'g.pop')} AS rate_bar
FROM pooled p LEFT JOIN pop_g g ON p.year = g.year AND p.race_ethn = g.race_ethn
WHERE p.year > 1995"""

_SLOT4 = ["chmal1", "chmal2", "chmal3", "chmal4"]


def _any(op: str) -> str:
    return " OR ".join(f"{s} {op}" for s in _SLOT4)


SQL["type_rates"] = with_(*NATIONAL, f"""
fl AS (SELECT imp, year, medical, ({_any('= 1')}) AS phy_abuse, ({_any('IN (2, 3)')}) AS neglect,
              ({_any('= 4')}) AS sex_abuse, ({_any('> 4')}) AS other FROM dd)""", """
sums AS (SELECT imp, year, medical, count(*) FILTER (WHERE phy_abuse) AS phy_abuse, count(*) FILTER (WHERE neglect) AS neglect,
                count(*) FILTER (WHERE sex_abuse) AS sex_abuse, count(*) FILTER (WHERE other) AS other FROM fl GROUP BY ALL)""", """
lng AS (SELECT imp, year, medical, 'phy_abuse' AS type, phy_abuse AS n FROM sums
        UNION ALL SELECT imp, year, medical, 'neglect', neglect FROM sums
        UNION ALL SELECT imp, year, medical, 'sex_abuse', sex_abuse FROM sums
        UNION ALL SELECT imp, year, medical, 'other', other FROM sums)""", """
pooled AS (SELECT year, medical, type, CAST(sum(n) AS DOUBLE) / count(*) AS n_mean,
                  CAST(min(n) AS BIGINT) AS n_min, CAST(max(n) AS BIGINT) AS n_max
           FROM lng GROUP BY year, medical, type)""", """
pop_y AS (SELECT year, CAST(sum(pop) AS BIGINT) AS pop FROM popy GROUP BY year)""", f"""
lab AS (
  SELECT p.year,
         CASE WHEN p.medical THEN 'Medical professionals' WHEN NOT p.medical THEN 'All others' END AS medical,
         CASE WHEN p.type = 'neglect' THEN 'Neglect' WHEN p.type = 'phy_abuse' THEN 'Physical abuse'
              WHEN p.type = 'sex_abuse' THEN 'Sexual abuse' WHEN p.type = 'other' THEN 'Other' END AS type,
         p.n_mean, p.n_min, p.n_max, y.pop,
         {rate('p.n_mean', 'y.pop')} AS rate_mean, {rate('p.n_min', 'y.pop')} AS rate_min,
         {rate('p.n_max', 'y.pop')} AS rate_max
  FROM pooled p LEFT JOIN pop_y y ON p.year = y.year)""") + """
SELECT *, CASE WHEN type = 'Neglect' THEN 1 WHEN type = 'Physical abuse' THEN 2 WHEN type = 'Sexual abuse' THEN 3
                WHEN type = 'Other' THEN 4 END AS type_ord,
          CASE WHEN medical = 'Medical professionals' THEN 1 WHEN medical = 'All others' THEN 2 END AS source_ord
FROM lab"""

STATE = (CASES, POPY, """
qual AS (SELECT state, year, CAST(count(*) FILTER (WHERE ipse IS NULL) AS DOUBLE) / count(*) AS pm,
                CAST(count(*) FILTER (WHERE ipse) AS DOUBLE) / count(*) AS st FROM cases GROUP BY ALL)""", """
gated AS (SELECT c.* FROM cases c WHERE EXISTS (
  SELECT 1 FROM qual q WHERE q.state = c.state AND q.year = c.year AND q.pm <= 0.36 AND q.st >= 0.30))""",
         long_cte("gated", "glong"), """
sc AS (SELECT year, imp, state, race_ethn, chmal1, ipse, count(*) AS n FROM glong WHERE medical GROUP BY ALL)""", """
grid AS (SELECT * FROM (SELECT DISTINCT year, imp FROM sc)
         JOIN (SELECT DISTINCT year, state FROM sc) USING (year)
         JOIN (SELECT DISTINCT year, race_ethn FROM sc) USING (year)
         JOIN (SELECT DISTINCT year, chmal1 FROM sc) USING (year)
         JOIN (SELECT DISTINCT year, ipse FROM sc) USING (year))""", """
state_counts AS (
  SELECT g.*, coalesce(s.n, 0) AS n FROM grid g LEFT JOIN sc s
  ON g.year IS NOT DISTINCT FROM s.year AND g.imp IS NOT DISTINCT FROM s.imp
 AND g.state IS NOT DISTINCT FROM s.state AND g.race_ethn IS NOT DISTINCT FROM s.race_ethn
 AND g.chmal1 IS NOT DISTINCT FROM s.chmal1 AND g.ipse IS NOT DISTINCT FROM s.ipse)""", """
sc2 AS (SELECT * FROM state_counts WHERE NOT coalesce(state IN ('NATION_1', 'NATION_2'), FALSE))""")

SQL["state_counts"] = with_(*STATE[:-1]) + "\nSELECT * FROM state_counts"


def pool_units_sql(where: str, keys: str) -> str:
    return f"""
per AS (SELECT {keys}, imp, sum(n) AS n FROM sc2 {where} GROUP BY ALL),
units0 AS (SELECT {keys}, CAST(sum(n) AS DOUBLE) / {M} AS n_mn,
                  CAST(CASE WHEN count(*) < {M} THEN 0 ELSE min(n) END AS BIGINT) AS n_min,
                  CAST(greatest(max(n), 0) AS BIGINT) AS n_max FROM per GROUP BY ALL),
units AS (SELECT u.*, p.pop, {rate('u.n_mn', 'p.pop')} AS r_mn, {rate('u.n_min', 'p.pop')} AS r_min,
                 {rate('u.n_max', 'p.pop')} AS r_max
          FROM units0 u LEFT JOIN popy p ON u.year IS NOT DISTINCT FROM p.year
           AND u.state IS NOT DISTINCT FROM p.state AND u.race_ethn IS NOT DISTINCT FROM p.race_ethn)"""


def totals_sql(by: str, src: str) -> str:
    return f"""
tot0 AS (
  SELECT {by}, race_ethn, n_mn, n_min, n_max, pop FROM {src}
  UNION ALL
  SELECT {by}, 'Total' AS race_ethn, {STRICT.format(c='n_mn')} AS n_mn,
         CAST({STRICT.format(c='n_min')} AS BIGINT) AS n_min, CAST({STRICT.format(c='n_max')} AS BIGINT) AS n_max,
         CAST({STRICT.format(c='pop')} AS BIGINT) AS pop
  FROM {src} GROUP BY {by}),
tot AS (SELECT *, {rate('n_mn')} AS r_mn, {rate('n_min')} AS r_min, {rate('n_max')} AS r_max FROM tot0)"""


SQL["state_panel"] = with_(*STATE, pool_units_sql("", "ipse, race_ethn, year, state"), """
per_unit AS (SELECT state, count(*) AS n FROM units GROUP BY state)""", """
panel AS (SELECT * FROM units WHERE state IN (SELECT state FROM per_unit WHERE n = (SELECT max(n) FROM per_unit))
          AND state <> 'NATION_5')""", totals_sql("year, state, ipse", "panel")) + """
SELECT year, state, ipse, race_ethn, round(n_mn, 6) AS n_mn, n_min, n_max, pop, round(r_mn, 6) AS r_mn,
       r_min, r_max FROM tot"""

UNIT_RATES = (*STATE, pool_units_sql("WHERE ipse AND year = 2000", "race_ethn, year, state"),
              totals_sql("year, state", "units"), """
ord AS (SELECT state, CAST(row_number() OVER (ORDER BY round(r_mn, 9) ASC NULLS LAST, state ASC NULLS LAST) AS INTEGER) AS state_ord
        FROM tot WHERE race_ethn = 'Total')""", """
unit_rates AS (
  SELECT t.*, o.state_ord,
         CASE WHEN t.race_ethn = 'Total' THEN 1 WHEN t.race_ethn = 'AUTOMOBILE' THEN 2
              WHEN t.race_ethn = 'BUILDING' THEN 3 WHEN t.race_ethn = 'FURNITURE' THEN 4
              WHEN t.race_ethn = 'HOUSEHOLD' THEN 5 WHEN t.race_ethn = 'MACHINERY' THEN 6 END AS group_ord
  FROM tot t LEFT JOIN ord o ON t.state = o.state)""")

SQL["unit_rates"] = with_(*UNIT_RATES) + """
SELECT * REPLACE (round(n_mn, 6) AS n_mn, round(r_mn, 6) AS r_mn) FROM unit_rates"""

SQL["unit_disparity"] = with_(*UNIT_RATES, """
ref AS (SELECT year, state, r_mn AS wht_mn, r_min AS wht_min, r_max AS wht_max FROM tot WHERE race_ethn = 'BUILDING')""",
                              f"""
dsp AS (
  SELECT t.*, r.wht_mn, r.wht_min, r.wht_max, {ratio('t.r_mn', 'r.wht_mn')} AS d,
         {ratio('t.r_min', 'r.wht_max')} AS d_min, {ratio('t.r_max', 'r.wht_min')} AS d_max
  FROM tot t LEFT JOIN ref r ON t.year = r.year AND t.state = r.state
  WHERE t.race_ethn NOT IN ('BUILDING', 'Total') AND t.race_ethn IS NOT NULL)""", """
dord AS (SELECT state, CAST(row_number() OVER (ORDER BY d ASC NULLS LAST, state ASC NULLS LAST) AS INTEGER) AS state_ord
         FROM dsp WHERE race_ethn = 'AUTOMOBILE')""") + """
SELECT d.*, CASE WHEN d.d_min > 1 THEN 'Greater than reference rate'
                 WHEN NOT (d.d_min > 1) THEN 'Less than or equal to reference rate' END AS grt1,
       o.state_ord
FROM dsp d LEFT JOIN dord o ON d.state = o.state"""

SQL["pop_index"] = with_(CASES, POPY, """
sy AS (SELECT DISTINCT state, year FROM cases)""") + """
SELECT p.race_ethn,
       CASE WHEN count(*) FILTER (WHERE p.pop IS NULL) > 0 THEN NULL ELSE CAST(sum(p.pop) AS BIGINT) END AS pop
FROM sy LEFT JOIN popy p ON sy.state IS NOT DISTINCT FROM p.state AND sy.year IS NOT DISTINCT FROM p.year
GROUP BY p.race_ethn"""


SQL["delimited_roundtrip"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey, o_orderstatus,
       CAST(o_orderdate AS DATE) AS o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS year
FROM orders"""

SQL["na_csv_roundtrip"] = """
SELECT c_custkey, CAST(c_nationkey AS INTEGER) AS c_nationkey,
       CASE WHEN c_acctbal > 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS cents,
       CASE WHEN c_nationkey <> 3 THEN c_acctbal > 500 END AS rich
FROM customer"""

SQL["delimited_files"] = SQL["delimited_roundtrip"].replace("AS year\n", "AS file_year\n")
SQL["fixed_width_files"] = """
SELECT c_custkey, CAST(c_nationkey AS INTEGER) AS c_nationkey,
       CASE WHEN c_acctbal < 0 THEN '-' ELSE '+' END AS bal_sign, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS bal_cents
FROM customer"""
SQL["result_files"] = SQL["quality_flags"]

# a year that is written over holds the medical reports only
SQL["checkpoint_years"] = with_(CASES) + """
SELECT CAST(year AS INTEGER) AS year, state, medical, count(*) AS n FROM cases
WHERE year >= 1994 AND (year <> 1996 OR medical) GROUP BY ALL"""

# the five donor groups below a prediction and the five at or above it, ranked, cut at five donors
SQL["pmm_donors"] = with_(CASES, f"""
c AS (SELECT k.row_key, k.year, k.chmal1 * 8 + length(k.state) AS p,
             CASE WHEN o.o_orderstatus = 'P' AND o.o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN NULL
                  ELSE CAST(round(o.o_totalprice / 1000) AS INTEGER) END AS amount
      FROM cases k JOIN orders o ON o.o_orderkey = k.row_key),
d AS (SELECT year, p, amount, n, row_number() OVER (PARTITION BY year ORDER BY p, amount) AS pos
      FROM (SELECT year, p, amount, count(*) AS n FROM c WHERE amount IS NOT NULL GROUP BY ALL)),
q AS (SELECT DISTINCT year, p + 3.25::DOUBLE AS x FROM c WHERE amount IS NULL),
g AS (SELECT q.year, q.x, count(d.pos) AS below FROM q LEFT JOIN d ON d.year = q.year AND d.p < q.x GROUP BY ALL),
near AS (SELECT g.year, g.x, d.p, d.amount, d.n,
                sum(d.n) OVER (PARTITION BY g.year, g.x ORDER BY abs(d.p - g.x), d.p, d.amount) AS upto
         FROM g JOIN d ON d.year = g.year AND d.pos BETWEEN g.below - 4 AND g.below + 5),
cut AS (SELECT year, x, amount, least(upto, 5) AS hi, upto - n AS lo, max(least(upto, 5)) OVER (PARTITION BY year, x) AS tot
        FROM near WHERE upto - n < 5),
need AS (SELECT row_key, year, p + 3.25::DOUBLE AS x, {u_sql('row_key', '1', 'amount')} AS u FROM c WHERE amount IS NULL)
""") + f"""
SELECT need.row_key, CAST(cut.amount AS INTEGER) AS amount
FROM need LEFT JOIN cut ON cut.year = need.year AND cut.x = need.x
  AND (need.u * cut.tot) // {U32} >= cut.lo AND (need.u * cut.tot) // {U32} < cut.hi"""



def exact_fit_ctes(t: str, src: str, a: str, b: str) -> str:
    """Target ``t`` of the long table ``src`` (row_key, year, imp, columns) by matching on its least squares on ``a`` and ``b``.

    The normal equations are solved by determinants of whole numbers; donors as in ``pmm_donors``, by imputation and year.
    Makes ``{src}_{t}``: the same table with ``t`` completed."""
    det = "n * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b)"
    zero = "y * (aa * bb - ab * ab) - a * (ay * bb - ab * yb) + b * (ay * ab - aa * yb)"
    one = "n * (ay * bb - ab * yb) - y * (a * bb - ab * b) + b * (a * yb - ay * b)"
    two = "n * (aa * yb - ay * ab) - a * (a * yb - ay * b) + y * (a * ab - aa * b)"
    return f"""
{t}_s AS (SELECT imp, year, count(*)::HUGEINT AS n, sum({a}) AS a, sum({b}) AS b, sum({a} * {a}) AS aa, sum({a} * {b}) AS ab, sum({b} * {b}) AS bb,
  sum({t}) AS y, sum({a} * {t}) AS ay, sum({b} * {t}) AS yb FROM {src} WHERE {t} IS NOT NULL GROUP BY imp, year),
{t}_f AS (SELECT imp, year, {det} AS d, {zero} AS z, {one} AS o, {two} AS w FROM {t}_s),
{t}_x AS (SELECT r.*, 1000 * (z + o * {a} + w * {b}) AS v, d FROM {src} r JOIN {t}_f USING (imp, year)),
{t}_p AS (SELECT row_key, imp, year, {t}, (v - ((v % d) + d) % d) // d AS p FROM {t}_x),
{t}_d AS (SELECT imp, year, p, {t}, n, row_number() OVER (PARTITION BY imp, year ORDER BY p, {t}) AS pos
  FROM (SELECT imp, year, p, {t}, count(*) AS n FROM {t}_p WHERE {t} IS NOT NULL GROUP BY ALL)),
{t}_q AS (SELECT DISTINCT imp, year, p AS x FROM {t}_p WHERE {t} IS NULL),
{t}_g AS (SELECT q.imp, q.year, q.x, count(d.pos) AS below FROM {t}_q q LEFT JOIN {t}_d d ON d.imp = q.imp AND d.year = q.year AND d.p < q.x GROUP BY ALL),
{t}_n AS (SELECT g.imp, g.year, g.x, d.p, d.{t}, d.n, sum(d.n) OVER (PARTITION BY g.imp, g.year, g.x ORDER BY abs(d.p - g.x), d.p, d.{t}) AS upto
  FROM {t}_g g JOIN {t}_d d ON d.imp = g.imp AND d.year = g.year AND d.pos BETWEEN g.below - 4 AND g.below + 5),
{t}_c AS (SELECT imp, year, x, {t}, least(upto, 5) AS hi, upto - n AS lo, max(least(upto, 5)) OVER (PARTITION BY imp, year, x) AS tot
  FROM {t}_n WHERE upto - n < 5),
{t}_u AS (SELECT row_key, imp, year, p AS x, {u_sql('row_key', 'imp', t)} AS u FROM {t}_p WHERE {t} IS NULL),
{t}_r AS (SELECT u.row_key, u.imp, c.{t} FROM {t}_u u JOIN {t}_c c ON c.imp = u.imp AND c.year = u.year AND c.x = u.x
  AND (u.u * c.tot) // {U32} >= c.lo AND (u.u * c.tot) // {U32} < c.hi),
{src}_{t} AS (SELECT l.* REPLACE (coalesce(l.{t}, r.{t}) AS {t}) FROM {src} l LEFT JOIN {t}_r r USING (row_key, imp))"""


SQL["impute_exact_round"] = with_(CASES, """
c AS (SELECT k.row_key, k.year, k.chmal1::BIGINT AS chmal1, k.medical::BIGINT AS urgent,
             CASE WHEN o.o_orderstatus = 'P' AND o.o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN NULL
                  ELSE CAST(round(o.o_totalprice / 1000) AS BIGINT) END AS amount, k.ipse::INTEGER::BIGINT AS flag
      FROM cases k JOIN orders o ON o.o_orderkey = k.row_key)""", """
l AS (SELECT c.*, amount IS NULL OR flag IS NULL AS open, imp FROM c, (SELECT CAST(unnest([1, 2]) AS INTEGER) AS imp))""",
    exact_fit_ctes("amount", "l", "chmal1", "urgent"), exact_fit_ctes("flag", "l_amount", "chmal1", "amount")) + """
SELECT row_key, imp, amount, flag FROM l_amount_flag WHERE open"""

GROUP_CODES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def chained_ctes(src: str, name: str) -> str:
    """``name``: the records of ``src`` completed by one exact round a year over group and flag, two imputations."""
    codes = " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(GROUP_CODES, 1))
    labels = " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(GROUP_CODES, 1))
    return f"""
l AS (SELECT row_key, year, chmal1::BIGINT AS chmal1, medical::BIGINT AS urgent, (CASE race_ethn {codes} END)::BIGINT AS grp,
             ipse::INTEGER::BIGINT AS flag, imp FROM {src}, (SELECT CAST(unnest([1, 2]) AS INTEGER) AS imp)),
""" + exact_fit_ctes("grp", "l", "chmal1", "urgent") + "," + exact_fit_ctes("flag", "l_grp", "chmal1", "grp") + f""",
{name} AS (SELECT k.* REPLACE (CASE x.grp {labels} END AS race_ethn, x.flag = 1 AS ipse), x.imp
           FROM {src} k JOIN l_grp_flag x USING (row_key))"""


def after_chained(name: str) -> str:
    """The SQL of a result with chained equations in the place of the hot-deck draws."""
    sql = SQL[name].replace(long_cte("cases"), chained_ctes("cases", "long")).replace(long_cte("gated", "glong"), chained_ctes("gated", "glong"))
    return sql.replace(f"/ {M} AS n_mn", "/ 2 AS n_mn").replace(f"count(*) < {M} THEN", "count(*) < 2 THEN")


for _name in ("group_rates", "type_rates", "state_counts", "state_panel", "unit_rates", "unit_disparity"):
    SQL[f"{_name}_chained"] = after_chained(_name)

SQL["imputation_store"] = with_(CASES, chained_ctes("cases", "long")) + """
SELECT x.row_key, x.imp, x.year, x.grp, x.flag FROM l_grp_flag x JOIN cases k USING (row_key)
WHERE x.year >= 1994 AND (x.year <> 1996 OR k.medical)"""

SQL["logistic_draw"] = with_(CASES) + f"""
SELECT row_key, {u_sql('row_key', '1', 'ipse')} / {U32}.0::DOUBLE
       >= 1 - 1 / (1 + exp(-(0.25::DOUBLE - 1.5::DOUBLE * ((chmal1 - 1) / 4.0::DOUBLE) + CASE WHEN medical THEN 0.75::DOUBLE ELSE 0 END))) AS ipse
FROM cases WHERE ipse IS NULL"""
