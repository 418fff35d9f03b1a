"""Queries for row-level fidelity and k-anonymity."""

from __future__ import annotations

from veritab.catalog import tables as t
from veritab.catalog.columns import scores
from veritab.catalog.registry import query
from veritab.operators import privacy, rows

VIEWS = ("pop", "ref", "syn")
BINNED = ("order_year", "price", "acctbal")


def _bin(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL THEN 'Missing' WHEN {c}_lo = {c}_hi THEN '1' ELSE
    CAST(CAST(greatest(1, least(20, floor((CAST({c} AS DOUBLE) - {c}_lo) / ({c}_hi - {c}_lo) * 20) + 1)) AS INT) AS VARCHAR) END"""


BOUNDS = "b AS (SELECT " + ", ".join(f"CAST(min({c}) AS DOUBLE) AS {c}_lo, CAST(max({c}) AS DOUBLE) AS {c}_hi" for c in BINNED) + " FROM pop)"
CELLS = ["CASE WHEN target THEN 'True' ELSE 'False' END", *[_bin(c) for c in BINNED], "priority", "segment", "nation", "tier",
         "strftime(odate, '%Y-%m-%d %H:%M:%S')"]
HASH = f"md5(concat_ws('|', {', '.join(CELLS)}))"
HASHES = BOUNDS + "".join(f", h_{v} AS (SELECT row_id, {HASH} AS row_hash FROM {v}, b)" for v in VIEWS)
FLAGS = f"""{HASHES}, j AS (SELECT s.row_id, s.row_hash, s.row_hash IN (SELECT row_hash FROM h_pop) AS p, s.row_hash IN (SELECT row_hash FROM h_ref) AS t FROM h_syn s)"""


def three(spark, sf):
    return t.pop(spark, sf), t.ref(spark, sf), t.syn(spark, sf)


@query(
    "bin_bounds",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM pop" for c in BINNED),
    ("pop",),
)
def bin_bounds(spark, sf):
    return rows.bin_bounds(t.pop(spark, sf), t.ROLES)


@query(
    "bin_rows",
    f"WITH {BOUNDS} SELECT row_id, {', '.join(f'{_bin(c)} AS {c}' for c in BINNED)}, CASE WHEN target THEN 'True' ELSE 'False' END AS target, priority FROM syn, b",
    ("pop", "syn"),
)
def bin_rows(spark, sf):
    cols = [*BINNED, "target", "priority"]
    return rows.bin_rows(t.syn(spark, sf).select("row_id", *cols), t.ROLES, rows.bounds_row(t.pop(spark, sf), t.ROLES), cols)


@query("row_hash", f"WITH {HASHES} SELECT row_id, row_hash FROM h_syn", VIEWS)
def row_hash(spark, sf):
    return rows.hashed(t.syn(spark, sf), t.ROLES, rows.bounds_row(t.pop(spark, sf), t.ROLES), keep=["row_id"])


@query("distinct_rows", f"WITH {HASHES} SELECT count(*) AS rows, count(DISTINCT row_hash) AS distinct_rows FROM h_syn", VIEWS)
def distinct_rows(spark, sf):
    return rows.distinct_rows(t.syn(spark, sf), t.ROLES, rows.bounds_row(t.pop(spark, sf), t.ROLES))


@query(
    "fact_rates",
    f"""WITH {FLAGS}, a AS (SELECT count(*) AS n, count(*) FILTER (p) AS tot, count(*) FILTER (p AND NOT t) AS nov, count(*) FILTER (p AND t) AS mem FROM j)
  SELECT rate_name, row_count, round(row_count / CAST(n AS DOUBLE), 6) AS rate, round(row_count / CAST(n AS DOUBLE) * 100, 6) AS rate_pct FROM
  (SELECT 'TotalFR' AS rate_name, tot AS row_count, n FROM a UNION ALL SELECT 'NovelFR', nov, n FROM a UNION ALL SELECT 'MemorizedFR', mem, n FROM a UNION ALL SELECT 'HR', n - tot, n FROM a)""",
    VIEWS,
)
def fact_rates(spark, sf):
    return scores(rows.fact_rates(*three(spark, sf), t.ROLES))


@query(
    "dataset_statistics",
    f"""WITH {HASHES} SELECT (SELECT count(*) FROM h_pop) AS population_rows, (SELECT count(DISTINCT row_hash) FROM h_pop) AS population_distinct,
  (SELECT count(*) FROM h_ref) AS training_rows, (SELECT count(DISTINCT row_hash) FROM h_ref) AS training_distinct,
  (SELECT count(*) FROM h_syn) AS synthetic_rows, (SELECT count(DISTINCT row_hash) FROM h_syn) AS synthetic_distinct""",
    VIEWS,
)
def dataset_statistics(spark, sf):
    cols = [f"{d}_{k}" for d in ("population", "training", "synthetic") for k in ("rows", "distinct")]
    return rows.fact_counts(*three(spark, sf), t.ROLES).select(*cols)


@query(
    "hallucinated_rows",
    f"WITH {FLAGS} SELECT row_id, row_hash, CASE WHEN NOT p THEN 'hallucinated' WHEN t THEN 'memorized' ELSE 'novel' END AS row_class FROM j",
    VIEWS,
)
def row_classes(spark, sf):
    return rows.classify_rows(*three(spark, sf), t.ROLES)


@query(
    "size_ratios",
    """WITH c AS (SELECT (SELECT count(*) FROM syn) AS s, (SELECT count(*) FROM pop) AS p, (SELECT count(*) FROM ref) AS r)
  SELECT 'synthetic_population' AS ratio_name, round(s / CAST(p AS DOUBLE), 6) AS ratio FROM c UNION ALL SELECT 'synthetic_training', round(s / CAST(r AS DOUBLE), 6) FROM c
  UNION ALL SELECT 'synthetic_reference', round(s / CAST(r AS DOUBLE), 6) FROM c""",
    VIEWS,
)
def size_ratios(spark, sf):
    return scores(rows.size_ratios(rows.fact_counts(*three(spark, sf), t.ROLES)))


MATCH = """EXISTS (SELECT 1 FROM ref r WHERE r.target = s.target AND r.segment IS NOT DISTINCT FROM s.segment AND r.nation = s.nation AND r.tier = s.tier
  AND r.priority IS NOT DISTINCT FROM s.priority AND r.odate = s.odate AND abs(r.order_year - s.order_year) <= abs(s.order_year * CAST(0.01 AS DOUBLE))
  AND abs(r.price - s.price) <= abs(s.price * CAST(0.01 AS DOUBLE))
  AND ((r.acctbal IS NULL AND s.acctbal IS NULL) OR abs(r.acctbal - s.acctbal) <= abs(s.acctbal * CAST(0.01 AS DOUBLE))))"""


@query(
    "new_row",
    f"""SELECT round(count(*) FILTER (NOT m) / CAST(count(*) AS DOUBLE), 6) AS score, count(*) FILTER (NOT m) AS new_rows, count(*) FILTER (m) AS matched_rows
  FROM (SELECT {MATCH} AS m FROM syn s)""",
    ("ref", "syn"),
)
def new_row(spark, sf):
    return scores(rows.new_row_score(t.ref(spark, sf), t.syn(spark, sf), t.ROLES))


@query("new_row_ids", f"SELECT row_id FROM syn s WHERE NOT {MATCH}", ("ref", "syn"))
def new_row_ids(spark, sf):
    return rows.new_rows(t.ref(spark, sf), t.syn(spark, sf), t.ROLES)


def datasets(spark, sf):
    return {"population": t.pop(spark, sf), "training": t.ref(spark, sf), "reference": t.ref(spark, sf), "synthetic": t.syn(spark, sf)}


K_SQL = """d AS (SELECT 'population' AS dataset, segment, tier, priority FROM pop UNION ALL SELECT 'training', segment, tier, priority FROM ref
  UNION ALL SELECT 'reference', segment, tier, priority FROM ref UNION ALL SELECT 'synthetic', segment, tier, priority FROM syn),
  k AS (SELECT dataset, min(n) AS k, count(*) AS classes FROM (SELECT dataset, count(*) AS n FROM d GROUP BY dataset, segment, tier, priority) GROUP BY 1)"""


@query(
    "k_anon",
    f"WITH {K_SQL} SELECT dataset, k, classes, CASE WHEN k >= 10 THEN 'Excellent' WHEN k >= 5 THEN 'Good' WHEN k >= 3 THEN 'Moderate' ELSE 'Poor' END AS tier FROM k",
    VIEWS,
)
def k_anon(spark, sf):
    return privacy.k_anonymity(datasets(spark, sf), t.QI)


@query(
    "k_ratios",
    f"""WITH {K_SQL}, x AS (SELECT a.dataset AS numerator, b.dataset AS denominator, a.k / CAST(b.k AS DOUBLE) AS ratio FROM k a, k b WHERE b.k > 0 AND
  (a.dataset, b.dataset) IN (('reference', 'population'), ('synthetic', 'population'), ('synthetic', 'reference'), ('synthetic', 'training')))
  SELECT numerator, denominator, round(ratio, 6) AS ratio, CASE WHEN ratio > 1.5 THEN 'Much better privacy' WHEN ratio > 1.1 THEN 'Better privacy'
  WHEN ratio > 0.9 THEN 'Similar privacy' WHEN ratio > 0.7 THEN 'Worse privacy' ELSE 'Much worse privacy' END AS tier FROM x""",
    VIEWS,
)
def k_ratios(spark, sf):
    return scores(privacy.k_ratios(privacy.k_anonymity(datasets(spark, sf), t.QI)))


@query("k_offending", "SELECT segment, nation, tier, priority, count(*) AS n FROM syn GROUP BY ALL HAVING count(*) < 5", ("syn",))
def k_offending(spark, sf):
    return privacy.offending_groups(t.syn(spark, sf), ["segment", "nation", "tier", "priority"], 5)


@query(
    "qi_label",
    """WITH d AS (SELECT segment, tier, priority FROM pop UNION ALL SELECT segment, tier, priority FROM syn),
  v AS (SELECT DISTINCT 'segment' AS column_name, coalesce(segment, 'nan') AS value FROM d UNION SELECT 'tier', coalesce(tier, 'nan') FROM d UNION SELECT 'priority', coalesce(priority, 'nan') FROM d)
  SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS code FROM v""",
    ("pop", "syn"),
)
def qi_label(spark, sf):
    return privacy.qi_codes(datasets(spark, sf), t.QI, t.ROLES)


@query("k_anon_cluster")
def k_anon_cluster(spark, sf):
    return privacy.k_cluster(datasets(spark, sf), t.QI, t.ROLES)
