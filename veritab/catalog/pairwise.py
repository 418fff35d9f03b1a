"""Queries for pairwise-column fidelity."""

from __future__ import annotations

from itertools import combinations

from veritab.catalog import tables as t
from veritab.catalog.columns import CDF, TV, VIEWS, scores, sides
from veritab.catalog.registry import query
from veritab.operators import pairs

F9 = t.ROLES.features
CATCOLS = ["target", *t.CATS]
NUMLIKE = [*t.NUMS, "odate"]


def num(c: str) -> str:
    return "CAST(epoch_us(odate) AS DOUBLE)" if c == "odate" else f"CAST({c} AS DOUBLE)"


def _spearman(view: str, cols: list[str]) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{a}' AS column_1, '{b}' AS column_2, {num(a)} AS v1, {num(b)} AS v2 FROM {view} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b in combinations(cols, 2)
    )
    return f"""(SELECT column_1, column_2, corr(r1, r2) AS value, count(*) AS n FROM (SELECT column_1, column_2,
  rank() OVER (PARTITION BY column_1, column_2 ORDER BY v1) + (count(*) OVER (PARTITION BY column_1, column_2, v1) - 1) / 2.0 AS r1,
  rank() OVER (PARTITION BY column_1, column_2 ORDER BY v2) + (count(*) OVER (PARTITION BY column_1, column_2, v2) - 1) / 2.0 AS r2 FROM ({long})) GROUP BY 1, 2)"""


def _cramer(view: str, cols: list[str]) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{a}' AS column_1, '{b}' AS column_2, CAST({a} AS VARCHAR) AS v1, CAST({b} AS VARCHAR) AS v2 FROM {view} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b in combinations(cols, 2)
    )
    return f"""(WITH l AS ({long}), o AS (SELECT column_1, column_2, v1, v2, count(*) AS o FROM l GROUP BY ALL), r AS (SELECT column_1, column_2, v1, count(*) AS r FROM l GROUP BY ALL),
  c AS (SELECT column_1, column_2, v2, count(*) AS c FROM l GROUP BY ALL), m AS (SELECT column_1, column_2, count(*) AS n FROM l GROUP BY ALL),
  z AS (SELECT column_1, column_2, v1, v2, r, c, n, r * CAST(c AS DOUBLE) / n AS e, (SELECT count(*) FROM r r2 WHERE r2.column_1 = m.column_1 AND r2.column_2 = m.column_2) AS nr,
        (SELECT count(*) FROM c c2 WHERE c2.column_1 = m.column_1 AND c2.column_2 = m.column_2) AS nc FROM r JOIN c USING (column_1, column_2) JOIN m USING (column_1, column_2)),
  d AS (SELECT column_1, column_2, n, nr, nc, e, abs(coalesce(o, 0) - e) AS dev FROM z LEFT JOIN o USING (column_1, column_2, v1, v2)),
  x AS (SELECT column_1, column_2, n, nr, nc, sum(power(dev - CASE WHEN nr = 2 AND nc = 2 THEN least(0.5, dev) ELSE 0 END, 2) / e) AS chi2 FROM d GROUP BY ALL)
  SELECT column_1, column_2, CASE WHEN least(nr, nc) = 1 THEN 0 ELSE sqrt(chi2 / (n * (least(nr, nc) - 1))) END AS value, n FROM x)"""


def _eta(view: str, cats: list[str], nums: list[str], order: list[str]) -> str:
    parts = []
    for c in cats:
        for x in nums:
            a, b = (c, x) if order.index(c) < order.index(x) else (x, c)
            parts.append(f"SELECT '{a}' AS column_1, '{b}' AS column_2, CAST({c} AS VARCHAR) AS k, {num(x)} AS v FROM {view} WHERE {c} IS NOT NULL AND {x} IS NOT NULL")
    return f"""(SELECT column_1, column_2, sqrt(sum(k * power(m - mu, 2)) / any_value(tot)) AS value, CAST(sum(k) AS BIGINT) AS n FROM
  (SELECT column_1, column_2, k AS cat, count(*) AS k, avg(v) AS m FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL) JOIN
  (SELECT column_1, column_2, avg(v) AS mu, var_pop(v) * count(*) AS tot FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL) USING (column_1, column_2) GROUP BY 1, 2)"""


def _assoc(view: str) -> str:
    dated = " UNION ALL ".join(f"SELECT '{a}' AS column_1, '{b}' AS column_2, CAST(NULL AS DOUBLE) AS value, 0 AS n" for a, b in combinations(F9, 2) if "odate" in (a, b))
    return f"""(SELECT column_1, column_2, abs(value) AS value, n FROM {_spearman(view, t.NUMS)} UNION ALL SELECT * FROM {_cramer(view, CATCOLS)}
  UNION ALL SELECT * FROM {_eta(view, CATCOLS, t.NUMS, F9)} UNION ALL {dated})"""


def _lab(c: str) -> str:
    if c in CATCOLS:
        return f"CAST({c} AS VARCHAR)"
    v = num(c)
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {v} < {c}_lo THEN '0' WHEN {v} > {c}_hi THEN '11' ELSE CAST(CAST(least(floor(({v} - {c}_lo) / ({c}_hi - {c}_lo) * 10) + 1, 10) AS INT) AS VARCHAR) END"


LIMITS = "lim AS (SELECT " + ", ".join(f"min({num(c)}) AS {c}_lo, max({num(c)}) AS {c}_hi" for c in NUMLIKE) + " FROM ref)"
LABELED = LIMITS + "".join(f", lab_{v} AS (SELECT {', '.join(f'{_lab(c)} AS {c}' for c in F9)} FROM {v}, lim)" for v in ("ref", "syn"))
_PAIRS = [(a, b) for a, b in combinations(F9, 2) if not (a in NUMLIKE and b in NUMLIKE)]
_LONG = " UNION ALL ".join(
    f"SELECT '{a}' AS column_1, '{b}' AS column_2, {a} AS v1, {b} AS v2, {r} AS r, {1 - r} AS s FROM lab_{v}" for v, r in (("ref", 1), ("syn", 0)) for a, b in _PAIRS
)
CONT = f"""(SELECT column_1, column_2, 1 - sum(abs(r / nr - s / ns)) / 2 AS score FROM (SELECT column_1, column_2, v1, v2, sum(r) AS r, sum(s) AS s FROM ({_LONG}) GROUP BY 1, 2, 3, 4),
  (SELECT CAST(count(*) AS DOUBLE) AS nr FROM ref), (SELECT CAST(count(*) AS DOUBLE) AS ns FROM syn) GROUP BY 1, 2)"""
CORR = f"""(SELECT a.column_1, a.column_2, a.value AS real_value, b.value AS synthetic_value, 1 - abs(a.value - b.value) / 2 AS score
  FROM {_spearman('ref', NUMLIKE)} a JOIN {_spearman('syn', NUMLIKE)} b USING (column_1, column_2))"""
TRENDS = f"tr AS (SELECT column_1, column_2, 'correlation_similarity' AS metric, score FROM {CORR} UNION ALL SELECT column_1, column_2, 'contingency_similarity', score FROM {CONT})"


@query("spearman_matrix", f"SELECT column_1, column_2, round(value, 6) AS value, n FROM {_spearman('syn', NUMLIKE)}", ("syn",))
def spearman_matrix(spark, sf):
    return scores(pairs.spearman(t.syn(spark, sf), t.ROLES, kinds=("numerical", "datetime")))


@query("cramers_v", f"SELECT column_1, column_2, round(value, 6) AS value, n FROM {_cramer('syn', CATCOLS)}", ("syn",))
def cramers_v(spark, sf):
    return scores(pairs.cramers_v(t.syn(spark, sf), t.ROLES))


@query(
    "cramers_v_two_by_two",
    "SELECT column_1, column_2, round(value, 6) AS value, n FROM " + _cramer("(SELECT target, price > 250000 AS dear FROM pop)", ["target", "dear"]),
    ("pop",),
)
def cramers_two(spark, sf):
    from veritab.sources.roles import BOOLEAN, Column, Roles

    df = t.pop(spark, sf).selectExpr("target", "price > 250000 AS dear")
    return scores(pairs.cramers_v(df, Roles((Column("target", BOOLEAN), Column("dear", BOOLEAN)))))


@query("correlation_ratio", f"SELECT column_1, column_2, round(value, 6) AS value, n FROM {_eta('syn', CATCOLS, t.NUMS, CATCOLS + t.NUMS)}", ("syn",))
def correlation_ratio(spark, sf):
    return scores(pairs.correlation_ratio(t.syn(spark, sf), t.ROLES))


@query(
    "association_matrix",
    f"""WITH a AS (SELECT column_1, column_2, round(value, 6) AS value, n FROM {_assoc('syn')}) SELECT * FROM a UNION ALL SELECT column_2, column_1, value, n FROM a
  UNION ALL SELECT c, c, 1.0, (SELECT count(*) FROM syn) FROM (SELECT unnest({F9!r}) AS c)""",
    ("syn",),
)
def association_matrix(spark, sf):
    return scores(pairs.association_matrix(t.syn(spark, sf), t.ROLES))


@query(
    "correlation_similarity",
    f"SELECT column_1, column_2, round(real_value, 6) AS real_value, round(synthetic_value, 6) AS synthetic_value, round(score, 6) AS score FROM {CORR}",
    VIEWS,
)
def correlation_similarity(spark, sf):
    return scores(pairs.correlation_similarity(*sides(spark, sf), t.ROLES))


@query("contingency_similarity", f"WITH {LABELED} SELECT column_1, column_2, round(score, 6) AS score FROM {CONT}", VIEWS)
def contingency_similarity(spark, sf):
    return scores(pairs.contingency_similarity(*sides(spark, sf), t.ROLES))


@query(
    "quality_score",
    f"""WITH {LABELED}, {TRENDS}, {CDF}, a AS (SELECT avg(score) AS s FROM (SELECT column_name, 1 - max(abs(fr - fs)) AS score FROM g GROUP BY 1 UNION ALL {TV.replace('round(', '(').replace(', 6) AS score', ') AS score')})),
  b AS (SELECT avg(score) AS s FROM tr) SELECT 'column_shapes' AS property, round(s, 6) AS score FROM a UNION ALL SELECT 'column_pair_trends', round(s, 6) FROM b
  UNION ALL SELECT 'overall', round((a.s + b.s) / 2, 6) FROM a, b""",
    VIEWS,
)
def quality_score(spark, sf):
    return scores(pairs.quality(*sides(spark, sf), t.ROLES))


@query(
    "pair_diagnostics",
    f"""WITH {LABELED}, {TRENDS} SELECT column_1, column_2, round(r.value, 6) AS real_value, r.n AS real_n, round(s.value, 6) AS synthetic_value, round(score, 6) AS score
  FROM {_assoc('ref')} r JOIN {_assoc('syn')} s USING (column_1, column_2) JOIN tr USING (column_1, column_2) WHERE r.value IS NOT NULL AND s.value IS NOT NULL""",
    VIEWS,
)
def pair_diagnostics(spark, sf):
    return scores(pairs.pair_diagnostics(*sides(spark, sf), t.ROLES))


@query(
    "worst_pairs",
    f"""WITH {LABELED}, {TRENDS} SELECT column_1, column_2, round(r.value, 6) AS real_value, r.n AS real_n, round(s.value, 6) AS synthetic_value, round(tr.score, 6) AS score
  FROM {_assoc('ref')} r JOIN {_assoc('syn')} s USING (column_1, column_2) JOIN tr USING (column_1, column_2) WHERE r.value IS NOT NULL AND s.value IS NOT NULL
  ORDER BY round(tr.score, 9), column_1, column_2 LIMIT 5""",
    VIEWS,
)
def worst_pairs(spark, sf):
    return scores(pairs.worst_pairs(pairs.pair_diagnostics(*sides(spark, sf), t.ROLES)))


@query(
    "pair_score_matrix",
    f"""WITH {LABELED}, {TRENDS}, m AS (SELECT column_1, column_2, round(score, 6) AS score FROM tr)
  SELECT * FROM m UNION ALL SELECT column_2, column_1, score FROM m UNION ALL SELECT c, c, 1.0 FROM (SELECT unnest({F9!r}) AS c)""",
    VIEWS,
)
def pair_score_matrix(spark, sf):
    return scores(pairs.pair_score_matrix(*sides(spark, sf), t.ROLES))
