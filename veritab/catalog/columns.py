"""Queries for per-column fidelity and structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.catalog import tables as t
from veritab.catalog.registry import query
from veritab.operators import marginal, structure
from veritab.sources.roles import BOOLEAN, CATEGORICAL, Column, Roles

VIEWS = ("ref", "syn")
NUM_LONG = """(SELECT 'order_year' AS column_name, CAST(order_year AS DOUBLE) AS value FROM {v} UNION ALL SELECT 'price', price FROM {v}
  UNION ALL SELECT 'acctbal', acctbal FROM {v} UNION ALL SELECT 'odate', CAST(epoch_us(odate) AS DOUBLE) FROM {v})"""
CAT_LONG = """(SELECT 'target' AS column_name, CAST(target AS VARCHAR) AS value FROM {v} UNION ALL SELECT 'priority', priority FROM {v}
  UNION ALL SELECT 'segment', segment FROM {v} UNION ALL SELECT 'nation', nation FROM {v} UNION ALL SELECT 'tier', tier FROM {v})"""


def both(long: str, extra: str = "") -> str:
    return f"""SELECT column_name, value, sum(r) AS r, sum(s) AS s FROM (SELECT column_name, value, 1 AS r, 0 AS s FROM {long.format(v='ref')}
      UNION ALL SELECT column_name, value, 0, 1 FROM {long.format(v='syn')}) {extra} GROUP BY 1, 2"""


CDF = f"""f AS ({both(NUM_LONG, 'WHERE value IS NOT NULL')}),
  g AS (SELECT column_name, value, sum(r) OVER w / CAST(sum(r) OVER p AS DOUBLE) AS fr, sum(s) OVER w / CAST(sum(s) OVER p AS DOUBLE) AS fs,
        lead(value) OVER o AS nxt FROM f WINDOW w AS (PARTITION BY column_name ORDER BY value ROWS UNBOUNDED PRECEDING),
        o AS (PARTITION BY column_name ORDER BY value), p AS (PARTITION BY column_name))"""
KS = "SELECT column_name, round(1 - max(abs(fr - fs)), 6) AS score FROM g GROUP BY 1"
TV = f"""SELECT column_name, round(1 - sum(abs(p - q)) / 2, 6) AS score FROM (SELECT column_name, value, r / CAST(sum(r) OVER (PARTITION BY column_name) AS DOUBLE) AS p,
  s / CAST(sum(s) OVER (PARTITION BY column_name) AS DOUBLE) AS q FROM ({both(CAT_LONG)})) GROUP BY 1"""
JSD = """SELECT column_name, round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 6) AS score
  FROM (SELECT column_name, r / CAST(sum(r) OVER (PARTITION BY column_name) AS DOUBLE) AS p, s / CAST(sum(s) OVER (PARTITION BY column_name) AS DOUBLE) AS q FROM {b}) GROUP BY 1"""


def scores(df, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c, d in df.dtypes if d == "double"})


def sides(spark, sf):
    return t.ref(spark, sf), t.syn(spark, sf)


@query("ks_complement", f"WITH {CDF} {KS}", VIEWS)
def ks(spark, sf):
    return scores(marginal.ks_complement(*sides(spark, sf), t.ROLES))


AREA = "sum(CASE WHEN nxt IS NULL THEN 0 ELSE abs(fr - fs) * (nxt - value) END)"


@query(
    "wasserstein_1d",
    f"""WITH {CDF}, w AS (SELECT column_name, max(value) - min(value) AS width FROM f WHERE r > 0 GROUP BY 1)
  SELECT column_name, round({AREA} / CASE WHEN column_name = 'odate' THEN 1000000 ELSE 1 END, 4) AS score, round({AREA} / any_value(width), 6) AS scaled FROM g JOIN w USING (column_name) GROUP BY 1""",
    VIEWS,
)
def w1(spark, sf):
    """Datetimes in seconds."""
    w = marginal.wasserstein_1d(*sides(spark, sf), t.ROLES)
    unit = F.when(F.col("column_name") == "odate", 1e6).otherwise(1.0)
    return w.select("column_name", F.round(F.col("score") / unit, 4).alias("score"), F.round("scaled", 6).alias("scaled"))


@query("tv_complement", TV, VIEWS)
def tv(spark, sf):
    return scores(marginal.tv_complement(*sides(spark, sf), t.ROLES))


@query(
    "boundary_adherence",
    f"""SELECT column_name, round(avg(CAST(value BETWEEN lo AND hi AS INT)), 6) AS score FROM {NUM_LONG.format(v='syn')}
  JOIN (SELECT column_name, min(value) AS lo, max(value) AS hi FROM {NUM_LONG.format(v='ref')} GROUP BY 1) USING (column_name) WHERE value IS NOT NULL GROUP BY 1""",
    VIEWS,
)
def boundary(spark, sf):
    return scores(marginal.boundary_adherence(*sides(spark, sf), t.ROLES))


@query(
    "category_adherence",
    f"SELECT column_name, round(sum(CASE WHEN r > 0 THEN s ELSE 0 END) / CAST(sum(s) AS DOUBLE), 6) AS score FROM ({both(CAT_LONG)}) GROUP BY 1",
    VIEWS,
)
def category(spark, sf):
    return scores(marginal.category_adherence(*sides(spark, sf), t.ROLES))


def _label(outside: str) -> str:
    return f"""CASE WHEN value IS NULL OR value < lo OR value > hi THEN {outside}
      ELSE CAST(least(coalesce(floor((value - lo) / nullif(hi - lo, 0) * nb), 0) + 1, nb) AS BIGINT) END"""


@query(
    "jsd_equal_width",
    f"""WITH b AS (SELECT column_name, min(value) AS lo, max(value) AS hi, least(10, count(DISTINCT value)) AS nb FROM {NUM_LONG.format(v='ref')} GROUP BY 1),
  n AS (SELECT column_name, CAST({_label('0')} AS VARCHAR) AS value, r, s FROM (SELECT column_name, value, 1 AS r, 0 AS s FROM {NUM_LONG.format(v='ref')}
        UNION ALL SELECT column_name, value, 0, 1 FROM {NUM_LONG.format(v='syn')}) JOIN b USING (column_name)),
  a AS (SELECT column_name, value, sum(r) AS r, sum(s) AS s FROM n GROUP BY 1, 2 UNION ALL {both(CAT_LONG)}) {JSD.format(b='a')}""",
    VIEWS,
)
def jsd_width(spark, sf):
    return scores(marginal.jsd_equal_width(*sides(spark, sf), t.ROLES))


@query(
    "jsd_discrete_aware",
    f"""WITH d AS (SELECT column_name, count(DISTINCT value) AS few FROM {NUM_LONG.format(v='ref')} GROUP BY 1),
  x AS (SELECT column_name, value, 1 AS r, 0 AS s FROM {NUM_LONG.format(v='ref')} UNION ALL SELECT column_name, value, 0, 1 FROM {NUM_LONG.format(v='syn')}),
  b AS (SELECT column_name, min(value) AS lo, max(value) AS hi, 10 AS nb FROM x GROUP BY 1),
  n AS (SELECT column_name, CASE WHEN few <= 10 THEN CAST(value AS VARCHAR) ELSE CAST({_label('0')} AS VARCHAR) END AS value, r, s FROM x JOIN b USING (column_name) JOIN d USING (column_name) WHERE value IS NOT NULL),
  a AS (SELECT column_name, value, sum(r) AS r, sum(s) AS s FROM n GROUP BY 1, 2 UNION ALL {both(CAT_LONG, 'WHERE value IS NOT NULL')}) {JSD.format(b='a')}""",
    VIEWS,
)
def jsd_discrete(spark, sf):
    return scores(marginal.jsd_discrete_aware(*sides(spark, sf), t.ROLES))


@query(
    "jsd_adaptive",
    f"""WITH m AS (SELECT column_name, min(value) AS lo, max(value) AS hi, count(*) AS n, skewness(value) AS g FROM {NUM_LONG.format(v='ref')} GROUP BY 1),
  b AS (SELECT column_name, lo, hi, greatest(10, least(50, CAST(floor(1 + log2(n) + log2(1 + abs(g) / sqrt(6.0 * (n - 2) / ((n + 1.0) * (n + 3.0))))) AS BIGINT))) AS nb FROM m),
  n AS (SELECT column_name, CAST({_label('0')} AS VARCHAR) AS value, r, s FROM (SELECT column_name, value, 1 AS r, 0 AS s FROM {NUM_LONG.format(v='ref')}
        UNION ALL SELECT column_name, value, 0, 1 FROM {NUM_LONG.format(v='syn')}) JOIN b USING (column_name) WHERE value IS NOT NULL),
  a AS (SELECT column_name, value, sum(r) AS r, sum(s) AS s FROM n GROUP BY 1, 2 UNION ALL {both(CAT_LONG, 'WHERE value IS NOT NULL')}),
  dr AS (SELECT column_name, round(sum(CASE WHEN value = '0' AND column_name IN ('order_year', 'price', 'acctbal', 'odate') THEN s ELSE 0 END) / CAST(sum(s) AS DOUBLE), 6) AS dropped_share FROM a GROUP BY 1),
  k AS (SELECT * FROM a WHERE NOT (value = '0' AND column_name IN ('order_year', 'price', 'acctbal', 'odate')))
  SELECT * FROM ({JSD.format(b='k')}) JOIN dr USING (column_name)""",
    VIEWS,
)
def jsd_skew(spark, sf):
    return scores(marginal.jsd_adaptive(*sides(spark, sf), t.ROLES))


@query(
    "column_shapes",
    f"WITH {CDF} SELECT column_name, 'ks_complement' AS metric, score FROM ({KS}) UNION ALL SELECT column_name, 'tv_complement', score FROM ({TV})",
    VIEWS,
)
def shapes(spark, sf):
    return scores(marginal.column_shapes(*sides(spark, sf), t.ROLES))


@query(
    "null_profile",
    "\n UNION ALL ".join(
        f"SELECT '{c}' AS column_name, (SELECT count(*) FILTER ({c} IS NULL) FROM ref) AS real_nulls, (SELECT count(*) FILTER ({c} IS NULL) FROM syn) AS synthetic_nulls"
        for c in t.ROLES.features
    ),
    VIEWS,
)
def nulls(spark, sf):
    return marginal.null_profile(*sides(spark, sf), t.ROLES.features)


STRUCT_ROWS = """(VALUES ('row_id','match'),('target','match'),('order_year','dtype_mismatch'),('price','match'),('acctbal','missing_in_synthetic'),
  ('priority','match'),('segment','match'),('nation','match'),('tier','match'),('odate','match'),('weight','only_in_synthetic')) x(column_name, status)"""


def _counts(view: str, alias: str, cols: list[str]) -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS {alias} FROM {view}" for c in cols) + ")"


def _filled(df, name: str):
    return df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", name)


@query(
    "table_structure",
    f"""SELECT column_name, status, round(8 / 12.0, 6) AS score, real_filled, synthetic_filled FROM {STRUCT_ROWS}
  LEFT JOIN {_counts('ref', 'real_filled', t.ROLES.names)} USING (column_name)
  LEFT JOIN (SELECT * FROM {_counts('syn', 'synthetic_filled', [c for c in t.ROLES.names if c != 'acctbal'])} UNION ALL SELECT 'weight', count(price) FROM syn) USING (column_name)""",
    VIEWS,
)
def table_structure(spark, sf):
    real, syn = sides(spark, sf)
    syn = syn.withColumn("order_year", F.col("order_year").cast("bigint")).drop("acctbal").withColumn("weight", F.col("price"))
    compared = structure.table_structure(real, syn)
    score = structure.structure_score(compared, mismatch_counts_twice=True).select(F.round("score", 6).alias("score"))
    out = compared.select("column_name", "status").crossJoin(F.broadcast(score))  # one row
    # one row per column
    return out.join(F.broadcast(_filled(real, "real_filled")), "column_name", "left").join(
        F.broadcast(_filled(syn, "synthetic_filled")), "column_name", "left"
    )


@query(
    "semantic_structure",
    f"""SELECT column_name, CASE status WHEN 'dtype_mismatch' THEN 'match' ELSE status END AS status, round(8 / 11.0, 6) AS score, real_filled FROM
  (SELECT column_name, CASE WHEN column_name = 'target' THEN 'role_mismatch' ELSE status END AS status FROM {STRUCT_ROWS})
  LEFT JOIN {_counts('ref', 'real_filled', t.ROLES.names)} USING (column_name)""",
    VIEWS,
)
def semantic_structure(spark, sf):
    real, _ = sides(spark, sf)
    other = Roles((*[Column(c.name, CATEGORICAL if c.role == BOOLEAN else c.role) for c in t.ROLES if c.name != "acctbal"], Column("weight", "numerical")))
    compared = structure.semantic_structure(spark, t.ROLES, other)
    score = structure.structure_score(compared, mismatch_counts_twice=False).select(F.round("score", 6).alias("score"))
    out = compared.select("column_name", "status").crossJoin(F.broadcast(score))  # one row
    return out.join(F.broadcast(_filled(real, "real_filled")), "column_name", "left")
