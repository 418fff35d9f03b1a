"""Queries for category repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.catalog import tables as t
from veritab.catalog.columns import scores
from veritab.catalog.registry import query
from veritab.operators import repair as rp

VIEWS = ("ref", "syn")
OTHERS = ["segment", "nation", "tier"]
U = "CAST(CAST('0x' || substr(md5(CAST(row_id AS VARCHAR) || ':priority:repair:0'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"
BAD = "bad AS (SELECT * FROM syn WHERE priority NOT IN (SELECT priority FROM ref))"


@query(
    "invalid_categories",
    "SELECT column_name, value, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM syn WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {c} FROM ref)" for c in t.CATS)
    + ") GROUP BY 1, 2",
    VIEWS,
)
def invalid_categories(spark, sf):
    return rp.invalid_categories(t.syn(spark, sf), t.ref(spark, sf), t.CATS)


@query(
    "repair_random",
    f"""WITH {BAD}, v AS (SELECT list(DISTINCT priority ORDER BY priority) AS l FROM ref)
  SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM bad) THEN l[CAST(floor({U} * len(l)) AS INT) + 1] ELSE priority END AS priority FROM syn, v""",
    VIEWS,
)
def repair_random(spark, sf):
    return rp.repair(t.syn(spark, sf), t.ref(spark, sf), t.ROLES, "random")[0].select("row_id", "priority")


@query(
    "repair_weighted",
    f"""WITH {BAD}, c AS (SELECT priority AS value, count(*) AS n FROM ref GROUP BY 1),
  iv AS (SELECT value, (sum(n) OVER w - n) / CAST(sum(n) OVER () AS DOUBLE) AS a, sum(n) OVER w / CAST(sum(n) OVER () AS DOUBLE) AS b FROM c WINDOW w AS (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING))
  SELECT row_id, value AS priority FROM bad JOIN iv ON {U} >= a AND {U} < b UNION ALL SELECT row_id, priority FROM syn WHERE row_id NOT IN (SELECT row_id FROM bad)""",
    VIEWS,
)
def repair_weighted(spark, sf):
    return rp.repair(t.syn(spark, sf), t.ref(spark, sf), t.ROLES, "weighted")[0].select("row_id", "priority")


NEAR = f"""{BAD}, q AS (SELECT DISTINCT {', '.join(OTHERS)} FROM bad),
  d AS (SELECT {', '.join('q.' + o for o in OTHERS)}, r.row_id AS rid, r.priority AS value, {' + '.join(f'CAST(q.{o} IS DISTINCT FROM r.{o} AS INT)' for o in OTHERS)} AS differing FROM q, ref r),
  p AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(OTHERS)} ORDER BY differing, rid) AS pos FROM d QUALIFY pos <= 5),
  w AS (SELECT *, (1 / (differing / 3.0::DOUBLE + 1e-6::DOUBLE)) / sum(1 / (differing / 3.0::DOUBLE + 1e-6::DOUBLE)) OVER (PARTITION BY {', '.join(OTHERS)}) AS weight FROM p)"""


@query("knn_repair_dist", f"WITH {NEAR} SELECT {', '.join(OTHERS)}, value, round(sum(weight), 6) AS weight FROM w GROUP BY ALL", VIEWS)
def knn_repair_dist(spark, sf):
    bad = rp.normalized(t.syn(spark, sf), t.CATS).join(
        rp.invalid_categories(t.syn(spark, sf), t.ref(spark, sf), ["priority"]).select(F.col("value").alias("priority")), "priority", "left_semi"
    )
    near = rp.knn_candidates(bad, t.ref(spark, sf), "priority", OTHERS, "row_id", 5)
    combos = bad.select(rp.combination_key(OTHERS).alias("_q"), *OTHERS).distinct()
    out = near.join(combos, "_q").groupBy(*OTHERS, "value").agg(F.sum("weight").alias("weight"))
    return scores(out)


@query(
    "repair_knn",
    f"""WITH {NEAR}, m AS (SELECT *, sum(weight) OVER (PARTITION BY {', '.join(OTHERS)} ORDER BY pos) AS mass FROM w),
  u AS (SELECT bad.*, {U} AS u FROM bad), f AS (SELECT u.row_id, value, row_number() OVER (PARTITION BY u.row_id ORDER BY CASE WHEN mass > u THEN pos ELSE 100 - pos END) AS rn FROM u JOIN m USING ({', '.join(OTHERS)}))
  SELECT row_id, value AS priority FROM f WHERE rn = 1 UNION ALL SELECT row_id, priority FROM syn WHERE row_id NOT IN (SELECT row_id FROM bad)""",
    VIEWS,
)
def repair_knn(spark, sf):
    return rp.repair(t.syn(spark, sf), t.ref(spark, sf), t.ROLES, "knn")[0].select("row_id", "priority")


@query(
    "repair_counts",
    f"WITH {BAD} SELECT method, 'priority' AS column_name, (SELECT count(*) FROM bad) AS repaired, 0 AS still_invalid, (SELECT count(*) FROM syn) AS rows FROM (VALUES ('knn'), ('weighted'), ('random')) m(method)",
    VIEWS,
)
def repair_counts(spark, sf):
    real, syn = t.ref(spark, sf), t.syn(spark, sf)
    out = None
    for m in ("knn", "weighted", "random"):
        fixed, counts = rp.repair(syn, real, t.ROLES, m)
        left = rp.invalid_categories(fixed, real, t.CATS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("still_invalid"))
        rows = [(m, c, n) for c, n in counts.items()]
        one = spark.createDataFrame(rows, "method string, column_name string, repaired bigint").crossJoin(left)
        one = one.crossJoin(fixed.agg(F.count(F.lit(1)).alias("rows")))  # one row each
        out = one if out is None else out.unionByName(one)
    return out
