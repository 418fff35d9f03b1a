"""Queries for detection and downstream utility."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.catalog import tables as t
from veritab.catalog.columns import scores
from veritab.catalog.registry import query
from veritab.functions.distributed import checkpointed
from veritab.operators import detect, features, scoring
from veritab.operators.split import stratified_split
from veritab.plans import report, utility
from veritab.plans.utility import TreeParams

BOOSTED = TreeParams(rounds=500)  # at most: a held-out part stops earlier
TRIALS = 50  # as the surveyed search runs by default


@query(
    "fit_domain",
    "SELECT row_id, " + ", ".join(f"CASE WHEN {c} IN (SELECT {c} FROM ref) THEN {c} END AS {c}" for c in t.CATS) + " FROM syn",
    ("ref", "syn"),
)
def fit_domain(spark, sf):
    return features.fit_domain(t.ref(spark, sf), t.syn(spark, sf).select("row_id", *t.CATS), t.CATS)


@query(
    "target_encode",
    """SELECT row_id, round(coalesce(a.m, (SELECT avg(CAST(target AS INT)) FROM ref)), 6) AS priority, round(coalesce(b.m, (SELECT avg(CAST(target AS INT)) FROM ref)), 6) AS nation FROM syn
  LEFT JOIN (SELECT priority, avg(CAST(target AS INT)) AS m FROM ref GROUP BY 1) a USING (priority) LEFT JOIN (SELECT nation, avg(CAST(target AS INT)) AS m FROM ref GROUP BY 1) b USING (nation)""",
    ("ref", "syn"),
)
def target_encode(spark, sf):
    from veritab.catalog.encoders import roles_of

    train = t.ref(spark, sf).withColumn("y", F.col("target").cast("int"))
    space = features.FeatureSpace.fit(train, roles_of("priority", "nation"), "y")
    return scores(space.wide(t.syn(spark, sf), ["row_id"]))


@query("class_guard", "SELECT segment, tier, order_year, count(*) AS rows, sum(CAST(target AS INT)) AS positives, CASE WHEN sum(CAST(target AS INT)) IN (0, count(*)) THEN 'skipped' ELSE 'ok' END AS status FROM syn GROUP BY ALL", ("syn",))
def class_guard(spark, sf):
    return scoring.class_guard(t.syn(spark, sf), "target", ["segment", "tier", "order_year"])


@query(
    "auroc",
    """WITH r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM scored)
  SELECT round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * CAST(sum(1 - y) AS DOUBLE)), 6) AS auroc, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives FROM r""",
    ("scored",),
)
def auroc(spark, sf):
    return scores(scoring.auroc(t.scored(spark, sf), "y", "p"))


CONF = """count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (p >= t AND y = 0) AS fp, count(*) FILTER (p < t AND y = 0) AS tn, count(*) FILTER (p < t AND y = 1) AS fn"""
RATES = """round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 6) AS accuracy, round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 6) AS precision, round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) AS recall,
  round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), 6) AS f1"""


@query("confusion", f"SELECT tp, fp, tn, fn, {RATES} FROM (SELECT {CONF} FROM scored, (SELECT CAST(0.4 AS DOUBLE) AS t))", ("scored",))
def confusion(spark, sf):
    return scores(scoring.confusion(t.scored(spark, sf), "y", "p", 0.4))


@query(
    "threshold_sweep",
    f"""WITH s AS (SELECT t AS threshold, {CONF} FROM scored, (SELECT unnest(range(1, 99)) / CAST(100 AS DOUBLE) AS t) GROUP BY t),
  f AS (SELECT *, coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS obj FROM s)
  SELECT round(threshold, 6) AS threshold, tp, fp, tn, fn, {RATES}, round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) + coalesce(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 0) - 1.0, 6) AS youden,
  row_number() OVER (ORDER BY obj DESC, threshold) = 1 AS best FROM f""",
    ("scored",),
)
def threshold_sweep(spark, sf):
    return scores(scoring.threshold_sweep(t.scored(spark, sf), "y", "p", "f1"))


def _area(rows: str, group: str) -> str:
    """Areas under the curve of (group, y, p) rows by average ranks."""
    return f"""SELECT {group}, (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * CAST(sum(1 - y) AS DOUBLE)) AS auroc
  FROM (SELECT {group}, y, rank() OVER (PARTITION BY {group} ORDER BY p) + (count(*) OVER (PARTITION BY {group}, p) - 1) / 2.0 AS rk FROM {rows}) GROUP BY 1"""


@query(
    "detection_tiers",
    f"""WITH d AS (SELECT segment, 0 AS y, price AS p FROM ref UNION ALL SELECT segment, 1, price FROM syn), a AS ({_area('d', 'segment')})
  SELECT segment, round(auroc, 6) AS auroc, CASE WHEN auroc <= 0.55 THEN 'Excellent' WHEN auroc <= 0.65 THEN 'Good' WHEN auroc <= 0.75 THEN 'Fair' ELSE 'Poor' END AS tier FROM a""",
    ("ref", "syn"),
)
def detection_tiers(spark, sf):
    """How far the price alone tells synthetic rows from real ones, per segment."""
    cols = ["segment", "y", "price"]
    both = t.ref(spark, sf).withColumn("y", F.lit(0)).select(*cols).unionByName(t.syn(spark, sf).withColumn("y", F.lit(1)).select(*cols))
    found = scoring.auroc(both, "y", "price", ["segment"])
    return scores(found.select("segment", "auroc", report.detection_tier(F.col("auroc")).alias("tier")))


@query(
    "gap_tiers",
    f"""WITH d AS (SELECT nation, y, p FROM scored JOIN tst USING (row_id)), o AS (SELECT 1 AS one, y, p FROM d), g AS (
    SELECT (SELECT auroc FROM ({_area('o', 'one')})) - auroc AS gap FROM ({_area('d', 'nation')}))
  SELECT round(gap, 6) AS score, CASE WHEN gap < 0.02 THEN 'Excellent' WHEN gap < 0.05 THEN 'Acceptable' ELSE 'High' END AS tier,
         CASE WHEN gap < 0.02 THEN 'Excellent' WHEN gap < 0.05 THEN 'Acceptable' ELSE 'High' END || ' utility loss' AS wording FROM g""",
    ("scored", "tst"),
)
def gap_tiers(spark, sf):
    """Tier of the score's loss per nation against all rows."""
    rows = t.scored(spark, sf).join(t.tst(spark, sf).select("row_id", "nation"), "row_id")
    whole = scoring.auroc(rows, "y", "p").select(F.col("auroc").alias("whole"))
    each = scoring.auroc(rows, "y", "p", ["nation"]).crossJoin(F.broadcast(whole))  # one row
    gaps = each.select(F.lit("utility_gap").alias("metric"), (F.col("whole") - F.col("auroc")).alias("score"))
    return scores(report.tiers(gaps).select("score", "tier", "wording"))


@query(
    "calibration_split",
    """SELECT row_id, target, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY md5(CAST(row_id AS VARCHAR) || ':cal42'), row_id)
    <= floor(count(*) OVER (PARTITION BY target) * 0.8) THEN 'train' ELSE 'test' END AS split FROM ref""",
    ("ref",),
)
def calibration_split(spark, sf):
    """The rows that a calibrated model trains on, and those that its calibrator is fitted on."""
    return stratified_split(t.ref(spark, sf).select("row_id", "target"), "target", "row_id", 0.8, "cal42")


def _detect(method: str):
    def run(spark, sf):
        return detect.detection(t.ref(spark, sf), t.syn(spark, sf), t.ROLES, method)

    return run


query("detect_gmm")(_detect("detection_gmm"))
query("detect_gbt")(_detect("detection_xgb"))
query("detect_mlp")(_detect("detection_mlp"))
query("detect_linear")(_detect("detection_linear"))


@query("detect_ensemble")
def detect_ensemble(spark, sf):
    return detect.detection_suite(t.ref(spark, sf), t.syn(spark, sf), t.ROLES)


def _boosted(spark, sf):
    """Trees on 80 % of the real rows; the rest ends the boosting."""
    parts = checkpointed(stratified_split(t.ref(spark, sf), t.ROLES.target, t.ROLES.row_id, 0.8, f"val{BOOSTED.seed}"))
    fit_part, held = (parts.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    return utility.fit_model(fit_part, t.ROLES, BOOSTED, held)


@query("train_gbt")
def train_gbt(spark, sf):
    return _boosted(spark, sf).score(t.tst(spark, sf))


@query("cv_auc")
def cv_auc(spark, sf):
    return utility.cv_auroc(t.ref(spark, sf), t.ROLES, BOOSTED)


@query("param_search")
def param_search(spark, sf):
    return utility.param_search(t.ref(spark, sf), t.ROLES, trials=TRIALS)[1].limit(5)


@query("beta_calibration")
def beta_calibration(spark, sf):
    """Calibrated scores next to the raw ones."""
    df = t.scored(spark, sf)
    cal = utility.BetaCalibrator.fit(df, "y", "p")
    return df.select("row_id", "y", "p", cal.apply(F.col("p")).alias("calibrated"))


@query("linear_contrib")
def linear_contrib(spark, sf):
    return utility.linear_contributions(t.ref(spark, sf), t.ROLES, "target").limit(10)


@query("permutation_importance")
def permutation_importance(spark, sf):
    return utility.permutation_importance(_boosted(spark, sf), t.tst(spark, sf)).limit(10)


@query("trtr")
def trtr(spark, sf):
    return utility.trtr(t.ref(spark, sf), t.tst(spark, sf), t.ROLES, TRIALS)[1]


@query("tstr")
def tstr(spark, sf):
    frozen, base = utility.trtr(t.ref(spark, sf), t.tst(spark, sf), t.ROLES, TRIALS)
    return base.unionByName(utility.tstr(t.syn(spark, sf), t.tst(spark, sf), t.ROLES, frozen, base))
