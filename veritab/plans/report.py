"""Scores to tiers, the assessment sentence, and timing shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (metric, lowest score, below this score, tier, wording).
_INF = float("inf")


def _falling(metric: str, cuts: tuple[float, ...], tiers: tuple[str, ...], what: str) -> list:
    """Higher is better: cuts from best to worst."""
    edges = [_INF, *cuts, -_INF]
    return [(metric, edges[i + 1], edges[i], tier, f"{tier} {what}") for i, tier in enumerate(tiers)]


def _rising(metric: str, cuts: tuple[float, ...], tiers: tuple[str, ...], what: str) -> list:
    """Lower is better: cuts from best to worst."""
    edges = [-_INF, *cuts, _INF]
    return [(metric, edges[i], edges[i + 1], tier, f"{tier} {what}") for i, tier in enumerate(tiers)]


RULES = [
    *_falling("authenticity", (0.8, 0.6), ("Strong", "Moderate", "Low"), "authenticity (OC)"),
    *_falling("prdc_score", (0.8, 0.6), ("Strong", "Moderate", "Low"), "PRDC performance"),
    *_rising("wasserstein_distance", (0.01, 0.05, 0.1), ("Excellent", "Good", "Moderate", "Poor"), "distributional similarity (Wasserstein)"),
    *_rising("maximum_mean_discrepancy", (0.001, 0.01, 0.1), ("Excellent", "Good", "Moderate", "Poor"), "distributional similarity (MMD)"),
    *[r for m, what in (("jensenshannon_synthcity", "JS-Synthcity"), ("jensenshannon_syndat", "JS-SYNDAT"), ("jensenshannon_nannyml", "JS-NannyML"))
      for r in _rising(m, (0.01, 0.05, 0.1), ("Excellent", "Good", "Moderate", "Poor"), f"distributional similarity ({what})")],
    *_falling("new_row_synthesis", (0.9, 0.7), ("Excellent", "Good", "Low"), "synthesis novelty"),
    *_falling("ks_complement", (0.9, 0.7), ("Excellent", "Good", "Poor"), "distribution similarity"),
    *_falling("tv_complement", (0.9, 0.7), ("Excellent", "Good", "Poor"), "categorical similarity"),
    *_falling("table_structure", (0.95, 0.8), ("Perfect", "Good", "Poor"), "table structure match"),
    *_falling("semantic_structure", (0.95, 0.8), ("Perfect", "Good", "Poor"), "semantic structure match"),
    *_falling("boundary_adherence", (0.95, 0.8), ("Excellent", "Good", "Poor"), "boundary adherence"),
    *_falling("category_adherence", (0.95, 0.8), ("Excellent", "Good", "Poor"), "category adherence"),
    *_falling("sdmetrics_quality", (0.8, 0.6, 0.4), ("Excellent", "Good", "Fair", "Poor"), "overall quality (SDMetrics)"),
    *_falling("column_shape", (0.9, 0.8, 0.7, 0.5), ("Excellent", "Good", "Acceptable", "Poor", "Very poor"), "column shape"),
    *_rising("utility_gap", (0.02, 0.05), ("Excellent", "Acceptable", "High"), "utility loss"),
]
# These cut points belong to the better tier.
DETECTION_CUTS = ((0.55, "Excellent"), (0.65, "Good"), (0.75, "Fair"))


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "metric string, low double, high double, tier string, wording string")


def detection_tier(auc):
    out = F.lit("Poor")
    for cut, tier in reversed(DETECTION_CUTS):
        out = F.when(auc <= cut, F.lit(tier)).otherwise(out)
    return out


def tiers(scores: DataFrame) -> DataFrame:
    """(metric, score, tier, wording) of aggregate scores; a metric without a score is left out."""
    rules = F.broadcast(rules_table(scores.sparkSession))  # a few dozen rows
    s = scores.where(F.col("score").isNotNull()).alias("s")
    r = rules.alias("r")
    known = s.join(r, (F.col("s.metric") == F.col("r.metric")) & (F.col("score") >= F.col("low")) & (F.col("score") < F.col("high")))
    return known.select("s.metric", "score", "tier", "wording")


def assessment(tiered: DataFrame) -> DataFrame:
    """One sentence over all tiers, ordered by metric (one row per metric goes in)."""
    words = F.sort_array(F.collect_list(F.struct("metric", "wording")))
    joined = F.array_join(F.transform(words, lambda w: w["wording"]), ", ")
    return tiered.agg(F.when(F.size(words) > 0, joined).otherwise(F.lit("No successful metrics")).alias("assessment"))


def timing_share(stages: DataFrame) -> DataFrame:
    """(stage, seconds, share) with one row per stage; a stage without a time stays null."""
    whole = stages.agg(F.sum("seconds").alias("_all"))  # one row
    return stages.crossJoin(F.broadcast(whole)).select("stage", "seconds", F.try_divide("seconds", "_all").alias("share"))
