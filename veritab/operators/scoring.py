"""Measures over (label, score) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.distributed import running_totals

# The swept thresholds 0.01 .. 0.98.
THRESHOLDS = [i / 100 for i in range(1, 99)]
OBJECTIVES = ("f1", "precision", "recall", "youden")


def auroc(df: DataFrame, label: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve by rank sums with average ranks, per group.

    Scores are counted first, then prefix-summed in ranges, so ties and large groups are cheap.
    """
    keys = list(group) or ["_g"]
    base = df if group else df.withColumn("_g", F.lit(0))
    y = F.col(label).cast("bigint")
    freq = base.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("_p")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )
    run = running_totals(freq, keys, ["_p"], ["pos", "neg"])
    below = (F.col("neg_run") - F.col("neg")) + F.col("neg") / 2
    area = F.sum(F.col("pos") * below)
    pairs = F.max("pos_all").cast("double") * F.max("neg_all")
    out = run.groupBy(*keys).agg(F.try_divide(area, pairs).alias("auroc"), F.max("pos_all").alias("positives"), F.max("neg_all").alias("negatives"))
    return out.drop("_g")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _rates(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 and youden from tp, fp, tn, fn; 0 on zero division."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return df.withColumns({
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn), "youden": _ratio(tp, tp + fn) + _ratio(tn, tn + fp) - 1.0,
    })


def confusion(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    hit, y = F.col(score) >= F.lit(threshold), F.col(label) == 1
    counts = df.agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn")
    )
    return _rates(counts).drop("youden")


def threshold_sweep(df: DataFrame, label: str, score: str, objective: str = "f1") -> DataFrame:
    """(threshold, tp, fp, tn, fn, rates..., best) for every threshold from one aggregation.

    Each score is counted once under the number of thresholds it reaches; cumulative sums over
    the 99 buckets give all confusion tables. The best is the first maximum.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective: {objective}")
    spark = df.sparkSession
    p = F.col(score).cast("double")
    ts = F.array(*[F.lit(x) for x in THRESHOLDS])
    guess = F.greatest(F.lit(0), F.least(F.lit(98), F.floor(p * 100).cast("int")))
    # the product can be off by one step: settle it against the literal thresholds
    up = F.when((guess < 98) & (p >= F.get(ts, guess)), guess + 1).otherwise(guess)
    reached = F.when((up > 0) & (p < F.get(ts, up - 1)), up - 1).otherwise(up)
    y = F.col(label).cast("bigint")
    hist = df.where(p.isNotNull()).groupBy(reached.alias("_b")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    steps = spark.range(0, 99).select(F.col("id").cast("int").alias("_b"))
    full = steps.join(F.broadcast(hist), "_b", "left").na.fill(0, ["pos", "neg"])
    down = Window.partitionBy().orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, 0)  # 99 rows
    everything = Window.partitionBy()
    cum = full.select(
        "_b", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(everything).alias("_p"), F.sum("neg").over(everything).alias("_n"),
    ).where(F.col("_b") > 0)
    table = _rates(cum.select(F.get(ts, F.col("_b") - 1).alias("threshold"), "tp", "fp", (F.col("_n") - F.col("fp")).alias("tn"), (F.col("_p") - F.col("tp")).alias("fn")))
    first = F.row_number().over(Window.partitionBy().orderBy(F.col(objective).desc(), F.col("threshold")))
    return table.withColumn("best", first == 1)


def best_threshold(df: DataFrame, label: str, score: str, objective: str = "f1") -> float:
    return float(threshold_sweep(df, label, score, objective).where("best").first().threshold)


def class_guard(df: DataFrame, label: str, group: Sequence[str]) -> DataFrame:
    """Whether a group has both classes; one class only means training is skipped."""
    y = F.col(label).cast("int")
    c = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.sum(y).alias("positives"))
    one = (F.col("positives") == 0) | (F.col("positives") == F.col("rows"))
    return c.withColumn("status", F.when(one, F.lit("skipped")).otherwise(F.lit("ok")))
