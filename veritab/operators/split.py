"""Exact, seeded, stratified sampling and splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.distributed import digest_digits, first_by_digest, rank_by_digest
from veritab.functions.expressions import digest


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per class and their share of the table (a handful of rows)."""
    n = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def quotas(counts: DataFrame, target: str, total: int) -> DataFrame:
    """Largest-remainder quota per class, adding up to `total`; input has one row per class."""
    everything = Window.partitionBy()
    exact = F.col("n").cast("double") * F.lit(float(total)) / F.sum("n").over(everything)
    parts = counts.withColumn("_exact", exact).withColumn("_base", F.floor("_exact").cast("bigint"))
    rest = F.lit(total) - F.sum("_base").over(everything)
    order = Window.partitionBy().orderBy((F.col("_exact") - F.col("_base")).desc(), target)
    placed = parts.withColumn("_rest", rest).withColumn("_rk", F.row_number().over(order))
    return placed.select(
        target, "n", F.least(F.col("n"), F.col("_base") + (F.col("_rk") <= F.col("_rest")).cast("bigint")).alias("take")
    )


def stratified_sample(df: DataFrame, target: str, row_id: str, total: int, seed: int) -> DataFrame:
    """Exactly `total` rows with the class mix of the table."""
    rows = df.count()
    if total > rows:
        raise ValueError(f"asked for {total} of {rows} rows")
    take = quotas(df.groupBy(target).agg(F.count(F.lit(1)).alias("n")), target, total).select(target, "take")
    keyed = df.withColumn("_key", digest(row_id, seed))
    return first_by_digest(keyed, [target], "_key", row_id, take, digest_digits(rows)).drop("_key")


def _ranked(df: DataFrame, strata: Sequence[str], row_id: str, seed: object, name: str, rows: int) -> DataFrame:
    keyed = df.withColumn("_key", digest(row_id, seed))
    return rank_by_digest(keyed, strata, "_key", row_id, digest_digits(rows), name).drop("_key")


def stratified_split(
    df: DataFrame, target: str, row_id: str, share: float, seed: object, names: tuple[str, str] = ("train", "test")
) -> DataFrame:
    """Label every row: the first `share` of each class (rounded down) by digest gets names[0]."""
    rows = df.count()
    per = df.groupBy(target).agg(F.floor(F.count(F.lit(1)) * F.lit(share)).cast("bigint").alias("_take"))
    ranked = _ranked(df, [target], row_id, seed, "_rank", rows)
    # one row per class
    out = ranked.join(F.broadcast(per), target)
    return out.select(
        *df.columns, F.when(F.col("_rank") <= F.col("_take"), F.lit(names[0])).otherwise(F.lit(names[1])).alias("split")
    )


def stratified_folds(df: DataFrame, target: str, row_id: str, k: int, seed: object) -> DataFrame:
    """Fold 0..k-1 per row, classes spread evenly over the folds."""
    ranked = _ranked(df, [target], row_id, seed, "_rank", df.count())
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def sample_rows(df: DataFrame, row_id: str, n: int, seed: object) -> DataFrame:
    """Exactly n rows without replacement (all rows when there are fewer)."""
    return df.orderBy(digest(row_id, seed), row_id).limit(n)


def multi_seed_split(df: DataFrame, target: str, row_id: str, total: int, seeds: Sequence[int]) -> DataFrame:
    """A 50/50 stratified split of a stratified sample for every seed, in one job.

    The histogram, not the rows, is kept per seed: rows outside a seed's sample are dropped
    by a filter before anything is ranked.
    """
    rows = df.count()
    per_class = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    quota = quotas(per_class, target, total).select(target, "take")
    seeded = df.withColumn("dseed", F.explode(F.array(*[F.lit(int(s)).cast("bigint") for s in seeds])))
    keyed = seeded.withColumn("_key", F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.col("dseed").cast("string"))))
    seeds_df = quota.withColumn("dseed", F.explode(F.array(*[F.lit(int(s)).cast("bigint") for s in seeds])))
    digits = digest_digits(rows)
    cohort = first_by_digest(keyed, ["dseed", target], "_key", row_id, seeds_df, digits)
    # the halves are drawn with a second digest
    half = cohort.withColumn("_key", F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.col("dseed").cast("string"), F.lit("half"))))
    ranked = rank_by_digest(half, ["dseed", target], "_key", row_id, digest_digits(total), "_rank")
    lim = seeds_df.withColumn("_half", F.floor(F.col("take") / 2).cast("bigint")).drop("take")
    out = ranked.join(F.broadcast(lim), ["dseed", target])
    return out.select(
        "dseed", *df.columns, F.when(F.col("_rank") <= F.col("_half"), F.lit("train")).otherwise(F.lit("test")).alias("split")
    )
