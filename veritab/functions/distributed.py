"""Distributed building blocks that hold up when one key has a large share of the rows."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key with at least this many rows is joined through salts. At most rows / HOT_ROWS keys
# can be that frequent, which bounds the broadcast table of hot keys.
HOT_ROWS = 1_000_000
SALTS = 64
# A lookup table is broadcast only after its row count was checked against this bound.
BROADCAST_ROWS = 500_000


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the session; a private one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="veritab-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], sums: Sequence[str], prev: str | None = None
) -> DataFrame:
    """Prefix sums per group without putting a whole group into one task.

    Rows are range-partitioned on (group, order), summed inside each range, and shifted by the
    totals of the ranges before it. Adds `<s>_run` (inclusive) and `<s>_all` (group total) per
    summed column, and `<prev>_prev`, the value of the row before. Order keys must be unique in
    a group, so pre-aggregate first; the result is then independent of the partitioning.
    """
    keys = [F.col(g) for g in group]
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    spread = checkpointed(df.repartitionByRange(*keys, *by).withColumn("_range", F.spark_partition_id()))

    inside = Window.partitionBy(*group, "_range").orderBy(*by)
    local = spread.select(
        "*",
        *[F.sum(s).over(inside).alias(f"{s}_run") for s in sums],
        *([F.lag(prev).over(inside).alias(f"{prev}_prev")] if prev else []),
    )
    per_range = spread.groupBy(*group, "_range").agg(
        *[F.sum(s).alias(f"_t_{s}") for s in sums],
        *([F.max_by(prev, F.struct(*_ascending(order))).alias("_last")] if prev else []),
        F.count(F.lit(1)).alias("_n"),
    )
    across = Window.partitionBy(*group).orderBy("_range")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = per_range.select(
        *group,
        "_range",
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"{s}_all") for s in sums],
        *([F.lag("_last").over(across).alias("_before")] if prev else []),
    )
    # one row per (group, range): at most partitions + groups rows
    joined = local.join(F.broadcast(offsets), [*group, "_range"])
    kept = [c for c in df.columns if c not in group]
    return joined.select(
        *group,
        *kept,
        *[(F.col(f"{s}_run") + F.col(f"_o_{s}")).alias(f"{s}_run") for s in sums],
        *[F.col(f"{s}_all") for s in sums],
        *([F.coalesce(f"{prev}_prev", "_before").alias(f"{prev}_prev")] if prev else []),
    )


def _ascending(order: Sequence[Column | str]) -> list[Column]:
    if not all(isinstance(o, str) for o in order):
        raise ValueError("the previous value needs plain ascending order columns")
    return [F.col(o) for o in order]


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", hot_rows: int = HOT_ROWS, salts: int = SALTS,
    weight: str | None = None,
) -> DataFrame:
    """Equi join to a table with distinct keys that splits the hot keys of the left side.

    Keys holding at least `hot_rows` rows of `left` are found by a map-side combined count.
    Their rows are spread over `salts` tasks and the matching right rows copied to each.
    `weight` names a column of `right` that bounds the left rows of its key and saves the count.
    """
    on = list(on)
    counted = right.select(*on, F.col(weight).alias("_n")) if weight else left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    hot = counted.where(F.col("_n") >= hot_rows).select(*[F.col(k).alias(f"_h_{k}") for k in on])
    right = right.drop(weight) if weight else right

    def same(df: DataFrame) -> Column:
        cond = F.lit(True)
        for k in on:
            cond = cond & (df[k] == F.col(f"_h_{k}"))
        return cond

    # rows(left) / hot_rows keys at most
    marked_left = left.join(F.broadcast(hot), same(left), "left")
    marked_right = right.join(F.broadcast(hot), same(right), "left")
    is_hot = F.col(f"_h_{on[0]}").isNotNull()
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if not _is_map(left, c)]), F.lit(salts)).cast("int")
    # a null key meets nothing, so its rows may go anywhere
    loose = is_hot
    for k in on:
        loose = loose | left[k].isNull()
    salted_left = marked_left.withColumn("_salt", F.when(loose, spread).otherwise(0)).drop(*[f"_h_{k}" for k in on])
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = marked_right.withColumn("_salt", F.explode(copies)).drop(*[f"_h_{k}" for k in on])
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def _is_map(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "map"


def _cumulated(staged: DataFrame, strata: list[str], digits: int) -> DataFrame:
    """(strata, _b, _n, _run): histogram over digest prefixes with its running count, at most 16^digits rows per stratum."""
    hist = staged.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    if digits <= 4:
        return hist.withColumn("_run", F.sum("_n").over(Window.partitionBy(*strata).orderBy("_b")))
    return running_totals(hist, strata, ["_b"], ["_n"]).withColumnRenamed("_n_run", "_run").drop("_n_all")


def first_by_digest(
    df: DataFrame, strata: Sequence[str], key: str, tie: str, quota: DataFrame, digits: int
) -> DataFrame:
    """Keep exactly `quota` rows per stratum, those with the smallest digest.

    A histogram over the leading hex digits finds the one bucket the quota falls into; whole
    buckets below it pass a filter and only that bucket is ranked. The table is not shuffled.
    `quota` has the strata columns and `take`.
    """
    strata = list(strata)
    staged = df.withColumn("_b", F.substring(key, 1, digits))
    edge = (
        _cumulated(staged, strata, digits)
        .join(F.broadcast(quota), strata)
        .where((F.col("_run") >= F.col("take")) & (F.col("_run") - F.col("_n") < F.col("take")))
        .select(*strata, F.col("_b").alias("_edge"), (F.col("take") - F.col("_run") + F.col("_n")).alias("_left"))
    )
    placed = staged.join(F.broadcast(edge), strata)
    below = placed.where(F.col("_b") < F.col("_edge"))
    at = placed.where(F.col("_b") == F.col("_edge")).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*strata).orderBy(key, tie))
    )
    return below.select(*df.columns).unionByName(at.where(F.col("_rn") <= F.col("_left")).select(*df.columns))


def rank_by_digest(df: DataFrame, strata: Sequence[str], key: str, tie: str, digits: int, name: str) -> DataFrame:
    """Row number per stratum in digest order, ranked inside even digest buckets."""
    strata = list(strata)
    staged = df.withColumn("_b", F.substring(key, 1, digits))
    offsets = _cumulated(staged, strata, digits).select(*strata, "_b", (F.col("_run") - F.col("_n")).alias("_off"))
    inside = Window.partitionBy(*strata, "_b").orderBy(key, tie)
    ranked = staged.withColumn("_rn", F.row_number().over(inside))
    joined = ranked.join(F.broadcast(offsets) if digits <= 3 else offsets, [*strata, "_b"])
    return joined.select(*df.columns, (F.col("_off") + F.col("_rn")).cast("bigint").alias(name))


def digest_digits(rows: int, per_bucket: int = 200_000) -> int:
    """Leading hex digits that keep a digest bucket near `per_bucket` rows."""
    digits = 1
    while rows / 16**digits > per_bucket:
        digits += 1
    return digits


def exact_quantiles(values: DataFrame, value: str, levels: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles from a frequency table, one row per (group, level)."""
    group = list(group)
    base = values.where(F.col(value).isNotNull())
    if not group:
        base, group = base.withColumn("_g", F.lit(0)), ["_g"]
    freq = base.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(freq, group, [value], ["n"])
    lv = F.array(*[F.lit(float(x)) for x in levels])
    first, last, top = F.col("n_run") - F.col("n"), F.col("n_run") - 1, (F.col("n_all") - 1).cast("double")

    def lands(level: Column) -> Column:
        lo, hi = F.floor(level * top), F.ceil(level * top)
        return ((lo >= first) & (lo <= last)) | ((hi >= first) & (hi <= last))

    # only the rows a level falls on survive: at most two per level
    hit = run.select("*", F.explode(F.filter(lv, lands)).alias("level")).withColumn("_at", F.col("level") * top)
    lo, hi = F.floor("_at"), F.ceil("_at")
    found = hit.groupBy(*group, "level").agg(
        F.max(F.when((lo >= first) & (lo <= last), F.col(value))).alias("_a"),
        F.max(F.when((hi >= first) & (hi <= last), F.col(value))).alias("_b"),
        F.max("_at").alias("_at"),
    )
    frac = F.col("_at") - F.floor("_at")
    out = found.select(*group, "level", (F.col("_a") + (F.col("_b") - F.col("_a")) * frac).alias("quantile"))
    return out.drop("_g")
