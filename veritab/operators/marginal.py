"""Per-column fidelity: each measure handles all its columns in one plan.

Every function takes (real, synthetic, roles, columns=None) and returns (column_name, score).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.distributed import running_totals
from veritab.functions.expressions import equal_width, js_part
from veritab.operators.longform import (
    CATEGORY_LIKE,
    NUMERIC_LIKE,
    as_number,
    distinct_up_to,
    number_bounds,
    number_frequencies,
    numbers,
    text_frequencies,
    texts,
    two_sided,
)
from veritab.sources.roles import Roles

NO_SCORES = "column_name string, score double"


def _pick(roles: Roles, kinds: Sequence[str], columns: Sequence[str] | None) -> list[str]:
    return roles.of(*kinds, within=columns)


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], NO_SCORES)


def _with_totals(freq: DataFrame, by: Sequence[str] = ("column_name",)) -> DataFrame:
    """Side totals per column next to every count (one row per column is broadcast)."""
    totals = freq.groupBy(*by).agg(F.sum("r").alias("r_all"), F.sum("s").alias("s_all"))
    return freq.join(F.broadcast(totals), list(by))


def _shares(freq: DataFrame) -> DataFrame:
    f = _with_totals(freq)
    return f.withColumn("p", F.coalesce(F.try_divide("r", "r_all"), F.lit(0.0))).withColumn(
        "q", F.coalesce(F.try_divide("s", "s_all"), F.lit(0.0))
    )


def ks_complement(real: DataFrame, syn: DataFrame, roles: Roles, columns: Sequence[str] | None = None) -> DataFrame:
    """1 - largest gap between the two cumulative distributions."""
    cols = _pick(roles, NUMERIC_LIKE, columns)
    if not cols:
        return _empty(real)
    run = running_totals(number_frequencies(real, syn, cols, roles), ["column_name"], ["value"], ["r", "s"])
    gap = F.abs(F.try_divide("r_run", "r_all") - F.try_divide("s_run", "s_all"))
    return run.groupBy("column_name").agg((F.lit(1.0) - F.max(gap)).alias("score"))


def wasserstein_1d(real: DataFrame, syn: DataFrame, roles: Roles, columns: Sequence[str] | None = None) -> DataFrame:
    """Area between the two cumulative distributions: `score` in the unit of the column (datetimes in microseconds), `scaled` as a
    share of the real table's range, which may be averaged over columns (null where the real values do not vary)."""
    cols = _pick(roles, NUMERIC_LIKE, columns)
    if not cols:
        return _empty(real).withColumn("scaled", F.col("score"))
    run = running_totals(number_frequencies(real, syn, cols, roles), ["column_name"], ["value"], ["r", "s"], prev="value")
    own = F.when(F.col("r") > 0, F.col("value"))
    return _area(run, ["column_name"], F.max(own) - F.min(own))


def _area(run: DataFrame, by: Sequence[str], width: Column | None = None) -> DataFrame:
    before = F.abs(
        F.try_divide(F.col("r_run") - F.col("r"), F.col("r_all")) - F.try_divide(F.col("s_run") - F.col("s"), F.col("s_all"))
    )
    step = F.coalesce(F.col("value") - F.col("value_prev"), F.lit(0.0))
    area = F.sum(before * step)
    scaled = [] if width is None else [F.try_divide(area, width).alias("scaled")]
    return run.groupBy(*by).agg(area.alias("score"), *scaled)


def tv_complement(real: DataFrame, syn: DataFrame, roles: Roles, columns: Sequence[str] | None = None) -> DataFrame:
    """1 - half the summed difference of category shares; null is a category."""
    cols = _pick(roles, CATEGORY_LIKE, columns)
    if not cols:
        return _empty(real)
    f = _shares(text_frequencies(real, syn, cols))
    return f.groupBy("column_name").agg((F.lit(1.0) - F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("score"))


def boundary_adherence(
    real: DataFrame, syn: DataFrame, roles: Roles, columns: Sequence[str] | None = None
) -> DataFrame:
    """Share of non-null synthetic values inside the real range: two narrow passes, no data shuffle."""
    cols = _pick(roles, NUMERIC_LIKE, columns)
    if not cols:
        return _empty(real)
    # one row per column
    bounds = F.broadcast(number_bounds(real, cols, roles).select("column_name", "lo", "hi"))
    long = numbers(syn, cols, roles).where(F.col("value").isNotNull())
    inside = F.col("value").between(F.col("lo"), F.col("hi")).cast("double")
    return long.join(bounds, "column_name").groupBy("column_name").agg(F.avg(inside).alias("score"))


def category_adherence(
    real: DataFrame, syn: DataFrame, roles: Roles, columns: Sequence[str] | None = None
) -> DataFrame:
    """Share of synthetic values whose category occurs in real; null needs a real null."""
    cols = _pick(roles, CATEGORY_LIKE, columns)
    if not cols:
        return _empty(real)
    f = text_frequencies(real, syn, cols)
    known = F.sum(F.when(F.col("r") > 0, F.col("s")).otherwise(0))
    return f.groupBy("column_name").agg(F.try_divide(known.cast("double"), F.sum("s")).alias("score"))


def _distance(buckets: DataFrame) -> DataFrame:
    f = _shares(buckets)
    total = F.sum(js_part(F.col("p"), F.col("q")))
    return f.groupBy("column_name").agg(F.sqrt(F.greatest(total, F.lit(0.0))).alias("score"))


def jsd_equal_width(
    real: DataFrame, syn: DataFrame, roles: Roles, columns: Sequence[str] | None = None, bins: int = 10
) -> DataFrame:
    """Jensen-Shannon distance over at most `bins` equal bins of the real range.

    Values outside the range and nulls share one extra bucket. Categories are compared as they are.
    """
    nums, cats = _pick(roles, NUMERIC_LIKE, columns), _pick(roles, CATEGORY_LIKE, columns)
    parts = []
    if nums:
        real_long = numbers(real, nums, roles)
        width = distinct_up_to(real_long, bins)
        bounds = number_bounds(real, nums, roles).join(width, "column_name")
        parts.append(two_sided(*[_binned(d, bounds, fold_outside=True) for d in (real_long, numbers(syn, nums, roles))],
                               ["column_name", "value"]))
    if cats:
        parts.append(text_frequencies(real, syn, cats))
    return _distance(_union(parts)) if parts else _empty(real)


def _binned(long: DataFrame, bounds: DataFrame, fold_outside: bool) -> DataFrame:
    """Bucket labels as text; bounds (one row per column) are broadcast."""
    b = long.join(F.broadcast(bounds), "column_name")
    n = F.col("distinct_values")
    idx = equal_width(F.col("value"), F.col("lo"), F.col("hi"), n)
    if fold_outside:
        idx = F.when(idx.isNull() | (idx < 1) | (idx > n), F.lit(0)).otherwise(idx)
    return b.select("column_name", idx.cast("string").alias("value"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def jsd_discrete_aware(
    real: DataFrame, syn: DataFrame, roles: Roles, columns: Sequence[str] | None = None,
    max_discrete: int = 10, bins: int = 10,
) -> DataFrame:
    """Jensen-Shannon distance; numeric columns with few distinct values are compared by value,
    the others over equal bins of the pooled range. Nulls are left out."""
    nums, cats = _pick(roles, NUMERIC_LIKE, columns), _pick(roles, CATEGORY_LIKE, columns)
    parts = []
    if nums:
        real_long, syn_long = numbers(real, nums, roles), numbers(syn, nums, roles)
        few = distinct_up_to(real_long, max_discrete + 1)
        pooled = number_bounds(real, nums, roles).unionByName(number_bounds(syn, nums, roles))
        bounds = pooled.groupBy("column_name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(few, "column_name")

        def labels(long: DataFrame) -> DataFrame:
            b = long.where(F.col("value").isNotNull()).join(F.broadcast(bounds), "column_name")
            by_bin = equal_width(F.col("value"), F.col("lo"), F.col("hi"), bins).cast("string")
            by_value = F.col("value").cast("string")
            return b.select(
                "column_name", F.when(F.col("distinct_values") <= max_discrete, by_value).otherwise(by_bin).alias("value")
            )

        parts.append(two_sided(labels(real_long), labels(syn_long), ["column_name", "value"]))
    if cats:
        parts.append(text_frequencies(real, syn, cats).where(F.col("value").isNotNull()))
    return _distance(_union(parts)) if parts else _empty(real)


def adaptive_bins(real: DataFrame, columns: Sequence[str], roles: Roles) -> DataFrame:
    """(column_name, lo, hi, distinct_values = bin count) from the skew-adaptive rule, clamped to 10..50."""
    aggs = [F.count(F.lit(1)).cast("double").alias("rows")]
    for i, c in enumerate(columns):
        v = as_number(real, c, roles)
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.count(v).cast("double").alias(f"n{i}"), F.skewness(v).alias(f"g{i}")]
    out = []
    for i, c in enumerate(columns):
        n, rows = F.col(f"n{i}"), F.col("rows")
        g = F.abs(F.coalesce(F.nanvl(f"g{i}", F.lit(0.0)), F.lit(0.0)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
        spread = F.sqrt(F.lit(6.0) * (rows - 2) / ((rows + 1) * (rows + 3)))
        raw = F.lit(1.0) + F.log2(rows) + F.log2(F.lit(1.0) + F.coalesce(g, F.lit(0.0)) / spread)
        count = F.greatest(F.lit(10), F.least(F.floor(raw).cast("int"), F.lit(50)))
        flat = F.col(f"lo{i}") == F.col(f"hi{i}")
        out.append(F.struct(
            F.lit(c).alias("column_name"),
            F.when(flat, F.col(f"lo{i}") - 0.5).otherwise(F.col(f"lo{i}")).alias("lo"),
            F.when(flat, F.col(f"hi{i}") + 0.5).otherwise(F.col(f"hi{i}")).alias("hi"),
            count.alias("distinct_values"),
        ))
    return real.agg(*aggs).select(F.inline(F.array(*out)))


def jsd_adaptive(
    real: DataFrame, syn: DataFrame, roles: Roles, columns: Sequence[str] | None = None
) -> DataFrame:
    """Jensen-Shannon distance on skew-adaptive real bins; synthetic values outside them are
    left out of the score and reported as dropped_share."""
    nums, cats = _pick(roles, NUMERIC_LIKE, columns), _pick(roles, CATEGORY_LIKE, columns)
    parts = []
    if nums:
        # one row per column
        bounds = adaptive_bins(real, nums, roles)

        def labels(df: DataFrame) -> DataFrame:
            return _binned(numbers(df, nums, roles).where(F.col("value").isNotNull()), bounds.select("*"), fold_outside=True)

        parts.append(two_sided(labels(real), labels(syn), ["column_name", "value"]))
    if cats:
        cat = text_frequencies(real, syn, cats).where(F.col("value").isNotNull())
        parts.append(cat.withColumn("value", F.concat(F.lit("="), F.col("value"))))
    if not parts:
        return real.sparkSession.createDataFrame([], NO_SCORES + ", dropped_share double")
    counts = _union(parts)
    outside = F.col("value") == "0"
    dropped = counts.groupBy("column_name").agg(
        F.coalesce(F.try_divide(F.sum(F.when(outside, F.col("s")).otherwise(0)).cast("double"), F.sum("s")), F.lit(0.0)).alias("dropped_share")
    )
    return _distance(counts.where(~outside)).join(dropped, "column_name")


def column_shapes(real: DataFrame, syn: DataFrame, roles: Roles, columns: Sequence[str] | None = None) -> DataFrame:
    """KS complement for numeric-like columns, TV complement for the others."""
    ks = ks_complement(real, syn, roles, columns).withColumn("metric", F.lit("ks_complement"))
    tv = tv_complement(real, syn, roles, columns).withColumn("metric", F.lit("tv_complement"))
    return ks.unionByName(tv).select("column_name", "metric", "score")


def null_profile(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null counts per column on both sides."""

    def side(df: DataFrame, name: str) -> DataFrame:
        agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        return agg.unpivot([], list(columns), "column_name", name)

    # one row per column on both sides
    return side(real, "real_nulls").join(F.broadcast(side(syn, "synthetic_nulls")), "column_name")
