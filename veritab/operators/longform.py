"""The long form shared by per-column measures: one scan and one shuffle for all columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.expressions import micros
from veritab.sources.roles import BOOLEAN, CATEGORICAL, DATETIME, NUMERICAL, Roles

NUMERIC_LIKE = (NUMERICAL, DATETIME)
CATEGORY_LIKE = (CATEGORICAL, BOOLEAN)


def as_number(df: DataFrame, name: str, roles: Roles) -> Column:
    """Column as double; a datetime becomes microseconds, NaN counts as missing."""
    if roles[name].role == DATETIME:
        dtype = dict(df.dtypes)[name]
        c = F.col(name).try_cast("timestamp_ntz") if dtype == "string" else F.col(name)
        return micros(c).cast("double")
    d = F.col(name).cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def as_text(name: str) -> Column:
    return F.col(name).cast("string")


def numbers(df: DataFrame, columns: Sequence[str], roles: Roles, keep: Sequence[str] = ()) -> DataFrame:
    """(column_name, value) with one row per cell of the numeric-like columns."""
    wide = df.select(*keep, *[as_number(df, c, roles).alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), "column_name", "value")


def texts(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    wide = df.select(*keep, *[as_text(c).alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), "column_name", "value")


def two_sided(real_long: DataFrame, syn_long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per key on both sides in one aggregation (combined map-side, so no key is hot)."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = real_long.select(*keys, one.alias("_r"), none.alias("_s")).unionByName(
        syn_long.select(*keys, none.alias("_r"), one.alias("_s"))
    )
    return both.groupBy(*keys).agg(F.sum("_r").alias("r"), F.sum("_s").alias("s"))


def number_frequencies(real: DataFrame, syn: DataFrame, columns: Sequence[str], roles: Roles) -> DataFrame:
    """Value counts of both sides for all numeric-like columns, nulls left out."""
    freq = two_sided(numbers(real, columns, roles), numbers(syn, columns, roles), ["column_name", "value"])
    return freq.where(F.col("value").isNotNull())


def text_frequencies(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Category counts of both sides; null is kept as a category of its own."""
    return two_sided(texts(real, columns), texts(syn, columns), ["column_name", "value"])


def number_bounds(df: DataFrame, columns: Sequence[str], roles: Roles) -> DataFrame:
    """(column_name, lo, hi, n) per column from one pass without a data shuffle."""
    aggs = []
    for i, c in enumerate(columns):
        v = as_number(df, c, roles)
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.count(v).alias(f"n{i}")]
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.col(f"n{i}").alias("n"))
        for i, c in enumerate(columns)
    ])
    return df.agg(*aggs).select(F.inline(rows))


def distinct_up_to(long: DataFrame, cap: int, buckets: int = 4096) -> DataFrame:
    """min(cap, exact number of distinct non-null values) per column.

    Values are folded into hash buckets, so a task ships at most `buckets` rows per column.
    Only a column with fewer than `cap` used buckets and a collision is counted in full.
    """
    values = long.where(F.col("value").isNotNull())
    folded = values.groupBy("column_name", F.pmod(F.xxhash64("value"), F.lit(buckets)).alias("_b")).agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi")
    )
    per = folded.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("_used"), F.count_if(F.col("_lo") != F.col("_hi")).alias("_mixed")
    )
    unsure = per.where((F.col("_used") < cap) & (F.col("_mixed") > 0)).select("column_name")
    # one row per column at most
    full = values.join(F.broadcast(unsure), "column_name", "left_semi").groupBy("column_name").agg(
        F.count_distinct("value").alias("_full")
    )
    return per.join(full, "column_name", "left").select(
        "column_name", F.least(F.lit(cap), F.coalesce("_full", "_used")).cast("int").alias("distinct_values")
    )
