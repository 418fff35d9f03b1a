"""Scalers fitted on the real table only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _scale(real: DataFrame, df: DataFrame, columns: Sequence[str], stats, apply) -> DataFrame:
    fit = real.agg(*[s.alias(f"_{k}_{c}") for c in columns for k, s in stats(F.col(c).cast("double")).items()])
    wide = df.crossJoin(F.broadcast(fit))  # exactly one row
    return wide.select(*[
        apply(F.col(c).cast("double"), lambda k, c=c: F.col(f"_{k}_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns
    ])


def zscore(real: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population sd of the real table; a constant column is only centred."""
    def stats(c: Column) -> dict:
        return {"mu": F.avg(c), "sd": F.stddev_pop(c)}

    def apply(x: Column, s) -> Column:
        return (x - s("mu")) / F.when(s("sd") == 0, F.lit(1.0)).otherwise(s("sd"))

    return _scale(real, df, columns, stats, apply)


def minmax(real: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) of the real table; a constant column is only shifted."""
    def stats(c: Column) -> dict:
        return {"lo": F.min(c), "hi": F.max(c)}

    def apply(x: Column, s) -> Column:
        span = s("hi") - s("lo")
        return (x - s("lo")) / F.when(span == 0, F.lit(1.0)).otherwise(span)

    return _scale(real, df, columns, stats, apply)


def as_vectors(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """(id, v) with the columns as one array; rows with a null are left out."""
    complete = df.dropna(subset=list(columns))
    return complete.select(F.col(row_id).alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))


@dataclass(frozen=True)
class VectorProfile:
    """Per-dimension statistics of a vector table: a few numbers per dimension."""

    mean: list[float]
    sd: list[float]
    lo: list[float]
    hi: list[float]

    @property
    def width(self) -> int:
        return len(self.mean)


def vector_profile(df: DataFrame) -> VectorProfile:
    """One pass; cells are combined map-side into one row per dimension."""
    cells = df.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    rows = cells.orderBy("i").collect()
    return VectorProfile(*[[float(r[k]) for r in rows] for k in ("mean", "sd", "lo", "hi")])


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def scale_vectors(df: DataFrame, profile: VectorProfile, how: str) -> DataFrame:
    """(id, v) scaled with the profile of the real table: zscore or minmax."""
    if how == "zscore":
        shift, span = profile.mean, profile.sd
    else:
        shift, span = profile.lo, [h - l for h, l in zip(profile.hi, profile.lo, strict=True)]
    centred = F.zip_with("v", literal_vector(shift), lambda x, m: x - m)
    return df.select("id", F.zip_with(centred, literal_vector([s or 1.0 for s in span]), lambda x, s: x / s).alias("v"))
