"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep an Arrow batch of texts small, so that a Python worker holds a few MB and at least one row."""
    for key, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 16 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not use, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named(df: DataFrame, column: str) -> Column:
    return df[f"`{column}`"]


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def slices(texts: list[str | None], most: int) -> Iterator[range]:
    """Index ranges whose texts have about `most` characters together, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= most:
            yield range(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))
