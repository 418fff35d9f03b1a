"""Encoded tables are made once, and short spellings are counted without patterns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veritab.operators import detect, encode
from veritab.operators.encode import TableEncoder, decimals
from veritab.sources.roles import BOOLEAN, CATEGORICAL, ID, NUMERICAL, Column, Roles

ROLES = Roles((Column("id", ID), Column("y", BOOLEAN, target=True), Column("a", NUMERICAL), Column("k", CATEGORICAL)))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, i % 3 == 0, i * 0.25, f"k{i % 4}") for i in range(400)], "id bigint, y boolean, a double, k string")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_folds_read_what_was_encoded(table):
    both = detect.labelled_union(table, table.withColumn("a", F.col("a") + 1), ROLES)
    # a category's draw is a digest of the row id; it must not be drawn again for means, counts and folds
    assert "md5" not in plan(both)
    assert both.count() == 800 and both.select("key").distinct().count() == 800


@pytest.mark.parametrize("values", [
    [0.5, 3.0, 1234567.25, None], [1e-13, 2.5e-13, 1.5], [float("nan"), 2.0], [float("inf"), 1.125], [12345678.25, 1e22], [1 / 3, -0.1], [None, None], [-0.0, 100.0]])
def test_digits_are_the_most_decimals(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "a double")
    row = df.agg(F.min("a"), F.max("a"), F.max(decimals(F.col("a")))).first()
    got = encode.numeric_state(df, ["a"])["a"]
    assert str((got["lo"], got["hi"], got["digits"])) == str((row[0], row[1], row[2] or 0))


def test_short_spellings_take_no_patterns(table, monkeypatch):
    monkeypatch.setattr(encode, "decimals", lambda c: pytest.fail("patterns over all rows"))
    assert TableEncoder(ROLES).fit(table).numeric["a"] == {"lo": 0.0, "hi": 99.75, "digits": 2}
