"""Every query with a SQL twin gives the same rows, columns and values as DuckDB."""

import check
import pytest

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()
HEAVY = {"param_search", "trtr", "tstr", "cv_auc", "sweep_scores", "chain_scores", "one_generation", "detect_mlp", "detect_gbt", "sinkhorn", "k_anon_cluster"}
ROWS_ONLY = sorted(set(entry.queries()) - set(ORACLE) - HEAVY)


@pytest.fixture(scope="module")
def con(sf):
    return check.duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, sf, name):
    ok, note, _ = check.compare(spark, con, sf, name)
    assert ok, note


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, sf, name):
    assert not entry.queries()[name](spark, sf).isEmpty()


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    rows = {r.rate_name: r for r in entry.entry(spark).collect()}
    assert rows["TotalFR"].row_count == rows["NovelFR"].row_count + rows["MemorizedFR"].row_count
    assert rows["TotalFR"].rate + rows["HR"].rate == pytest.approx(1.0, abs=1e-5)
