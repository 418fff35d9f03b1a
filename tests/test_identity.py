"""A table compared with itself is perfect; results do not depend on the partitioning."""

import pytest
from pyspark.sql import functions as F

from veritab.catalog import tables as t
from veritab.operators import marginal, pairs, rows, split, structure
from veritab.operators.repair import repair


@pytest.mark.parametrize("fn", [marginal.ks_complement, marginal.tv_complement, marginal.boundary_adherence, marginal.category_adherence])
def test_perfect_scores(spark, sf, fn):
    real = t.ref(spark, sf)
    got = fn(real, real, t.ROLES).collect()
    assert got and all(r.score == pytest.approx(1.0) for r in got)


@pytest.mark.parametrize("fn", [marginal.jsd_equal_width, marginal.jsd_discrete_aware, marginal.jsd_adaptive, marginal.wasserstein_1d])
def test_zero_distances(spark, sf, fn):
    real = t.ref(spark, sf)
    got = fn(real, real, t.ROLES).collect()
    assert got and all(r.score == pytest.approx(0.0, abs=1e-9) for r in got)


def test_quality_is_one(spark, sf):
    real = t.ref(spark, sf)
    assert all(r.score == pytest.approx(1.0) for r in pairs.quality(real, real, t.ROLES).collect())


def test_nothing_hallucinated_or_new_in_a_copy(spark, sf):
    real = t.ref(spark, sf)
    got = {r.rate_name: r.row_count for r in rows.fact_rates(real, real, real, t.ROLES).collect()}
    assert got["HR"] == 0 and got["NovelFR"] == 0 and got["MemorizedFR"] == real.count()
    assert rows.new_row_score(real, real, t.ROLES).first().new_rows == 0


def test_empty_synthetic_gives_zero_rates(spark, sf):
    real = t.ref(spark, sf)
    assert all(r.rate == 0.0 and r.row_count == 0 for r in rows.fact_rates(real, real, real.where("false"), t.ROLES).collect())


def test_no_columns_is_an_empty_success(spark, sf):
    real = t.ref(spark, sf)
    assert marginal.ks_complement(real, real, t.ROLES, ["segment"]).count() == 0


def test_structure_of_equal_schemas(spark, sf):
    real = t.ref(spark, sf)
    assert structure.structure_score(structure.table_structure(real, real), True).first().score == 1.0


def test_split_ignores_partitioning(spark, sf):
    df = t.pop(spark, sf).select("row_id", "target")
    a = split.stratified_sample(df, "target", "row_id", 500, 3)
    b = split.stratified_sample(df.repartition(13), "target", "row_id", 500, 3)
    assert a.count() == 500 and a.exceptAll(b).count() == 0


def test_finer_digest_buckets_give_the_same_sample(spark, sf):
    from veritab.functions.distributed import first_by_digest, rank_by_digest
    from veritab.functions.expressions import digest

    df = t.pop(spark, sf).select("row_id", "target").withColumn("k", digest("row_id", 9))
    take = spark.createDataFrame([(True, 100), (False, 333)], "target boolean, take bigint")
    got = [sorted(r.row_id for r in first_by_digest(df, ["target"], "k", "row_id", take, d).collect()) for d in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 433
    ranks = [sorted((r.row_id, r.rk) for r in rank_by_digest(df, ["target"], "k", "row_id", d, "rk").collect()) for d in (1, 4)]
    assert ranks[0] == ranks[1]


def test_folds_are_even(spark, sf):
    df = t.pop(spark, sf).select("row_id", "target")
    n = [r["count"] for r in split.stratified_folds(df, "target", "row_id", 5, 1).groupBy("target", "fold").count().collect()]
    assert len(n) == 10 and max(n) - min(n) < df.count()


@pytest.mark.parametrize("method", ["random", "weighted", "knn"])
def test_repair_is_reproducible_and_complete(spark, sf, method):
    real, syn = t.ref(spark, sf), t.syn(spark, sf)
    a, counts = repair(syn, real, t.ROLES, method)
    b, _ = repair(syn.repartition(5), real.repartition(3), t.ROLES, method)
    bad = syn.where("priority = 'UNKNOWN'").count()
    assert counts == {"priority": bad}
    assert a.where("priority = 'UNKNOWN'").count() == 0 and a.count() == syn.count()
    assert a.exceptAll(b).count() == 0
    untouched = a.join(syn.select("row_id", F.col("priority").alias("was")), "row_id").where("was <> 'UNKNOWN' AND was <> priority")
    assert untouched.count() == 0


def test_repair_none_and_unknown_method(spark, sf):
    real, syn = t.ref(spark, sf), t.syn(spark, sf)
    assert repair(syn, real, t.ROLES, "none")[1] == {}
    with pytest.raises(ValueError):
        repair(syn, real, t.ROLES, "guess")
