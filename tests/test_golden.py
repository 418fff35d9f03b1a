"""Hand-computed answers for small tables and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from veritab.functions.expressions import bin_label, canonical_text, to_binary
from veritab.operators import marginal, pairs, privacy, rows, split
from veritab.operators.encode import TableEncoder, TableEncoderModel
from veritab.plans import report
from veritab.sources import runs, typed
from veritab.sources.roles import BOOLEAN, CATEGORICAL, DATETIME, ID, NUMERICAL, Column, Roles, select_roles


def test_bins(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (9.99,), (10.0,), (-5.0,), (50.0,)], "v double")
    got = [r[0] for r in df.select(bin_label("v", F.lit(0.0), F.lit(10.0), 20)).collect()]
    assert got == ["Missing", "Missing", "1", "20", "20", "1", "20"]
    flat = [r[0] for r in df.select(bin_label("v", F.lit(3.0), F.lit(3.0), 20)).collect()]
    assert flat == ["Missing", "Missing", "1", "1", "1", "1", "1"]


def test_canonical_text(spark):
    df = spark.createDataFrame([(35.0,), (1e7,), (0.5,), (None,), (-2.25,), (1e-7,)], "v double")
    assert [r[0] for r in df.select(canonical_text("v", "double")).collect()] == ["35", "10000000", "0.5", "Missing", "-2.25", "0.0000001"]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "v boolean")
    assert [r[0] for r in flags.select(canonical_text("v", "boolean")).collect()] == ["True", "False", "Missing"]


def test_two_by_two_correction(spark):
    data = [("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] * 3 + [("b", "y")] * 7
    roles = Roles((Column("p", CATEGORICAL), Column("q", CATEGORICAL)))
    got = pairs.cramers_v(spark.createDataFrame(data, "p string, q string"), roles).first()
    chi2 = 20 * (abs(8 * 7 - 2 * 3) - 10) ** 2 / (10 * 10 * 11 * 9)
    assert got.value == pytest.approx(math.sqrt(chi2 / 20)) and got.n == 20


def test_one_category_has_no_association(spark):
    roles = Roles((Column("p", CATEGORICAL), Column("q", CATEGORICAL)))
    assert pairs.cramers_v(spark.createDataFrame([("a", "x"), ("a", "y")], "p string, q string"), roles).first().value == 0.0


def test_correlation_ratio(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 6.0), ("b", 8.0), ("b", None)], "c string, v double")
    roles = Roles((Column("c", CATEGORICAL), Column("v", NUMERICAL)))
    got = pairs.correlation_ratio(df, roles).first()
    assert got.value == pytest.approx(math.sqrt(25.0 / 29.0)) and got.n == 4


def test_null_category_counts(spark):
    roles = Roles((Column("c", CATEGORICAL),))
    real = spark.createDataFrame([("a",), ("b",)], "c string")
    syn = spark.createDataFrame([("a",), (None,)], "c string")
    assert marginal.tv_complement(real, syn, roles).first().score == pytest.approx(0.5)
    assert marginal.category_adherence(real, syn, roles).first().score == pytest.approx(0.5)


def test_distinct_up_to_survives_collisions(spark):
    from veritab.operators.longform import distinct_up_to

    long = spark.createDataFrame([("few", float(i % 3)) for i in range(30)] + [("many", float(i)) for i in range(30)], "column_name string, value double")
    for buckets in (1, 2, 4096):
        got = {r.column_name: r.distinct_values for r in distinct_up_to(long, 10, buckets).collect()}
        assert got == {"few": 3, "many": 10}


def test_largest_remainder(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, n bigint")
    got = {r.k: r["take"] for r in split.quotas(counts, "k", 7).collect()}
    assert sum(got.values()) == 7 and got == {"a": 4, "b": 2, "c": 1}


def test_sample_larger_than_table(spark):
    with pytest.raises(ValueError):
        split.stratified_sample(spark.range(5).withColumn("y", F.col("id") % 2), "y", "id", 6, 1)


def test_k_tiers_and_ratios(spark):
    a = spark.createDataFrame([("x",)] * 12 + [("y",)] * 10, "q string")
    b = spark.createDataFrame([("x",)] * 4 + [("y",)] * 7, "q string")
    k = privacy.k_anonymity({"reference": a, "synthetic": b}, ["q"])
    assert {r.dataset: (r.k, r.tier) for r in k.collect()} == {"reference": (10, "Excellent"), "synthetic": (4, "Moderate")}
    ratio = privacy.k_ratios(k).first()
    assert (ratio.numerator, ratio.denominator, ratio.ratio, ratio.tier) == ("synthetic", "reference", 0.4, "Much worse privacy")
    with pytest.raises(ValueError):
        privacy.k_anonymity({"reference": a, "synthetic": b}, ["missing"])


def test_row_hash_length_prefix(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    assert df.select(rows.row_hash(["x", "y"]).alias("h")).distinct().count() == 1
    assert df.select(rows.row_hash(["x", "y"], length_prefix=True).alias("h")).distinct().count() == 2


def test_to_binary_raises_on_other_text(spark):
    df = spark.createDataFrame([("maybe",)], "v string")
    with pytest.raises(Exception, match="maybe|CAST"):
        df.select(to_binary("v", "string")).collect()


ROLES = Roles((
    Column("id", ID), Column("flag", BOOLEAN), Column("n", NUMERICAL, "Int8"), Column("u", NUMERICAL, "UInt16"), Column("x", NUMERICAL, "Float"),
    Column("c", CATEGORICAL), Column("o", CATEGORICAL, order=("low", "mid", "high")), Column("d", DATETIME, datetime_format="%d/%m/%Y %H:%M"),
))


def test_typed_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id,flag,n,u,x,c,o,d,extra\n007,TRUE,35.0,65535,1.5,591,low,03/02/2020 10:30,z\n8,maybe,NA,,nan,None,high,,\n")
    df = typed.read_csv(spark, str(path), ROLES)
    a, b = df.orderBy("id").collect()
    assert (a.id, a.flag, a.n, a.u, a.x, a.c, a.o, str(a.d), a.extra) == ("007", True, 35, 65535, 1.5, "591", "low", "2020-02-03 10:30:00", "z")
    assert (b.id, b.flag, b.n, b.u, b.x, b.c, b.o, b.d) == ("8", None, None, None, None, None, "high", None)
    bad = tmp_path / "bad.csv"
    bad.write_text("n\n300\n")
    with pytest.raises(Exception, match="overflow|OVERFLOW|out of range"):
        typed.read_csv(spark, str(bad), ROLES).collect()


def test_roles_survive_schema_and_metadata():
    assert [(c.name, c.role, c.repr, c.order) for c in Roles.from_struct(ROLES.struct())] == [(c.name, c.role, c.repr, c.order) for c in ROLES]
    assert [(c.name, c.role, c.repr) for c in Roles.from_metadata(ROLES.metadata())] == [(c.name, c.role, c.repr) for c in ROLES]
    with pytest.raises(ValueError):
        Roles.from_metadata({})
    assert ROLES.encoding()["o"] == "ordered_label" and ROLES.encoding_document()["transformers"]["o"]["params"] == {"order": ["low", "mid", "high"]}


def test_missing_columns_abort(spark):
    with pytest.raises(ValueError, match="missing"):
        select_roles(spark.range(1), ROLES)
    with pytest.raises(ValueError, match="lacks"):
        typed.check_generated(["nope"], spark.range(1))
    with pytest.raises(ValueError, match="empty"):
        typed.check_generated(["id"], spark.range(0))
    with pytest.raises(ValueError):
        typed.check_config(ROLES, ROLES.encoding(), spark.range(1))


def test_file_fingerprint(spark, tmp_path):
    import hashlib

    f = tmp_path / "a.bin"
    f.write_bytes(b"x" * 1_500_000)
    assert runs.file_fingerprint(spark, str(f)) == hashlib.sha256(b"x" * 1048576).hexdigest()[:8]
    assert runs.file_fingerprint(spark, str(tmp_path / "none.bin")) == "unknown"


def test_table_fingerprint_ignores_order(spark):
    df = spark.range(50).withColumn("t", F.concat(F.lit("v"), F.col("id").cast("string")))
    assert runs.table_fingerprint(df).first() == runs.table_fingerprint(df.orderBy(F.col("id").desc()).repartition(3)).first()
    assert runs.table_fingerprint(df).first() != runs.table_fingerprint(df.where("id > 0")).first()


def test_pending_and_runs(spark, tmp_path):
    planned, done = spark.createDataFrame([("a", 1), ("a", 2)], "m string, s int"), spark.createDataFrame([("a", 1)], "m string, s int")
    assert [r.s for r in runs.pending(planned, done, ["m", "s"]).collect()] == [2]
    assert runs.pending(planned, done, ["m", "s"], force=True).count() == 2
    path = str(tmp_path / "runs")
    for g in (0, 1):
        runs.append_run(runs.run_record(spark.range(3), "r", "marginal", 1, g, None, {}, 0.5), path)
    assert spark.read.parquet(path).count() == 2


def test_score_sink_replaces_only_its_generation(spark, tmp_path):
    path = str(tmp_path / "scores")

    def one(g, s):
        return spark.createDataFrame([("r", g, s)], "run string, generation int, score double")

    for g, s in ((0, 0.1), (1, 0.2), (1, 0.3)):
        typed.write_scores(one(g, s), path)
    assert sorted((r.generation, r.score) for r in spark.read.parquet(path).collect()) == [(0, 0.1), (1, 0.3)]


@pytest.fixture(scope="module")
def mixed(spark):
    data = [(i, i % 3 == 0, i % 50, i * 7, i / 8, None if i % 9 == 0 else f"c{i % 4}", ("low", "mid", "high")[i % 3]) for i in range(200)]
    df = spark.createDataFrame(data, "id bigint, flag boolean, n int, u int, x double, c string, o string")
    return df.withColumn("d", F.expr("TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_dt_interval(int(id), 1, 2, 3.5)"))


@pytest.mark.parametrize("kind", ["uniform", "label", "one_hot"])
def test_round_trip(spark, mixed, kind):
    model = TableEncoder(ROLES, {"c": kind}).fit(mixed)
    encoded = model.transform(mixed)
    assert all(t == "double" for n, t in encoded.dtypes if n != "id")
    back = model.inverse(encoded)
    for c in ("flag", "n", "x", "c", "o", "d"):
        wrong = back.select("id", F.col(c).cast("string").alias("b")).join(mixed.select("id", F.col(c).cast("string").alias("a")), "id").where("NOT a <=> b")
        assert wrong.count() == 0, c


def test_one_hot_columns(mixed):
    enc = TableEncoder(ROLES, {"c": "one_hot"}).fit(mixed).transform(mixed)
    assert {"c__c0", "c__c1", "c__c2", "c__c3", "c__null"} <= set(enc.columns) and "c" not in enc.columns


def test_encoder_errors_and_clipping(spark, mixed):
    with pytest.raises(ValueError):
        TableEncoder(ROLES, {"c": "magic"}).fit(mixed)
    with pytest.raises(ValueError):
        TableEncoder(ROLES).fit(mixed.drop("x"))
    model = TableEncoder(ROLES).fit(mixed)
    far = model.transform(mixed).withColumns({"x": F.lit(1e9), "n": F.lit(-77.4)})
    row = model.inverse(far).first()
    assert row.x == 199 / 8 and row.n == 0


def test_encoder_state_is_portable(spark, mixed, tmp_path):
    model = TableEncoder(ROLES, seed=4).fit(mixed)
    model.save(str(tmp_path / "enc"))
    again = TableEncoderModel.load(spark, str(tmp_path / "enc"))
    assert again.transform(mixed).exceptAll(model.transform(mixed)).count() == 0


def test_population_encoder_is_reused(spark, mixed, tmp_path):
    import os

    from veritab.plans.encoding import population_encoder

    for _ in range(2):
        population_encoder(mixed, ROLES, str(tmp_path))
    assert len(os.listdir(tmp_path)) == 1
    population_encoder(mixed.where("id > 3"), ROLES, str(tmp_path))
    assert len(os.listdir(tmp_path)) == 2


def test_tiers(spark):
    s = spark.createDataFrame([("ks_complement", 0.9), ("wasserstein_distance", 0.05), ("utility_gap", -0.1), ("sdmetrics_quality", 0.41), ("tv_complement", None)], "metric string, score double")
    got = {r.metric: r.tier for r in report.tiers(s).collect()}
    assert got == {"ks_complement": "Excellent", "wasserstein_distance": "Moderate", "utility_gap": "Excellent", "sdmetrics_quality": "Fair"}
    assert report.assessment(report.tiers(s.where("false"))).first().assessment == "No successful metrics"
    auc = spark.createDataFrame([(0.55,), (0.66,), (0.9,)], "a double")
    assert [r[0] for r in auc.select(report.detection_tier(F.col("a"))).collect()] == ["Excellent", "Fair", "Poor"]
