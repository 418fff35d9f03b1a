"""Hot keys, many ranges and many tiles: the distributed paths against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritab.functions.distributed import exact_quantiles, lookup_join, running_totals
from veritab.operators import pairs, repair, rows, spatial
from veritab.operators.repair import combination_key, hamming_neighbours
from veritab.operators.scoring import auroc, best_threshold
from veritab.sources.roles import CATEGORICAL, ID, NUMERICAL, Column, Roles


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_with_hot_keys(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "k string, v int")
    plain = left.join(right, "k", how)
    salted = lookup_join(left, right, ["k"], how, hot_rows=500, salts=7)
    assert salted.count() == plain.count()
    assert salted.select("id", "k", "v").exceptAll(plain.select("id", "k", "v")).count() == 0
    weighted = right.withColumn("w", F.when(F.col("k") == "hot", 1000).otherwise(1))
    assert lookup_join(left, weighted, ["k"], how, hot_rows=500, salts=7, weight="w").select("id", "k", "v").exceptAll(plain.select("id", "k", "v")).count() == 0


def test_running_totals_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(500).select((F.col("id") % 2).alias("g"), ((F.col("id") * 37) % 500).alias("x"), (F.col("id") % 7 + 1).alias("n"))
        got = running_totals(df, ["g"], ["x"], ["n"], prev="x").toPandas().sort_values(["g", "x"])
        down = running_totals(df, ["g"], [F.col("n").desc(), F.col("x").asc()], ["n"]).toPandas().sort_values(["g", "n", "x"], ascending=[True, False, True])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = df.toPandas().sort_values(["g", "x"])
    assert (got["n_run"].to_numpy() == want.groupby("g")["n"].cumsum().to_numpy()).all()
    prev = want.groupby("g")["x"].shift().to_numpy()
    assert np.array_equal(got["x_prev"].to_numpy(dtype=float), prev, equal_nan=True)
    assert (down["n_run"].to_numpy() == down.groupby("g")["n"].cumsum().to_numpy()).all()


def test_exact_quantiles(spark):
    v = np.random.default_rng(1).integers(0, 40, 333) / 4
    levels = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    got = {round(r.level, 6): r.quantile for r in exact_quantiles(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", levels).collect()}
    for lv in levels:
        assert got[round(lv, 6)] == pytest.approx(np.quantile(v, lv))


@pytest.fixture(scope="module")
def clouds(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(150, 3)), np.tile([[0.5, 0.5, 0.5]], (40, 1)), r.normal(6, 0.2, size=(40, 3))])
    y = np.concatenate([r.normal(0.2, 1.1, size=(120, 3)), np.tile([[0.5, 0.5, 0.5]], (10, 1))])

    def df(m):
        return spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(m)], "id bigint, v array<double>")

    return x, y, df(x), df(y)


def dist(a, b):
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))


def test_radius_over_tiles(clouds):
    x, _, dx, _ = clouds
    t = spatial.tiled(dx, list(x.mean(0)), 16)
    assert t.select("tile").distinct().count() > 10
    got = {r.id: r.radius for r in spatial.knn_radius(t, 5).collect()}
    d = dist(x, x)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, 1)[:, 4]
    assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], want, atol=1e-9)


def test_prdc_over_tiles(clouds):
    x, y, dx, dy = clouds
    rx, ry = dist(x, x), dist(y, y)
    np.fill_diagonal(rx, np.inf), np.fill_diagonal(ry, np.inf)
    kx, ky, d = np.sort(rx, 1)[:, 4], np.sort(ry, 1)[:, 4], dist(x, y)
    want = ((d < kx[:, None]).any(0).mean(), (d < ky[None, :]).any(1).mean(), (d < kx[:, None]).sum() / (5 * len(y)), (d < kx[:, None]).any(1).mean())
    for size in (16, 4096):
        r = spatial.prdc(dx, dy, 5, size).first()
        assert (r.precision, r.recall, r.density, r.coverage) == pytest.approx(want)


def test_alpha_precision_is_the_same_over_tiles(clouds):
    _, _, dx, dy = clouds
    a, b = spatial.alpha_precision(dx, dy, 16).first(), spatial.alpha_precision(dx, dy, 4096).first()
    assert tuple(a) == pytest.approx(tuple(b))


def test_mmd_over_tiles_and_features(clouds):
    x, y, dx, dy = clouds
    xs, ys = (x - x.mean(0)) / x.std(0), (y - x.mean(0)) / x.std(0)
    g, n, m = 0.2, len(x), len(y)
    k = lambda a, b: np.exp(-g * dist(a, b) ** 2).sum()
    want = (k(xs, xs) - n) / (n * (n - 1)) + (k(ys, ys) - m) / (m * (m - 1)) - 2 * k(xs, ys) / (n * m)
    for size in (32, 4096):
        assert spatial.mmd(dx, dy, gamma=g, tile_rows=size).first().mmd2 == pytest.approx(want)
    assert spatial.mmd_rff(dx, dy, gamma=g, features=4096).first().mmd2 == pytest.approx(want, abs=0.02)
    assert abs(spatial.mmd(dx, dx, gamma=g).first().mmd2) < 0.02
    with pytest.raises(ValueError):
        spatial.mmd(dx, dy, kernel="linear")


def test_sinkhorn_against_numpy(clouds):
    x, y, dx, dy = clouds
    x, y = x[:60], y[:50]
    lo, hi = x.min(0), x.max(0)
    xs, ys = (x - lo) / (hi - lo), (y - lo) / (hi - lo)
    diam = np.sqrt(((np.maximum(xs.max(0), ys.max(0)) - np.minimum(xs.min(0), ys.min(0))) ** 2).sum())
    eps, e = [diam**2], 2 * math.log(diam)
    while e > 2 * math.log(0.05):
        eps.append(math.exp(e))
        e += 2 * math.log(0.5)
    eps.append(0.05**2)
    cxy, cxx, cyy = dist(xs, ys) ** 2 / 2, dist(xs, xs) ** 2 / 2, dist(ys, ys) ** 2 / 2
    la, lb = -math.log(len(xs)), -math.log(len(ys))

    def soft(ep, c, h):
        z = h[None, :] - c / ep
        top = z.max(1)
        return -ep * (top + np.log(np.exp(z - top[:, None]).sum(1)))

    f, gq, p, q = np.zeros(len(xs)), np.zeros(len(ys)), np.zeros(len(xs)), np.zeros(len(ys))
    for s, ep in enumerate([eps[0], *eps, eps[-1]]):
        n = soft(ep, cxy, lb + gq / ep), soft(ep, cxy.T, la + f / ep), soft(ep, cxx, la + p / ep), soft(ep, cyy, lb + q / ep)
        mix = (lambda o, v: (o + v) / 2) if 0 < s <= len(eps) else (lambda o, v: v)
        f, gq, p, q = mix(f, n[0]), mix(gq, n[1]), mix(p, n[2]), mix(q, n[3])
    want = (f - p).mean() + (gq - q).mean()
    got = spatial.sinkhorn(dx.where("id < 60"), dy.where("id < 50"), tile_rows=25).first().sinkhorn
    assert got == pytest.approx(want, rel=1e-6)


def test_hamming_neighbours_against_brute_force(spark):
    r = np.random.default_rng(5)
    feats = ["a", "b", "c"]
    ref = pd.DataFrame({f: r.choice(list("uvwxyz") + [None], 60) for f in feats})
    ask = pd.DataFrame({f: r.choice(list("uvwxyzk"), 25) for f in feats}).drop_duplicates()
    schema = ", ".join(f"{f} string" for f in feats)
    ref_df = spark.createDataFrame([(int(i), *[v for v in row]) for i, row in zip(ref.index, ref.values, strict=True)], f"rid bigint, {schema}")
    ask_df = spark.createDataFrame([tuple(row) for row in ask.values], schema)
    got = hamming_neighbours(ask_df.select(combination_key(feats).alias("_q"), *feats), ref_df, feats, "rid", 5)
    named = got.join(ask_df.select(combination_key(feats).alias("_q"), *feats), "_q").collect()
    for row in ask.values:
        d = (ref.values != row[None, :]).sum(1)
        want = sorted(zip(d, ref.index, strict=True))[:5]
        mine = sorted((g.differing, g._rid) for g in named if (g.a, g.b, g.c) == tuple(row))
        assert mine == [(int(a), int(b)) for a, b in want]


def test_spearman_with_hot_values_and_nulls(spark):
    r = np.random.default_rng(2)
    x = np.where(r.random(400) < 0.4, 1.0, r.integers(0, 50, 400).astype(float))
    y = x * 0.5 + r.normal(size=400)
    z = np.where(r.random(400) < 0.2, np.nan, -y + r.normal(size=400))
    df = spark.createDataFrame([(float(a), float(b), None if np.isnan(c) else float(c)) for a, b, c in zip(x, y, z, strict=True)], "x double, y double, z double")
    roles = Roles(tuple(Column(n, NUMERICAL) for n in "xyz"))
    pdf = pd.DataFrame({"x": x, "y": y, "z": z})
    for row in pairs.spearman(df, roles, hot_rows=50).collect():
        both = pdf[[row.column_1, row.column_2]].dropna().rank()
        assert row.n == len(both) and row.value == pytest.approx(both.corr().iloc[0, 1])


def test_new_rows_against_brute_force(spark):
    r = np.random.default_rng(7)
    real = [(i, "hot" if r.random() < 0.6 else f"k{i % 4}", float(r.choice([0.0, 1.0, -3.0, 100.0])), float(r.uniform(50, 60)), float(r.uniform(-2, 2))) for i in range(200)]
    syn = [(i, k, a * float(r.choice([1.0, 1.005, 1.02])), b * float(r.choice([1.0, 0.995, 1.03])), c) for i, k, a, b, c in real[:150]]
    syn += [(500 + i, "hot", 0.0001, 55.0, None) for i in range(5)]
    schema = "id bigint, k string, a double, b double, c double"
    roles = Roles((Column("id", ID), Column("k", CATEGORICAL), Column("a", NUMERICAL), Column("b", NUMERICAL), Column("c", NUMERICAL)))

    def close(s, v):
        return (s is None and v is None) or (s is not None and v is not None and abs(v - s) <= abs(s * 0.01))

    want = sorted(s[0] for s in syn if not any(s[1] == q[1] and all(close(s[j], q[j]) for j in (2, 3, 4)) for q in real))
    real_df, syn_df = spark.createDataFrame(real, schema), spark.createDataFrame(syn, schema)
    assert sorted(x.id for x in rows.new_rows(real_df, syn_df, roles, 0.01, hot_rows=20).collect()) == want
    score = rows.new_row_score(real_df, syn_df, roles).first()
    assert (score.new_rows, score.matched_rows) == (len(want), len(syn) - len(want))
    exact = sorted(s[0] for s in syn if not any(s[1:] == q[1:] for q in real))
    assert sorted(x.id for x in rows.new_rows(real_df, syn_df, roles, 0.0).collect()) == exact


def test_auroc_and_threshold_with_ties(spark):
    data = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.29), (0, 0.29)]
    df = spark.createDataFrame(data, "y int, p double")
    wins = sum((a > b) + 0.5 * (a == b) for u, a in data if u for v, b in data if not v)
    assert auroc(df, "y", "p").first().auroc == pytest.approx(wins / 9)
    assert best_threshold(df, "y", "p", "precision") == pytest.approx(0.51)
    with pytest.raises(ValueError):
        best_threshold(df, "y", "p", "luck")


def test_null_keys_are_spread(spark):
    """Rows with a null key meet nothing in a left join and do not gather in one task."""
    from pyspark.sql import functions as F

    from veritab.functions.distributed import lookup_join

    left = spark.range(40_000).select(F.when(F.col("id") % 100 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 40_000, 100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.set(key, {"spark.sql.adaptive.enabled": "false"}.get(key, "-1"))
    try:
        joined = lookup_join(left, right, ["k"], how="left", hot_rows=1000)
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 40_000 and joined.where("w is not null").count() == 400
        assert max(sizes) < 15_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_neighbours_over_pivots(clouds):
    x, y, dx, dy = clouds
    d, own = dist(x, y), dist(x, x)
    np.fill_diagonal(own, np.inf)
    for size in (8, 64, 4096):
        got = {(r.id, r.pos): (r.other, r.d) for r in spatial.nearest(dx, dy, 3, False, size).collect()}
        for i in range(len(x)):
            # equal distances go to the smaller id
            want = sorted(zip(np.round(d[i], 12), range(len(y)), strict=True))[:3]
            assert [got[i, p + 1][0] for p in range(3)] == [j for _, j in want]
            assert np.allclose([got[i, p + 1][1] for p in range(3)], [v for v, _ in want], atol=1e-9)
        radius = {r.id: r.radius for r in spatial.knn_radius(dx, 4, size).collect()}
        assert np.allclose([radius[i] for i in range(len(x))], np.sort(own, 1)[:, 3], atol=1e-9)


def test_few_points_than_neighbours(spark):
    pts = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "id bigint, v array<double>")
    got = sorted((r.id, r.other) for r in spatial.nearest(pts, pts, 5, True).collect())
    assert got == [(a, b) for a in range(3) for b in range(3) if a != b]


def test_pivots_skip_far_cells(spark):
    r = np.random.default_rng(11)
    centres = r.normal(0, 40, size=(20, 6))
    v = np.concatenate([c + r.normal(size=(40, 6)) for c in centres])
    pts = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(v)], "id bigint, v array<double>")
    seen = spatial.cells_visited(pts, 5, 40).first()
    assert seen.cells > 20 and seen.visited_pairs < seen.cell_pairs / 2 and seen.row_share < 0.5


def test_hamming_neighbours_in_nine_columns(spark):
    r = np.random.default_rng(9)
    feats = [f"c{i}" for i in range(9)]
    schema = ", ".join(f"{f} string" for f in feats)
    # a third of the rows are one combination
    ref = [[("u" if i % 3 == 0 else str(r.choice(list("uvwx")))) for _ in feats] for i in range(240)]
    ask = [[str(r.choice(list("uvwxz"))) for _ in feats] for _ in range(6)] + [["z"] * 9]
    ref_df = spark.createDataFrame([(i, *row, f"v{i}") for i, row in enumerate(ref)], f"rid bigint, {schema}, wanted string")
    ask_df = spark.createDataFrame([tuple(a) for a in ask], schema).select(combination_key(feats).alias("_q"), *feats)
    index = repair.combination_index(ref_df, feats, "rid", 4)
    assert index.count() <= 4 + 160 and index.where(" AND ".join(f"r_{f} = 'u'" for f in feats)).count() == 4
    got = hamming_neighbours(ask_df, ref_df, feats, "rid", 4, "wanted").join(ask_df, "_q").collect()
    for a in ask:
        d = [sum(p != q for p, q in zip(a, row, strict=True)) for row in ref]
        want = sorted(zip(d, range(len(ref)), strict=True))[:4]
        mine = sorted((g.differing, g._rid, g.value) for g in got if [g[f] for f in feats] == a)
        assert mine == [(x, i, f"v{i}") for x, i in want]


def test_rank_matrix_shares_patterns(spark):
    r = np.random.default_rng(4)
    n = 300
    gone = r.random(n) < 0.3
    frame = pd.DataFrame({"a": r.normal(size=n), "b": r.integers(0, 4, n).astype(float), "c": r.normal(size=n), "d": r.normal(size=n), "e": r.normal(size=n), "f": np.nan})
    frame.loc[gone, ["c", "d"]] = np.nan  # the same rows
    frame.loc[r.random(n) < 0.2, "e"] = np.nan
    clean = lambda v: [None if np.isnan(x) else float(x) for x in v]
    df = spark.createDataFrame([clean(v) for v in frame.to_numpy()], ", ".join(f"{c} double" for c in frame))
    roles = Roles(tuple(Column(n, NUMERICAL) for n in frame))
    x = {c: c for c in frame}
    assert pairs._null_patterns(df, list(frame), x) == {"a": None, "b": None, "c": "c", "d": "c", "e": "e", "f": "f"}
    half = df.where("b < 2")
    got = pairs.rank_matrix({"all": df, "half": half}, roles, hot_rows=40).collect()
    for g in got:
        own = frame if g.side == "all" else frame[frame.b < 2]
        both = own[[g.column_1, g.column_2]].dropna().rank()
        assert g.n == len(both) and g.value == pytest.approx(both.corr().iloc[0, 1])
    assert len(got) == 2 * 10


def test_band_join_cuts_heavy_cells(spark):
    r = np.random.default_rng(12)
    # the first two columns are mostly null, the discrete part is the same everywhere
    def row(i):
        return (i, "k", None if r.random() < 0.6 else float(r.uniform(1, 3)), None if r.random() < 0.6 else float(r.uniform(1, 3)), float(r.uniform(1, 500)), 7.0)

    real = [row(i) for i in range(600)]
    syn = [(i, k, a, b, c * float(r.choice([1.0, 1.004, 1.05])), e) for i, k, a, b, c, e in real[:300]]
    schema = "id bigint, k string, a double, b double, c double, e double"
    roles = Roles((Column("id", ID), Column("k", CATEGORICAL), *(Column(n, NUMERICAL) for n in "abce")))

    def close(s, v):
        return (s is None and v is None) or (s is not None and v is not None and abs(v - s) <= abs(s * 0.01))

    want = sum(not any(all(close(s[j], q[j]) for j in range(2, 6)) for q in real) for s in syn)
    real_df, syn_df = spark.createDataFrame(real, schema), spark.createDataFrame(syn, schema)
    for banded, heavy in ((2, 100_000), (1, 5), (0, 3), (4, 1), (1, 0)):
        assert rows.unmatched(real_df, syn_df, roles, 0.01, banded, heavy).agg(F.sum("n")).first()[0] == want
    cells = real_df.select(*[F.element_at(rows._match_cells(c, 0.01, 0), 1).alias(c) for c in "abce"])
    assert rows._by_evenness(cells, {c: c for c in "abce"})[0] == "c"


def test_wide_one_hot_is_sparse(spark):
    from veritab.operators.encode import TableEncoder, encoded_columns

    roles = Roles((Column("id", ID), Column("k", CATEGORICAL, encoder="one_hot"), Column("a", NUMERICAL)))
    df = spark.range(12_000).select("id", F.when(F.col("id") % 997 > 0, F.concat(F.lit("c"), (F.col("id") % 5000).cast("string"))).alias("k"), F.col("id").cast("double").alias("a"))
    model = TableEncoder(roles).fit(df)
    assert model.sizes["k"] == 5001
    enc = model.transform(df)
    assert dict(enc.dtypes)["k__sparse"] == "vector" and encoded_columns(model, enc) == ["a"]
    back = model.inverse(enc).select("id", "k")
    assert back.exceptAll(df.select("id", "k")).count() == 0 and back.count() == 12_000
    unseen = model.transform(spark.createDataFrame([(1, "other", 1.0)], "id bigint, k string, a double"))
    assert unseen.first()["k__sparse"].numNonzeros() == 0 and model.inverse(unseen).first().k is None


def test_pairs_of_blocks_are_not_shuffled(clouds):
    x, _, dx, dy = clouds
    plan = spatial.kernel_sums(dx, dy, 0.2, 16, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    keyed = dx.withColumn("side", F.when(F.col("id") < 40, 0).otherwise(1).cast("int")).coalesce(1).sortWithinPartitions("side")
    rows = spatial.packed(keyed, "side", 16).collect()
    assert all(r.n <= 16 and len(r.id) == 8 * r.n and len(r.v) == 24 * r.n for r in rows)
    assert sorted(i for r in rows for i in np.frombuffer(r.id, np.int64).tolist()) == list(range(len(x)))


def test_many_copies_and_null_ids_have_neighbours(spark):
    # 300 copies of one vector in blocks of 16 rows, and rows without an id
    data = [(i, [0.0, 0.0]) for i in range(300)] + [(1000 + i, [float(i + 1), 1.0]) for i in range(40)] + [(None, [7.0, 7.0]), (None, [9.0, 9.0])]
    pts = spark.createDataFrame(data, "id bigint, v array<double>")
    got = {r.id: r.radius for r in spatial.knn_radius(pts, 3, 16).where("id is not null").collect()}
    v = np.array([p for _, p in data])
    d = dist(v, v)
    np.fill_diagonal(d, np.inf)
    assert np.allclose([got[i] for i, _ in data[:340]], np.sort(d, 1)[:340, 2], atol=1e-12) and len(got) == 340
