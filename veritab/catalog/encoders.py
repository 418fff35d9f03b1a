"""Queries for the reversible encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.catalog import tables as t
from veritab.catalog.columns import scores
from veritab.catalog.registry import query
from veritab.functions.workspace import new_folder
from veritab.operators.encode import TableEncoder, TableEncoderModel
from veritab.sources.roles import Roles


def roles_of(*names: str) -> Roles:
    return Roles(tuple(c for c in t.ROLES if c.name in ("row_id", *names)))


def fitted(df, *names: str, kind: str | None = None, seed: int = 0) -> TableEncoderModel:
    return TableEncoder(roles_of(*names), {n: kind for n in names} if kind else {}, seed).fit(df)


def _intervals(cols, order: str = "n DESC, value") -> str:
    """Interval table over the training view."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM ref" for c in cols)
    return f"""c AS (SELECT column_name, value, count(*) AS n FROM ({long}) GROUP BY 1, 2),
  iv AS (SELECT column_name, value, n, (sum(n) OVER w - n) / CAST(sum(n) OVER p AS DOUBLE) AS start, sum(n) OVER w / CAST(sum(n) OVER p AS DOUBLE) AS stop
         FROM c WINDOW w AS (PARTITION BY column_name ORDER BY {order} ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY column_name))"""


def _draw(c: str, a: str) -> str:
    u = f"CAST(CAST('0x' || substr(md5(CAST(row_id AS VARCHAR) || ':{c}:0'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"
    return f"{a}.start + {u} * ({a}.stop - {a}.start)"


@query(
    "uniform_intervals",
    f"WITH {_intervals(t.CATS[:3])} SELECT column_name, value, n, round(start, 6) AS start, round(stop, 6) AS stop FROM iv",
    ("ref",),
)
def uniform_intervals(spark, sf):
    m = fitted(t.ref(spark, sf), *t.CATS[:3], kind="uniform")
    return scores(m.categories.select("column_name", "value", "n", "start", "stop"))


@query(
    "uniform_encode",
    f"""WITH {_intervals(t.CATS[:3])} SELECT row_id, {', '.join(f"round({_draw(c, 'i_' + c)}, 6) AS {c}" for c in t.CATS[:3])} FROM ref
  {' '.join(f"JOIN iv i_{c} ON i_{c}.column_name = '{c}' AND i_{c}.value = ref.{c}" for c in t.CATS[:3])}""",
    ("ref",),
)
def uniform_encode(spark, sf):
    df = t.ref(spark, sf).select("row_id", *t.CATS[:3])
    return scores(fitted(df, *t.CATS[:3], kind="uniform").transform(df))


@query(
    "uniform_roundtrip",
    "SELECT count(*) AS rows, 0 AS priority, 0 AS segment, 0 AS nation FROM ref",
    ("ref",),
)
def uniform_roundtrip(spark, sf):
    cols = t.CATS[:3]
    df = t.ref(spark, sf).select("row_id", *cols, *[F.col(c).alias(f"was_{c}") for c in cols])
    m = fitted(df, *cols, kind="uniform")
    back = m.inverse(m.transform(df))
    return back.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"was_{c}"))).alias(c) for c in cols])


TIER_POS = "coalesce(nullif(list_position(['-1','0','1','2','3','4'], value), 0), 1000000)"


@query(
    "ordered_uniform",
    f"WITH {_intervals(['tier'], TIER_POS + ', value')} SELECT row_id, round({_draw('tier', 'iv')}, 6) AS tier FROM ref JOIN iv ON iv.value = ref.tier",
    ("ref",),
)
def ordered_uniform(spark, sf):
    df = t.ref(spark, sf).select("row_id", "tier")
    return scores(fitted(df, "tier", kind="ordered_uniform").transform(df))


@query(
    "ordered_label",
    """SELECT row_id, CAST(list_position(['-1','0','1','2','3','4'], tier) - 1 AS DOUBLE) AS code, tier AS back FROM ref""",
    ("ref",),
)
def ordered_label(spark, sf):
    df = t.ref(spark, sf).select("row_id", "tier")
    m = fitted(df, "tier", kind="ordered_label")
    coded = m.transform(df).withColumn("code", F.col("tier"))
    # codes off by less than a half come back to the same label
    return m.inverse(coded.withColumn("tier", F.col("tier") + 0.4)).select("row_id", "code", F.col("tier").alias("back"))


@query(
    "label_encode",
    "SELECT row_id, CAST(dense_rank() OVER (ORDER BY nation) - 1 AS DOUBLE) AS nation, CAST(dense_rank() OVER (ORDER BY segment) - 1 AS DOUBLE) AS segment FROM ref",
    ("ref",),
)
def label_encode(spark, sf):
    df = t.ref(spark, sf).select("row_id", "nation", "segment")
    return fitted(df, "nation", "segment", kind="label").transform(df)


@query(
    "one_hot",
    """SELECT CAST(sum(CAST(l_returnflag = 'A' AS INT)) AS DOUBLE) AS a, CAST(sum(CAST(l_returnflag = 'N' AS INT)) AS DOUBLE) AS n,
  CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS DOUBLE) AS r, count(*) AS rows FROM lineitem""",
)
def one_hot(spark, sf):
    from veritab.sources.roles import CATEGORICAL, ID, Column

    df = t.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    roles = Roles((Column("l_orderkey", ID), Column("l_returnflag", CATEGORICAL)))
    enc = TableEncoder(roles, {"l_returnflag": "one_hot"}).fit(df).transform(df)
    return enc.agg(*[F.sum(f"l_returnflag__{v}").alias(v.lower()) for v in "ANR"], F.count(F.lit(1)).alias("rows"))


@query(
    "frequency_encode",
    f"WITH {_intervals(['nation', 'segment'])} SELECT row_id, round((a.start + a.stop) / 2, 6) AS nation, round((b.start + b.stop) / 2, 6) AS segment FROM ref "
    "JOIN iv a ON a.column_name = 'nation' AND a.value = ref.nation JOIN iv b ON b.column_name = 'segment' AND b.value = ref.segment",
    ("ref",),
)
def frequency_encode(spark, sf):
    df = t.ref(spark, sf).select("row_id", "nation", "segment")
    return scores(fitted(df, "nation", "segment", kind="frequency").transform(df))


@query("unix_ts", "SELECT event_id, CAST(epoch_us(ts) * 1000 AS DOUBLE) AS ns, ts AS back FROM events")
def unix_ts(spark, sf):
    from veritab.sources.roles import DATETIME, ID, Column

    df = t.table(spark, sf, "events").select("event_id", "ts")
    m = TableEncoder(Roles((Column("event_id", ID), Column("ts", DATETIME)))).fit(df)
    enc = m.transform(df).withColumn("ns", F.col("ts"))
    return m.inverse(enc).select("event_id", "ns", F.col("ts").alias("back"))


@query(
    "float_format",
    """WITH b AS (SELECT min(price) AS lo, max(price) AS hi FROM ref) SELECT row_id, round(greatest(lo, least(hi, round(price + 12.3456, 2))), 2) AS price,
  CAST(greatest((SELECT min(order_year) FROM ref), least((SELECT max(order_year) FROM ref), round(order_year + 0.75))) AS SMALLINT) AS order_year FROM syn, b""",
    ("ref", "syn"),
)
def float_format(spark, sf):
    m = fitted(t.ref(spark, sf), "price", "order_year")
    enc = m.transform(t.syn(spark, sf).select("row_id", "price", "order_year"))
    moved = enc.select("row_id", (F.col("price") + 12.3456).alias("price"), (F.col("order_year") + 0.75).alias("order_year"))
    return m.inverse(moved).withColumn("price", F.round("price", 2))


@query("binary_encode", "SELECT row_id, CAST(CAST(target AS INT) AS DOUBLE) AS code, target AS back FROM ref", ("ref",))
def binary_encode(spark, sf):
    m = fitted(t.ref(spark, sf), "target")
    enc = m.transform(t.ref(spark, sf).select("row_id", "target")).withColumn("code", F.col("target"))
    return m.inverse(enc).select("row_id", "code", F.col("target").alias("back"))


@query(
    "encode_table",
    f"""WITH {_intervals(t.CATS[:3])} SELECT row_id, CAST(CAST(target AS INT) AS DOUBLE) AS target, CAST(order_year AS DOUBLE) AS order_year, price, acctbal,
  {', '.join(f"round({_draw(c, 'i_' + c)}, 6) AS {c}" for c in t.CATS[:3])}, CAST(list_position(['-1','0','1','2','3','4'], tier) - 1 AS DOUBLE) AS tier,
  CAST(epoch_us(odate) * 1000 AS DOUBLE) AS odate FROM syn
  {' '.join(f"LEFT JOIN iv i_{c} ON i_{c}.column_name = '{c}' AND i_{c}.value = syn.{c}" for c in t.CATS[:3])}""",
    ("ref", "syn"),
)
def encode_table(spark, sf):
    m = TableEncoder(t.ROLES).fit(t.ref(spark, sf))
    enc = m.transform(t.syn(spark, sf))
    return enc.withColumns({c: F.round(c, 6) for c in t.CATS[:3]})


@query(
    "encode_eval_unseen",
    "SELECT c AS column_name, count(DISTINCT v) AS unseen_values, count(v) AS unseen_rows FROM (VALUES ('priority'), ('segment'), ('nation'), ('tier')) x(c) LEFT JOIN ("
    + " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v FROM syn WHERE {c} NOT IN (SELECT {c} FROM ref)" for c in t.CATS)
    + ") USING (c) GROUP BY 1",
    ("ref", "syn"),
)
def encode_eval_unseen(spark, sf):
    return TableEncoder(t.ROLES).fit(t.ref(spark, sf)).unseen(t.syn(spark, sf))


@query("encoder_state")
def encoder_state(spark, sf):
    """Save, load and use the fitted state: the reloaded encoder must agree with the first."""
    df = t.ref(spark, sf)
    m = TableEncoder(t.ROLES).fit(df)
    path = new_folder(spark, "encoder")
    m.save(path)
    again = TableEncoderModel.load(spark, path)
    return again.transform(df).exceptAll(m.transform(df)).agg(F.count(F.lit(1)).alias("differences"))


@query(
    "encode_training",
    f"""SELECT 'encoded' AS form, count(*) AS rows, {len(t.ROLES.encoding())} AS columns FROM ref UNION ALL SELECT 'decoded', count(*), {len(t.ROLES.names) - 1} FROM ref""",
    ("ref",),
)
def encode_training(spark, sf):
    """Encoded and decoded form of the training table with their shapes."""
    from veritab.plans.encoding import dual_forms

    encoded, decoded, shapes = dual_forms(t.pop(spark, sf), t.ref(spark, sf), t.ROLES)
    return shapes
