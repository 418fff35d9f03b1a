"""Queries for scans, normalisation, checks, bookkeeping, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.catalog import tables as t
from veritab.catalog.registry import query
from veritab.functions.expressions import canonical_text, to_binary, to_boolean
from veritab.functions.workspace import new_folder
from veritab.operators import split
from veritab.plans.utility import class_weights
from veritab.sources import runs, typed
from veritab.sources.roles import BOOLEAN, CATEGORICAL, DATETIME, ID, NUMERICAL, Column, Roles, select_roles

# Query text of the test column with every boolean spelling and some that are none.
SPELLED = """CASE row_id % 9 WHEN 0 THEN 'True' WHEN 1 THEN 'true' WHEN 2 THEN 'TRUE' WHEN 3 THEN '1'
       WHEN 4 THEN 'False' WHEN 5 THEN 'FALSE' WHEN 6 THEN '0' WHEN 7 THEN 'yes' ELSE NULL END"""


@query(
    "typed_scan",
    """SELECT CAST(row_id AS VARCHAR) AS row_id, CASE WHEN row_id % 9 < 4 THEN TRUE WHEN row_id % 9 < 7 THEN FALSE END AS target,
       CAST(order_year AS SMALLINT) AS order_year, CASE WHEN row_id % 13 <> 0 THEN price END AS price,
       CASE WHEN row_id % 7 <> 0 THEN segment END AS segment, odate FROM pop""",
    ("pop",),
)
def typed_scan(spark, sf):
    k = F.col("row_id")
    path = new_folder(spark, "typed-scan")
    raw = t.pop(spark, sf).select(
        "row_id", F.expr(SPELLED).alias("target"), "order_year",
        F.when(k % 13 == 0, F.lit("NA")).otherwise(F.col("price").cast("string")).alias("price"),
        F.when(k % 7 == 0, F.lit("None")).otherwise(F.col("segment")).alias("segment"),
        F.date_format(F.col("odate").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("odate"),
    )
    typed.write_csv(raw, path)
    roles = Roles((
        Column("row_id", ID), Column("target", BOOLEAN), Column("order_year", NUMERICAL, "Int16"), Column("price", NUMERICAL, "Float"),
        Column("segment", CATEGORICAL), Column("odate", DATETIME, datetime_format="%Y-%m-%d %H:%M:%S"),
    ))
    return typed.read_csv(spark, path, roles)


@query(
    "bool_normalize",
    f"""SELECT row_id, CASE WHEN s IN ('True','true','TRUE','1') THEN TRUE WHEN s IN ('False','false','FALSE','0') THEN FALSE END AS value
       FROM (SELECT row_id, {SPELLED} AS s FROM pop)""",
    ("pop",),
)
def bool_normalize(spark, sf):
    return t.pop(spark, sf).select("row_id", to_boolean(F.expr(SPELLED)).alias("value"))


@query(
    "cat_normalize",
    """SELECT row_id, CASE WHEN row_id % 4 IN (0, 1) THEN NULL ELSE segment END AS segment, CAST(order_year AS VARCHAR) AS order_year FROM pop""",
    ("pop",),
)
def cat_normalize(spark, sf):
    k = F.col("row_id") % 4
    raw = t.pop(spark, sf).select(
        "row_id", F.when(k == 0, F.lit("nan")).when(k == 1, F.lit("None")).otherwise(F.col("segment")).alias("segment"), "order_year"
    )
    return typed.normalize_categories(raw, ["segment", "order_year"])


@query(
    "repr_violations",
    """SELECT 'l_partkey' AS column_name, 'Int8' AS representation, count(*) FILTER (l_partkey NOT BETWEEN -128 AND 127) AS violations, count(l_partkey) AS non_null FROM lineitem
       UNION ALL SELECT 'l_quantity', 'UInt8', count(*) FILTER (l_quantity NOT BETWEEN 0 AND 255 OR l_quantity <> floor(l_quantity)), count(l_quantity) FROM lineitem
       UNION ALL SELECT 'l_extendedprice', 'Int16', count(*) FILTER (l_extendedprice NOT BETWEEN -32768 AND 32767 OR l_extendedprice <> floor(l_extendedprice)), count(l_extendedprice) FROM lineitem
       UNION ALL SELECT 'l_discount', 'Float', 0, count(l_discount) FROM lineitem""",
)
def repr_violations(spark, sf):
    return typed.representation_violations(
        t.table(spark, sf, "lineitem"),
        {"l_partkey": "Int8", "l_quantity": "UInt8", "l_extendedprice": "Int16", "l_discount": "Float"},
    )


@query("pop_select", "SELECT row_id, target, order_year, price, acctbal, priority, segment, nation, tier, odate FROM pop", ("pop",))
def pop_select(spark, sf):
    return select_roles(t.pop(spark, sf), t.ROLES)


@query(
    "config_check",
    """SELECT p.column_name, p.problem, p.severity, coalesce(n.non_null, 0) AS non_null FROM
       (VALUES ('price', 'role without encoder', 'error'), ('weight', 'declared column not in data', 'error'),
               ('weight', 'role without encoder', 'error'), ('odate', 'data column not declared', 'warning'),
               ('volume', 'encoder without role', 'error')) p(column_name, problem, severity)
       LEFT JOIN (SELECT 'price' AS column_name, count(price) AS non_null FROM pop
                  UNION ALL SELECT 'odate', count(odate) FROM pop) n USING (column_name)""",
    ("pop",),
)
def config_check(spark, sf):
    df = t.pop(spark, sf)
    declared = Roles((*[c for c in t.ROLES if c.name != "odate"], Column("weight", NUMERICAL)))
    encoders = {c: "uniform" for c in declared.names if c not in ("price", "weight")} | {"volume": "uniform"}
    problems = typed.config_problems(spark, declared, encoders, df.columns)
    filled = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "non_null")
    # one row per column
    return problems.join(F.broadcast(filled), "column_name", "left").withColumn("non_null", F.coalesce("non_null", F.lit(0)))


@query(
    "gen_validate",
    """SELECT 'priority' AS column_name, TRUE AS present, count(priority) AS non_null, count(*) AS rows FROM syn
       UNION ALL SELECT 'acctbal', TRUE, count(acctbal), count(*) FROM syn
       UNION ALL SELECT 'weight', FALSE, 0, count(*) FROM syn""",
    ("syn",),
)
def gen_validate(spark, sf):
    return typed.generated_problems(["priority", "acctbal", "weight"], t.syn(spark, sf))


@query(
    "pending_work",
    """SELECT DISTINCT event_type AS model, user_id AS seed, CAST(hour(ts) AS INT) AS generation FROM events
       EXCEPT SELECT event_type, user_id, CAST(hour(ts) AS INT) FROM events WHERE value >= 5""",
)
def pending_work(spark, sf):
    ev = t.table(spark, sf, "events")
    work = ev.select(F.col("event_type").alias("model"), F.col("user_id").alias("seed"), F.hour("ts").alias("generation"), "value")
    keys = ["model", "seed", "generation"]
    return runs.pending(work.select(*keys).distinct(), work.where(F.col("value") >= 5), keys)


@query(
    "latest_record",
    """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def latest_record(spark, sf):
    ev = t.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return runs.latest(ev, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("one_test_set", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) <> 1")
def one_test_set(spark, sf):
    return runs.exactly_one(t.table(spark, sf, "events").where(F.col("event_type") == "error"), "user_id")


@query(
    "table_fingerprint",
    """SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', CAST(row_id AS VARCHAR), CASE WHEN target THEN 'True' ELSE 'False' END,
       CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE CAST(price AS VARCHAR) END, priority, tier)), 1, 10)) AS BIGINT)) AS VARCHAR) AS fingerprint FROM pop""",
    ("pop",),
)
def table_fingerprint(spark, sf):
    return runs.table_fingerprint(t.pop(spark, sf), ["row_id", "target", "price", "priority", "tier"])


@query(
    "score_sinks",
    """WITH s AS (SELECT event_type AS run, CAST(hour(ts) % 3 AS INT) AS generation, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY ALL)
  SELECT sink, s.* FROM s, (VALUES ('csv'), ('json'), ('parquet')) AS k(sink)""",
)
def score_sinks(spark, sf):
    """A scores table through every sink and back."""
    ev = t.table(spark, sf, "events").select(F.col("event_type").alias("run"), (F.hour("ts") % 3).cast("int").alias("generation"), "value")
    base = new_folder(spark, "sinks")
    typed.write_scores(ev, f"{base}/parquet")
    typed.write_json(ev, f"{base}/json")
    typed.write_csv(ev, f"{base}/csv")
    back = {"parquet": spark.read.parquet(f"{base}/parquet"), "json": spark.read.json(f"{base}/json"), "csv": spark.read.option("header", True).csv(f"{base}/csv")}
    rows = [df.select(F.lit(k).alias("sink"), F.col("run").cast("string").alias("run"), F.col("generation").cast("int").alias("generation"), F.col("value").cast("double").alias("value")) for k, df in back.items()]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.groupBy("sink", "run", "generation").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))


@query("run_record")
def run_record(spark, sf):
    return runs.run_record(t.syn(spark, sf), "demo", "planted", 7, 0, None, {"source": "pop"}, 0.0)


@query(
    "canonical_text",
    """SELECT row_id, CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE CAST(price AS VARCHAR) END AS price,
       CASE WHEN acctbal IS NULL THEN 'Missing' WHEN acctbal = floor(acctbal) THEN CAST(CAST(acctbal AS BIGINT) AS VARCHAR) ELSE CAST(acctbal AS VARCHAR) END AS acctbal,
       CASE WHEN target THEN 'True' ELSE 'False' END AS target, CAST(floor(price) * 1000 AS BIGINT)::VARCHAR AS big FROM syn""",
    ("syn",),
)
def canonical(spark, sf):
    return t.syn(spark, sf).select(
        "row_id", canonical_text("price", "double").alias("price"), canonical_text("acctbal", "double").alias("acctbal"),
        canonical_text("target", "boolean").alias("target"), canonical_text(F.floor("price").cast("double") * 1000, "double").alias("big"),
    )


@query(
    "to_binary",
    """SELECT row_id, CAST(target AS INT) AS from_bool, CAST(target AS INT) AS from_text, order_year % 2 AS from_number FROM pop""",
    ("pop",),
)
def binary_label(spark, sf):
    return t.pop(spark, sf).select(
        "row_id", to_binary("target", "boolean").alias("from_bool"),
        to_binary(F.concat(F.lit(" "), F.upper(F.col("target").cast("string"))), "string").alias("from_text"),
        to_binary(F.col("order_year") % 2, "int").alias("from_number"),
    )


@query(
    "class_balance",
    """SELECT quality, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM labels GROUP BY quality""",
)
def class_balance(spark, sf):
    return split.class_counts(t.table(spark, sf, "labels"), "quality").withColumn("share", F.round("share", 6))


@query(
    "class_weights",
    """SELECT y, n, round(CASE WHEN y = 1 THEN (sum(n) OVER () - n) / CAST(n AS DOUBLE) ELSE 1.0 END, 6) AS pos_weight,
       round(sum(n) OVER () / (2.0 * n), 6) AS balanced FROM (SELECT CAST(target AS INT) AS y, count(*) AS n FROM ref GROUP BY 1)""",
    ("ref",),
)
def weights(spark, sf):
    df = t.ref(spark, sf).select(F.col("target").cast("int").alias("y"))
    return class_weights(df, "y").select("y", "n", F.round("pos_weight", 6).alias("pos_weight"), F.round("balanced", 6).alias("balanced"))


QUOTA = """t AS (SELECT {total} AS total FROM pop), c AS (SELECT target, count(*) AS n FROM pop GROUP BY 1),
  e AS (SELECT target, n, total, CAST(n AS DOUBLE) * total / sum(n) OVER () AS ex FROM c, t),
  k AS (SELECT target, CAST(floor(ex) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY ex - floor(ex) DESC, target)
        <= total - sum(CAST(floor(ex) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS take FROM e)"""


@query(
    "strat_sample",
    f"""WITH {QUOTA.format(total='count(*) // 3')},
  r AS (SELECT row_id, target, row_number() OVER (PARTITION BY target ORDER BY md5(CAST(row_id AS VARCHAR) || ':7'), row_id) AS rn FROM pop)
  SELECT row_id, target FROM r JOIN k USING (target) WHERE rn <= take""",
    ("pop",),
)
def strat_sample(spark, sf):
    df = t.pop(spark, sf)
    return split.stratified_sample(df, "target", "row_id", df.count() // 3, 7).select("row_id", "target")


def _split_sql(share: str, seed: int) -> str:
    return f"""WITH c AS (SELECT target, CAST(floor(count(*) * CAST({share} AS DOUBLE)) AS BIGINT) AS take FROM pop GROUP BY 1),
  r AS (SELECT row_id, target, row_number() OVER (PARTITION BY target ORDER BY md5(CAST(row_id AS VARCHAR) || ':{seed}'), row_id) AS rn FROM pop)
  SELECT row_id, target, CASE WHEN rn <= take THEN 'train' ELSE 'test' END AS split FROM r JOIN c USING (target)"""


@query("strat_split", _split_sql("0.5", 11), ("pop",))
def strat_split(spark, sf):
    return split.stratified_split(t.pop(spark, sf).select("row_id", "target"), "target", "row_id", 0.5, 11)


@query("train_test", _split_sql("0.8", 42), ("pop",))
def train_test(spark, sf):
    return split.stratified_split(t.pop(spark, sf).select("row_id", "target"), "target", "row_id", 0.8, 42)


@query(
    "kfold",
    """SELECT row_id, target, CAST((row_number() OVER (PARTITION BY target ORDER BY md5(CAST(row_id AS VARCHAR) || ':5'), row_id) - 1) % 5 AS INT) AS fold FROM pop""",
    ("pop",),
)
def kfold(spark, sf):
    return split.stratified_folds(t.pop(spark, sf).select("row_id", "target"), "target", "row_id", 5, 5)


@query(
    "multi_seed_split",
    f"""WITH {QUOTA.format(total='count(*) // 2')}, s AS (SELECT unnest([1597, 196418, 14930352])::BIGINT AS dseed),
  r AS (SELECT dseed, row_id, target, row_number() OVER (PARTITION BY dseed, target ORDER BY md5(CAST(row_id AS VARCHAR) || ':' || CAST(dseed AS VARCHAR)), row_id) AS rn FROM pop, s),
  q AS (SELECT r.*, take, row_number() OVER (PARTITION BY dseed, r.target ORDER BY md5(CAST(row_id AS VARCHAR) || ':' || CAST(dseed AS VARCHAR) || ':half'), row_id) AS h
        FROM r JOIN k USING (target) WHERE rn <= take)
  SELECT dseed, row_id, target, CASE WHEN h <= take // 2 THEN 'train' ELSE 'test' END AS split FROM q""",
    ("pop",),
)
def multi_seed(spark, sf):
    df = t.pop(spark, sf).select("row_id", "target")
    return split.multi_seed_split(df, "target", "row_id", df.count() // 2, (1597, 196418, 14930352))
