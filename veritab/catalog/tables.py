"""The test tables seen as population, training, held-out and synthetic tables.

The same shapes are given twice: as DataFrames and as SQL for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.expressions import digest
from veritab.sources.roles import BOOLEAN, CATEGORICAL, DATETIME, ID, NUMERICAL, Column, Roles

TIERS = ("-1", "0", "1", "2", "3", "4")
ROLES = Roles((
    Column("row_id", ID),
    Column("target", BOOLEAN, target=True),
    Column("order_year", NUMERICAL, "Int16"),
    Column("price", NUMERICAL, "Float"),
    Column("acctbal", NUMERICAL, "Float"),
    Column("priority", CATEGORICAL),
    Column("segment", CATEGORICAL),
    Column("nation", CATEGORICAL),
    Column("tier", CATEGORICAL, order=TIERS),
    Column("odate", DATETIME),
))
QI = ["segment", "tier", "priority"]
CATS = ["priority", "segment", "nation", "tier"]
NUMS = ["order_year", "price", "acctbal"]

SQL = {
    "pop": """SELECT o_orderkey AS row_id, o_orderstatus = 'F' AS target, CAST(year(o_orderdate) AS INT) AS order_year,
       o_totalprice AS price, c_acctbal AS acctbal, o_orderpriority AS priority, c_mktsegment AS segment,
       n_name AS nation, CAST(CAST(floor(o_totalprice / 100000) AS INT) AS VARCHAR) AS tier, o_orderdate AS odate
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    # training half and held-out half of the population, drawn by digest
    "ref": "SELECT * FROM pop WHERE md5(CAST(row_id AS VARCHAR) || ':half') < '8'",
    "tst": "SELECT * FROM pop WHERE md5(CAST(row_id AS VARCHAR) || ':half') >= '8'",
    # a deterministic generator with planted defects, as many rows as the population
    "syn": """SELECT row_id, CASE WHEN row_id % 11 = 0 THEN NOT target ELSE target END AS target, order_year,
       CASE WHEN row_id % 5 = 0 THEN round(price * 1.03, 2) ELSE price END AS price,
       CASE WHEN row_id % 19 = 0 THEN NULL ELSE acctbal END AS acctbal,
       CASE WHEN row_id % 17 = 0 THEN 'UNKNOWN' ELSE priority END AS priority,
       CASE WHEN row_id % 7 = 0 THEN 'BUILDING' ELSE segment END AS segment, nation, tier, odate FROM pop""",
    "scored": """SELECT row_id, CAST(target AS INT) AS y, CAST(floor(price / 500 + row_id % 101) AS DOUBLE) / 1200 AS p FROM tst""",
    "vec_r": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    # each vector mixed with its mirror image
    "vec_s": """SELECT vec_id, list_transform(list_zip(v, list_reverse(v)), lambda z: z[1] * 0.75 + z[2] * 0.25) AS v FROM vec_r""",
}
NEEDS = {"ref": ("pop",), "tst": ("pop",), "syn": ("pop",), "scored": ("tst",), "vec_s": ("vec_r",)}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Prefix the fixture views a statement uses, in dependency order."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS.get(v, ()):
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    if not order:
        return sql
    head = ",\n".join(f"{v} AS ({SQL[v]})" for v in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pop(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").alias("target"),
        F.year("o_orderdate").cast("int").alias("order_year"), F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("acctbal"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"), F.floor(F.col("o_totalprice") / 100000).cast("int").cast("string").alias("tier"),
        F.col("o_orderdate").alias("odate"),
    )


def ref(spark: SparkSession, sf: str) -> DataFrame:
    return pop(spark, sf).where(digest("row_id", "half") < "8")


def tst(spark: SparkSession, sf: str) -> DataFrame:
    return pop(spark, sf).where(digest("row_id", "half") >= "8")


def syn(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("row_id")
    return pop(spark, sf).select(
        "row_id", F.when(k % 11 == 0, ~F.col("target")).otherwise(F.col("target")).alias("target"), "order_year",
        F.when(k % 5 == 0, F.round(F.col("price") * 1.03, 2)).otherwise(F.col("price")).alias("price"),
        F.when(k % 19 == 0, F.lit(None)).otherwise(F.col("acctbal")).alias("acctbal"),
        F.when(k % 17 == 0, F.lit("UNKNOWN")).otherwise(F.col("priority")).alias("priority"),
        F.when(k % 7 == 0, F.lit("BUILDING")).otherwise(F.col("segment")).alias("segment"), "nation", "tier", "odate",
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    p = F.floor(F.col("price") / 500 + F.col("row_id") % 101).cast("double") / 1200
    return tst(spark, sf).select("row_id", F.col("target").cast("int").alias("y"), p.alias("p"))


def vec_r(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def vec_s(spark: SparkSession, sf: str) -> DataFrame:
    mixed = F.zip_with("v", F.reverse("v"), lambda a, b: a * 0.75 + b * 0.25)
    return vec_r(spark, sf).select("vec_id", mixed.alias("v"))
