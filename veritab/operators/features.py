"""Model features from typed tables: train-fitted category domains and target means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.distributed import BROADCAST_ROWS, checkpointed, lookup_join
from veritab.operators.encode import key_of
from veritab.operators.longform import as_number, texts
from veritab.sources.roles import BOOLEAN, CATEGORICAL, DATETIME, NUMERICAL, Roles


def fit_domain(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Test table in which categories the training table does not have are missing."""
    seen = checkpointed(texts(train, columns).where(F.col("value").isNotNull()).distinct())
    sizes = {r.column_name: r.n for r in seen.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = test
    for c in columns:
        known = seen.where(F.col("column_name") == c).select(F.col("value").alias(c), F.lit(True).alias("_known"))
        out = out.withColumn(c, F.col(c).cast("string"))
        out = out.join(F.broadcast(known), c, "left") if sizes.get(c, 0) <= BROADCAST_ROWS else lookup_join(out, known, [c])
        out = out.withColumn(c, F.when(F.col("_known"), F.col(c))).select(*test.columns)
    return out


def target_means(train: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column_name, key, n, mean) of the label per category, all columns in one pass."""
    wide = train.select(F.col(label).cast("double").alias("_y"), *[F.col(c).cast("string").alias(c) for c in columns])
    long = wide.unpivot(["_y"], columns, "column_name", "value")
    return long.where(F.col("value").isNotNull()).groupBy("column_name", key_of(F.col("value")).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean")
    )


@dataclass
class FeatureSpace:
    """Numeric feature vector per row; fitted on the training table only."""

    roles: Roles
    label: str
    columns: list[str]
    codes: DataFrame | None
    sizes: dict[str, int]
    defaults: dict[str, float]

    @staticmethod
    def fit(train: DataFrame, roles: Roles, label: str, target_encoding: bool = True, default: str = "global") -> FeatureSpace:
        """Categories become target means (default for unseen: the global mean, or the mean of the
        category means) or sorted codes (unseen: -1). A missing number sorts below the smallest."""
        cols = [c for c in roles.features if c != label]
        cats = [c for c in cols if roles[c].role == CATEGORICAL]
        nums = [c for c in cols if roles[c].role in (NUMERICAL, DATETIME)]
        low = train.agg(*[F.min(as_number(train, c, roles)).alias(c) for c in nums]).first() if nums else {}
        defaults = {c: float(low[c] if low[c] is not None else 0.0) - 1.0 for c in nums}
        codes, sizes = None, {}
        if cats:
            codes = checkpointed(target_means(train, cats, label))
            if not target_encoding:
                from veritab.functions.distributed import running_totals

                ones = codes.select("column_name", "key", "n", F.lit(1).cast("bigint").alias("one"))
                codes = running_totals(ones, ["column_name"], ["key"], ["one"]).select(
                    "column_name", "key", "n", (F.col("one_run") - 1).cast("double").alias("mean"))
            # a few numbers per column
            stats = codes.groupBy("column_name").agg(
                F.count(F.lit(1)).alias("k"), F.avg("mean").alias("flat"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("glob")).collect()
            sizes = {r.column_name: r.k for r in stats}
            for r in stats:
                defaults[r.column_name] = -1.0 if not target_encoding else (r.glob if default == "global" else r.flat)
            for c in cats:
                defaults.setdefault(c, -1.0)
        return FeatureSpace(roles, label, cols, codes, sizes, defaults)

    def wide(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Features as plain double columns."""
        out = df.select(*keep, *[c for c in self.columns if c not in keep])
        for c in self.columns:
            if self.roles[c].role != CATEGORICAL:
                continue
            state = self.codes.where(F.col("column_name") == c).select(F.col("key").alias("_k"), F.col("mean").alias("_m"))
            keyed = out.withColumn("_k", key_of(F.col(c)))
            joined = keyed.join(F.broadcast(state), "_k", "left") if self.sizes.get(c, 0) <= BROADCAST_ROWS else lookup_join(keyed, state, ["_k"])
            out = joined.withColumn(c, F.coalesce("_m", F.lit(self.defaults[c]))).drop("_k", "_m")
        plain = {}
        for c in self.columns:
            kind = self.roles[c].role
            if kind in (NUMERICAL, DATETIME):
                plain[c] = F.coalesce(as_number(df, c, self.roles), F.lit(self.defaults[c]))
            elif kind == BOOLEAN:
                plain[c] = F.coalesce(F.col(c).cast("int").cast("double"), F.lit(-1.0))
        return out.withColumns(plain)

    def vectors(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return assemble(self.wide(df, keep), self.columns, keep)


def assemble(wide: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(wide).select(*keep, "features")
