"""Reversible column encoders and the whole-table encoder built from them.

Fitting yields small state: one row per category in a table, and one entry per numeric column.
Transforming adds columns to the wide table; categories come from broadcast joins while the
state is small (the row count is known from fitting) and from split-key joins beyond that.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.distributed import BROADCAST_ROWS, HOT_ROWS, checkpointed, lookup_join, running_totals
from veritab.functions.expressions import EPOCH, canonical_text, micros, uniform
from veritab.operators.longform import texts
from veritab.sources.roles import REPRESENTATIONS, Roles

# Encoder names.
INTERVAL = ("uniform", "ordered_uniform", "frequency")
CODED = ("label", "ordered_label")
CATEGORY = (*INTERVAL, *CODED, "one_hot")
PLAIN = ("float_format", "binary", "unix_timestamp")
ENCODERS = (*CATEGORY, *PLAIN)
ONE_HOT_LIMIT = 2000
NULL_KEY = "-"


def key_of(c: Column) -> Column:
    """Category key that keeps null apart from every text."""
    return F.when(c.isNull(), F.lit(NULL_KEY)).otherwise(F.concat(F.lit("="), c.cast("string")))


def decimals(c: Column) -> Column:
    """Number of decimals in the shortest spelling of a double."""
    text = canonical_text(c, "double")
    small = F.regexp_extract(text, "E-(\\d+)$", 1)
    fraction = F.length(F.regexp_extract(text, "\\.(\\d+)(?:E-\\d+)?$", 1))
    return F.when(c.isNotNull(), fraction + F.coalesce(small.try_cast("int"), F.lit(0)))


def _short(c: Column) -> Column:
    """Whether the cast to text is the canonical spelling but for the ".0" of whole numbers."""
    text = c.cast("string")
    return (F.length(text) <= 18) & ~F.contains(text, F.lit("E"))


def _short_decimals(c: Column) -> Column:
    """`decimals` of a value with a short spelling, without patterns."""
    text = c.cast("string")
    point = F.instr(text, ".")
    return F.when((point == 0) | F.endswith(text, F.lit(".0")), F.lit(0)).otherwise(F.length(text) - point)


def numeric_state(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Bounds and most decimals per column; only values with a long spelling, if there are any, take the patterns of `decimals`."""
    at = {c: F.col(c).cast("double") for c in columns}
    row = df.agg(*[a for i, x in enumerate(at.values()) for a in (
        F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.max(F.when(_short(x), _short_decimals(x))).alias(f"d{i}"), F.count_if(~_short(x)).alias(f"n{i}"))]).first()
    out = {c: {"lo": row[f"lo{i}"], "hi": row[f"hi{i}"], "digits": row[f"d{i}"] or 0} for i, c in enumerate(columns)}
    for i, c in enumerate(columns):
        if row[f"n{i}"]:
            found = df.where(~_short(at[c])).agg(F.max(decimals(at[c])).alias("d")).first().d
            out[c]["digits"] = max(out[c]["digits"], found or 0)
    return out


def category_state(df: DataFrame, columns: list[str], orders: dict[str, tuple[str, ...]]) -> DataFrame:
    """(column_name, key, value, n, start, stop, code) for all category columns in one pass.

    Undeclared order: intervals by falling frequency, codes by sorted value with null last.
    """
    counts = texts(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts.withColumn("key", key_of(F.col("value"))))
    declared = F.create_map(*[x for c, o in orders.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in o]))]) if orders else None
    place = F.lit(None).cast("bigint")
    if declared is not None:
        spot = F.array_position(F.element_at(declared, F.col("column_name")), F.col("value"))
        # null and values outside the declared order come after it
        place = F.when(F.col("column_name").isin(*orders), F.when(spot > 0, spot).otherwise(F.lit(1_000_000))).cast("bigint")
    ranked = counts.withColumn("_place", place).withColumn("one", F.lit(1).cast("bigint"))
    first = F.coalesce("_place", -F.col("n"))
    by_mass = running_totals(ranked, ["column_name"], [first.asc(), F.col("key").asc()], ["n"])
    intervals = by_mass.select(
        "column_name", "key", "value", "n", ((F.col("n_run") - F.col("n")) / F.col("n_all")).alias("start"), (F.col("n_run") / F.col("n_all")).alias("stop")
    )
    by_name = running_totals(
        ranked, ["column_name"], [F.coalesce("_place", F.lit(0)).asc(), F.col("value").isNull().asc(), F.col("key").asc()], ["one"]
    )
    codes = by_name.select(
        "column_name", "key",
        F.when(F.col("_place") < 1_000_000, F.col("_place") - 1).when(F.col("_place").isNull(), F.col("one_run") - 1).alias("code"),
    )
    return checkpointed(intervals.join(codes, ["column_name", "key"]))


def interval_lookup(df: DataFrame, state: DataFrame, size: int, name: str) -> DataFrame:
    """Replace `name` by the category whose interval holds `_draw` (null stays null).

    A band lookup through a grid over [0, 1]: a frequent category covers many cells, so its rows
    stay spread, and every row meets only the intervals of its own cell.
    """
    grid = max(1024, 4 * size)
    g = float(grid)
    cells = state.select(
        F.col("start").alias("_a"), F.col("stop").alias("_b"), F.col("value").alias("_value"),
        F.explode(F.sequence(F.floor(F.col("start") * g), F.least(F.floor(F.col("stop") * g), F.lit(grid - 1)))).alias("_cell"),
    )
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0 - 2.0**-53), F.col("_draw")))
    plain = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() != "map"]
    away = F.lit(-1) - F.pmod(F.xxhash64(*plain), F.lit(4096))  # rows without a draw meet no cell, in many places
    probed = df.withColumn("_x", F.when(F.col("_draw").isNotNull(), x)).withColumn("_cell", F.coalesce(F.floor(F.col("_x") * g), away))
    if size <= BROADCAST_ROWS:
        cells = F.broadcast(cells)  # at most grid + categories rows
    cond = (probed["_cell"] == cells["_cell"]) & (F.col("_x") >= F.col("_a")) & (F.col("_x") < F.col("_b"))
    return probed.join(cells, cond, "left").withColumn(name, F.col("_value"))


@dataclass
class TableEncoderModel:
    roles: Roles
    encoders: dict[str, str]
    numeric: dict[str, dict]
    categories: DataFrame | None
    sizes: dict[str, int]
    seed: int = 0

    # -- forward -------------------------------------------------------------------------

    def transform(self, df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
        """Every encoded column as a number; others pass through. Unseen categories become null."""
        rid = self.roles.row_id
        out = df
        for name, kind in self.encoders.items():
            if kind in CATEGORY and kind != "one_hot" and name in df.columns:
                out = self._encode_category(out, name, kind, rid, hot_rows)
        plain: dict[str, Column] = {}
        for name, kind in self.encoders.items():
            if name not in df.columns:
                continue
            if kind == "float_format":
                plain[name] = F.col(name).cast("double")
            elif kind == "binary":
                plain[name] = F.col(name).cast("int").cast("double")
            elif kind == "unix_timestamp":
                plain[name] = (micros(F.col(name)) * 1000).cast("double")
        out = out.withColumns(plain)
        for name, kind in self.encoders.items():
            if kind == "one_hot" and name in df.columns:
                out = self._one_hot(out, name)
        return out

    def _state(self, name: str) -> DataFrame:
        return self.categories.where(F.col("column_name") == name)

    def _encode_category(self, df: DataFrame, name: str, kind: str, rid: str, hot_rows: int) -> DataFrame:
        state = self._state(name).select(F.col("key").alias("_k"), "start", "stop", F.col("code").cast("double").alias("_code"))
        keyed = df.withColumn("_k", key_of(F.col(name)))
        if self.sizes[name] <= BROADCAST_ROWS:
            joined = keyed.join(F.broadcast(state), "_k", "left")
        else:
            joined = lookup_join(keyed, state, ["_k"], "left", hot_rows=hot_rows)
        if kind in CODED:
            value = F.col("_code")
        elif kind == "frequency":
            value = (F.col("start") + F.col("stop")) / 2
        else:
            drawn = F.col("start") + uniform(rid, name, self.seed) * (F.col("stop") - F.col("start"))
            value = F.when(drawn >= F.col("stop"), (F.col("start") + F.col("stop")) / 2).otherwise(drawn)
        return joined.withColumn(name, value).drop("_k", "start", "stop", "_code").select(*df.columns)

    def one_hot_values(self, name: str) -> list:
        """The vocabulary of a column that is expanded into columns."""
        return [r.value for r in self._state(name).orderBy(F.col("value").asc_nulls_last()).select("value").collect()]

    def _sparse(self, name: str) -> bool:
        return self.sizes[name] > ONE_HOT_LIMIT

    def _one_hot(self, df: DataFrame, name: str) -> DataFrame:
        """One column per category; of a column with more than ONE_HOT_LIMIT of them, one sparse vector over the stored codes."""
        if self._sparse(name):
            size = self.sizes[name]
            state = self._state(name).select(F.col("key").alias("_k"), F.col("code").alias("_code"))
            keyed = df.withColumn("_k", key_of(F.col(name)))
            joined = keyed.join(F.broadcast(state), "_k", "left") if size <= BROADCAST_ROWS else lookup_join(keyed, state, ["_k"])
            # an unseen category is the vector without entries
            joined = joined.withColumn("_code", F.coalesce("_code", F.lit(size)).cast("double")).drop("_k")
            learnt = df.sparkSession.range(size - 1, size).select(F.col("id").cast("double").alias("_code"))
            hot = OneHotEncoder(inputCols=["_code"], outputCols=[f"{name}__sparse"], handleInvalid="keep").fit(learnt)
            return hot.transform(joined).drop("_code", name)
        flags = {}
        for v in self.one_hot_values(name):
            hit = F.col(name).isNull() if v is None else F.col(name).cast("string").eqNullSafe(F.lit(v))
            flags[f"{name}__{'null' if v is None else v}"] = hit.cast("int").cast("double")
        return df.withColumns(flags).drop(name)

    # -- backward ------------------------------------------------------------------------

    def inverse(self, df: DataFrame) -> DataFrame:
        """Numbers back to typed values: clipped, rounded, nearest code or enclosing interval."""
        out = df
        for name, kind in self.encoders.items():
            if kind == "one_hot":
                out = self._inverse_one_hot(out, name)
            elif name in out.columns and kind in CODED:
                out = self._inverse_code(out, name)
            elif name in out.columns and kind in INTERVAL:
                out = self._inverse_interval(out, name)
        plain: dict[str, Column] = {}
        for name, kind in self.encoders.items():
            if name not in out.columns:
                continue
            if kind == "float_format":
                s = self.numeric[name]
                dtype = REPRESENTATIONS[self.roles[name].repr or "Float"][0]
                v = F.round(F.col(name), s["digits"])
                if s["lo"] is not None:
                    v = F.when(v.isNotNull(), F.greatest(F.lit(s["lo"]), F.least(F.lit(s["hi"]), v)))
                plain[name] = v.cast(dtype)
            elif kind == "binary":
                plain[name] = F.col(name) >= 0.5
            elif kind == "unix_timestamp":
                whole = F.round(F.col(name) / 1000).cast("bigint")
                plain[name] = F.expr(EPOCH) + F.make_dt_interval(
                    F.lit(0), F.lit(0), F.lit(0), (whole / F.lit(1000000).cast("decimal(18,0)")).cast("decimal(18,6)")
                )
        return out.withColumns(plain)

    def _inverse_code(self, df: DataFrame, name: str) -> DataFrame:
        top = self.sizes[name] - 1
        order = self.roles[name].order
        if order:
            spot = F.greatest(F.lit(0), F.least(F.lit(len(order) - 1), F.round(F.col(name)).cast("int"))) + 1
            return df.withColumn(name, F.when(F.col(name).isNotNull(), F.element_at(F.array(*[F.lit(v) for v in order]), spot)))
        state = self._state(name).select(F.col("code").alias("_code"), F.col("value").alias("_value"))
        coded = df.withColumn("_code", F.greatest(F.lit(0), F.least(F.lit(top), F.round(F.col(name)))).cast("bigint"))
        joined = coded.join(F.broadcast(state), "_code", "left") if self.sizes[name] <= BROADCAST_ROWS else lookup_join(coded, state, ["_code"])
        return joined.withColumn(name, F.col("_value")).select(*df.columns)

    def _inverse_interval(self, df: DataFrame, name: str) -> DataFrame:
        return interval_lookup(df.withColumn("_draw", F.col(name)), self._state(name), self.sizes[name], name).select(*df.columns)

    def _inverse_sparse(self, df: DataFrame, name: str) -> DataFrame:
        """The category of a vector's largest entry; a vector without entries has none."""
        if f"{name}__sparse" not in df.columns:
            return df
        v = F.unwrap_udt(F.col(f"{name}__sparse"))
        spot = F.array_position(v["values"], F.array_max(v["values"])).cast("int")
        code = F.when(F.size(v["values"]) > 0, F.when(v["type"] == 0, F.element_at(v["indices"], spot)).otherwise(spot - 1)).cast("bigint")
        state = self._state(name).select(F.col("code").alias("_code"), F.col("value").alias(name))
        coded = df.withColumn("_code", code).drop(f"{name}__sparse")
        joined = coded.join(F.broadcast(state), "_code", "left") if self.sizes[name] <= BROADCAST_ROWS else lookup_join(coded, state, ["_code"])
        return joined.drop("_code")

    def _inverse_one_hot(self, df: DataFrame, name: str) -> DataFrame:
        if self._sparse(name):
            return self._inverse_sparse(df, name)
        values = self.one_hot_values(name)
        cols = [f"{name}__{'null' if v is None else v}" for v in values]
        if not set(cols) <= set(df.columns):
            return df
        best = F.array_position(F.array(*[F.col(f"`{c}`") for c in cols]), F.greatest(*[F.col(f"`{c}`") for c in cols]) if len(cols) > 1 else F.col(f"`{cols[0]}`"))
        labels = F.array(*[F.lit(v).cast("string") for v in values])
        return df.withColumn(name, F.element_at(labels, best.cast("int"))).drop(*cols)

    # -- unseen categories -----------------------------------------------------------------

    def unseen(self, df: DataFrame) -> DataFrame:
        """(column_name, unseen_values, unseen_rows) of categories that were not fitted."""
        cols = [n for n, k in self.encoders.items() if k in CATEGORY and n in df.columns]
        seen = texts(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("key", key_of(F.col("value")))
        known = self.categories.select("column_name", "key")
        if sum(self.sizes.values()) <= BROADCAST_ROWS:
            known = F.broadcast(known)
        new = seen.join(known, ["column_name", "key"], "left_anti").groupBy("column_name").agg(
            F.count(F.lit(1)).alias("unseen_values"), F.sum("n").alias("unseen_rows")
        )
        names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
        out = names.join(new, "column_name", "left")
        return out.select("column_name", F.coalesce("unseen_values", F.lit(0)).alias("unseen_values"), F.coalesce("unseen_rows", F.lit(0)).alias("unseen_rows"))

    # -- state -----------------------------------------------------------------------------

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        doc = json.dumps({"encoders": self.encoders, "numeric": self.numeric, "sizes": self.sizes, "seed": self.seed})
        spark.createDataFrame([(doc, self.roles.struct().json())], "state string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        if self.categories is not None:
            self.categories.write.mode("overwrite").parquet(f"{path}/categories")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TableEncoderModel:
        from pyspark.sql.types import StructType

        row = spark.read.parquet(f"{path}/model").first()
        doc = json.loads(row.state)
        has = any(k in CATEGORY for k in doc["encoders"].values())
        cats = spark.read.parquet(f"{path}/categories") if has else None
        return TableEncoderModel(
            Roles.from_struct(StructType.fromJson(json.loads(row.schema))), doc["encoders"], doc["numeric"], cats, doc["sizes"], doc["seed"]
        )


@dataclass
class TableEncoder:
    """Fits all columns at once: one aggregation for numbers, one for categories."""

    roles: Roles
    encoders: dict[str, str] = field(default_factory=dict)
    seed: int = 0

    def fit(self, df: DataFrame) -> TableEncoderModel:
        chosen = {**self.roles.encoding(), **self.encoders}
        wrong = {k for k in chosen.values() if k not in ENCODERS}
        if wrong:
            raise ValueError(f"unknown encoders: {sorted(wrong)}")
        missing = [c for c in chosen if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing from data: {missing}")
        nums = [c for c, k in chosen.items() if k == "float_format"]
        numeric: dict[str, dict] = {}
        if nums:
            numeric = numeric_state(df, nums)
        cats = [c for c, k in chosen.items() if k in CATEGORY]
        state, sizes = None, {}
        if cats:
            orders = {c: self.roles[c].order for c in cats if chosen[c].startswith("ordered") and self.roles[c].order}
            state = category_state(df, cats, orders)
            # one number per column
            sizes = {r.column_name: r.n for r in state.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        return TableEncoderModel(self.roles, chosen, numeric, state, sizes, self.seed)


def encoded_columns(model: TableEncoderModel, encoded: DataFrame) -> list[str]:
    """Numeric columns of an encoded table: encoded columns and their one-hot expansions, ids and sparse vectors left out."""
    base = set(model.encoders)
    ids = set(model.roles.of("id"))
    return [f.name for f in encoded.schema if f.name not in ids and (f.name in base or f.name.split("__")[0] in base) and not isinstance(f.dataType, VectorUDT)]
