"""Metric registry and router: one scores table out of many measures.

Scores are long: (metric, column_1, column_2, score, status, detail).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.distributed import checkpointed
from veritab.operators import detect, marginal, pairs, privacy, rows, scaling, spatial, structure
from veritab.operators.encode import TableEncoderModel, encoded_columns
from veritab.sources.roles import Roles

SIDE_BY_SIDE = 4
SCHEMA = "metric string, column_1 string, column_2 string, score double, status string, detail map<string,double>"


@dataclass
class Inputs:
    """The tables a metric may need; encoded ones are all-numeric, decoded ones typed."""

    roles: Roles
    reference: DataFrame
    synthetic: DataFrame
    reference_encoded: DataFrame | None = None
    synthetic_encoded: DataFrame | None = None
    encoder: TableEncoderModel | None = None
    population: DataFrame | None = None
    training: DataFrame | None = None
    params: dict[str, dict] = field(default_factory=dict)
    locks: dict[str, Lock] = field(default_factory=dict)
    shared: dict[str, DataFrame] = field(default_factory=dict)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A result that several metrics read; metrics may run side by side."""
        with self.locks.setdefault(name, Lock()):
            if name not in self.shared:
                self.shared[name] = checkpointed(build())
            return self.shared[name]

    def vectors(self) -> tuple[DataFrame, DataFrame]:
        """Both encoded tables as scaled vectors, made once."""
        return self.once("reference", lambda: self._vectors()[0]), self.once("synthetic", lambda: self._vectors()[1])

    def _vectors(self) -> tuple[DataFrame, DataFrame]:
        if self.encoder is None:
            raise ValueError("encoded tables are needed")
        cols = encoded_columns(self.encoder, self.reference_encoded)
        rid = self.roles.row_id
        # a vector holds the evaluation columns only; missing values sit at the real mean
        scaled = [scaling.zscore(self.reference_encoded, d, cols).na.fill(0.0, cols) for d in (self.reference_encoded, self.synthetic_encoded)]
        return tuple(scaling.as_vectors(d, rid, cols) for d in scaled)

    def datasets(self) -> dict[str, DataFrame]:
        out = {"reference": self.reference, "synthetic": self.synthetic}
        if self.population is not None:
            out["population"] = self.population
        if self.training is not None:
            out["training"] = self.training
        return out


def _columns(df: DataFrame) -> DataFrame:
    """Per-column scores plus their mean as a row without a column."""
    detail = F.create_map().cast("map<string,double>")
    each = df.select(F.col("column_name").alias("column_1"), F.lit(None).cast("string").alias("column_2"), "score", detail.alias("detail"))
    total = each.agg(
        F.lit(None).cast("string").alias("column_1"), F.lit(None).cast("string").alias("column_2"), F.avg("score").alias("score"),
        F.map_from_arrays(F.array(F.lit("columns")), F.array(F.count("score").cast("double"))).alias("detail"),
    )
    return each.unionByName(total)


def _single(df: DataFrame, score: str) -> DataFrame:
    """A one-row result: its headline number, the other numbers as detail."""
    nums = [c for c, d in df.dtypes if d in ("double", "bigint", "int") and c != score]
    detail = F.map_from_arrays(F.array(*[F.lit(c) for c in nums]), F.array(*[F.col(c).cast("double") for c in nums])) if nums else F.create_map().cast("map<string,double>")
    none = F.lit(None).cast("string")
    return df.select(none.alias("column_1"), none.alias("column_2"), F.col(score).cast("double").alias("score"), detail.alias("detail"))


def _named(df: DataFrame, name: str, score: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.col(name).alias("column_1"), none.alias("column_2"), F.col(score).cast("double").alias("score"), F.create_map().cast("map<string,double>").alias("detail"))


def _per_column(fn: Callable) -> Callable[[Inputs, dict], DataFrame]:
    def run(i: Inputs, p: dict) -> DataFrame:
        return _columns(fn(i.reference, i.synthetic, i.roles, p.get("target_columns")).select("column_name", "score"))

    return run


def _quality(i: Inputs, p: dict) -> DataFrame:
    q = pairs.quality(i.reference, i.synthetic, i.roles)
    return _named(q, "property", "score").withColumn("column_1", F.when(F.col("column_1") != "overall", F.col("column_1")))


def _alpha(i: Inputs) -> DataFrame:
    return i.once("alpha_precision", lambda: spatial.alpha_precision(*i.vectors()))


def _detection(i: Inputs, p: dict, method: str) -> DataFrame:
    p = dict(p)
    folds, seed = p.pop("folds", 5), p.pop("seed", detect.SEED)
    data = i.once(f"folds:{folds}:{seed}", lambda: detect.folded(i.reference, i.synthetic, i.roles, folds, seed))
    return detect.fold_scores(data, method, folds, **p).agg(F.avg("auroc").alias("mean_auroc"), F.max("auroc").alias("max_auroc"))


def _anonymity(i: Inputs, p: dict) -> DataFrame:
    qi = p.get("qi_columns") or i.roles.quasi_identifiers
    return i.once(f"k:{','.join(qi)}", lambda: privacy.k_anonymity(i.datasets(), qi))


# name -> (form it is computed on, builder)
METRICS: dict[str, tuple[str, Callable[[Inputs, dict], DataFrame]]] = {
    "table_structure": ("decoded", lambda i, p: _single(structure.structure_score(structure.table_structure(i.reference, i.synthetic), True), "score")),
    "semantic_structure": ("decoded", lambda i, p: _single(structure.structure_score(
        structure.semantic_structure(i.reference.sparkSession, i.roles, p.get("synthetic_roles", i.roles)), False), "score")),
    "boundary_adherence": ("decoded", _per_column(marginal.boundary_adherence)),
    "category_adherence": ("decoded", _per_column(marginal.category_adherence)),
    "ks_complement": ("decoded", _per_column(marginal.ks_complement)),
    "tv_complement": ("decoded", _per_column(marginal.tv_complement)),
    "wasserstein_1d": ("decoded", lambda i, p: _columns(marginal.wasserstein_1d(i.reference, i.synthetic, i.roles, p.get("target_columns")).select(
        "column_name", F.col("scaled").alias("score")))),
    "jensenshannon_synthcity": ("decoded", lambda i, p: _columns(marginal.jsd_equal_width(i.reference, i.synthetic, i.roles, bins=p.get("n_histogram_bins", 10)))),
    "jensenshannon_syndat": ("decoded", lambda i, p: _columns(marginal.jsd_discrete_aware(i.reference, i.synthetic, i.roles, max_discrete=p.get("n_unique_threshold", 10)))),
    "jensenshannon_nannyml": ("decoded", lambda i, p: _columns(marginal.jsd_adaptive(i.reference, i.synthetic, i.roles).select("column_name", "score"))),
    "sdmetrics_quality": ("decoded", _quality),
    "new_row_synthesis": ("decoded", lambda i, p: _single(rows.new_row_score(
        i.reference, i.synthetic, i.roles, p.get("numerical_match_tolerance", 0.01), p.get("synthetic_sample_size")), "score")),
    "alpha_precision": ("encoded", lambda i, p: _single(_alpha(i), "delta_precision_alpha")),
    "authenticity": ("encoded", lambda i, p: _single(_alpha(i), "authenticity")),
    "prdc_score": ("encoded", lambda i, p: _single(spatial.prdc(*i.vectors(), k=p.get("nearest_k", 5)).withColumn(
        "mean", (F.col("precision") + F.col("recall") + F.col("coverage")) / 3), "mean")),
    "wasserstein_distance": ("encoded", lambda i, p: _single(
        spatial.sinkhorn(*i.vectors()) if p.get("exact") else spatial.sliced_wasserstein(*i.vectors()), "sinkhorn" if p.get("exact") else "sliced_wasserstein")),
    "maximum_mean_discrepancy": ("encoded", lambda i, p: _single(
        (spatial.mmd if p.get("exact", False) else spatial.mmd_rff)(*i.vectors(), gamma=p.get("gamma")), "mmd2")),
    "k_anonymization": ("decoded", lambda i, p: _named(_anonymity(i, p), "dataset", "k")),
    "k_ratios": ("decoded", lambda i, p: _named(privacy.k_ratios(_anonymity(i, p)).withColumn(
        "pair", F.concat_ws("/", "numerator", "denominator")), "pair", "ratio")),
    "k_cluster": ("decoded", lambda i, p: _named(privacy.k_cluster(i.datasets(), p.get("qi_columns") or i.roles.quasi_identifiers, i.roles), "dataset", "k")),
    **{m: ("decoded", lambda i, p, m=m: _single(_detection(i, p, m), "mean_auroc")) for m in detect.DETECTORS},
    "fact_rates": ("decoded", lambda i, p: _named(rows.fact_rates(i.population, i.training, i.synthetic, i.roles, p.get("num_bins", 20)), "rate_name", "rate")),
}


def score_metric(inputs: Inputs, name: str) -> tuple[DataFrame, bool]:
    """Scores of one metric and whether it succeeded; a failing one is one row with its error, an unknown name too."""
    try:
        if name not in METRICS:
            raise ValueError(f"unknown metric: {name}")
        got = checkpointed(METRICS[name][1](inputs, inputs.params.get(name, {})))
        return got.select(F.lit(name).alias("metric"), "column_1", "column_2", "score", F.lit("success").alias("status"), "detail"), True
    except Exception as e:  # isolation per metric is the contract
        return inputs.reference.sparkSession.createDataFrame([(name, None, None, None, f"error: {str(e)[:300]}", None)], SCHEMA), False


def score_card(inputs: Inputs, metrics: Sequence[str], side_by_side: int = SIDE_BY_SIDE) -> DataFrame:
    """Scores of all named metrics, several of them in work at a time."""
    with ThreadPoolExecutor(side_by_side) as pool:
        parts = list(pool.map(lambda name: score_metric(inputs, name)[0], metrics))
    return reduce(DataFrame.unionByName, parts)
