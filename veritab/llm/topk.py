"""Exact top-k by inner product over a vector-approximation file (operator 3).

Components become integers, floor(256 * x). Vectors are dealt into blocks; a block keeps its vectors as cells of at most
sixteen per dimension (a corner and a width) beside the exact integers. Queries are dealt into chunks, and each pair of a
chunk and a block is one row of a Cartesian product: the cells give bounds on every score, exact vectors are then read in the order of their
bounds until none that is left can reach the kth score. The best k of each block meet in one ranking per query.

Rows whose id is null, and vectors that are null or hold null or non-finite components, take no part. Vectors are compared
with those of their own length. A query's own row is any row of its id. Repeated query rows are one query. Scores are exact
while they fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.workspace import stored

BLOCK = 2048  # vectors of a block, on average
CHUNK = 512  # queries of a chunk, on average
CELLS = 16
FIRST = 64  # exact vectors that are read at once

PACKED = "part int, dim int, n int, ids binary, corner bigint, shift int, cells binary, exact binary"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of bigint), dim of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * 256).cast("bigint"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    v = np.array(rows["v"].tolist(), np.int64).reshape(len(rows), -1)
    low, high = (int(v.min()), int(v.max())) if v.size else (0, 0)
    shift = max(0, ((high - low) // CELLS).bit_length())
    cells = ((v - low) >> shift).astype(np.uint8)
    ids = rows["vec_id"].to_numpy(np.int64)
    out = (int(rows["part"].iloc[0]), int(rows["dim"].iloc[0]), len(rows), ids.tobytes(), low, shift, cells.tobytes(), v.tobytes())
    return pd.DataFrame([out], columns=[c.split()[0] for c in PACKED.split(", ")])


def packed(rows: DataFrame, size: int, count: int) -> DataFrame:
    """Rows dealt by id and vector into parts of about `size`, one packed row per part and dimension."""
    parts = max(1, -(-count // size))
    return rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int")).groupBy("part", "dim").applyInPandas(_pack, PACKED)


def best(query: np.ndarray, own: int, ids: np.ndarray, base: np.ndarray, slack: tuple[float, float], exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of a block. `base` + slack: bounds on each score from below and above."""
    others = np.nonzero(ids != own)[0]
    if len(others) > max(k, FIRST):
        order = others[np.argpartition(-base[others], FIRST - 1)[:FIRST]]
        least = np.partition(exact[order] @ query, -k)[-k]
        others = others[base[others] + slack[1] >= least]  # what may still reach the kth score, ties included
    score = exact[others] @ query
    first = np.lexsort((ids[others], -score))[:k]
    return ids[others][first], score[first]


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                queries = np.frombuffer(r.q_exact, np.int64).reshape(r.q_n, r.dim)
                own = np.frombuffer(r.q_ids, np.int64)
                ids, exact = np.frombuffer(r.ids, np.int64), np.frombuffer(r.exact, np.int64).reshape(r.n, r.dim)
                cells = np.frombuffer(r.cells, np.uint8).reshape(r.n, r.dim)
                big = float(np.abs(queries).max(initial=0)) * float(np.abs(exact).max(initial=0)) * max(1, r.dim) >= 2.0**52
                out: list[tuple[np.ndarray, np.ndarray]] = []
                wide = float((1 << r.shift) - 1)
                if not big:
                    corner = (cells.astype(np.float64) * float(1 << r.shift) + float(r.corner)).T
                    base = queries.astype(np.float64) @ corner
                    under, over = wide * np.minimum(queries, 0).sum(1), wide * np.maximum(queries, 0).sum(1)
                for i in range(r.q_n):
                    if big:  # bounds would be rounded: read all
                        out.append(best(queries[i], own[i], ids, np.zeros(r.n), (-np.inf, np.inf), exact, k))
                    else:
                        out.append(best(queries[i], own[i], ids, base[i], (under[i], over[i]), exact, k))
                yield pd.DataFrame({
                    "query_id": np.repeat(own, [len(a) for a, _ in out]), "vec_id": np.concatenate([a for a, _ in out]), "score": np.concatenate([s for _, s in out]),
                })

    return run


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query, queries being the rows whose id is divisible by `every`."""
    rows = integers(vectors)
    asked = F.col("vec_id") % every == 0
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("q")).first()
    file = stored(packed(rows, BLOCK, n.n), "cells")
    chunks = stored(packed(rows.where(asked).distinct(), CHUNK, n.q), "chunks")
    each = chunks.select(F.col("dim").alias("q_dim"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("exact").alias("q_exact"))
    # a Cartesian product: its tasks read both sides where they are stored, so no chunk is copied to a row per block, shuffled or broadcast
    pairs = each.hint("shuffle_replicate_nl").join(file, F.col("q_dim") == F.col("dim")).select("dim", "q_n", "q_ids", "q_exact", "n", "ids", "corner", "shift", "cells", "exact")
    found = pairs.mapInPandas(_search(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
