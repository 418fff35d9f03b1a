"""Pairs of query chunks and blocks are made where they are stored."""

from __future__ import annotations

import numpy as np

from veritab.llm import topk


def test_chunks_are_not_copied_or_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "CHUNK", 4)
    v = np.random.default_rng(3).normal(size=(1000, 6)).round(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    found = topk.nearest(df)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in found.collect()}
    whole = np.floor(v * 256).astype(np.int64)
    for q in range(0, 1000, 50):
        score = whole @ whole[q]
        best = [i for i in np.lexsort((np.arange(1000), -score)) if i != q][:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, score[i]) for i in best]
    assert len(got) == 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan
