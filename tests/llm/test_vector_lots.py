"""Queries meet shards without being gathered on the driver."""

import math
import random

import pytest


@pytest.mark.parametrize("lots", [1, 2, 64])
def test_no_copies_are_broadcast(spark, monkeypatch, lots):
    from hydrolens.llm import vectors

    monkeypatch.setattr(vectors, "SHARD", 32)
    monkeypatch.setattr(vectors, "BLOCK", 4)
    monkeypatch.setattr(vectors, "LOT", 3, raising=False)
    monkeypatch.setattr(vectors, "LOTS", lots, raising=False)
    random.seed(5)
    rows = [(i, [random.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    found = vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, top=3)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    for q in range(0, 300, 20):
        nearest = sorted((math.dist(rows[q][1], v), i) for i, v in rows if i != q)[:3]
        assert sorted(got[q]) == [(k + 1, i) for k, (_, i) in enumerate(nearest)]
