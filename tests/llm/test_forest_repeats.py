"""Rows repeated many times leave room for other ids with an equal vector."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mudline.llm import ann_forest


def test_an_id_repeated_ten_times(spark):
    rows = [(1, [1.0, 2.0, 3.0])] * 10 + [(i, [1.0, 2.0, 3.0]) for i in range(2, 9)] + [(0, [1.0, 2.0, 2.5])]
    got = ann_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]


def cosines(query, rows, k=5):
    best = {}
    for i, v in rows:
        if i != query[0]:
            c = float(np.dot(query[1], v) / np.linalg.norm(query[1]) / np.linalg.norm(v))
            best[i] = max(best.get(i, -2), c)
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_an_id_with_many_different_near_vectors(spark):
    r = np.random.default_rng(4)
    centre = r.standard_normal(8)
    rows = [(7, (centre + 0.001 * r.standard_normal(8)).tolist()) for _ in range(40)] + [(i, (centre + 0.5 * r.standard_normal(8)).tolist()) for i in range(100, 140)] + [(1, centre.tolist())]
    got = ann_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") == 1).orderBy("rank").collect()
    want = cosines((1, centre), rows)
    assert [g.vec_id for g in got] == [i for i, _ in want] and got[0].vec_id == 7
    assert np.allclose([g.score for g in got], [c for _, c in want])


@pytest.mark.parametrize("shard", [16, 64])
def test_shards_that_begin_alike(spark, shard):
    """Heads of eight equal rows, then rows far from the query in one shard and near to it in the other."""
    r = np.random.default_rng(5)
    head = [(i, r.standard_normal(64).tolist()) for i in range(8)]
    query = r.standard_normal(64)
    far = [(100 + i, r.standard_normal(64).tolist()) for i in range(8)]
    near = [(200 + i, (query + 0.01 * r.standard_normal(64)).tolist()) for i in range(7)]
    rows = [*head, *far, *head, *near, (50, query.tolist())]
    got = ann_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") == 50, shard=shard).orderBy("rank").collect()
    want = cosines((50, query), rows)
    assert [g.vec_id for g in got] == [i for i, _ in want] and min(g.score for g in got) > 0.9
