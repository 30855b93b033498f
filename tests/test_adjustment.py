"""Adjustment of long sessions against the dense solution and the true poses."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanfuse.operators import posegraph, sparse
from scanfuse.operators.trajectory import POSE

SHAPE = "session_id int, frame_id int, " + ", ".join(f"{n} double" for n in POSE)


def track(session, n, wide=False):
    """A spiral of poses."""
    return [(session, k, 3 * math.cos(0.05 * k) + 0.02 * k, 3 * math.sin(0.05 * k), 0.01 * k, 0.0, 0.0, math.sin(0.025 * k), math.cos(0.025 * k)) for k in range(n)]


def graph(spark, rows, loops, drift=0.003, prior=True):
    """Drifted poses, true edges with noise, loops."""
    true = spark.createDataFrame(rows, SHAPE)
    e = posegraph.odometry_edges(true).unionByName(posegraph.window_edges(true))
    a, b = (true.select("session_id", F.col("frame_id").alias(i), *(F.col(n).alias(s + n) for n in POSE)) for s, i in (("a_", "id1"), ("b_", "id2")))
    pairs = spark.createDataFrame(loops, "session_id int, id1 int, id2 int").join(a, ["session_id", "id1"]).join(b, ["session_id", "id2"])
    e = e.unionByName(posegraph._edges(pairs, "loop", F.lit(0.02)))
    noise = lambda k: (F.pmod(F.hash("session_id", "id1", "id2", F.lit(k)), F.lit(1000)) - 500) / 5e5
    e = e.withColumns({n: F.col(n) + noise(k) for k, n in enumerate(POSE[:3])})
    if prior:
        e = e.unionByName(posegraph.unary_edges(true.where("frame_id = 0"), "prior", 1e-4))
    return true.withColumns({"tx": F.col("tx") + drift * F.col("frame_id"), "ty": F.col("ty") - drift * F.col("frame_id")}), e


def table(df):
    return df.orderBy("session_id", "frame_id").toPandas().to_numpy(float)


@pytest.mark.parametrize("how", [{"size": 8, "grow": 8}])
def test_equals_the_dense_solution(spark, how):
    """By elimination over several levels."""
    poses, edges = graph(spark, track(1, 40) + track(2, 25), [(1, 2, 30), (1, 5, 38), (2, 0, 24)], prior=False)
    got = table(sparse.adjust_long(poses, edges, 2, **how))
    want = table(posegraph.adjust(poses, edges, 2))
    assert got.shape == (65, 9) and np.abs(got - want).max() < 1e-6


def test_conjugate_gradients_agree(spark):
    """Conjugate gradients, which take what loops leave crowded, and elimination over two levels find the same."""
    poses, edges = graph(spark, track(1, 4), [(1, 0, 3)])
    blocks = sparse.staged(sparse.equations(poses, edges), "blocks")
    step = lambda df: {r["i"]: np.array(r["step"]) for r in df.collect()}
    got, want = step(sparse.solve(blocks, crowd=0)), step(sparse.solve(blocks, size=2))
    assert sorted(got) == sorted(want) == list(range(4))
    assert max(np.abs(got[k] - want[k]).max() for k in got) < 1e-6


def test_long_session_in_several_tasks(spark):
    n = 2000
    poses, edges = graph(spark, track(3, n), [(3, k, k + 700) for k in range(0, n - 700, 300)], drift=1e-4)
    blocks = sparse.staged(sparse.equations(poses, edges), "blocks")
    res = sparse.solve(blocks)
    step = {r["i"]: np.array(r["step"]) for r in res.collect()}
    left = np.zeros((n, 6))
    for r in blocks.collect():
        h = np.array(r["h"]).reshape(6, 6)
        left[r["i"]] += h @ step[r["j"]]
        if r["i"] != r["j"]:
            left[r["j"]] += h.T @ step[r["i"]]
        else:
            left[r["i"]] += r["g"]
    assert len(step) == n and np.abs(left).max() < 1e-4


def test_empty(spark):
    poses, edges = graph(spark, track(1, 3), [(1, 0, 2)])
    assert sparse.adjust_long(poses.limit(0), edges.limit(0)).collect() == []
