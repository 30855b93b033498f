"""Nearest neighbours where one cell holds most points, against all pairs."""

from __future__ import annotations

import numpy as np

from scanfuse.operators import neighbors


def test_crowded_cell(spark):
    rng = np.random.default_rng(7)
    crowd = 3.3 + rng.normal(0, 0.02, (6000, 3))
    copies = np.tile([[3.31, 3.3, 3.3]], (300, 1))
    spread = rng.uniform(0, 8, (600, 3))
    t = np.r_[crowd, copies, spread].round(6)
    q = np.r_[crowd[:40] + rng.normal(0, 0.01, (40, 3)), spread[:100] + 0.05, [[3.31, 3.3, 3.3], [4.2, 3.3, 3.3], [30.0, 30, 30]]].round(6)
    shape = "pt_id long, x double, y double, z double"
    df = lambda v: spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(v)], shape)
    got = neighbors.nearest_uneven(df(q), df(t), 7, 1.0, None, crowd=32).collect()
    mine = {(r["q_id"], r["nr"]): (r["t_id"], r["d2"]) for r in got}
    n = 0
    for k, p in enumerate(q):
        d2 = ((t - p) ** 2).sum(axis=1)
        best = [j for j in np.lexsort((np.arange(len(t)), d2.round(12)))[:7] if d2[j] < 1]
        n += len(best)
        for nr, j in enumerate(best):
            assert abs(mine[k, nr + 1][1] - d2[j]) < 1e-9
    assert n == len(got) and len(mine) == n
    placed, known = neighbors._tree(df(t), 1.0, 32, 12, [])
    sizes = [r["n"] for r in known.where("NOT inner AND level < 12").collect()]
    assert max(sizes) <= 32 and placed.count() == len(t)


def test_nearest_sets_of_crowded_tiles_equal_brute_force(spark):
    """A heap of points with ties goes cell by cell, the rest as lists; both with the same ranks and sums."""
    rng = np.random.default_rng(4)
    t = np.vstack([rng.uniform(-3, 9, (300, 3)), np.round(rng.uniform(0, 1, (150, 3)), 1), np.full((9, 3), 0.5)])
    q = np.vstack([rng.uniform(-3, 9, (80, 3)), np.round(rng.uniform(-1, 2, (40, 3)), 1)])
    df = lambda p: spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "pt_id long, x double, y double, z double")
    want = {}
    for k, v in enumerate(q):
        d = (v[0] - t[:, 0]) ** 2 + (v[1] - t[:, 1]) ** 2 + (v[2] - t[:, 2]) ** 2
        if found := [j for j in np.lexsort((np.arange(len(t)), d)) if d[j] < 1.0][:4]:
            want[k] = found
    for crowd in (4096, 50):
        rows = neighbors.nearest_sets(df(q), df(t), 4, 1.0, None, sums=True, crowd=crowd).collect()
        assert {r["q_id"]: [x["t_id"] for x in r["near"]] for r in rows} == want
        assert all(r["n"] == len(r["near"]) and np.isclose(r["sxy"], sum(x["tx"] * x["ty"] for x in r["near"])) for r in rows)


def test_neighbour_joins_deal_out_no_cells(spark):
    """A query is shuffled once, not once for each of 27 cells, and no pair is."""
    p = spark.range(1000).selectExpr("id AS pt_id", "rand(1) * 9 AS x", "rand(2) * 9 AS y", "rand(3) * 9 AS z")
    for out in (neighbors.within(p, p, 1.0, None), neighbors.nearest(p, p, 1, 1.0, None), neighbors.new_points(p, p, 0.2, None)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(transform" not in plan and "Window" not in plan
