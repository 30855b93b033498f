"""Exact rays, running values over long keys, tiles of the reference, lines and planes."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from scanfuse.operators import asof, change, grid, stats
from scanfuse.operators.components import shared_dir
from scanfuse.operators.trajectory import POSE


def walked(a, b, leaf):
    """Voxels between a and b, plane by plane."""
    a, b = np.array(a) / leaf, np.array(b) / leaf
    cell, last, d = np.floor(a).astype(int), np.floor(b).astype(int), b - a
    out = [tuple(cell)]
    while tuple(cell) != tuple(last) and len(out) < 1000:
        at = [((cell[k] + (d[k] > 0)) - a[k]) / d[k] if d[k] else math.inf for k in range(3)]
        k = int(np.argmin(at))
        if at[k] >= 1:
            break
        cell[k] += 1 if d[k] > 0 else -1
        out.append(tuple(cell))
    return out


def test_no_voxel_of_a_ray_is_missed(spark):
    rng = random.Random(5)
    rays = [(k, *(rng.uniform(-9, 9) for _ in range(6))) for k in range(60)] + [(100, 0.5, 0.5, 0.5, 6.5, 0.5, 0.5), (101, 2.3, 2.3, 2.3, 2.4, 2.3, 2.3), (102, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    got = grid.crossed(spark.createDataFrame(rays, "id long, tx double, ty double, tz double, x double, y double, z double"), 0.7, ("id",)).collect()
    for r in rays:
        mine = [(x["vx"], x["vy"], x["vz"]) for x in sorted((x for x in got if x["id"] == r[0]), key=lambda x: x["u"])]
        assert mine == walked(r[1:4], r[4:], 0.7)


def test_running_values_over_a_long_key(spark):
    rng = random.Random(6)
    rows = [(None if k % 10 == 3 else 1 if k % 10 < 8 else 2, k, rng.choice([None, 1, 2, 5]), rng.choice([None, None, k]), "x") for k in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "s int, k int, n int, v int, part string").repartition(5)
    got = asof.scanned(df, "s", "k", total=(F.col("n"), "sum"), top=(F.col("n"), "max"), carried=(F.col("v"), "last"))
    assert got.columns[:5] == ["s", "k", "n", "v", "part"]
    state, want = {}, []
    for s, k, n, v, _ in sorted(rows, key=lambda r: r[1]):
        total, top, carried = state.get(s, (None, None, None))
        total = total if n is None else (total or 0) + n
        top = top if n is None else max(top or 0, n)
        state[s] = total, top, carried if v is None else v
        want.append((k, *state[s]))
    assert sorted((r["k"], r["total"], r["top"], r["carried"]) for r in got.collect()) == want
    assert asof.scanned(df.limit(0), "s", "k", total=(F.col("n"), "sum")).collect() == []


def scans(plan):
    """The file scans of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return scans(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return scans(plan.plan())
    found = [plan] if kind == "FileSourceScanExec" else []
    kids = plan.children()
    return found + [x for k in range(kids.size()) for x in scans(kids.apply(k))]


def test_keyframes_read_the_tiles_that_they_see(spark):
    path = f"{shared_dir(spark)}/tiles-{random.randrange(1 << 40)}"
    ref = spark.range(4000).select(F.col("id").alias("pt_id"), (F.col("id") * 0.5).alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z"))
    change.write_reference(ref, path)
    frames = spark.createDataFrame([(k, 100.0 * k, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for k in range(20)], "frame_id int, " + ", ".join(f"{n} double" for n in POSE))
    one = change.covisible_tiles(spark, path, frames.where("frame_id = 7"), 10.0, 5)
    got, want = one.collect(), change.covisible(ref, frames.where("frame_id = 7"), 10.0, 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 41
    read = [s.metrics().apply("numFiles").value() for s in scans(one._jdf.queryExecution().executedPlan()) if "tile_x" in s.toString()]
    every = len(spark.read.parquet(path).inputFiles())
    assert read and all(n <= every // 20 for n in read)
    assert change.covisible_tiles(spark, path, frames, 10.0, 100).collect() == []  # none sees as many


def test_lines_and_planes_share_a_descent(spark):
    rng = np.random.default_rng(2)
    line = np.c_[np.linspace(0.1, 1.9, 60), np.full(60, 0.55), np.full(60, 0.4)] + rng.normal(0, 0.005, (60, 3))
    plane = np.c_[rng.uniform(0.1, 1.9, (80, 2)), np.full(80, 0.3)] + rng.normal(0, 0.005, (80, 3))
    step = np.r_[np.c_[rng.uniform(4.1, 4.9, (60, 2)), np.full(60, 0.2)], np.c_[rng.uniform(5.1, 5.9, (60, 2)), np.full(60, 1.6)]] + rng.normal(0, 0.003, (120, 3))
    rows = [(k, *map(float, p), kind) for k, (p, kind) in enumerate([(p, "line") for p in line] + [(p, "plane") for p in plane] + [(p, "plane") for p in step])]
    got = stats.feature_axes(stats.adaptive_features(spark.createDataFrame(rows, "pt_id long, x double, y double, z double, kind string"), 2.0, layers=3)).collect()
    found = {(r["kind"], r["layer"], r["vx"]): r for r in got}
    assert abs(found["line", 0, 0]["nx"]) > 0.99 and found["line", 0, 0]["n"] == 60
    assert abs(found["plane", 0, 0]["nz"]) > 0.99 and found["plane", 0, 0]["n"] == 80
    assert {(k, l) for k, l, v in found if v >= 2} == {("plane", 1)} and sum(r["n"] for r in got) == 260


def test_reference_views_broadcast_one_image(spark):
    """However many frames there are, only the view is broadcast, not their pixels."""
    from scanfuse.functions.profile import PROFILES
    from scanfuse.operators import change

    seen = spark.range(40).selectExpr("CAST(id % 16 AS INT) AS row_id", "CAST(id AS INT) AS col_id", "1.0D AS rng", "id AS pt_id")
    out = change.reference_views(spark.range(3).selectExpr("CAST(id AS INT) AS frame_id"), seen, PROFILES["room"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    assert out.count() == 120


def test_moved_points_are_worked_out_once(spark):
    """A filter on moved points does not carry their formula with it."""
    from scanfuse.operators.trajectory import POSE, transform_points

    p = spark.range(4).selectExpr("0 AS frame_id", "id AS pt_id", "id * 1.0D AS x", "0.0D AS y", "0.0D AS z")
    pose = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.6, 0.8)], "frame_id int, " + ", ".join(f"{n} double" for n in POSE))
    out = transform_points(p, pose).where("abs(x) + x * x + x * x * x > -1e9")
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in lines if "SQRT" in line and ("Filter" in line or "Join" in line)]
    assert out.count() == 4
