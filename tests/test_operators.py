from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanfuse.functions import geom as G
from scanfuse.operators import change, neighbors, stats, trajectory
from scanfuse.operators.components import components
from scanfuse.sources import pointcloud
from scanfuse.streaming import jobs


def test_spline_weights_follow_the_recursion(spark):
    u = [k / 20 for k in range(21)]
    got = spark.createDataFrame([(x,) for x in u], "u double").select("u", F.array(*G.clamped_cubic(F.col("u"))).alias("w")).collect()
    for r in got:
        assert np.allclose(r["w"], trajectory._clamped(r["u"]), atol=1e-12)


def test_transform_and_inverse(spark):
    rng = np.random.default_rng(0)
    pts = pd.DataFrame({"frame_id": 0, "pt_id": range(50), **{a: rng.normal(size=50) for a in "xyz"}})
    q = rng.normal(size=4)
    q /= np.linalg.norm(q)
    pose = spark.createDataFrame([(0, 1.0, 2.0, 3.0, *map(float, q))], "frame_id int, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    p = spark.createDataFrame(pts)
    back = trajectory.transform_points(trajectory.transform_points(p, pose), pose, inverse=True).toPandas().sort_values("pt_id")
    assert np.allclose(back[list("xyz")], pts[list("xyz")], atol=1e-9)
    again = trajectory.matrix_pose(trajectory.pose_matrix(pose)).first()
    same = np.array([again[n] for n in ("qx", "qy", "qz", "qw")])
    assert np.allclose(abs(same @ q), 1)


def test_eigenvalues(spark):
    rng = np.random.default_rng(1)
    mats = [(lambda a: a @ a.T)(rng.normal(size=(3, 3))) for _ in range(20)] + [np.eye(3), np.zeros((3, 3))]
    rows = [tuple(float(m[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))) for m in mats]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").select(*(v.alias(f"l{k}") for k, v in enumerate(G.eigenvalues(*map(F.col, "abcdef"))))).toPandas().to_numpy()
    assert np.allclose(got, [np.linalg.eigvalsh(m) for m in mats], atol=1e-9)


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    q, t = (pd.DataFrame({"pt_id": range(n), **{a: rng.uniform(0, 3, n) for a in "xyz"}}) for n in (60, 200))
    got = neighbors.nearest(spark.createDataFrame(q), spark.createDataFrame(t), 3, 0.7, None).toPandas()
    d = ((q[list("xyz")].to_numpy()[:, None] - t[list("xyz")].to_numpy()[None]) ** 2).sum(2)
    want = {(i, j) for i in range(60) for j in np.argsort(d[i])[:3] if d[i, j] < 0.49}
    assert set(zip(got["q_id"], got["t_id"])) == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 50), (100, 70), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {50: 50, 70: 50, 100: 50}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("binary", [True, False])
def test_pcd_round_trip(spark, tmp_path, binary):
    pts = pd.DataFrame({"x": [1.5, -2.0], "y": [0.0, 3.25], "z": [4.0, 5.0], "intensity": [7.0, 8.0]})
    (tmp_path / "12.5.pcd").write_bytes(pointcloud.pcd_bytes(pts, binary))
    got = pointcloud.read_pcd(spark, str(tmp_path)).orderBy("pt_id").toPandas()
    assert got["ts"].tolist() == [12.5, 12.5] and np.allclose(got[["x", "y", "z", "intensity"]], pts)


def test_map_sink(spark, tmp_path):
    pts = spark.createDataFrame([(1, 5.0, 250.0, 0.0), (2, -5.0, 1.0, 0.0)], "pt_id long, x double, y double, z double")
    pointcloud.write_map(pts, str(tmp_path / "map"))
    assert spark.read.parquet(str(tmp_path / "map")).where("tile_x = 0 AND tile_y = 2").count() == 1


def test_trajectory_switch(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1.0 1 2 3 0.1 0.2 0.3 0.9\nbroken\n")
    r = pointcloud.read_trajectory(spark, str(tmp_path / "t.txt"), True).collect()
    assert len(r) == 1 and (r[0]["tx"], r[0]["ty"], r[0]["tz"]) == (2.0, 3.0, 1.0)


def test_status_is_order_free_and_mergeable(spark):
    obs = [(1, f, 0.6 if f % 3 else 0.4) for f in range(9)]
    one = change.fuse_status(spark.createDataFrame(obs, "pt_id long, frame_id int, prob double")).first()["change_prob"]
    two = change.fuse_status(spark.createDataFrame(obs[::-1], "pt_id long, frame_id int, prob double")).first()["change_prob"]
    assert math.isclose(one, two) and math.isclose(one, 1 / (1 + (0.4 / 0.6) ** 3), rel_tol=1e-9)


def test_plane_fit(spark):
    near = spark.createDataFrame([(1, x * 1.0, y * 1.0, 2.0) for x in range(3) for y in range(3)], "q_id long, tx double, ty double, tz double")
    r = stats.neighbour_planes(near).first()
    assert r["valid"] and math.isclose(abs(r["nz"]), 1, abs_tol=1e-9) and math.isclose(abs(r["d"]), 2, abs_tol=1e-9)


def test_count_windows_stream_equals_batch(spark, tmp_path):
    frames = spark.createDataFrame([(s, f) for s in range(2) for f in range(9)], "session_id int, frame_id long")
    for k, cut in enumerate(("frame_id < 4", "frame_id >= 4")):
        frames.where(cut).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got: list = []
    stream = jobs.count_windows(jobs.source(spark, str(tmp_path / "in"), "session_id int, frame_id long", 10))
    jobs.run(stream, lambda b, n: got.extend(map(tuple, b.collect())), str(tmp_path / "check")).awaitTermination()
    want = trajectory.windows_of(frames).collect()
    assert sorted(got) == sorted((r["session_id"], r["window_id"], r["frame_id"], r["no"]) for r in want)
