"""Line residuals, trimmed alignment and tiled maps on small fixtures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scanfuse.operators import register, stats
from scanfuse.streaming import jobs


def test_line_residuals_are_the_distance(spark):
    rng = np.random.default_rng(3)
    d = np.array([1.0, 2.0, -1.0]) / np.sqrt(6)
    on_line = np.array([0.5, 1.0, 2.0]) + np.linspace(-1, 1, 5)[:, None] * d
    near = spark.createDataFrame(pd.DataFrame([(q, *p) for q in range(4) for p in on_line], columns=["q_id", "tx", "ty", "tz"]))
    at = on_line.mean(0) + rng.normal(size=(4, 3)) / 4
    moved = spark.createDataFrame(pd.DataFrame({"frame_id": 0, "pt_id": range(4), **dict(zip("xyz", at.T))}))
    got = register.line_residuals(moved, stats.neighbour_lines(near), F.lit(1.0)).toPandas()
    assert len(got) == 8
    sides = got.groupby(["x", "y", "z"])["r"].apply(lambda r: float(np.sqrt((r**2).sum())))
    for place, r in sides.items():
        assert np.isclose(r, np.linalg.norm(np.cross(np.array(place) - on_line.mean(0), d)), atol=1e-6)


def test_trimmed_alignment_finds_the_motion(spark):
    rng = np.random.default_rng(4)
    t = pd.DataFrame({"map_key": 0, "pt_id": range(300), **{a: rng.uniform(0, 8, 300) for a in "xyz"}})
    q = t.iloc[:200].assign(frame_id=1, x=lambda d: d["x"] + 0.1, y=lambda d: d["y"] - 0.05)
    frames = spark.createDataFrame([(1,), (2,)], "frame_id long")  # frame 2 has no points
    got = {r["frame_id"]: r for r in register.align_trimmed(spark.createDataFrame(q), spark.createDataFrame(t), frames).collect()}
    assert np.allclose([got[1][n] for n in ("tx", "ty", "tz", "qz")], [-0.1, 0.05, 0, 0], atol=1e-6) and got[1]["mean_d2"] < 1e-9
    assert got[2]["mean_d2"] is None and got[2]["rounds"] == 0 and got[2]["tx"] == 0


def test_tile_map_restarts_voxels_and_maps(spark, tmp_path):
    kinds = "session_id int, ts double, x double, y double, z double, epoch long"
    batches = [[(1, 0.0, 0.5, 0.5, 0.5, 0), (1, 1.0, 0.7, 0.5, 0.5, 0), (1, 1.0, 9.5, 0.5, 0.5, 0)], [(1, 9.0, 0.6, 0.5, 0.5, 0), (1, 9.0, 20.5, 0.5, 0.5, 0)], [(2, 0.0, 0.5, 0.5, 0.5, 0), (2, 1.0, 3.5, 0.5, 0.5, 1)]]
    for b in batches:
        spark.createDataFrame(b, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got: list = []
    jobs.run(jobs.tile_map(jobs.source(spark, str(tmp_path / "in"), kinds), keep=5.0), lambda b, n: got.extend(map(tuple, b.collect())), str(tmp_path / "check"), "update").awaitTermination()
    changes = spark.createDataFrame(got, "session_id int, vx long, vy long, vz long, epoch long, n long, x double, y double, z double, ts double")
    assert sorted((r["session_id"], r["vx"], r["n"]) for r in jobs.current_map(changes, 5.0).collect()) == [(1, 0, 1), (1, 20, 1), (2, 3, 1)]
