"""Keys that are worked on whole: the same results as by tiles and round by round, in fewer jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanfuse.operators import register
from scanfuse.operators.trajectory import POSE


@pytest.fixture(scope="module")
def room(spark):
    """Two frames of points on three walls seen from a little off, the first one's map, and poses of three frames."""
    rng = np.random.default_rng(8)
    on = [np.insert(rng.uniform(0, 4, (250, 2)), a, 0.0, axis=1) for a in range(3)]
    known = pd.DataFrame(np.concatenate(on) + [2.0, 1.0, 3.0], columns=list("xyz")).assign(map_key=0, pt_id=range(750))
    rod = np.c_[rng.uniform(0, 4, (60, 1)), rng.normal(0, 0.01, (60, 2))] + [2.0, 1.0, 3.0]
    edge_map = pd.DataFrame(rod, columns=list("xyz")).assign(map_key=0, pt_id=range(1000, 1060))
    off = lambda df, f: df.assign(frame_id=f, pt_id=df["pt_id"] + 10_000 * (f + 1), x=df["x"] + 0.03 * f, y=df["y"] - 0.05, z=df["z"] + 0.02)
    df = spark.createDataFrame
    frames = {name: df(pd.concat([off(of.sample(frac=0.4, random_state=f), f) for f in (0, 1)])) for name, of in (("points", known), ("edges", edge_map))}
    poses = df([(f, *(1.0 if n == "qw" else 0.0 for n in POSE)) for f in (0, 1, 2)], "frame_id long, " + ", ".join(f"{n} double" for n in POSE))
    return {**frames, "map": df(known), "edge_map": df(edge_map), "poses": poses}


def _same(got, want, places: int = 7) -> None:
    got, want = (x.toPandas().sort_values("frame_id").reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False, atol=10.0**-places, rtol=1e-6)


def test_frames_registered_in_a_group_end_as_round_by_round(spark, room):
    how = dict(rounds=2, edges=room["edges"], edge_map=room["edge_map"], edge_rounds=1)
    got = register.register(room["points"], room["map"], room["poses"], **how)
    _same(got, register.register(room["points"], room["map"], room["poses"], whole=10, **how))
    rows = {r["frame_id"]: r for r in got.collect()}
    assert rows[1]["n"] > 200 and abs(rows[1]["tx"] + 0.03) < 0.01 and rows[2]["n"] is None and rows[2]["tx"] == 0


def test_trimmed_and_cloud_registration_in_a_group_end_as_round_by_round(spark, room):
    frames = room["poses"].select("frame_id")
    _same(*(register.align_trimmed(room["points"], room["map"], frames, rounds=3, whole=w) for w in (65_536, 10)))
    _same(*(register.register_clouds(room["points"], room["map"], room["poses"], (1.0,), whole=w) for w in (65_536, 10)), places=5)


def test_more_rounds_are_no_more_jobs(spark, room):
    def jobs(rounds: int) -> int:
        spark.sparkContext.setJobGroup(f"rounds-{rounds}", "")
        register.register(room["points"], room["map"], room["poses"], rounds=rounds).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{rounds}"))

    try:
        assert jobs(1) == jobs(4)
    finally:
        spark.sparkContext.setJobGroup("rest", "")


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(9)
    p = pd.DataFrame({"map_key": np.repeat([0, 1, 2], 400), "pt_id": rng.permutation(1200), **{a: np.round(rng.uniform(0, 3, 1200), 1) for a in "xyz"}})
    return spark.createDataFrame(p)


def test_samples_searched_in_a_group_equal_those_by_tiles(spark, clouds):
    from scanfuse.operators import grid, neighbors

    rows = lambda df: sorted((r["map_key"], r["q_id"], tuple(t["t_id"] for t in r["near"]), r["n"], round(r["sxy"], 9)) for r in df.collect())
    want = rows(neighbors.nearest_sets(grid.voxel_samples(clouds, 0.5, ("map_key",)), clouds, 6, 0.8, complete=True, sums=True, by="map_key", whole=0))
    got = neighbors.sample_sets(clouds, 0.5, 6, 0.8, "map_key")
    assert got.columns[-1] == "map_key" and rows(got) == want and want
    assert rows(neighbors.sample_sets(clouds, 0.5, 6, 0.8, "map_key", whole=100)) == want


def test_sets_in_order_follow_their_keys(spark, clouds):
    from scanfuse.operators import neighbors

    keys = [r["map_key"] for r in neighbors.nearest_sets(clouds, clouds, 3, 1.0, by="map_key", in_order=True).collect()]
    assert keys == sorted(keys) and len(set(keys)) == 3


def test_quality_by_one_search_equals_its_parts(spark, room):
    from scanfuse.operators import neighbors, stats
    from scanfuse.operators.project import cauchy_weight
    from scanfuse.plans.maps import solid

    q, t = room["points"], room["map"]
    sets = neighbors.nearest_sets(q, t, 5, 1.0, complete=True, sums=True)
    eq = stats.normal_equations(register.plane_residuals(q, stats.neighbour_planes(solid(sets), 0.02), cauchy_weight(F.col("r"))), ["frame_id"])
    want = register.quality(neighbors.overlap(q, t, 0.2), neighbors.fitness(q, t, 1.0), eq)
    _same(register.quality_of(q, t), want)
