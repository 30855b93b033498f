"""Streams of several batches: tiles that fall silent, sums that are merged and survive a crash."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanfuse.streaming import jobs


def test_tile_map_keeps_recent_voxels_and_silent_tiles_end(spark, tmp_path):
    """Tile 0 hears nothing after 5 s; the watermark passes its 20 s and its voxel goes, in the state and in the map. A sweep of its own it never has."""
    shape = "session_id int, ts double, x double, y double, z double, epoch long"
    for batch in ([(1, 5.0, 0.5, 0.5, 0.5, 0), (1, 6.0, 20.5, 0.5, 0.5, 0)], [(1, 24.0, 20.5, 0.5, 0.5, 0), (1, 24.5, 40.5, 0.5, 0.5, 0)], [(1, 40.0, 20.5, 0.5, 0.5, 0)], [(1, 41.0, 20.5, 0.5, 0.5, 0)]):
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got: list = []
    stream = jobs.tile_map(jobs.source(spark, str(tmp_path / "in"), shape), 1.0, 20.0, late="1 second")
    jobs.run(stream, lambda b, n: got.extend((n, *r) for r in b.collect()), str(tmp_path / "check"), "update").awaitTermination()
    gone = [r for r in got if r[6] == 0]
    assert [r[2] for r in gone] == [0] and abs(gone[0][-1] - 25.0) < 0.01
    now = jobs.current_map(spark.createDataFrame([r[1:] for r in got], "session_id int, vx long, vy long, vz long, epoch long, n long, x double, y double, z double, ts double"), 20.0)
    assert sorted((r["vx"], r["n"]) for r in now.collect()) == [(20, 4), (40, 1)]


@pytest.mark.parametrize("cut", [7, 10])
def test_tile_map_begins_anew_with_all_points_of_the_frame_after_a_gap(spark, tmp_path, cut):
    """Frames 6 and 9 of one voxel, over `keep` apart, in two batches or in one: what begins at 9 holds all its points, in whatever order they come."""
    shape = "session_id int, ts double, x double, y double, z double, epoch long"
    rows = [(0, 9.0, 0.3, 0.5, 0.5, 1), (0, 6.0, 0.9, 0.5, 0.5, 1), (0, 9.0, 0.1, 0.5, 0.5, 1), (0, 9.0, 0.2, 0.5, 0.5, 1), (0, 8.0, 3.5, 0.5, 0.5, 1)]
    for part in ([r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut]):
        if part:
            spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got: list = []
    stream = jobs.tile_map(jobs.source(spark, str(tmp_path / "in"), shape), 1.0, 2.0)
    jobs.run(stream, lambda b, n: got.extend(b.collect()), str(tmp_path / "check"), "update").awaitTermination()
    now = jobs.current_map(spark.createDataFrame(got, "session_id int, vx long, vy long, vz long, epoch long, n long, x double, y double, z double, ts double"), 2.0)
    assert sorted((r["vx"], r["n"], round(r["x"], 5)) for r in now.collect()) == [(0, 3, 0.2), (3, 1, 3.5)]


def batch(spark, k):
    return spark.createDataFrame([(p, 0.3 + 0.05 * ((p + k) % 9)) for p in range(k % 3, 6)], "pt_id long, prob double")


def expected(n):
    sums = {}
    for k in range(n):
        for p in range(k % 3, 6):
            q = 0.3 + 0.05 * ((p + k) % 9)
            sums[p] = sums.get(p, 0.0) + math.log(q / (1 - q))
    return {p: 1 / (1 + math.exp(-s)) for p, s in sums.items()}


def same(spark, path, n):
    got = {r["pt_id"]: r["change_prob"] for r in jobs.compacted_status(spark, path).collect()}
    want = expected(n)
    assert sorted(got) == sorted(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_merged_sums_survive_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sums")
    sink = jobs.compacting_sink(path, 3)
    for k in range(8):
        sink(batch(spark, k), k)
        assert len(jobs._folders(spark, path)) <= 5
    assert jobs.covering(spark, path) == [(0, 2), (3, 5), (6, 6), (7, 7)]
    same(spark, path, 8)
    deleted = []

    def crash(session, name):
        deleted.append(name)
        if len(deleted) == 2:
            raise RuntimeError("lost")
        remove(session, name)

    remove = jobs._delete
    monkeypatch.setattr(jobs, "_delete", crash)
    with pytest.raises(RuntimeError):
        sink(batch(spark, 8), 8)  # ends between the merge and the deletes
    same(spark, path, 9)
    monkeypatch.setattr(jobs, "_delete", remove)
    sink(batch(spark, 8), 8)  # the batch comes again
    same(spark, path, 9)
    assert jobs._folders(spark, path) == [(0, 8)]
    (tmp_path / "sums" / "sums-9-17").mkdir()  # a merge that never ended
    sink(batch(spark, 9), 9)
    same(spark, path, 10)


def test_late_rows_are_marked_across_batches(spark, tmp_path):
    rows = [(1, k, t) for k, t in enumerate([100, 300, 260, 240, 900, 845, 850, 2000, 100])] + [(2, 20, 50), (2, 21, 20)]
    for cut in ("event_id < 4", "event_id BETWEEN 4 AND 6", "event_id > 6"):
        spark.createDataFrame(rows, "s long, event_id long, ts long").where(cut).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = jobs.mark_late(jobs.source(spark, str(tmp_path / "in"), "s long, event_id long, ts long"), 50)
    jobs.run(stream, jobs.aside_sink(out), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(out).where("late = 'true'").orderBy("event_id").select("event_id").toPandas()["event_id"].tolist()
    assert got == [3, 5, 8] and spark.read.parquet(out).agg(F.count("*")).first()[0] == 11


def test_sync_meets_no_row_with_all_of_its_key(spark):
    rng = np.random.default_rng(5)
    times = {side: np.r_[rng.integers(-3000, 3000, 400), np.arange(-1000, 1001, 50)].tolist() for side in "lr"}
    side = lambda ts: spark.createDataFrame([(1, t, k) for k, t in enumerate(ts)], "s long, ms long, id long").select("s", F.timestamp_millis("ms").alias("ts"), "id")
    got = jobs.sync(side(times["l"]), side(times["r"]))
    want = sorted((i, j) for i, a in enumerate(times["l"]) for j, b in enumerate(times["r"]) if abs(a - b) <= 50)
    assert got.columns == ["l_s", "l_ts", "l_id", "r_s", "r_ts", "r_id"] and sorted((r["l_id"], r["r_id"]) for r in got.collect()) == want
    assert "l_span" in got._jdf.queryExecution().executedPlan().toString()  # spans of time are part of what the sides are joined on


def test_a_tile_reads_and_writes_its_state_once_a_batch():
    class Value:
        held, calls = None, 0

        def exists(self):
            return self.held is not None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, held):
            self.held, self.calls = held, self.calls + 1

    class Handle:
        def __init__(self):
            self.states = {}

        def getValueState(self, name, schema):
            return self.states.setdefault(name, Value())

    rng, tile, handle = np.random.default_rng(2), jobs.TileMap(1.0, 2.0), Handle()
    tile.init(handle)
    want: dict = {}
    for batch in range(3):
        p = pd.DataFrame({"ts": np.sort(rng.integers(4 * batch, 4 * batch + 4, 300)).astype(float), **{a: rng.uniform(-4, 4, 300) for a in "xyz"}})
        p["epoch"] = (p["ts"] >= 9).astype(int)
        for r in p.itertuples():  # one by one, in order of time
            cell = (math.floor(r.x), math.floor(r.y), math.floor(r.z))
            v = want.get(cell)
            v = v if v and v[0] == r.epoch and r.ts - v[2] <= 2 else (r.epoch, [], r.ts)
            want[cell] = (r.epoch, [*v[1], r.x], r.ts)
        got = pd.concat(tile.handleInputRows((1, 0, 0), iter([p.iloc[:100], p.iloc[100:]]), None))
        for r in got.itertuples():
            epoch, xs, ts = want[r.vx, r.vy, r.vz]
            assert (r.epoch, r.n, r.ts) == (epoch, len(xs), ts) and math.isclose(r.x, sum(xs) / len(xs), rel_tol=1e-9)
        assert len(got) == len({(math.floor(r.x), math.floor(r.y), math.floor(r.z)) for r in p.itertuples()})
    assert sum(v.calls for v in handle.states.values()) <= 6
