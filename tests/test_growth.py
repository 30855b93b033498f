"""Steps that grew faster than their input: same results, without the joins, shuffles or calls that made them grow."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanfuse.operators import change, cluster, components, grid, neighbors, project, select, stats, trajectory
from scanfuse.plans import changes, lines, maps
from scanfuse.plans.registry import QUERIES
from scanfuse.sources import fixture
from scanfuse.sources.fixture import points

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_front_surface_is_one_shuffle(spark):
    px = lines.project(points(spark, SF), lines.ROOM)
    got = grid.front(px)
    want = px.join(grid.nearest_returns(px).select("pt_id"), "pt_id", "left_semi").select(px.columns)
    assert got.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = _plan(QUERIES["w11_ground"](spark, SF))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_lines_are_those_of_one_by_one(spark):
    p = points(spark, SF).withColumn("line", F.col("ring") + 16 * (F.col("frame_id").cast("long") * 10 + F.floor(F.col("az") / 18)))
    fits = stats.ransac_lines(p, "line")
    assert "FlatMapGroups" not in _plan(fits)  # a call fits a batch of lines
    got, rows = fits.toPandas().set_index("line"), p.toPandas()
    for line, pdf in list(rows.groupby("line"))[::40]:
        q = pdf.sort_values("pt_id")[["x", "y", "z"]].to_numpy()
        rng, best = np.random.default_rng([7, line]), np.zeros(len(q), bool)
        for _ in range(50 if len(q) > 1 else 0):
            a, b = q[rng.choice(len(q), 2, replace=False)]
            if (size := np.linalg.norm(b - a)) > 1e-9:
                inside = np.linalg.norm(np.cross(q - a, (b - a) / size), axis=1) <= 0.1
                best = inside if inside.sum() > best.sum() else best
        chosen = q[best] if best.sum() > 1 else q
        values, vectors = np.linalg.eigh(np.cov(chosen.T, bias=True) if len(chosen) > 1 else np.zeros((3, 3)))
        assert got.inliers[line] == best.sum()
        assert abs(got.length[line] - np.ptp(chosen @ vectors[:, 2])) < 1e-7
        assert abs(got.linearity[line] - (values[2] - values[1]) / max(values[2], 1e-12)) < 1e-7


def test_frame_clusters_without_joined_pairs(spark):
    image = lines.image(spark, SF)
    got = cluster.segments(image, 180, 2.0, 2.0)
    label = cluster.frame_components(cluster.image_edges(image, 180, 2.0, 2.0))
    on = image.join(label, ["frame_id", "pt_id"], "left").withColumn("label", F.coalesce("label", "pt_id"))
    size = on.groupBy("frame_id", "label").agg(F.count("*").alias("size"), F.countDistinct("row_id").alias("rows"))
    want = {(r.pt_id, r.label if r.size >= 30 or r.size >= 5 and r.rows >= 3 else 999_999, r.size, r.rows) for r in on.join(size, ["frame_id", "label"]).collect()}
    assert {tuple(r) for r in got.select("pt_id", "label", "size", "rows").collect()} == want
    for df in (got, cluster.feature_clusters(image, 180)):
        assert "Join" not in _plan(df)
    pairs = None
    for rows, step in ((0, 1), (1, -1), (1, 0), (1, 1), (2, -1), (2, 0), (2, 1)):
        near = cluster._shifted(image, rows, step, 180).where("sqrt((x-b_x)*(x-b_x)+(y-b_y)*(y-b_y)+(z-b_z)*(z-b_z)) < 0.5").select("frame_id", F.col("pt_id").alias("u"), F.col("b_pt_id").alias("v"))
        pairs = near if pairs is None else pairs.unionByName(near)
    on = image.join(cluster.frame_components(pairs), ["frame_id", "pt_id"], "left").withColumn("label", F.coalesce("label", "pt_id"))
    want = {tuple(r) for r in on.groupBy("frame_id", "label").agg(F.count("*"), F.countDistinct("row_id")).collect()}
    assert {tuple(r) for r in cluster.feature_clusters(image, 180).select("frame_id", "label", "n", "rows").collect()} == want


def test_tiles_of_some_density_are_not_split(spark, monkeypatch):
    q, t = maps.crowded_pair(spark, SF)
    pairs = lambda **o: sorted(map(tuple, neighbors.nearest_uneven(q, t, 5, 1.0, complete=True, **o).select("q_id", "nr", "t_id", F.round("d2", 9)).collect()))
    split = pairs(whole=60, crowd=16)
    monkeypatch.setattr(neighbors, "_split_cells", None)  # a tile of up to 4,096 points goes as a list: nothing is dealt to cells
    assert pairs() == split and split


def test_components_of_near_numbers(spark, monkeypatch):
    rng = np.random.default_rng(3)
    u = np.r_[rng.integers(0, 20_000, 15_000), np.full(500, 7), np.arange(30_000, 30_300)]
    v = np.r_[u[:15_000] + rng.integers(-3, 4, 15_000), rng.integers(0, 200, 500), np.arange(30_001, 30_301)]
    sets = components.UnionFind(40_000)
    sets.join_all(np.abs(u), np.abs(v))
    root = sets.roots()
    edges = spark.createDataFrame([(int(abs(a)), int(abs(b))) for a, b in zip(u, v)], "u long, v long").repartition(6)
    want = {(int(n), int(root[n])) for n in np.unique(np.abs(np.r_[u[u != v], v[u != v]]))}
    rounds, left = components.components, []
    monkeypatch.setattr(components, "components", lambda e: left.append(e.count()) or rounds(e))
    assert {tuple(r) for r in components.near_components(edges).collect()} == want
    assert left[0] < 0.1 * len(u)
    assert components.near_components(edges.limit(0)).isEmpty()


def test_times_between_two_decimals(spark, duck):
    from __spark_entry__ import oracle_sql

    sf = "/root/testdata/sf0.1"
    duck.execute(f"CREATE OR REPLACE TEMP VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    want = duck.execute(oracle_sql()["p12_relative_time"]).df().set_index("pt_id").rel_time
    duck.execute("DROP VIEW temp.lineitem")
    got = QUERIES["p12_relative_time"](spark, sf).toPandas().set_index("pt_id").rel_time
    assert (got.reindex(want.index) == want).all()


def test_hull_keeps_what_batches_leave(spark):
    rng = np.random.default_rng(1)
    for t in range(60):
        p = rng.normal(size=(50, 2)) if t % 2 else rng.integers(0, 5, (50, 2)).astype(float)
        g = np.sort(rng.integers(0, 3, 50))
        order = np.lexsort((p[:, 1], p[:, 0], g))
        p, keep = p[order], select._outer(*p[order].T, g)
        for k in set(g):
            assert np.array_equal(select._hull(p[g == k]), select._hull(p[keep][g[keep] == k]))


@pytest.mark.parametrize("small", [0, 100])
def test_covisible_points_stay_in_place(spark, small):
    """Every keyframe's points and the least number are exact, also where the outer cells decide; what a keyframe sees is not dealt by place."""
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(-9, 9, 600) * rng.uniform(0, 1, 600), 1)
    ref = spark.createDataFrame([(k, float(v), 0.5 * k, 1.0) for k, v in enumerate(x)], "pt_id long, x double, y double, z double")
    poses = [(k, -12.0 + 0.5 * k, 0.1 * k, 0.2, 0.0, 0.0, float(np.sin(0.1 * k)), float(np.cos(0.1 * k))) for k in range(50)]
    frames = spark.createDataFrame(poses, "frame_id int, " + ", ".join(f"{n} double" for n in trajectory.POSE))
    sees = {f[0]: [k for k, v in enumerate(x) if f[1] - 2.0 <= v <= f[1] + 2.0] for f in poses}
    for least in sorted({len(s) for s in sees.values()})[1::4]:
        want = {(f, k) for f, s in sees.items() if len(s) >= least for k in s}
        got = change.covisible(ref, frames, 2.0, least, small)
        assert sorted((r["frame_id"], r["pt_id"]) for r in got.collect()) == sorted(want)
    want = trajectory.transform_points(got.select("frame_id", "pt_id").join(ref, "pt_id").select("frame_id", "pt_id", "x", "y", "z"), frames, inverse=True)
    key = lambda df: sorted(map(tuple, df.select("frame_id", "pt_id", *(F.round(a, 9) + 0.0 for a in "xyz")).collect()))
    assert key(got) == key(want)
    if small:
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if tables were large
        try:
            plan = _plan(change.covisible(ref, frames, 2.0, least))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert "hashpartitioning(cell" not in plan and "hashpartitioning(tile" not in plan


def test_rounding_off_ties_is_rounding(spark):
    values = [0.0, -0.0, 1.000005, -1.000005, 2.675e-5, 0.123455, 12.0, 1e12 + 0.3, -7.1234549999, 1e300, float("nan"), float("inf"), None, *np.random.default_rng(1).normal(0, 10, 500).tolist(), *(k / 200000 for k in range(-99, 99, 2))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(fixture.r5("v")[0].alias("a"), fixture.r5_off_ties("v")[0].alias("b"))
    assert [repr(r["a"]) for r in got.collect()] == [repr(r["b"]) for r in got.collect()]


def test_status_without_rows_of_one_half(spark):
    rng = np.random.default_rng(8)
    frames = [0, 1, 2, 5, 6, *range(9, 40)]
    kinds = rng.choice([0.6, 0.4, 0.5], (60, len(frames)), p=[0.25, 0.35, 0.4])
    kinds[:3] = [[0.4], [0.5], [0.6]]
    kinds[3, -4:] = 0.4, 0.4, 0.4, 0.5
    dense = spark.createDataFrame([(k, f, float(p)) for k, row in enumerate(kinds) for f, p in zip(frames, row)], "pt_id long, frame_id int, prob double")
    sparse = dense.where("prob <> 0.5 OR (pt_id + frame_id) % 3 = 0")
    every, seen = dense.select("pt_id").distinct(), dense.select("frame_id").distinct()
    for mode in ("logodds", "reference"):
        want = {r["pt_id"]: r["change_prob"] for r in change.fuse_status(dense, mode).collect()}
        got = {r["pt_id"]: r["change_prob"] for r in change.fuse_status(sparse, mode, every, seen).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        assert change.fuse_status(sparse.limit(0), mode, every, seen.limit(0)).isEmpty()  # no frame, no status
    for name in ("c5_fused_status", "c5_reference_status"):
        plan = _plan(QUERIES[name](spark, SF))
        assert "FullOuter" not in plan and "explode" not in plan


@pytest.mark.parametrize("mode", ["logodds", "reference"])
def test_status_is_that_of_all_pixels(spark, mode):
    cur = changes._observed(spark, SF)
    want = {tuple(r) for r in change.fuse_status(cur, mode).select("pt_id", F.round("change_prob", 9)).collect()}
    name = {"logodds": "c5_fused_status", "reference": "c5_reference_status"}[mode]
    got = {(r["pt_id"], r["change_prob"]) for r in QUERIES[name](spark, SF).collect()}
    assert got == {(k, round(v, 5) + 0.0) for k, v in want} and got


def test_one_image_without_sorts(spark):
    rng = np.random.default_rng(4)
    px = spark.createDataFrame([(int(r), int(c), float(v), k) for k, (r, c, v) in enumerate(zip(rng.integers(0, 4, 900), rng.integers(0, 5, 900), rng.integers(1, 9, 900) / 4))], "row_id int, col_id int, rng double, pt_id long")
    got, want = grid.nearest_in_image(px), grid.nearest_returns(px, ())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Sort" not in _plan(got)


def test_columns_are_rounded_as_before(spark):
    p = points(spark, SF).select("x", "y").unionByName(spark.createDataFrame([(float(np.sin(np.radians(a))), float(np.cos(np.radians(a)))) for a in np.arange(-180, 181, 0.5)], "x double, y double"))
    v = (F.degrees(F.atan2("x", "y")) - 90.0) / lines.ROOM.res_x
    first = (-F.round(v) + lines.ROOM.cols // 2).cast("int")
    want = F.when(first >= lines.ROOM.cols, first - lines.ROOM.cols).otherwise(first)
    assert p.where(~project.column_of(lines.ROOM).eqNullSafe(want)).isEmpty()
