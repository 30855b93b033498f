"""Operators and queries do the whole table, not a part of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanfuse.operators import change, trajectory
from scanfuse.plans import changes, lines, maps  # noqa: F401
from scanfuse.plans.registry import QUERIES
from scanfuse.sources.fixture import points

SF = "/root/testdata/sf0.01"


def _frames(spark, df, name="pt_id"):
    p = points(spark, SF).select("frame_id", F.col("pt_id").alias(name))
    return {r[0] for r in df.join(p, name).select("frame_id").distinct().collect()}


def test_surfels_of_every_window(spark):
    got = QUERIES["c9_surfels"](spark, SF)
    assert _frames(spark, got) == set(range(20))
    # a window's surfels are those of its points alone
    p = points(spark, SF).where("frame_id IN (6, 7)").select("pt_id", "x", "y", "z")
    alone = {r[0] for r in change.surfels(p, 0.5, 1.0).select("pt_id").collect()}
    assert alone and alone == {r[0] for r in got.join(p, "pt_id", "left_semi").select("pt_id").collect()}


def test_surfels_match_in_every_session(spark):
    got = QUERIES["j13_match_surfels"](spark, SF)
    assert _frames(spark, got, "q_id") == {f for f in range(20) if f % 10 > 1}
    p = points(spark, SF).select("frame_id", "pt_id")
    both = got.join(p.select(F.col("pt_id").alias("q_id"), F.col("frame_id").alias("q")), "q_id").join(p.select(F.col("pt_id").alias("t_id"), F.col("frame_id").alias("t")), "t_id")
    assert both.where("floor(q / 2.0) <> floor(t / 2.0) + 1").isEmpty()


def test_deskew_keeps_sessions_apart(spark):
    at = F.col("session_id") * 10.0
    windows = spark.range(2).select(F.col("id").alias("session_id"), F.lit(0).alias("window_id")).withColumns({f"c{k}": F.struct(at.alias("tx"), *(F.lit(1.0 if n == "qw" else 0.0).alias(n) for n in trajectory.POSE[1:])) for k in range(5)})
    p = spark.createDataFrame([(s, 0, s, 1.0, 0.0, 0.0, 0.3) for s in range(2)], "session_id long, window_id int, pt_id long, x double, y double, z double, ratio double")
    got = {(r["pt_id"], round(r["x"], 6)) for r in trajectory.deskew(p, windows, ("session_id", "window_id")).collect()}
    assert got == {(0, 1.0), (1, 11.0)}


def test_pairs_are_of_every_frame(spark):
    later = {f for f in range(20) if f % 10}
    assert _frames(spark, QUERIES["a10_lines"](spark, SF).withColumnRenamed("q_id", "pt_id")) == later
    assert {r["frame_id"] for r in QUERIES["a21_align_pairs"](spark, SF).collect()} == later
    assert {r["frame_id"] for r in QUERIES["r4_quality"](spark, SF).collect()} == later


def test_every_row_and_ring_takes_part(spark):
    p = points(spark, "/root/testdata/sf0.001")
    assert QUERIES["a11_ransac_lines"](spark, "/root/testdata/sf0.001").count() == p.select("frame_id", "ring", F.floor(F.col("az") / 18)).distinct().count()
    image = lines.image(spark, "/root/testdata/sf0.001")
    rows = image.select("row_id").distinct().count()
    for name in ("k4_greedy_logdet", "k5_constraint_sphere"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").join(image, ["frame_id", "pt_id"]).select("row_id").distinct().count() > (1 if name[1] == "5" else rows // 2)
