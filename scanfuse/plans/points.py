"""Queries: sources, projections, filters, transforms and trajectories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfuse.functions import geom as G
from scanfuse.functions.profile import PROFILES
from scanfuse.operators import project as P
from scanfuse.operators import trajectory as T
from scanfuse.operators.components import shared_dir
from scanfuse.plans.registry import query
from scanfuse.sources import pointcloud
from scanfuse.sources.fixture import oracle, points, poses, r5

ROOM = PROFILES["room"]


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the time of their frame."""
    return points(spark, sf_dir).withColumn("ts", 0.1 * F.col("frame_id"))


_ROT = """qn AS (SELECT frame_id, tx, ty, tz, qz/sqrt(qz*qz+qw*qw) AS qz, qw/sqrt(qz*qz+qw*qw) AS qw FROM ps),
moved AS (SELECT p.frame_id, p.pt_id, x*(1-2*qz*qz) - y*2*qz*qw + tx AS x, x*2*qz*qw + y*(1-2*qz*qz) + ty AS y, z + tz AS z FROM p JOIN qn USING (frame_id))"""


@query("s5_build_map", oracle("SELECT m.frame_id, m.pt_id, round(m.x,5) AS x, round(m.y,5) AS y, round(m.z,5) AS z FROM moved m JOIN p USING (pt_id) WHERE sqrt(p.x*p.x+p.y*p.y+p.z*p.z) < 10", "points", "poses", _ROT))
def build_map(spark, sf_dir):
    return pointcloud.build_map(poses(spark, sf_dir), timed(spark, sf_dir), 10.0).select("frame_id", "pt_id", *r5("x", "y", "z"))


@query("s1_read_pcd", oracle("SELECT CAST(frame_id AS DOUBLE) AS ts, row_number() OVER (PARTITION BY frame_id ORDER BY pt_id)-1 AS pt_id, round(CAST(CAST(x AS FLOAT) AS DOUBLE),4) AS x, round(CAST(CAST(z AS FLOAT) AS DOUBLE),4) AS z, CAST(intensity AS DOUBLE) AS intensity FROM p", "points"))
def read_pcd(spark, sf_dir):
    """Every frame as a PCD file and back."""
    return pointcloud.decode_pcd(pointcloud.encode_pcd(points(spark, sf_dir))).select("ts", "pt_id", F.round("x", 4).alias("x"), F.round("z", 4).alias("z"), "intensity")


@query("s2_map_sink", oracle("SELECT CAST(floor(x/8.0) AS INT) AS tile_x, CAST(floor(y/8.0) AS INT) AS tile_y, count(*) AS n, round(sum(z),4)+0.0 AS z FROM p GROUP BY 1,2", "points"))
def map_sink(spark, sf_dir):
    out = f"{shared_dir(spark)}/map-{uuid.uuid4().hex}"
    pointcloud.write_map(points(spark, sf_dir).select("pt_id", "x", "y", "z"), out, 8.0)
    return spark.read.parquet(out).groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"), (F.round(F.sum("z"), 4) + 0.0).alias("z"))


@query("s3_trajectory_source", oracle("SELECT frame_id, round(ty,5) AS tx, round(tz,5) AS ty, round(tx,5) AS tz, round(qz,5) AS qy FROM ps", "poses"))
def trajectory_source(spark, sf_dir):
    """Trajectory text, its axes turned."""
    out = f"{shared_dir(spark)}/turned-{uuid.uuid4().hex}"
    pointcloud.write_trajectory(poses(spark, sf_dir), out)
    return pointcloud.read_trajectory(spark, out, switch=True).select(F.round(F.col("ts") * 10).cast("int").alias("frame_id"), *r5("tx", "ty", "tz", "qy"))


@query("s8_flatten_packets", oracle("SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY pt_id)-1 AS INT) AS pos, pt_id, round(x,5) AS x, intensity FROM p QUALIFY pos < 32000", "points"))
def flatten_packets(spark, sf_dir):
    return pointcloud.flatten_packets(pointcloud.livox_packets(points(spark, sf_dir))).select("frame_id", "pos", "pt_id", *r5("x"), "intensity")


@query("p1_spherical", oracle("SELECT pt_id, round(sqrt(x*x+y*y+z*z),5) AS rng, round(degrees(atan2(x,y)),5) AS azimuth, round(degrees(atan2(z,sqrt(x*x+y*y))),5) AS elevation FROM p", "points"))
def spherical(spark, sf_dir):
    return P.spherical(points(spark, sf_dir)).select("pt_id", *r5("rng", "azimuth", "elevation"))


@query("p2_project", oracle("SELECT pt_id, row_id, col_id, round(rng,5) AS rng FROM px", "points", "pixels"))
def project(spark, sf_dir):
    return P.project(points(spark, sf_dir), ROOM).select("pt_id", "row_id", "col_id", *r5("rng"))


@query("p3_nearest_beam", oracle("""SELECT pt_id, row_id, col_id FROM (SELECT pt_id, CAST(b.k AS INT) AS row_id, col_id,
 row_number() OVER (PARTITION BY pt_id ORDER BY abs(-15.0+2.0*b.k - degrees(atan2(z,sqrt(x*x+y*y)))), b.k) AS nr FROM px, range(16) b(k)) q WHERE nr=1""", "points", "pixels"))
def nearest_beam(spark, sf_dir):
    return P.project_nearest_beam(points(spark, sf_dir), ROOM).select("pt_id", "row_id", "col_id")


@query("p4_ring_projection", oracle("SELECT pt_id, CAST(coalesce(CASE WHEN pt_id%3=0 THEN ring END, row_id) AS INT) AS row_id, col_id FROM px", "points", "pixels"))
def ring_projection(spark, sf_dir):
    some = points(spark, sf_dir).withColumn("ring", F.when(F.col("pt_id") % 3 == 0, F.col("ring")))
    return P.project_with_ring(some, ROOM).select("pt_id", "row_id", "col_id")


@query("p5_organised", oracle("""SELECT pt_id, CAST(i%16 AS INT) AS row_id, CAST((i//16 + (i%16)%4*3) % 180 AS INT) AS col_id, round(sqrt(x*x+y*y+z*z),5) AS rng
 FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY pt_id)-1 AS i FROM p) q""", "points"))
def organised(spark, sf_dir):
    from pyspark.sql import Window

    on = points(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("frame_id").orderBy("pt_id")) - 1)
    return P.project_organised(on, F.col("i"), ROOM, tuple(k % 4 * 3 for k in range(16))).select("pt_id", "row_id", "col_id", *r5("rng"))


@query("p6_sphere_image", oracle("""SELECT pt_id, row_id, col_id, round(rng,5) AS rng FROM (SELECT pt_id, CAST(round((degrees(atan2(z,sqrt(x*x+y*y)))+30.0)/0.7) AS INT) AS row_id,
 CAST(round((degrees(atan2(x,y))+180.0)/0.7) AS INT) AS col_id, sqrt(x*x+y*y+z*z) AS rng FROM p) q WHERE row_id BETWEEN 0 AND 85 AND col_id BETWEEN 0 AND 514 AND rng < 200""", "points"))
def sphere_image(spark, sf_dir):
    return P.project_sphere(points(spark, sf_dir), 0.7, 0.7).select("pt_id", "row_id", "col_id", *r5("rng"))


@query("p7_unproject", oracle("""SELECT pt_id, round(rng*cos(el)*sin(az),5) AS x, round(rng*cos(el)*cos(az),5) AS y, round(rng*sin(el),5) AS z FROM (
 SELECT pt_id, rng, radians(CAST(round((degrees(atan2(z,sqrt(x*x+y*y)))+30.0)/0.7) AS INT)*0.7::DOUBLE-30.0) AS el, radians(CAST(round((degrees(atan2(x,y))+180.0)/0.7) AS INT)*0.7::DOUBLE-180.0) AS az FROM (SELECT *, sqrt(x*x+y*y+z*z) AS rng FROM p) w) q""", "points"))
def unproject(spark, sf_dir):
    return P.unproject_sphere(P.project_sphere(points(spark, sf_dir), 0.7, 0.7), 0.7, 0.7).select("pt_id", *r5("x", "y", "z"))


@query("p8_pass_through", oracle("SELECT frame_id, count(*) AS n FROM p WHERE x BETWEEN -6 AND 6 GROUP BY 1", "points"))
def pass_through(spark, sf_dir):
    return P.pass_through(points(spark, sf_dir), "x", -6, 6).groupBy("frame_id").agg(F.count("*").alias("n"))


@query("p9_crop_around", oracle("SELECT pt_id FROM p JOIN ps USING (frame_id) WHERE x BETWEEN tx-5 AND tx+5 AND y BETWEEN ty-5 AND ty+5 AND z BETWEEN tz-5 AND tz+5", "points", "poses"))
def crop_around(spark, sf_dir):
    return P.crop_around(points(spark, sf_dir), poses(spark, sf_dir), 5.0).select("pt_id")


@query("p10_range_gate", oracle("SELECT frame_id, count(*) AS n FROM p WHERE sqrt(x*x+y*y+z*z) < 9 AND sqrt(x*x+y*y+z*z) >= 0.5 GROUP BY 1", "points"))
def range_gate(spark, sf_dir):
    return P.range_gate(points(spark, sf_dir), 9.0, 0.5).groupBy("frame_id").agg(F.count("*").alias("n"))


@query("p11_finite", oracle("SELECT frame_id, count(*) AS n FROM p WHERE pt_id%5<>0 AND pt_id%7<>0 GROUP BY 1", "points"))
def finite(spark, sf_dir):
    broken = F.when(F.col("pt_id") % 5 == 0, float("nan")).when(F.col("pt_id") % 7 == 0, float("inf")).otherwise(F.col("x"))
    return P.finite(points(spark, sf_dir).withColumn("x", broken)).groupBy("frame_id").agg(F.count("*").alias("n"))


@query("p12_relative_time", oracle("""SELECT pt_id, round((CASE WHEN round(off,9)<0 THEN off+2*pi() ELSE off END)/(CASE WHEN span<=0 THEN span+2*pi() ELSE span END)*0.1,5) AS rel_time FROM (
 SELECT pt_id, -atan2(y,x)-st AS off, en-st AS span FROM p JOIN (SELECT frame_id, arg_min(-atan2(y,x),pt_id) AS st, arg_max(-atan2(y,x),pt_id) AS en FROM p GROUP BY 1) f USING (frame_id)) q""", "points"))
def relative_time(spark, sf_dir):
    # rounded as the SQL's round does, by scaling: shares of a sweep such as 110 of 320 lie between two fifth decimals
    return P.relative_time(points(spark, sf_dir)).select("pt_id", (F.round(F.col("rel_time") * 1e5) / 1e5 + 0.0).alias("rel_time"))


@query("p14_select", oracle("SELECT 'in' AS side, count(*) AS n FROM p WHERE ring>=8 UNION ALL SELECT 'out', count(*) FROM p WHERE ring<8", "points"))
def select_points(spark, sf_dir):
    p = points(spark, sf_dir)
    chosen = p.where("ring >= 8")
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(P.select_points(p, chosen), "in").unionByName(count(P.select_points(p, chosen, True), "out"))


@query("p15_gnc_weight", oracle("SELECT pt_id, round(CASE WHEN r2 >= 1.5*0.0004 THEN 0 WHEN r2 <= 0.0004*2/3 THEN 1 ELSE sqrt(0.0004*2*3/r2)-2 END,5) AS w FROM (SELECT pt_id, (z+1.8)*(z+1.8) AS r2 FROM p) q", "points"))
def gnc_weight(spark, sf_dir):
    r = F.col("z") + 1.8
    return points(spark, sf_dir).select("pt_id", F.round(P.gnc_weight(r * r, 2.0, 0.02), 5).alias("w"))


@query("p16_cauchy_weight", oracle("SELECT pt_id, round(1/(1+(z+1.8)*(z+1.8)/(0.1*0.1)),5) AS w FROM p", "points"))
def cauchy_weight(spark, sf_dir):
    return points(spark, sf_dir).select("pt_id", F.round(P.cauchy_weight(F.col("z") + 1.8), 5).alias("w"))


@query("p17_break_distance", oracle("SELECT pt_id, round(sqrt(x*x+y*y+z*z)*sin(radians(0.2))/sin(radians(9.8))+0.09,5) AS d FROM p", "points"))
def break_distance(spark, sf_dir):
    return points(spark, sf_dir).select("pt_id", F.round(P.break_distance(G.norm(*G.vec())), 5).alias("d"))


@query("t1_transform", oracle("SELECT pt_id, round(x,5) AS x, round(y,5) AS y, round(z,5) AS z FROM moved", "points", "poses", _ROT))
def transform(spark, sf_dir):
    return T.transform_points(points(spark, sf_dir), poses(spark, sf_dir)).select("pt_id", *r5("x", "y", "z"))


_REL = """rel AS (SELECT session_id, frame_id, lag(frame_id) OVER w AS f0, tx - lag(tx) OVER w AS dx, ty - lag(ty) OVER w AS dy, 0.01*lag(frame_id) OVER w AS h0, 0.01*frame_id AS h1 FROM ps WINDOW w AS (PARTITION BY session_id ORDER BY ts))"""


@query("t2_relative_poses", oracle("SELECT session_id, frame_id, round(dx*cos(2*h0)+dy*sin(2*h0),5) AS tx, round(-dx*sin(2*h0)+dy*cos(2*h0),5) AS ty, round(sin(h1-h0),5) AS qz, round(cos(h1-h0),5) AS qw FROM rel WHERE f0 IS NOT NULL", "poses", _REL))
def relative_poses(spark, sf_dir):
    return T.relative_poses(poses(spark, sf_dir)).select("session_id", "frame_id", *r5("tx", "ty", "qz", "qw"))


@query("t3_pose_matrix", oracle("SELECT frame_id, round(cos(0.02*frame_id),5) AS m00, round(-sin(0.02*frame_id),5) AS m01, round(tx,5) AS m03, round(sin(0.02*frame_id),5) AS m10, round(abs(qz),5) AS qz FROM ps", "poses"))
def pose_matrix(spark, sf_dir):
    back = T.matrix_pose(T.pose_matrix(poses(spark, sf_dir)))
    m = F.col("matrix")
    return back.select("frame_id", F.round(m[0], 5).alias("m00"), F.round(m[1], 5).alias("m01"), F.round(m[3], 5).alias("m03"), F.round(m[4], 5).alias("m10"), F.round(F.abs("qz"), 5).alias("qz"))


@query("t4_chain_poses", oracle("SELECT session_id, frame_id, round((tx-x0)*cos(2*h0)+(ty-y0)*sin(2*h0),5) AS tx, round(-(tx-x0)*sin(2*h0)+(ty-y0)*cos(2*h0),5) AS ty FROM (SELECT *, first_value(tx) OVER w AS x0, first_value(ty) OVER w AS y0, 0.01*first_value(frame_id) OVER w AS h0, row_number() OVER w AS nr FROM ps WINDOW w AS (PARTITION BY session_id ORDER BY frame_id)) q WHERE nr > 1", "poses"))
def chain_poses(spark, sf_dir):
    steps = T.relative_poses(poses(spark, sf_dir)).withColumn("ok", F.lit(True))
    return T.chain_poses(steps, 4).select("session_id", "frame_id", *r5("tx", "ty"))


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).select("session_id", (F.col("ts") + 0.04).alias("at"))


_AT = "tm AS (SELECT session_id, ts+0.04 AS t0, tx, ty, frame_id, lead(frame_id) OVER w AS f1, lag(frame_id) OVER w AS f_1, lead(frame_id,2) OVER w AS f2 FROM ps WINDOW w AS (PARTITION BY session_id ORDER BY ts))"


@query("t5_slerp", oracle("SELECT session_id, round(t0,5) AS t_at, round(tx+0.08,5) AS tx, round(sin(0.01*frame_id+0.004),5) AS qz FROM tm WHERE f1 IS NOT NULL", "poses", _AT))
def slerp(spark, sf_dir):
    return T.interpolate(_times(spark, sf_dir), poses(spark, sf_dir)).withColumnRenamed("at", "t_at").select("session_id", *r5("t_at", "tx", "qz"))


@query("t7_catmull_rom", oracle("SELECT session_id, round(t0,5) AS t_at, round(tx+0.08,5) AS tx, round(ty+0.02,5) AS ty FROM tm WHERE f_1 IS NOT NULL AND f2 IS NOT NULL", "poses", _AT))
def catmull_rom(spark, sf_dir):
    return T.interpolate(_times(spark, sf_dir), poses(spark, sf_dir), "catmull").withColumnRenamed("at", "t_at").select("session_id", *r5("t_at", "tx", "ty"))


@query("t9_uniform_spline", oracle("SELECT session_id, round(t0,5) AS t_at, round(tx+0.08,5) AS tx, 2.0 AS vx, 0.5 AS vy, 0.0 AS ax FROM tm WHERE f_1 IS NOT NULL AND f2 IS NOT NULL", "poses", _AT))
def uniform_spline(spark, sf_dir):
    p, t = poses(spark, sf_dir), _times(spark, sf_dir)
    motion = T.uniform_motion(t, p).withColumn("ax", F.abs(F.round("ax", 5)))
    at = T.interpolate(t, p, "uniform").join(motion, ["session_id", "at"])
    return at.withColumnRenamed("at", "t_at").select("session_id", *r5("t_at", "tx", "vx", "vy"), "ax")


def _windows(spark: SparkSession, sf_dir: str, turned: bool = True) -> DataFrame:
    """Five control poses for each window of five frames."""
    p = poses(spark, sf_dir)
    if not turned:
        p = p.withColumns({"qz": F.lit(0.0), "qw": F.lit(1.0)})
    on = T.windows_of(p).join(p.select("session_id", "frame_id", F.struct(*T.POSE).alias("pose")), ["session_id", "frame_id"])
    return on.groupBy("session_id", "window_id").agg(*(F.max(F.when(F.col("no") == k, F.col("pose"))).alias(f"c{k}") for k in range(5)))


_WIN = "win AS (SELECT session_id, CAST(k AS INT) AS window_id, f.frame_id AS f0 FROM (SELECT session_id, frame_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM ps WINDOW w AS (PARTITION BY session_id ORDER BY frame_id)) f, range(10000) r(k) WHERE f.i = 2*k AND 2*k+5 <= f.n)"


@query("t6_clamped_spline", oracle("SELECT session_id, window_id, round(0.2*f0 + 0.2*(2*0.3*0.4*0.4+2*0.3*0.7*0.4+2*0.3*0.7*0.7 + 2*(1-0.4*0.4*0.4-(2*0.3*0.4*0.4+2*0.3*0.7*0.4+2*0.3*0.7*0.7)-2*0.3*0.3*0.3) + 3*2*0.3*0.3*0.3),5) AS tx FROM win", "poses", _WIN))
def clamped_spline(spark, sf_dir):
    return T.spline_pose(_windows(spark, sf_dir), F.lit(0.3)).select("session_id", "window_id", *r5("tx"))


@query("t8_control_poses")
def control_poses(spark, sf_dir):
    p = poses(spark, sf_dir)
    on = T.windows_of(p).join(p, ["session_id", "frame_id"]).withColumn("u", F.col("no") / 4.0).select("session_id", F.col("window_id").cast("long").alias("window_id"), "no", "u", *T.POSE)
    return T.control_poses(on).select("session_id", "window_id", "no", *r5(*T.POSE))


@query("t10_deskew", oracle("""SELECT pt_id, w.session_id, w.window_id, round(x + 0.2*w.f0 + 0.2*(w1 + 2*(1-w0-w1-w3-w4) + 3*w3 + 4*w4),5) AS x FROM (SELECT *, CASE WHEN u<0.5 THEN (1-2*u)*(1-2*u)*(1-2*u) ELSE 0 END AS w0,
 CASE WHEN u<0.5 THEN 2*u*(1-2*u)*(1-2*u)+2*u*(1-u)*(1-2*u)+2*u*(1-u)*(1-u) ELSE 2*(1-u)*(1-u)*(1-u) END AS w1, CASE WHEN u<0.5 THEN 2*u*u*u ELSE 2*(1-u)*(2*u-1)*(2*u-1)+2*(1-u)*u*(2*u-1)+2*(1-u)*u*u END AS w3,
 CASE WHEN u<0.5 THEN 0 ELSE (2*u-1)*(2*u-1)*(2*u-1) END AS w4 FROM (SELECT *, (pt_id%101)/100.0 AS u FROM p) a) b JOIN win w ON w.f0 = b.frame_id""", "points", "poses", _WIN))
def deskew(spark, sf_dir):
    p = poses(spark, sf_dir)
    starts = T.windows_of(p).where("no = 0").select("frame_id", "session_id", "window_id")
    on = points(spark, sf_dir).join(starts, "frame_id").withColumn("ratio", F.col("pt_id") % 101 / 100.0).select("session_id", "window_id", "pt_id", "x", "y", "z", "ratio")
    return T.deskew(on, _windows(spark, sf_dir, False), ("session_id", "window_id")).select("pt_id", "session_id", "window_id", *r5("x"))


@query("t11_keyframes_greedy")
def keyframes(spark, sf_dir):
    return T.keyframes(poses(spark, sf_dir), 0.5).select("session_id", "frame_id")


@query("t11_keyframes_by_travel", oracle("SELECT session_id, CAST(floor(round(travelled,9)/0.5) AS INT) AS stretch, min(frame_id) AS frame_id FROM (SELECT session_id, frame_id, sum(coalesce(d,0)) OVER (PARTITION BY session_id ORDER BY frame_id) AS travelled FROM (SELECT *, sqrt((tx-lag(tx) OVER w)**2+(ty-lag(ty) OVER w)**2) AS d FROM ps WINDOW w AS (PARTITION BY session_id ORDER BY frame_id)) a) b GROUP BY 1,2", "poses"))
def travel_keyframes(spark, sf_dir):
    return T.travel_keyframes(poses(spark, sf_dir), 0.5)


@query("t12_compound_covariance")
def compound_covariance(spark, sf_dir):
    cov = F.array(*(F.lit(1e-4 if k % 7 == 0 else 0.0) for k in range(36)))
    out = T.compound_covariance(T.relative_poses(poses(spark, sf_dir)).withColumn("cov", cov))
    return out.select("session_id", "frame_id", F.round(sum((F.col("cov")[7 * k] for k in range(1, 6)), F.col("cov")[0]), 8).alias("trace"))


@query("t13_point_uncertainty", oracle("SELECT pt_id, round(3*0.01*(1+frame_id) + 2*0.0001*(x*x+y*y+z*z) + 3*0.0004,5) AS cov_trace FROM p", "points"))
def point_uncertainty(spark, sf_dir):
    return T.point_uncertainty(points(spark, sf_dir), 0.01 * (1 + F.col("frame_id")), F.lit(0.0001), F.lit(0.0004)).select("pt_id", *r5("cov_trace"))


@query("t14_absolute_error", oracle("SELECT session_id, round(avg(d),5) AS mean_error, round(max(d),5) AS max_error, count(*) AS n FROM (SELECT session_id, 0.01*(frame_id%7)*sqrt(2.0) AS d FROM ps) q GROUP BY 1", "poses"))
def absolute_error(spark, sf_dir):
    p = poses(spark, sf_dir)
    off = 0.01 * (F.col("frame_id") % 7)
    return T.absolute_error(p.withColumns({"tx": F.col("tx") + off, "tz": F.col("tz") + off}), p).select("session_id", *r5("mean_error", "max_error"), "n")


@query("w13_windows", oracle("SELECT w.session_id, w.window_id, CAST(f0+k AS INT) AS frame_id, CAST(k AS INT) AS no FROM win w, range(5) r(k)", "poses", _WIN))
def windows(spark, sf_dir):
    return T.windows_of(poses(spark, sf_dir))
