"""Queries: change detection, registration, pose graphs and streams."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfuse.functions import geom as G
from scanfuse.functions.profile import PROFILES
from scanfuse.operators import asof, change, grid, posegraph, register, scanline, sparse, trajectory
from scanfuse.operators.components import shared_dir, staged
from scanfuse.operators.project import project

from scanfuse.operators.trajectory import POSE
from scanfuse.plans.lines import COLS, image
from scanfuse.plans.maps import _PAIRS, _PLANE, frames_pair
from scanfuse.plans.registry import query
from scanfuse.sources.fixture import oracle, points, poses, r5, r5_off_ties, read
from scanfuse.streaming import jobs

ROOM = PROFILES["room"]

_SCENE = """cur AS (SELECT frame_id, pt_id, x, y, z FROM p WHERE frame_id%2=1),
ref AS (SELECT pt_id, x*m AS x, y*m AS y, z*m AS z FROM (SELECT *, CASE WHEN az BETWEEN 100 AND 107 AND ring>=6 THEN 0.7 ELSE 1.0 END AS m FROM p WHERE frame_id%2=0) q),
cp AS (SELECT frame_id, pt_id, CAST(floor((degrees(atan2(z, sqrt(x*x+y*y)))+15.1)/2.0) AS INT) AS row_id, CAST(-round((degrees(atan2(x,y))-90.0)/2.0)+90 AS INT) AS c0, sqrt(x*x+y*y+z*z) AS rng FROM cur),
ci AS (SELECT frame_id, row_id, CASE WHEN c0>=180 THEN c0-180 ELSE c0 END AS col_id, min(rng) AS cur_rng, arg_min(pt_id, rng) AS cur_id FROM cp GROUP BY 1,2,3),
rp AS (SELECT pt_id, CAST(floor((degrees(atan2(z, sqrt(x*x+y*y)))+15.1)/2.0) AS INT) AS row_id, CAST(-round((degrees(atan2(x,y))-90.0)/2.0)+90 AS INT) AS c0, sqrt(x*x+y*y+z*z) AS rng FROM ref),
r0 AS (SELECT row_id, col_id, rng AS ref_rng, pt_id AS ref_id FROM (SELECT *, row_number() OVER (PARTITION BY row_id, col_id ORDER BY rng, pt_id) AS nr FROM (SELECT *, CASE WHEN c0>=180 THEN c0-180 ELSE c0 END AS col_id FROM rp) v) w WHERE nr=1),
ri AS (SELECT f.frame_id, r0.* FROM r0 CROSS JOIN (SELECT DISTINCT frame_id FROM ci) f),
j AS (SELECT coalesce(ci.frame_id,ri.frame_id) AS frame_id, coalesce(ci.row_id,ri.row_id) AS row_id, coalesce(ci.col_id,ri.col_id) AS col_id, cur_rng, ref_rng, ref_id FROM ci FULL OUTER JOIN ri ON ci.frame_id=ri.frame_id AND ci.row_id=ri.row_id AND ci.col_id=ri.col_id),
l AS (SELECT *, CASE WHEN cur_rng>100 OR ref_rng>100 THEN 'skip' WHEN cur_rng IS NULL THEN 'unseen' WHEN ref_rng IS NULL THEN 'new' WHEN ref_rng-cur_rng > 0.06*ref_rng THEN 'appeared' WHEN ref_rng-cur_rng < -0.06*ref_rng THEN 'disappeared' ELSE 'static' END AS change_type FROM j),
lo AS (SELECT *, CASE change_type WHEN 'disappeared' THEN 0.6 WHEN 'static' THEN 0.4 ELSE 0.5 END AS ref_prob FROM l WHERE ref_id IS NOT NULL)"""


def scene(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Current frames (odd), and the reference map: the even frames with a pillar that is gone now."""
    p = points(spark, sf_dir)
    m = F.when(F.col("az").between(100, 107) & (F.col("ring") >= 6), 0.7).otherwise(1.0)
    ref = p.where("frame_id % 2 = 0").select("pt_id", *((F.col(a) * m).alias(a) for a in "xyz"))
    return p.where("frame_id % 2 = 1").select("frame_id", "pt_id", "x", "y", "z"), ref


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cur, ref = scene(spark, sf_dir)
    view = change.view(cur, ROOM)
    frames = view.select("frame_id").distinct()
    seen = change.view(ref, ROOM, keys=())
    return change.difference(view, change.reference_views(frames, seen, ROOM))


@query("c7_change_summary", oracle("SELECT frame_id, change_type, count(*) AS n, min(col_id) AS c_lo, max(col_id) AS c_hi FROM l GROUP BY 1,2", "points", _SCENE))
def change_summary(spark, sf_dir):
    return change.summary(changes(spark, sf_dir))


@query("c7_confusion", oracle("SELECT CASE WHEN col_id BETWEEN 130 AND 137 AND row_id>=6 THEN 'appeared' WHEN col_id BETWEEN 10 AND 17 AND row_id>=6 THEN 'disappeared' ELSE 'static' END AS truth, change_type, count(*) AS n FROM l GROUP BY 1,2", "points", _SCENE))
def confusion(spark, sf_dir):
    at = lambda a, b: F.col("col_id").between(a, b) & (F.col("row_id") >= 6)
    truth = F.when(at(130, 137), "appeared").when(at(10, 17), "disappeared").otherwise("static")
    return change.confusion(changes(spark, sf_dir).withColumn("t", truth), "t")


@query("c4_difference", oracle("SELECT frame_id, row_id, col_id, change_type, round(cur_rng,5) AS cur_rng, round(ref_rng,5) AS ref_rng FROM l", "points", _SCENE))
def difference(spark, sf_dir):
    return changes(spark, sf_dir).select("frame_id", "row_id", "col_id", "change_type", *r5("cur_rng", "ref_rng"))


@query("j9_pixel_join", oracle("SELECT frame_id, count(*) AS n, count(cur_rng) AS n_cur, count(ref_rng) AS n_ref FROM j GROUP BY 1", "points", _SCENE))
def pixel_join(spark, sf_dir):
    return changes(spark, sf_dir).groupBy("frame_id").agg(F.count("*").alias("n"), F.count("cur_rng").alias("n_cur"), F.count("ref_rng").alias("n_ref"))


@query("c2_view", oracle("SELECT frame_id, row_id, col_id, round(cur_rng,5) AS rng FROM ci", "points", _SCENE))
def view(spark, sf_dir):
    return change.view(scene(spark, sf_dir)[0], ROOM).select("frame_id", "row_id", "col_id", *r5("rng"))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).where("ref_id IS NOT NULL").select(F.col("ref_id").alias("pt_id"), "frame_id", F.col("ref_prob").alias("prob"))


def _status(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    cur, ref = scene(spark, sf_dir)
    seen = staged(change.view(ref, ROOM, keys=()), "view")  # one image, read twice
    frames = project(cur, ROOM).select("frame_id").distinct()
    return change.fuse_status(change.resting_observations(cur, seen, ROOM), mode, seen.select("pt_id"), frames).select("pt_id", *r5("change_prob"))


@query("c5_fused_status", oracle("SELECT ref_id AS pt_id, round(1/(1+exp(-sum(ln(ref_prob/(1-ref_prob))))),5) AS change_prob FROM lo GROUP BY 1", "points", _SCENE))
def fused_status(spark, sf_dir):
    return _status(spark, sf_dir, "logodds")


@query("c5_reference_status")
def reference_status(spark, sf_dir):
    return _status(spark, sf_dir, "reference")


@query("c1_covisible", oracle("SELECT k.frame_id, r.pt_id, round((x-tx)*cos(0.02*k.frame_id)+(y-ty)*sin(0.02*k.frame_id),5) AS x, round(-(x-tx)*sin(0.02*k.frame_id)+(y-ty)*cos(0.02*k.frame_id),5) AS y FROM ref r JOIN ps k ON r.x BETWEEN tx-6 AND tx+6", "points", "poses", _SCENE))
def covisible(spark, sf_dir):
    return change.covisible(scene(spark, sf_dir)[1], poses(spark, sf_dir), 6.0, 100).select("frame_id", "pt_id", *r5_off_ties("x", "y"))


# a moving sensor: sessions lie 100 m apart, each keyframe (odd frame) stands at its own pose, and the reference lies in files by tile
_MOVING = """mk AS (SELECT DISTINCT frame_id, 0.2*(frame_id%10) AS tx, 0.05*(frame_id%10) AS ty, 0.02*(frame_id%10) AS a, CAST(floor(frame_id/10.0) AS INT) AS s FROM p WHERE frame_id%2=1),
mr AS (SELECT CAST(floor(frame_id/10.0) AS INT) AS s, pt_id, x*m AS x, y*m AS y, z*m AS z FROM (SELECT *, CASE WHEN az BETWEEN 100 AND 107 AND ring>=6 THEN 0.7 ELSE 1.0 END AS m FROM p WHERE frame_id%2=0) q),
mb AS (SELECT 'cur' AS side, frame_id, pt_id, (x-tx)*cos(a)+(y-ty)*sin(a) AS x, (y-ty)*cos(a)-(x-tx)*sin(a) AS y, z FROM p JOIN mk USING (frame_id)
 UNION ALL SELECT 'ref', mk.frame_id, pt_id, (x-tx)*cos(a)+(y-ty)*sin(a), (y-ty)*cos(a)-(x-tx)*sin(a), z FROM mr JOIN mk USING (s) WHERE x BETWEEN tx-8 AND tx+8),
mp AS (SELECT *, CAST(floor((degrees(atan2(z, sqrt(x*x+y*y)))+15.1)/2.0) AS INT) AS row_id, CAST(-round((degrees(atan2(x,y))-90.0)/2.0)+90 AS INT) AS c0, sqrt(x*x+y*y+z*z) AS rng FROM mb),
mi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side, frame_id, row_id, col_id ORDER BY rng, pt_id) AS nr FROM (SELECT *, CASE WHEN c0>=180 THEN c0-180 ELSE c0 END AS col_id FROM mp WHERE degrees(atan2(z, sqrt(x*x+y*y)))+15.1 >= 0 AND row_id BETWEEN 0 AND 15) v) w WHERE nr=1),
l AS (SELECT *, CASE WHEN cur_rng>100 OR ref_rng>100 THEN 'skip' WHEN cur_rng IS NULL THEN 'unseen' WHEN ref_rng IS NULL THEN 'new' WHEN ref_rng-cur_rng > 0.06*ref_rng THEN 'appeared' WHEN ref_rng-cur_rng < -0.06*ref_rng THEN 'disappeared' ELSE 'static' END AS change_type FROM (
 SELECT coalesce(c.frame_id,r.frame_id) AS frame_id, coalesce(c.row_id,r.row_id) AS row_id, coalesce(c.col_id,r.col_id) AS col_id, c.rng AS cur_rng, r.rng AS ref_rng, r.pt_id AS ref_id
 FROM (SELECT * FROM mi WHERE side='cur') c FULL OUTER JOIN (SELECT * FROM mi WHERE side='ref') r ON c.frame_id=r.frame_id AND c.row_id=r.row_id AND c.col_id=r.col_id) j),
lo AS (SELECT *, CASE change_type WHEN 'disappeared' THEN 0.6 WHEN 'static' THEN 0.4 ELSE 0.5 END AS ref_prob FROM l WHERE ref_id IS NOT NULL)"""
_TILED: dict[tuple[str, str], str] = {}


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("frame_id") % 10
    at = {"tx": 100.0 * F.floor(F.col("frame_id") / 10.0) + 0.2 * k, "ty": 0.05 * k, "tz": F.lit(0.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(0.01 * k), "qw": F.cos(0.01 * k)}
    return poses(spark, sf_dir).where("frame_id % 2 = 1").select("frame_id", *(v.alias(n) for n, v in at.items()))


def tiled_reference(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the sessions' reference, written by tile once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TILED:
        _TILED[key] = f"{shared_dir(spark)}/reference-{uuid.uuid4().hex}"
        m = F.when(F.col("az").between(100, 107) & (F.col("ring") >= 6), 0.7).otherwise(1.0)
        ref = points(spark, sf_dir).where("frame_id % 2 = 0").select("pt_id", (F.col("x") * m + 100.0 * F.floor(F.col("frame_id") / 10.0)).alias("x"), (F.col("y") * m).alias("y"), (F.col("z") * m).alias("z"))
        change.write_reference(ref, _TILED[key])
    return _TILED[key]


def moving_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keyframes(spark, sf_dir)
    near = change.covisible_tiles(spark, tiled_reference(spark, sf_dir), k, 8.0, 100)
    world = points(spark, sf_dir).where("frame_id % 2 = 1").select("frame_id", "pt_id", (F.col("x") + 100.0 * F.floor(F.col("frame_id") / 10.0)).alias("x"), "y", "z")
    return change.keyframe_changes(trajectory.transform_points(world, k, inverse=True), near, ROOM)


def _moving_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moving_changes(spark, sf_dir).where("ref_id IS NOT NULL").select(F.col("ref_id").alias("pt_id"), "frame_id", F.col("ref_prob").alias("prob"))


@query("c1_tile_covisible", oracle("SELECT frame_id, pt_id, round(x,5) AS x, round(y,5) AS y FROM mb WHERE side='ref'", "points", _MOVING))
def tile_covisible(spark, sf_dir):
    near = change.covisible_tiles(spark, tiled_reference(spark, sf_dir), keyframes(spark, sf_dir), 8.0, 100)
    return near.select("frame_id", "pt_id", *r5("x", "y"))


@query("c4_keyframe_difference", oracle("SELECT frame_id, row_id, col_id, change_type, round(cur_rng,5) AS cur_rng, round(ref_rng,5) AS ref_rng FROM l", "points", _MOVING))
def keyframe_difference(spark, sf_dir):
    return moving_changes(spark, sf_dir).select("frame_id", "row_id", "col_id", "change_type", *r5("cur_rng", "ref_rng"))


@query("c5_keyframe_status", oracle("SELECT ref_id AS pt_id, round(1/(1+exp(-sum(ln(ref_prob/(1-ref_prob))))),5) AS change_prob FROM lo GROUP BY 1", "points", _MOVING))
def keyframe_status(spark, sf_dir):
    return change.fuse_status(_moving_observed(spark, sf_dir)).select("pt_id", *r5("change_prob"))


@query("c7_keyframe_summary", oracle("SELECT frame_id, change_type, count(*) AS n, min(col_id) AS c_lo, max(col_id) AS c_hi FROM l GROUP BY 1,2", "points", _MOVING))
def keyframe_summary(spark, sf_dir):
    return change.summary(moving_changes(spark, sf_dir))


@query("c6_fused_map", oracle("""SELECT vx, vy, vz, owner, count(*) AS seen, round(1/(1+exp(-sum(l))),5) AS change_prob FROM (SELECT m.*, min(frame_id) OVER (PARTITION BY vx,vy,vz) AS owner FROM (
 SELECT frame_id, CAST(floor(x) AS BIGINT) AS vx, CAST(floor(y) AS BIGINT) AS vy, CAST(floor(z) AS BIGINT) AS vz, sum(ln((0.4+0.01*(pt_id%20))/(1-(0.4+0.01*(pt_id%20))))) AS l FROM p GROUP BY 1,2,3,4) m) q
 WHERE owner IN (SELECT frame_id FROM (SELECT frame_id, avg(CASE WHEN frame_id=owner THEN 1.0 ELSE 0.0 END) AS sh FROM (SELECT frame_id, min(frame_id) OVER (PARTITION BY floor(x),floor(y),floor(z)) AS owner, row_number() OVER (PARTITION BY frame_id,floor(x),floor(y),floor(z) ORDER BY pt_id) AS one FROM p) z WHERE one=1 GROUP BY 1) s WHERE sh<0.5 OR frame_id=0) GROUP BY 1,2,3,4""", "points"))
def fused_map(spark, sf_dir):
    k = points(spark, sf_dir).withColumn("prob", 0.4 + 0.01 * (F.col("pt_id") % 20))
    out = change.fuse_map(k.select("frame_id", "pt_id", "x", "y", "z", "prob"), 1.0)
    return grid.cells(out, 1.0).select(*grid.CELL, "owner", "seen", *r5("change_prob"))


def _frame_twos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by windows of two frames; five windows are a session."""
    return points(spark, sf_dir).select(F.floor(F.col("frame_id") / 2.0).cast("int").alias("map_key"), "pt_id", "x", "y", "z")


@query("c9_surfels")
def surfels(spark, sf_dir):
    p = _frame_twos(spark, sf_dir)
    return change.surfels(p, 0.5, 1.0, hits=p.where("pt_id % 2 = 0"), key="map_key").select("pt_id", *r5("cx", "cy", "cz", "confidence"))


@query("j13_match_surfels")
def match_surfels(spark, sf_dir):
    """Every window's points against the surfels of the window before in their session; a session's first window has none."""
    p = _frame_twos(spark, sf_dir)
    later = p.where("map_key % 5 <> 0").withColumn("map_key", F.col("map_key") - 1)
    return change.match_surfels(later, change.surfels(p, 0.5, 1.0, key="map_key"), 0.6, "map_key").select("q_id", "t_id", *r5("d2"))


# registration: frames against the frame before in their session, from a pose that is off
def _off_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = poses(spark, sf_dir).where("frame_id % 10 <> 0").select("frame_id")
    return f.select("frame_id", *_off())


def _off() -> list[Column]:
    """A pose that is a little off its place."""
    at = {"tx": 0.08, "ty": -0.05, "qz": math.sin(0.005), "qw": math.cos(0.005)}
    return [F.lit(at.get(n, 0.0)).alias(n) for n in POSE]


@query("r1_register")
def register_frames(spark, sf_dir):
    q, t = frames_pair(spark, sf_dir)
    out = register.register(q, t, _off_poses(spark, sf_dir), rounds=4)
    return out.select("frame_id", *((F.round(n, 2) + 0.0).alias(n) for n in ("tx", "ty", "qz")), "n")


@query("r1_register_edges")
def register_edges(spark, sf_dir):
    """As r1_register, with the sharpest pixels of each sector as edge points beside the rest."""
    q, t = frames_pair(spark, sf_dir)
    sharp = scanline.ranked_features(scanline.curvature(image(spark, sf_dir)).where("curvature IS NOT NULL"), COLS).where("sharp_rank <= 4").select("pt_id")
    out = register.register(q, t, _off_poses(spark, sf_dir), rounds=4, edges=q.join(sharp, "pt_id", "left_semi"), edge_map=t.join(sharp, "pt_id", "left_semi"), edge_rounds=2)
    return out.select("frame_id", *((F.round(n, 2) + 0.0).alias(n) for n in ("tx", "ty", "qz")), "n")


def moving_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points as a moving sensor saw them (frame_id the window, map_key the session, ratio the time in it), the windows' control poses, and each session's map.

    Five frames are a window. A point's own time is its frame's and a share of the time to the next; the true pose then is on the line of the given poses.
    The sensor knows only the five poses of the window, from which the control poses come.
    """
    p = poses(spark, sf_dir)
    five = F.floor(F.col("frame_id") / 5.0).cast("int")
    no = (F.col("frame_id") % 5).cast("int")
    whole = p.groupBy(five.alias("window_id")).agg(F.count("*").alias("n")).where("n = 5").select("window_id")
    data = p.select("session_id", five.alias("window_id"), no.alias("no"), (no / 4.0).alias("u"), *POSE).join(whole, "window_id")
    knots = trajectory.control_poses(data.withColumn("window_id", F.col("window_id").cast("long")))
    control = knots.groupBy("window_id").agg(*(F.max(F.when(F.col("no") == k, F.struct(*POSE))).alias(f"c{k}") for k in range(5)))
    on = points(spark, sf_dir).withColumn("window_id", five).join(whole, "window_id").withColumn("ratio", F.least(no / 4.0 + F.col("pt_id") % 100 / 400.0, F.lit(1.0)))
    f = 5.0 * F.col("window_id") + 4.0 * F.col("ratio")
    q = (F.lit(0.0), F.lit(0.0), F.sin(0.01 * f), F.cos(0.01 * f))
    seen = G.rotate(G.conj(q), (F.col("x") - 0.2 * f, F.col("y") - 0.05 * f, F.col("z")))
    session = F.floor(F.col("frame_id") / 10.0).cast("int")
    sensor = on.select(F.col("window_id").alias("frame_id"), "window_id", session.alias("map_key"), "pt_id", *(v.alias(a) for v, a in zip(seen, "xyz")), "ratio")
    room = grid.voxel_centroids(points(spark, sf_dir).withColumn("map_key", session), 0.4, keys=("map_key",))
    number = sum((F.col(v) + 4096) * F.lit(8192**k).cast("long") for k, v in enumerate(grid.CELL))
    return sensor, control, room.select("map_key", number.alias("pt_id"), "x", "y", "z")


@query("r2_register_deskewed")
def register_deskewed(spark, sf_dir):
    """Windows of a moving sensor, de-skewed by their splines and registered to their session's map."""
    sensor, windows, room = moving_windows(spark, sf_dir)
    off = windows.select(F.col("window_id").cast("int").alias("frame_id"), *_off())
    out = register.register_deskewed(sensor, windows, room, off, rounds=3)
    return out.select("frame_id", *((F.round(n, 2) + 0.0).alias(n) for n in ("tx", "ty", "qz")), "n")


@query("r2_register_windows")
def register_windows(spark, sf_dir):
    """Windows of a moving sensor whose five control poses are each off by an error of their own."""
    sensor, windows, room = moving_windows(spark, sf_dir)
    wrong = {k: (0.04 * (-1) ** k, 0.03 * (k - 2), 0.004 * (2 - k)) for k in range(5)}
    off = lambda k: F.struct(*((F.col(f"c{k}")[n] + dict(zip(("tx", "ty", "qz"), wrong[k])).get(n, 0.0)).alias(n) for n in POSE))
    out = register.register_windows(sensor, windows.select(F.col("window_id").cast("int").alias("window_id"), *(off(k).alias(f"c{k}") for k in range(5))), room, rounds=3)
    return out.select("window_id", *((F.round(F.col(f"c{k}")[n], 2) + 0.0).alias(f"{n}{k}") for k in range(5) for n in ("tx", "ty")), "n")


@query("r3_register_clouds")
def register_clouds(spark, sf_dir):
    q, t = frames_pair(spark, sf_dir)
    return register.register_clouds(q, t, _off_poses(spark, sf_dir)).select("frame_id", *((F.round(n, 2) + 0.0).alias(n) for n in ("tx", "ty", "qz")))


@query("r4_quality", oracle("""SELECT o.frame_id, o.n, o.n_new, round(o.n_new*1.0/o.n,5) AS share_new, round(f.fitness,5) AS fitness, round(e.mean_cost,4)+0.0 AS mean_cost, o.n_new*1.0/o.n > 0.5 OR coalesce(f.fitness, 1e9) > 0.15 AS bad
 FROM (SELECT frame_id, count(*) AS n, count(*) FILTER (WHERE pt_id NOT IN (SELECT q_id FROM pr WHERE d2<0.04)) AS n_new FROM q GROUP BY 1) o
 LEFT JOIN (SELECT frame_id, avg(d2) AS fitness FROM nn WHERE nr=1 GROUP BY 1) f ON f.frame_id=o.frame_id
 LEFT JOIN (SELECT frame_id, sum(r*r/(1+r*r/0.01))/count(*) AS mean_cost FROM (SELECT q.frame_id, q.x*g.nx+q.y*g.ny+q.z*g.nz+g.d AS r FROM q JOIN (SELECT q_id, nx, ny, nz, d FROM pl JOIN nk USING (q_id) GROUP BY ALL HAVING max(abs(nx*tx+ny*ty+nz*tz+d)) <= 0.02) g ON g.q_id=q.pt_id) v GROUP BY 1) e ON e.frame_id=o.frame_id""", "points", _PAIRS, _PLANE.replace("1e-6", "1e-3")))
def quality(spark, sf_dir):
    out = register.quality_of(*frames_pair(spark, sf_dir))
    return out.select("frame_id", "n", "n_new", *r5("share_new", "fitness"), (F.round("mean_cost", 4) + 0.0).alias("mean_cost"), "bad")


# pose graphs
_ODOM = "od AS (SELECT *, lag(frame_id) OVER w AS id1, tx-lag(tx) OVER w AS dx, ty-lag(ty) OVER w AS dy FROM ps WINDOW w AS (PARTITION BY session_id ORDER BY frame_id))"


@query("g5_odometry_edges", oracle("SELECT session_id, id1, frame_id AS id2, round(dx*cos(0.02*id1)+dy*sin(0.02*id1),5) AS tx, round(sin(0.01*(frame_id-id1)),5) AS qz, round((frame_id-id1)*CASE WHEN frame_id%7=0 THEN 50.0 ELSE 0.01 END,5) AS var FROM od WHERE id1 IS NOT NULL", "poses", _ODOM))
def odometry_edges(spark, sf_dir):
    p = poses(spark, sf_dir).withColumn("bad", F.col("frame_id") % 7 == 0)
    return posegraph.odometry_edges(p).select("session_id", "id1", "id2", *r5("tx", "qz", "var"))


@query("g5_window_edges", oracle("SELECT session_id, CAST(frame_id-2 AS INT) AS id1, frame_id AS id2, round(0.01*2,5) AS var FROM ps WHERE frame_id-2 >= session_id*10", "poses"))
def window_edges(spark, sf_dir):
    return posegraph.window_edges(poses(spark, sf_dir)).select("session_id", "id1", "id2", *r5("var"))


@query("g6_unary_edges", oracle("SELECT session_id, frame_id AS id2, CASE WHEN frame_id%10=0 THEN 'prior' ELSE 'gps' END AS kind, round(CASE WHEN frame_id%10=0 THEN 1e-4 ELSE 1.0 END,5) AS var FROM ps WHERE frame_id%10=0 OR frame_id%4=1", "poses"))
def unary_edges(spark, sf_dir):
    p = poses(spark, sf_dir)
    both = posegraph.unary_edges(p.where("frame_id % 10 = 0"), "prior", 1e-4).unionByName(posegraph.unary_edges(p.where("frame_id % 4 = 1 AND frame_id % 10 <> 0"), "gps", 1.0))
    return both.select("session_id", "id2", "kind", *r5("var"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Drifted poses, and edges measured on the true ones."""
    p = poses(spark, sf_dir)
    edges = posegraph.odometry_edges(p).unionByName(posegraph.window_edges(p)).unionByName(posegraph.unary_edges(p.where("frame_id % 10 = 0"), "prior", 1e-6))
    return p.withColumns({"tx": F.col("tx") + 0.03 * (F.col("frame_id") % 10), "ty": F.col("ty") - 0.02 * (F.col("frame_id") % 10)}), edges


@query("g8_residuals", oracle("SELECT session_id, CAST(frame_id-1 AS INT) AS id1, frame_id AS id2, round(sqrt(0.03*0.03+0.02*0.02),5) AS t_err FROM ps WHERE frame_id%10<>0", "poses"))
def residuals(spark, sf_dir):
    p, e = _graph(spark, sf_dir)
    return posegraph.residuals(e.where("kind = 'odom'"), p).select("session_id", "id1", "id2", *r5("t_err"))


@query("g7_adjust", oracle("SELECT session_id, frame_id, round(tx,4)+0.0 AS tx, round(ty,4)+0.0 AS ty FROM ps", "poses"))
def adjust(spark, sf_dir):
    return posegraph.adjust(*_graph(spark, sf_dir)).select("session_id", "frame_id", (F.round("tx", 4) + 0.0).alias("tx"), (F.round("ty", 4) + 0.0).alias("ty"))


@query("g7_adjust_long", oracle("SELECT frame_id, round(tx,4)+0.0 AS tx, round(ty,4)+0.0 AS ty FROM ps", "poses"))
def adjust_long(spark, sf_dir):
    """All frames as one session, eliminated by stretches."""
    p = poses(spark, sf_dir).withColumn("session_id", F.lit(0))
    edges = posegraph.odometry_edges(p).unionByName(posegraph.window_edges(p)).unionByName(posegraph.unary_edges(p.where("frame_id % 10 = 0"), "prior", 1e-6))
    drifted = p.withColumns({"tx": F.col("tx") + 0.03 * (F.col("frame_id") % 10), "ty": F.col("ty") - 0.02 * (F.col("frame_id") % 10)})
    out = sparse.adjust_long(drifted, edges, size=16)
    return out.select("frame_id", (F.round("tx", 4) + 0.0).alias("tx"), (F.round("ty", 4) + 0.0).alias("ty"))


@query("g9_reassemble", oracle("SELECT p.pt_id, round(x*cos(0.02*frame_id)-y*sin(0.02*frame_id)+tx,5) AS x FROM p JOIN ps USING (frame_id)", "points", "poses"))
def reassemble(spark, sf_dir):
    return posegraph.reassemble(points(spark, sf_dir), poses(spark, sf_dir)).select("pt_id", *r5("x"))


# streams: the given tables, written to the shared folder in parts and read back as a stream
def _streamed(df: DataFrame, label: str, parts: int = 2, key: str | None = None, files: int = 1) -> tuple[DataFrame, str]:
    """df as a stream of about `parts` batches of `files` files; rows of one key stay in one file."""
    on = staged(df.repartition(parts * files, *([key] if key else [])), label)
    path = on.inputFiles()[0].rsplit("/", 1)[0]
    return jobs.source(df.sparkSession, path, df.schema.simpleString()[7:-1].replace(":", " "), files), f"{shared_dir(df.sparkSession)}/{label}-out-{path.rsplit('-', 1)[-1]}"


def _collected(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all there is and reads what it wrote."""
    spark = stream.sparkSession
    schema = stream.schema
    jobs.run(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/data/batch={n}"), f"{out}/check", mode).awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/data")


@query("x1_frame_stream", oracle("SELECT frame_id, row_id, col_id, round(rng,5) AS rng, pt_id FROM img", "points", "pixels"))
def frame_stream(spark, sf_dir):
    frames = points(spark, sf_dir).select("frame_id", "pt_id", "x", "y", "z", "intensity")
    src, out = _streamed(frames, "frames", 4, "frame_id", 8)  # a frame never splits
    jobs.run(src, jobs.frames_sink(ROOM, out + "/products"), out + "/check").awaitTermination()
    return spark.read.parquet(out + "/products/image").select("frame_id", "row_id", "col_id", *r5("rng"), "pt_id")


@query("s6_stream_topic", oracle("SELECT event_id, user_id, round(value,5) AS value FROM events"))
def stream_topic(spark, sf_dir):
    """The events through a stream source and sink, several batches."""
    src, out = _streamed(read(spark, sf_dir, "events").select("event_id", "user_id", "value"), "topic", 4)
    return _collected(src, out).select("event_id", "user_id", *r5("value"))


@query("x3_late_rows", oracle("SELECT s, count(*) AS n, count(*) FILTER (WHERE late) AS n_late FROM (SELECT user_id%5 AS s, t < max(t) OVER (PARTITION BY user_id%5 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 50 AS late FROM (SELECT user_id, event_id, event_id*100+((event_id*37)%13-6)*30 AS t FROM events) q) w GROUP BY 1"))
def late_rows(spark, sf_dir):
    """Of each stream its rows and those that come over 50 ms after a later one."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("s"), "event_id", (F.col("event_id") * 100 + (F.col("event_id") * 37 % 13 - 6) * 30).alias("ts"))
    return asof.late_counts(e, 50)


@query("x4_hopping", oracle("SELECT s, w AS start_ms, count(*) AS n FROM (SELECT user_id%5 AS s, unnest([event_id*100 - event_id*100%200, event_id*100 - event_id*100%200 - 200, event_id*100 - event_id*100%200 - 400]) AS w, event_id*100 AS t FROM events) q WHERE t >= w AND t < w+500 GROUP BY 1,2"))
def hopping(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("s"), F.timestamp_millis(F.col("event_id") * 100).alias("ts"), "value")
    return jobs.hopping(e).select("s", F.unix_millis("start").alias("start_ms"), "n")


@query("x7_keyframe_stream", oracle("SELECT ref_id AS pt_id, round(1/(1+exp(-sum(ln(ref_prob/(1-ref_prob))))),5) AS change_prob FROM lo GROUP BY 1", "points", _MOVING))
def keyframe_stream(spark, sf_dir):
    """The moving sensor's observations as a stream of several batches."""
    src, out = _streamed(_moving_observed(spark, sf_dir), "keyframes", 3)
    jobs.run(src, jobs.status_sink(out + "/sums"), out + "/check").awaitTermination()
    return jobs.status(spark, out + "/sums").select("pt_id", *r5("change_prob"))


@query("x7_status_stream", oracle("SELECT ref_id AS pt_id, round(1/(1+exp(-sum(ln(ref_prob/(1-ref_prob))))),5) AS change_prob FROM lo GROUP BY 1", "points", _SCENE))
def status_stream(spark, sf_dir):
    src, out = _streamed(_observed(spark, sf_dir), "status", 3)
    jobs.run(src, jobs.status_sink(out + "/sums"), out + "/check").awaitTermination()
    return jobs.status(spark, out + "/sums").select("pt_id", *r5("change_prob"))


def _in_order(df: DataFrame, label: str, first: str, files: int = 4) -> tuple[DataFrame, str]:
    """df as a stream of two batches: the rows that `first` holds for, then the others."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    for cut in (first, f"NOT ({first})"):
        df.where(cut).repartition(files).write.mode("append").parquet(path)
    return jobs.source(df.sparkSession, path, df.schema.simpleString()[7:-1].replace(":", " "), files), path + "-out"


def _in_batches(df: DataFrame, label: str, number: Column, batches: int, files: int = 2) -> tuple[DataFrame, str]:
    """df as a stream of `batches` batches: the rows of number 0, then of 1, and so on."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    for k in range(batches):
        df.where(number == k).repartition(files).write.mode("append").parquet(path)
    return jobs.source(df.sparkSession, path, df.schema.simpleString()[7:-1].replace(":", " "), files), path + "-out"


def _state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("x3_late_stream", oracle("SELECT s, count(*) AS n, count(*) FILTER (WHERE late) AS n_late FROM (SELECT user_id%5 AS s, t < max(t) OVER (PARTITION BY user_id%5 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 50 AS late FROM (SELECT user_id, event_id, event_id*100+((event_id*37)%13-6)*30 AS t FROM events) q) w GROUP BY 1"))
def late_stream(spark, sf_dir):
    """The events of each stream in four batches; what comes late is written aside and counted."""
    _state_store(spark)
    e = read(spark, sf_dir, "events")
    last = e.agg(F.max("event_id").alias("last"))
    e = e.crossJoin(F.broadcast(last)).select((F.col("user_id") % 5).cast("long").alias("s"), F.col("event_id").cast("long").alias("event_id"), (F.col("event_id") * 100 + (F.col("event_id") * 37 % 13 - 6) * 30).cast("long").alias("ts"), F.floor(4 * F.col("event_id") / (F.col("last") + 1)).cast("int").alias("batch"))
    src, out = _in_batches(e, "late", F.col("batch"), 4)
    jobs.run(jobs.mark_late(src.drop("batch"), 50), jobs.aside_sink(out + "/data"), out + "/check").awaitTermination()
    return spark.read.parquet(out + "/data").groupBy("s").agg(F.count("*").alias("n"), F.count_if(F.col("late") == "true").alias("n_late"))


@query("x4_hopping_stream", oracle("SELECT s, w AS start_ms, count(*) AS n FROM (SELECT user_id%5 AS s, unnest([event_id*100 - event_id*100%200, event_id*100 - event_id*100%200 - 200, event_id*100 - event_id*100%200 - 400]) AS w, event_id*100 AS t FROM events) q WHERE t >= w AND t < w+500 GROUP BY 1,2"))
def hopping_stream(spark, sf_dir):
    """The hopping windows of a stream of three batches that cut windows; each batch emits the windows that it changed."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("s"), F.timestamp_millis(F.col("event_id") * 100).alias("ts"), "value", (F.col("event_id") % 3).alias("batch"))
    src, out = _in_batches(e, "hops", F.col("batch"), 3)
    rows = jobs.hopping(src.drop("batch"), late="10 days")
    jobs.run(rows, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/data/batch={n}"), out + "/check", "update").awaitTermination()
    newest = spark.read.parquet(out + "/data").groupBy("s", "start").agg(F.max_by("n", "batch").alias("n"))
    return newest.select("s", F.unix_millis("start").alias("start_ms"), "n")


@query("x8_compacted", oracle("SELECT ref_id AS pt_id, round(1/(1+exp(-sum(ln(ref_prob/(1-ref_prob))))),5) AS change_prob FROM lo GROUP BY 1", "points", _SCENE))
def compacted(spark, sf_dir):
    """The fused status from a stream of five batches whose sums are merged two by two."""
    src, out = _in_batches(_observed(spark, sf_dir), "compacted", F.pmod(F.col("frame_id"), F.lit(5)), 5)
    jobs.run(src, jobs.compacting_sink(out + "/sums", 2), out + "/check").awaitTermination()
    return jobs.compacted_status(spark, out + "/sums").select("pt_id", *r5("change_prob"))


@query("x5_tile_map", oracle("""SELECT session_id, vx, vy, vz, n, round(x,5) AS x, round(y,5) AS y, round(z,5) AS z FROM (
 SELECT session_id, vx, vy, vz, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z, max(epoch) AS epoch, max(f) AS f FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY session_id, epoch, vx, vy, vz ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM (
 SELECT *, CASE WHEN f - lag(f) OVER (PARTITION BY session_id, epoch, vx, vy, vz ORDER BY f) > 2 THEN 1 ELSE 0 END AS fresh FROM vo) a) b GROUP BY session_id, epoch, vx, vy, vz, part) c
 JOIN (SELECT session_id, max(epoch) AS le, max(f) AS lf FROM vo GROUP BY 1) l USING (session_id) WHERE epoch = le AND f >= lf - 2""", "points", """vo AS (SELECT CAST(floor(frame_id/10.0) AS INT) AS session_id, frame_id AS f, CASE WHEN frame_id%10>=6 THEN 1 ELSE 0 END AS epoch,
 CAST(floor(x) AS BIGINT) AS vx, CAST(floor(y) AS BIGINT) AS vy, CAST(floor(z) AS BIGINT) AS vz, x, y, z FROM p)"""))
def tile_map(spark, sf_dir):
    """Each session's map of the last two frames' time, from a stream in two batches; the sixth frame begins a new map."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    f = F.col("frame_id")
    on = points(spark, sf_dir).select(F.floor(f / 10.0).cast("int").alias("session_id"), f.cast("double").alias("ts"), "x", "y", "z", (f % 10 >= 6).cast("long").alias("epoch"), (f % 10).alias("no"))
    src, out = _in_order(on, "tiles", "no < 5")
    return jobs.current_map(_collected(jobs.tile_map(src, 1.0, 2.0), out, "update"), 2.0).select("session_id", "vx", "vy", "vz", "n", *r5("x", "y", "z"))


@query("x8_snapshots", oracle("SELECT snapshot, pt_id, round(1/(1+exp(-sum(s) OVER (PARTITION BY pt_id ORDER BY snapshot))),5) AS change_prob FROM (SELECT CAST(CASE WHEN frame_id%10<5 THEN 0 ELSE 1 END AS BIGINT) AS snapshot, ref_id AS pt_id, sum(ln(ref_prob/(1-ref_prob))) AS s FROM lo GROUP BY 1,2) q", "points", _SCENE))
def status_snapshots(spark, sf_dir):
    src, out = _in_order(_observed(spark, sf_dir), "snapshots", "frame_id % 10 < 5")
    jobs.run(src, jobs.status_sink(out + "/sums"), out + "/check").awaitTermination()
    return jobs.snapshots(spark, out + "/sums").select("snapshot", "pt_id", *r5("change_prob"))


@query("x2_sync_stream", oracle("SELECT c.s AS l_s, c.event_id AS l_id, o.odom_id AS r_id FROM (SELECT user_id%5 AS s, event_id, event_id*100 AS t FROM events) c JOIN (SELECT user_id%5 AS s, event_id AS odom_id, event_id*100+((event_id*37)%13-6)*10 AS t FROM events WHERE event_id%17<>0) o ON c.s=o.s AND o.t BETWEEN c.t-50 AND c.t+50"))
def sync_stream(spark, sf_dir):
    return _collected(jobs.sync(*_two_sides(spark, sf_dir, 1)[:2]), f"{shared_dir(spark)}/synced-{uuid.uuid4().hex}").select("l_s", "l_id", "r_id")


@query("x2_stale_drop", oracle("SELECT c.s AS l_s, c.event_id AS l_id, o.odom_id AS r_id FROM (SELECT user_id%5 AS s, event_id, event_id*100 AS t FROM events WHERE NOT (event_id%97=0 AND event_id < (SELECT max(event_id) FROM events)/2)) c JOIN (SELECT user_id%5 AS s, event_id AS odom_id, event_id*100+((event_id*37)%13-6)*10 AS t FROM events WHERE event_id%17<>0) o ON c.s=o.s AND o.t BETWEEN c.t-50 AND c.t+50"))
def stale_drop(spark, sf_dir):
    """Both sides in four batches by time; some left rows of the first half come in the last batch, long after the watermark, and drop."""
    return _collected(jobs.sync(*_two_sides(spark, sf_dir, 4)), f"{shared_dir(spark)}/synced-{uuid.uuid4().hex}").select("l_s", "l_id", "r_id")


def _two_sides(spark: SparkSession, sf_dir: str, batches: int) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events")
    ms = lambda c: F.timestamp_millis(c.cast("long"))
    left = e.select((F.col("user_id") % 5).alias("s"), ms(F.col("event_id") * 100).alias("ts"), F.col("event_id").alias("id"))
    right = e.where("event_id % 17 <> 0").select((F.col("user_id") % 5).alias("s"), ms(F.col("event_id") * 100 + (F.col("event_id") * 37 % 13 - 6) * 10).alias("ts"), F.col("event_id").alias("id"))
    if batches == 1:
        return _streamed(left, "left", 1)[0], _streamed(right, "right", 1)[0]
    n = F.lit(e.agg(F.max("event_id")).first()[0] or 0)
    batch = F.floor(batches * F.col("id") / (n + 1)).cast("int")
    stale = (F.col("id") % 97 == 0) & (F.col("id") < n / 2)
    sides = (left.withColumn("batch", F.when(stale, batches - 1).otherwise(batch)), right.withColumn("batch", batch))
    return tuple(_in_batches(side, name, F.col("batch"), batches)[0].drop("batch") for side, name in zip(sides, ("left", "right")))


@query("s4_trajectory_text", oracle("SELECT session_id, frame_id, round(tx,5) AS tx, round(qw,5) AS qw FROM ps", "poses"))
def trajectory_text(spark, sf_dir):
    from scanfuse.sources import pointcloud

    out = f"{shared_dir(spark)}/trajectory-{spark.sparkContext.applicationId}"
    p = poses(spark, sf_dir)
    pointcloud.write_trajectory(p, out)
    back = pointcloud.read_trajectory(spark, out).withColumn("frame_id", F.round(F.col("ts") * 10).cast("int"))
    return back.select(F.floor(F.col("frame_id") / 10.0).cast("int").alias("session_id"), "frame_id", *r5("tx", "qw"))


