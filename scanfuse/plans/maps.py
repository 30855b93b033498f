"""Queries: joins and aggregations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfuse.functions import geom as G
from scanfuse.functions.profile import PROFILES
from scanfuse.operators import asof, grid, neighbors, posegraph, select, stats
from scanfuse.operators.project import project
from scanfuse.operators.trajectory import transform_points
from scanfuse.plans.registry import query
from scanfuse.sources.fixture import oracle, points, poses, r5, read

ROOM = PROFILES["room"]


# time joins over events: integer milliseconds
def _streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("s"), "event_id")
    left = e.select("s", F.col("event_id").alias("l_id"), (F.col("event_id") * 100).alias("ts"))
    right = e.where("event_id % 17 <> 0").select("s", F.col("event_id").alias("r_id"), (F.col("event_id") * 100 + (F.col("event_id") * 37 % 13 - 6) * 10).alias("ts"))
    return left, right


_SYNC = """c AS (SELECT user_id%5 AS s, event_id, event_id*100 AS ts_ms FROM events),
o AS (SELECT user_id%5 AS s, event_id AS odom_id, event_id*100+((event_id*37)%13-6)*10 AS ts_ms FROM events WHERE event_id%17<>0),
m AS (SELECT c.s, c.event_id, o.odom_id, abs(c.ts_ms-o.ts_ms) AS dt, row_number() OVER (PARTITION BY c.s,c.event_id ORDER BY abs(c.ts_ms-o.ts_ms), o.odom_id) AS rn FROM c JOIN o ON c.s=o.s AND o.ts_ms BETWEEN c.ts_ms-50 AND c.ts_ms+50)"""


@query("j1_nearest_in_time", oracle("SELECT s, event_id AS l_id, odom_id AS r_id, dt FROM m WHERE rn=1", _SYNC))
def nearest_in_time(spark, sf_dir):
    return asof.nearest_in_time(*_streams(spark, sf_dir), 50)


@query("j2_sync_sides", oracle("SELECT c.s, c.event_id AS l_id, m.odom_id AS line_id, e.odom_id AS edge_id FROM c JOIN (SELECT * FROM m WHERE rn=1) m ON m.s=c.s AND m.event_id=c.event_id LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s,event_id ORDER BY dt, odom_id) AS r2 FROM m WHERE odom_id%3=0) q WHERE r2=1) e ON e.s=c.s AND e.event_id=c.event_id", _SYNC))
def sync_sides(spark, sf_dir):
    left, right = _streams(spark, sf_dir)
    return asof.synced(left, {"line": (right, True), "edge": (right.where("r_id % 3 = 0"), False)}, 50)


@query("j3_attach_pose", oracle("SELECT s, event_id AS l_id, round(0.1*odom_id + value*cos(0.01*odom_id),5) AS x FROM m JOIN (SELECT event_id AS eid, value FROM events) ev ON ev.eid=m.event_id WHERE rn=1", _SYNC))
def attach_pose(spark, sf_dir):
    near = asof.nearest_in_time(*_streams(spark, sf_dir), 50)
    on = near.join(read(spark, sf_dir, "events").select(F.col("event_id").alias("l_id"), "value"), "l_id")
    r = F.col("r_id")
    moved = G.rotate((F.lit(0.0), F.lit(0.0), F.sin(0.005 * r), F.cos(0.005 * r)), (F.col("value"), F.lit(0.0), F.lit(0.0)))
    return on.select("s", "l_id", (F.round(0.1 * r + moved[0], 5) + 0.0).alias("x"))


@query("x6_segments", oracle("SELECT s, event_id, CAST(sum(CAST(event_type='error' OR event_id%50=0 AS INT)) OVER (PARTITION BY s ORDER BY event_id) AS INT) AS segment FROM (SELECT user_id%5 AS s, event_id, event_type FROM events) q"))
def restart_segments(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("s"), "event_id", F.col("event_id").alias("ts"), ((F.col("event_type") == "error") | (F.col("event_id") % 50 == 0)).alias("bad"))
    return asof.segments(e).select("s", "event_id", "segment")


@query("x6_one_stream", oracle("SELECT event_id, CAST(sum(CAST(event_type='error' OR event_id%50=0 AS INT)) OVER w AS INT) AS segment, round(max(value) OVER w,5) AS highest, max(CASE WHEN event_type='error' THEN event_id END) OVER w AS last_error FROM events WINDOW w AS (ORDER BY event_id)"))
def one_stream(spark, sf_dir):
    """All events as one long stream: segments, the highest value and the last error so far."""
    e = read(spark, sf_dir, "events").select(F.lit(0).alias("s"), "event_id", ((F.col("event_type") == "error") | (F.col("event_id") % 50 == 0)).cast("int").alias("bad"), "value", F.when(F.col("event_type") == "error", F.col("event_id")).alias("error_id"))
    out = asof.scanned(e, "s", "event_id", segment=(F.col("bad"), "sum"), highest=(F.col("value"), "max"), last_error=(F.col("error_id"), "last"))
    return out.select("event_id", F.col("segment").cast("int").alias("segment"), *r5("highest"), "last_error")


# neighbour joins: every frame looks for the points of the frame before in its session
def frames_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir).select("frame_id", "pt_id", "x", "y", "z")
    q = p.where("frame_id % 10 <> 0").withColumn("map_key", F.col("frame_id") - 1)
    return q, p.where("frame_id % 10 <> 9").withColumnRenamed("frame_id", "map_key")




_PAIRS = """q AS (SELECT frame_id, pt_id, x, y, z FROM p WHERE frame_id%10<>0), t AS (SELECT frame_id+1 AS map_for, pt_id, x, y, z FROM p WHERE frame_id%10<>9),
pr AS (SELECT q.frame_id, q.pt_id AS q_id, t.pt_id AS t_id, (q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(q.z-t.z)*(q.z-t.z) AS d2, t.x AS tx, t.y AS ty, t.z AS tz FROM q JOIN t ON t.map_for=q.frame_id AND t.x BETWEEN q.x-1 AND q.x+1 AND t.y BETWEEN q.y-1 AND q.y+1),
nn AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, t_id) AS nr FROM pr WHERE d2 < 1.0), nk AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY q_id) AS have FROM nn WHERE nr<=5) w WHERE have=5)"""


@query("j4_nearest_five", oracle("SELECT q_id, t_id, round(d2,5) AS d2, CAST(nr AS INT) AS nr FROM nk", "points", _PAIRS))
def nearest_five(spark, sf_dir):
    return neighbors.nearest(*frames_pair(spark, sf_dir), 5, 1.0, complete=True).select("q_id", "t_id", *r5("d2"), "nr")


_CROWD = """cw AS (SELECT frame_id, pt_id, 3.0+(x-3.0)*f AS x, 2.0+(y-2.0)*f AS y, z*f AS z FROM (SELECT *, CASE WHEN pt_id%3=0 THEN 0.01 ELSE 1.0 END AS f FROM p) a)"""


def crowded_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """As frames_pair, a third of the points drawn together into a spot a few centimetres wide."""
    f = F.when(F.col("pt_id") % 3 == 0, 0.01).otherwise(1.0)
    p = points(spark, sf_dir).select("frame_id", "pt_id", (3.0 + (F.col("x") - 3.0) * f).alias("x"), (2.0 + (F.col("y") - 2.0) * f).alias("y"), (F.col("z") * f).alias("z"))
    return p.where("frame_id % 10 <> 0").withColumn("map_key", F.col("frame_id") - 1), p.where("frame_id % 10 <> 9").withColumnRenamed("frame_id", "map_key")


@query("j4_uneven", oracle("SELECT q_id, t_id, round(d2,7) AS d2, CAST(nr AS INT) AS nr FROM nk", "points", _CROWD, _PAIRS.replace("FROM p ", "FROM cw ")))
def uneven(spark, sf_dir):
    out = neighbors.nearest_uneven(*crowded_pair(spark, sf_dir), 5, 1.0, complete=True)
    return out.select("q_id", "t_id", F.round("d2", 7).alias("d2"), "nr")


@query("j5_within_radius", oracle("SELECT q_id, count(*) AS n, round(min(d2),5) AS nearest FROM pr WHERE d2 < 0.25 GROUP BY 1", "points", _PAIRS))
def within_radius(spark, sf_dir):
    return neighbors.within(*frames_pair(spark, sf_dir), 0.5).groupBy("q_id").agg(F.count("*").alias("n"), F.min("d2").alias("nearest")).select("q_id", "n", *r5("nearest"))


@query("j6_new_points", oracle("SELECT pt_id FROM q WHERE pt_id NOT IN (SELECT q_id FROM pr WHERE d2 < 0.04)", "points", _PAIRS))
def new_points(spark, sf_dir):
    return neighbors.new_points(*frames_pair(spark, sf_dir), 0.2).select("pt_id")


@query("j7_refresh", oracle("SELECT t.pt_id, round(greatest(0.1*(map_for-1), coalesce(m.ts,0)),5) AS ts FROM t LEFT JOIN (SELECT t_id, max(0.1*frame_id) AS ts FROM nn WHERE nr=1 AND d2<0.25 GROUP BY 1) m ON m.t_id=t.pt_id", "points", _PAIRS))
def refresh(spark, sf_dir):
    q, t = frames_pair(spark, sf_dir)
    return neighbors.refresh(t.withColumn("ts", 0.1 * F.col("map_key")), q.withColumn("ts", 0.1 * F.col("frame_id")), 0.5).select("pt_id", *r5("ts"))


@query("j8_nearest_one", oracle("SELECT q_id, t_id, round(d2,5) AS d2 FROM nn WHERE nr=1", "points", _PAIRS))
def nearest_one(spark, sf_dir):
    return neighbors.nearest(*frames_pair(spark, sf_dir), 1, 1.0).select("q_id", "t_id", *r5("d2"))


@query("a12_overlap", oracle("SELECT frame_id, count(*) AS n, count(*) FILTER (WHERE new) AS n_new, round(count(*) FILTER (WHERE new)*1.0/count(*),5) AS share_new, count(*) FILTER (WHERE new)*1.0/count(*) > 0.5 AS bad FROM (SELECT frame_id, pt_id NOT IN (SELECT q_id FROM pr WHERE d2<0.04) AS new FROM q) w GROUP BY 1", "points", _PAIRS))
def overlap(spark, sf_dir):
    return neighbors.overlap(*frames_pair(spark, sf_dir), 0.2).select("frame_id", "n", "n_new", *r5("share_new"), "bad")


@query("a16_fitness", oracle("SELECT frame_id, round(avg(d2),5) AS fitness, count(*) AS matched FROM nn WHERE nr=1 GROUP BY 1", "points", _PAIRS))
def fitness(spark, sf_dir):
    return neighbors.fitness(*frames_pair(spark, sf_dir), 1.0).select("frame_id", *r5("fitness"), "matched")


def five_with_places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The queries, and the five neighbours of each as a set with its sums."""
    q, t = frames_pair(spark, sf_dir)
    return q, neighbors.nearest_sets(q, t, 5, 1.0, complete=True, sums=True)


def solid(near: DataFrame, least: float = 1e-3) -> DataFrame:
    """Neighbour sets of the queries whose five are not near a plane through the origin, where a plane's equation has no stable solution."""
    return near.where(F.abs(G.det3(*(F.col("s" + p) for p in ("xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz")))) > least)


_PLANE = """s AS (SELECT q_id, count(*) AS n, sum(tx) AS sx, sum(ty) AS sy, sum(tz) AS sz, sum(tx*tx) AS sxx, sum(tx*ty) AS sxy, sum(tx*tz) AS sxz, sum(ty*ty) AS syy, sum(ty*tz) AS syz, sum(tz*tz) AS szz FROM nk GROUP BY 1),
dt AS (SELECT *, sxx*(syy*szz-syz*syz)-sxy*(sxy*szz-syz*sxz)+sxz*(sxy*syz-syy*sxz) AS det FROM s),
ab AS (SELECT *, -(sx*(syy*szz-syz*syz)-sxy*(sy*szz-syz*sz)+sxz*(sy*syz-syy*sz))/det AS a, -(sxx*(sy*szz-syz*sz)-sx*(sxy*szz-syz*sxz)+sxz*(sxy*sz-sy*sxz))/det AS b, -(sxx*(syy*sz-sy*syz)-sxy*(sxy*sz-sy*sxz)+sx*(sxy*syz-syy*sxz))/det AS c FROM dt WHERE abs(det)>1e-6),
pl AS (SELECT q_id, n, a/sqrt(a*a+b*b+c*c) AS nx, b/sqrt(a*a+b*b+c*c) AS ny, c/sqrt(a*a+b*b+c*c) AS nz, 1/sqrt(a*a+b*b+c*c) AS d FROM ab)"""


@query("a9_planes", oracle("SELECT q_id, round(nx,3) AS nx, round(ny,3) AS ny, max(abs(nx*tx+ny*ty+nz*tz+d)) <= 0.2 AS valid FROM pl JOIN nk USING (q_id) GROUP BY q_id, nx, ny, nz, d", "points", _PAIRS, _PLANE).replace("round(nx,3)", "round(nx,3)+0.0").replace("round(ny,3)", "round(ny,3)+0.0"))
def planes(spark, sf_dir):
    _, near = five_with_places(spark, sf_dir)
    return stats.neighbour_planes(solid(near, 1e-6)).select("q_id", (F.round("nx", 3) + 0.0).alias("nx"), (F.round("ny", 3) + 0.0).alias("ny"), "valid")


@query("a10_lines")
def lines(spark, sf_dir):
    return stats.neighbour_lines(five_with_places(spark, sf_dir)[1]).select("q_id", "is_line", *r5("cx", "cy", "cz", "ax", "ay", "az"))


@query("a15_normal_equations", oracle("""SELECT frame_id, round(sum(w*nx*nx),3)+0.0 AS h33, round(sum(w*ny*ny),3)+0.0 AS h44, round(sum(w*(y*nz-z*ny)*(y*nz-z*ny)),2)+0.0 AS h00, round(sum(w*nx*r),3)+0.0 AS g3, count(*) AS n FROM (
 SELECT v.*, 1/(1+r*r/0.01) AS w FROM (SELECT q.frame_id, q.x, q.y, q.z, g.nx, g.ny, g.nz, q.x*g.nx+q.y*g.ny+q.z*g.nz+g.d AS r FROM q JOIN (SELECT q_id, nx, ny, nz, d FROM pl JOIN nk USING (q_id) GROUP BY ALL HAVING max(abs(nx*tx+ny*ty+nz*tz+d)) <= 0.02) g ON g.q_id=q.pt_id) v) u GROUP BY 1""", "points", _PAIRS, _PLANE.replace("1e-6", "1e-3")))
def normal_equations(spark, sf_dir):
    from scanfuse.operators.project import cauchy_weight
    from scanfuse.operators.register import plane_residuals

    q, near = five_with_places(spark, sf_dir)
    near = solid(near)
    eq = stats.normal_equations(plane_residuals(q, stats.neighbour_planes(near, 0.02), cauchy_weight(F.col("r"))), ["frame_id"])
    return eq.select("frame_id", *((F.round(n, k) + 0.0).alias(n) for n, k in (("h33", 3), ("h44", 3), ("h00", 2), ("g3", 3))), "n")


@query("j10_pixel_points", oracle("SELECT pt_id, row_id, col_id, round(x,5) AS x, round(y,5) AS y FROM img", "points", "pixels"))
def pixel_points(spark, sf_dir):
    p = points(spark, sf_dir)
    front = grid.nearest_returns(project(p, ROOM)).select("pt_id", "row_id", "col_id")
    return front.join(p.select("pt_id", "x", "y"), "pt_id").select("pt_id", "row_id", "col_id", *r5("x", "y"))


_LOOP = "lp AS (SELECT a.session_id, b.frame_id AS id1, a.frame_id AS id2, sqrt((a.tx-b.tx)**2+(a.ty-b.ty)**2) AS dist FROM ps a JOIN ps b ON a.session_id=b.session_id AND a.frame_id-b.frame_id>=2)"


@query("j11_loop_candidates", oracle("SELECT session_id, id1, id2, round(dist,5) AS dist, CAST(row_number() OVER (PARTITION BY session_id, id2 ORDER BY dist, id1) AS INT) AS nr FROM lp WHERE dist <= 0.7", "poses", _LOOP))
def loop_candidates(spark, sf_dir):
    return posegraph.loop_candidates(poses(spark, sf_dir), 0.7, 2).select("session_id", "id1", "id2", *r5("dist"), "nr")


@query("j12_history", oracle("SELECT l.session_id, id1, id2, ps.frame_id AS unit FROM lp l JOIN ps ON ps.session_id=l.session_id AND ps.frame_id BETWEEN id1-1 AND id1+1 WHERE dist<=0.7", "poses", _LOOP))
def history(spark, sf_dir):
    p = poses(spark, sf_dir)
    return posegraph.history(p, posegraph.loop_candidates(p, 0.7, 2))


# voxels and pixels
@query("a1_voxel_centroids", oracle("SELECT frame_id, CAST(floor(x/1.0) AS BIGINT) AS vx, CAST(floor(y/1.0) AS BIGINT) AS vy, CAST(floor(z/0.5) AS BIGINT) AS vz, round(avg(x),5) AS x, round(avg(y),5) AS y, round(avg(z),5) AS z, count(*) AS n FROM p GROUP BY 1,2,3,4", "points"))
def voxel_centroids(spark, sf_dir):
    return grid.voxel_centroids(points(spark, sf_dir), 1.0, 0.5, ("frame_id",)).select("frame_id", *grid.CELL, *r5("x", "y", "z"), "n")


@query("a2_voxel_samples", oracle("SELECT vx, vy, vz, pt_id FROM (SELECT *, row_number() OVER (PARTITION BY vx,vy,vz ORDER BY (x-(vx+0.5))*(x-(vx+0.5))+(y-(vy+0.5))*(y-(vy+0.5))+(z-(vz+0.5))*(z-(vz+0.5)), pt_id) AS nr FROM (SELECT *, CAST(floor(x) AS BIGINT) AS vx, CAST(floor(y) AS BIGINT) AS vy, CAST(floor(z) AS BIGINT) AS vz FROM p) a) b WHERE nr=1", "points"))
def voxel_samples(spark, sf_dir):
    return grid.voxel_samples(points(spark, sf_dir), 1.0).select(*grid.CELL, "pt_id")


@query("a3_nearest_returns", oracle("SELECT frame_id, row_id, col_id, round(rng,5) AS rng, pt_id FROM img", "points", "pixels"))
def nearest_returns(spark, sf_dir):
    return grid.nearest_returns(project(points(spark, sf_dir), ROOM)).select("frame_id", "row_id", "col_id", *r5("rng"), "pt_id")


@query("a3_projection_counts", oracle("SELECT frame_id, CAST(sum(CASE WHEN row_id BETWEEN 0 AND 9 THEN n-1 ELSE 0 END) AS BIGINT) AS overlaps, CAST(sum(CASE WHEN row_id NOT BETWEEN 0 AND 9 THEN n ELSE 0 END) AS BIGINT) AS bad_rows, CAST(0 AS BIGINT) AS bad_cols FROM (SELECT frame_id, row_id, col_id, count(*) AS n FROM px GROUP BY 1,2,3) q GROUP BY 1", "points", "pixels"))
def projection_counts(spark, sf_dir):
    return grid.projection_counts(project(points(spark, sf_dir), ROOM), 10, 180)


@query("a4_last_returns", oracle("SELECT frame_id, row_id, col_id, max(pt_id) AS pt_id FROM px GROUP BY 1,2,3", "points", "pixels"))
def last_returns(spark, sf_dir):
    return grid.last_returns(project(points(spark, sf_dir), ROOM)).drop("rng")


@query("a5_outdoor", oracle("SELECT frame_id, count(*) FILTER (WHERE rng>13) AS n_far, count(*) FILTER (WHERE rng>13) >= 20 AS outdoor FROM px GROUP BY 1", "points", "pixels"))
def outdoor(spark, sf_dir):
    return grid.outdoor_frames(project(points(spark, sf_dir), ROOM), 13.0)


_VOX = "vx AS (SELECT *, CAST(floor(x) AS BIGINT) AS vx, CAST(floor(y) AS BIGINT) AS vy, CAST(floor(z) AS BIGINT) AS vz FROM p), mo AS (SELECT vx, vy, vz, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(x*z) AS sxz, sum(y*y) AS syy, sum(y*z) AS syz, sum(z*z) AS szz FROM vx GROUP BY 1,2,3)"
_EIG = """cv AS (SELECT *, sxx/n-sx/n*(sx/n) AS xx, sxy/n-sx/n*(sy/n) AS xy, sxz/n-sx/n*(sz/n) AS xz, syy/n-sy/n*(sy/n) AS yy, syz/n-sy/n*(sz/n) AS yz, szz/n-sz/n*(sz/n) AS zz FROM mo WHERE n>=20),
e1 AS (SELECT *, (xx+yy+zz)/3 AS q FROM cv), e2 AS (SELECT *, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(xy*xy+xz*xz+yz*yz))/6) AS pp FROM e1),
e3 AS (SELECT *, CASE WHEN pp>0 THEN acos(greatest(-1.0,least(1.0,((xx-q)*((yy-q)*(zz-q)-yz*yz)-xy*(xy*(zz-q)-yz*xz)+xz*(xy*yz-(yy-q)*xz))/(2*pp*pp*pp))))/3 ELSE 0 END AS phi FROM e2),
e4 AS (SELECT *, q+2*pp*cos(phi+2*pi()/3) AS l1, q+2*pp*cos(phi) AS l3 FROM e3), ev AS (SELECT *, 3*q-l1-l3 AS l2 FROM e4)"""


def _voxel_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.principal(stats.moments(grid.cells(points(spark, sf_dir), 1.0), grid.CELL).where("n >= 20"))


@query("a7_principal", oracle("SELECT vx, vy, vz, n, round(l1,5) AS l1, round(l2,5) AS l2, round(l3,5) AS l3 FROM ev", "points", _VOX, _EIG))
def principal(spark, sf_dir):
    return _voxel_pca(spark, sf_dir).select(*grid.CELL, "n", *r5("l1", "l2", "l3"))


@query("a7_axes")
def axes(spark, sf_dir):
    return stats.eigenvectors(_voxel_pca(spark, sf_dir)).select(*grid.CELL, *((F.round(F.col("axes")[k], 4) + 0.0).alias(f"a{k}") for k in range(9)))


@query("a8_shape_class", oracle("SELECT vx, vy, vz, l3>20*l2 AS is_edge, l3>3*l2 AS is_line, round((l3-l2)/l3,4)+0.0 AS linearity, round((l2-l1)/l3,4)+0.0 AS planarity FROM ev", "points", _VOX, _EIG))
def shape_class(spark, sf_dir):
    return stats.shape_class(_voxel_pca(spark, sf_dir)).select(*grid.CELL, "is_edge", "is_line", (F.round("linearity", 4) + 0.0).alias("linearity"), (F.round("planarity", 4) + 0.0).alias("planarity"))


@query("a11_ransac_lines")
def ransac_lines(spark, sf_dir):
    return stats.ransac_lines(points(spark, sf_dir).withColumn("line", F.col("ring") + 16 * (F.col("frame_id").cast("long") * 10 + F.floor(F.col("az") / 18))), "line").select("line", "inliers", *r5("length", "linearity"))


@query("a13_distinct_rows", oracle("SELECT frame_id, col_id//10 AS cluster, count(DISTINCT row_id) AS rows FROM px GROUP BY 1,2", "points", "pixels"))
def distinct_rows(spark, sf_dir):
    return project(points(spark, sf_dir), ROOM).groupBy("frame_id", F.floor(F.col("col_id") / 10).cast("int").alias("cluster")).agg(F.countDistinct("row_id").alias("rows"))


@query("a14_line_density", oracle("SELECT frame_id, row_id, round(avg(sqrt(x*x+y*y)),5) AS mean_range, count(*) AS n FROM px GROUP BY 1,2", "points", "pixels"))
def line_density(spark, sf_dir):
    from scanfuse.operators.scanline import line_density as density

    return density(project(points(spark, sf_dir), ROOM)).select("frame_id", "row_id", *r5("mean_range"), "n")


@query("a17_capped_voxels", oracle("SELECT pt_id FROM (SELECT pt_id, row_number() OVER (PARTITION BY floor(x),floor(y),floor(z) ORDER BY frame_id, pt_id) AS nr FROM p WHERE sqrt(x*x+y*y+z*z) <= 9) q WHERE nr<=10", "points"))
def capped_voxels(spark, sf_dir):
    return grid.capped_voxels(points(spark, sf_dir), 1.0, 10, far=9.0).select("pt_id")


_OCC = """ry AS (SELECT p.frame_id, x, y, z, tx, ty, tz, sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty)+(z-tz)*(z-tz)) AS d FROM p JOIN ps USING (frame_id)),
en AS (SELECT DISTINCT frame_id, CAST(floor(x) AS BIGINT) AS vx, CAST(floor(y) AS BIGINT) AS vy, CAST(floor(z) AS BIGINT) AS vz FROM ry WHERE d<=50),
fr AS (SELECT DISTINCT frame_id, CAST(floor(tx+u*(x-tx)) AS BIGINT) AS vx, CAST(floor(ty+u*(y-ty)) AS BIGINT) AS vy, CAST(floor(tz+u*(z-tz)) AS BIGINT) AS vz FROM (SELECT *, k*0.7/d AS u FROM (SELECT *, unnest(range(0, greatest(CAST(floor((d-1)/0.7) AS INT),0)+1)) AS k FROM ry WHERE d<=50) a) b),
od AS (SELECT vx, vy, vz, greatest(-2.0, least(3.5, sum(o))) AS log_odds FROM (SELECT vx,vy,vz,0.85 AS o FROM en UNION ALL SELECT vx,vy,vz,-0.4 FROM fr ANTI JOIN en USING (frame_id,vx,vy,vz)) w GROUP BY 1,2,3)"""


def occupancy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.occupancy(points(spark, sf_dir), poses(spark, sf_dir), 1.0, 0.7)


@query("a18_occupancy", oracle("SELECT vx, vy, vz, round(CAST(log_odds AS DOUBLE),5) AS log_odds FROM od", "points", "poses", _OCC))
def occupancy(spark, sf_dir):
    return occupancy_grid(spark, sf_dir).select(*grid.CELL, *r5("log_odds"))


@query("c8_occupied_points", oracle("SELECT pt_id FROM p JOIN od ON od.vx=CAST(floor(x) AS BIGINT) AND od.vy=CAST(floor(y) AS BIGINT) AND od.vz=CAST(floor(z) AS BIGINT) WHERE 1/(1+exp(-log_odds)) >= 0.5", "points", "poses", _OCC))
def occupied_points(spark, sf_dir):
    return grid.occupied_points(points(spark, sf_dir), occupancy_grid(spark, sf_dir), 1.0, 0.5).select("pt_id")


@query("c3_visible_voxels", oracle("SELECT frame_id*1000+k AS ray_id, round(min(t),5) AS t FROM (SELECT frame_id, k, i*0.5::DOUBLE AS t, CAST(floor(tx+i*0.5::DOUBLE*cos(radians(k*2.0::DOUBLE))) AS BIGINT) AS vx, CAST(floor(ty+i*0.5::DOUBLE*sin(radians(k*2.0::DOUBLE))) AS BIGINT) AS vy, CAST(floor(tz) AS BIGINT) AS vz FROM ps, range(180) r(k), range(1,41) s(i)) q JOIN od USING (vx,vy,vz) WHERE 1/(1+exp(-log_odds)) >= 0.5 GROUP BY 1", "points", "poses", _OCC))
def visible_voxels(spark, sf_dir):
    rays = poses(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(179))))
    a = F.radians(F.col("k") * 2.0)
    rays = rays.select((F.col("frame_id") * 1000 + F.col("k")).cast("long").alias("ray_id"), "tx", "ty", "tz", F.cos(a).alias("dx"), F.sin(a).alias("dy"), F.lit(0.0).alias("dz"))
    return grid.visible_voxels(rays, occupancy_grid(spark, sf_dir), 1.0, 0.5, 20.0).select("ray_id", *r5("t"))


_CROSSED = """sg AS (SELECT frame_id, pt_id, x, y, z, tx, ty, tz FROM p JOIN ps USING (frame_id) WHERE sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty)+(z-tz)*(z-tz))<=50),
cu AS (SELECT frame_id, pt_id, unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS u FROM sg """ + " ".join(
    f"UNION ALL SELECT frame_id, pt_id, (unnest(generate_series(CAST(floor(least(t{a},{a})) AS BIGINT)+1, CAST(ceil(greatest(t{a},{a})) AS BIGINT)-1))-t{a})/({a}-t{a}) AS u FROM sg" for a in "xyz"
) + """),
mi AS (SELECT frame_id, pt_id, u, (u+nu)/2 AS m FROM (SELECT *, lead(u) OVER (PARTITION BY pt_id ORDER BY u) AS nu FROM cu) q WHERE nu-u > 1e-12),
fx AS (SELECT DISTINCT frame_id, CAST(floor(tx+m*(x-tx)) AS BIGINT) AS vx, CAST(floor(ty+m*(y-ty)) AS BIGINT) AS vy, CAST(floor(tz+m*(z-tz)) AS BIGINT) AS vz FROM mi JOIN sg USING (frame_id, pt_id)),
ox AS (SELECT vx, vy, vz, greatest(-2.0, least(3.5, sum(o))) AS log_odds FROM (SELECT vx,vy,vz,0.85 AS o FROM en UNION ALL SELECT vx,vy,vz,-0.4 FROM fx ANTI JOIN en USING (frame_id,vx,vy,vz)) w GROUP BY 1,2,3)"""


def exact_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.occupancy(points(spark, sf_dir), poses(spark, sf_dir), 1.0, None)


@query("a18_exact_occupancy", oracle("SELECT vx, vy, vz, round(CAST(log_odds AS DOUBLE),5) AS log_odds FROM ox", "points", "poses", _OCC, _CROSSED))
def exact_occupancy(spark, sf_dir):
    return exact_grid(spark, sf_dir).select(*grid.CELL, *r5("log_odds"))


@query("c8_exact_filter", oracle("SELECT pt_id FROM p JOIN ox ON ox.vx=CAST(floor(x) AS BIGINT) AND ox.vy=CAST(floor(y) AS BIGINT) AND ox.vz=CAST(floor(z) AS BIGINT) WHERE 1/(1+exp(-log_odds)) >= 0.5", "points", "poses", _OCC, _CROSSED))
def exact_filter(spark, sf_dir):
    return grid.occupied_points(points(spark, sf_dir), exact_grid(spark, sf_dir), 1.0, 0.5).select("pt_id")


@query("c3_exact_visible", oracle("""SELECT ray_id, round(min(lo),4)+0.0 AS t FROM (SELECT ray_id, greatest(0, lx, ly) AS lo, least(20, hx, hy) AS hi FROM (
 SELECT r.frame_id*1000+k AS ray_id, least((vx-tx)/dx,(vx+1-tx)/dx) AS lx, greatest((vx-tx)/dx,(vx+1-tx)/dx) AS hx, least((vy-ty)/dy,(vy+1-ty)/dy) AS ly, greatest((vy-ty)/dy,(vy+1-ty)/dy) AS hy
 FROM (SELECT *, cos(radians(k*2.0::DOUBLE+0.7)) AS dx, sin(radians(k*2.0::DOUBLE+0.7)) AS dy FROM ps, range(180) s(k)) r JOIN ox ON ox.vz=CAST(floor(tz) AS BIGINT) AND vx BETWEEN tx-21 AND tx+20 AND vy BETWEEN ty-21 AND ty+20 WHERE 1/(1+exp(-log_odds)) >= 0.5) q) s WHERE hi-lo > 1e-9 GROUP BY 1""", "points", "poses", _OCC, _CROSSED))
def exact_visible(spark, sf_dir):
    """Its SQL cuts every ray with every occupied voxel near it, by their faces."""
    rays = poses(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(179))))
    a = F.radians(F.col("k") * 2.0 + 0.7)
    rays = rays.select((F.col("frame_id") * 1000 + F.col("k")).cast("long").alias("ray_id"), "tx", "ty", "tz", F.cos(a).alias("dx"), F.sin(a).alias("dy"), F.lit(0.0).alias("dz"))
    return grid.visible_voxels(rays, exact_grid(spark, sf_dir), 1.0, None, 20.0).select("ray_id", (F.round("t", 4) + 0.0).alias("t"))


def _layers(n: int, root: float) -> str:
    """Common tables of each layer: its voxels with eigenvalues, and the points that go on."""
    parts = ["f0 AS (SELECT pt_id, x, y, z, CASE WHEN ring<3 THEN 'line' ELSE 'plane' END AS kind FROM p)"]
    for k in range(n):
        size = root / 2**k
        eig = _EIG.replace("mo WHERE n>=20", f"mo{k} WHERE n>=7")
        eig = re.sub(r"\b(cv|e\d|ev)\b", rf"\g<1>_{k}", eig)
        cell = ", ".join(f"CAST(floor({a}/{size}) AS BIGINT) AS v{a}" for a in "xyz")
        parts += [
            f"g{k} AS (SELECT *, {cell} FROM f{k})",
            f"mo{k} AS (SELECT kind, vx, vy, vz, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(x*z) AS sxz, sum(y*y) AS syy, sum(y*z) AS syz, sum(z*z) AS szz FROM g{k} GROUP BY 1,2,3,4)",
            eig,
            f"ok{k} AS (SELECT *, CASE WHEN kind='line' THEN l3>1e-9 AND l3>=4*greatest(l2,0) ELSE l2>1e-9 AND l2>=9*greatest(l1,0) END AS ok FROM ev_{k})",
            f"f{k + 1} AS (SELECT pt_id, x, y, z, kind FROM g{k} SEMI JOIN (SELECT kind, vx, vy, vz FROM ok{k} WHERE NOT ok) r USING (kind, vx, vy, vz))",
        ]
    return ",\n".join(parts)


@query("a19_adaptive_features", oracle(" UNION ALL ".join(f"SELECT kind, CAST({k} AS INT) AS layer, vx, vy, vz, n, round(l2,5) AS l2, round(l3,5) AS l3, round(sx/n,5) AS cx FROM ok{k} WHERE ok" for k in range(3)), "points", _layers(3, 2.0)))
def adaptive_features(spark, sf_dir):
    """The lowest three beams as line points, the others as plane points."""
    p = points(spark, sf_dir).withColumn("kind", F.when(F.col("ring") < 3, "line").otherwise("plane"))
    return stats.adaptive_features(p, 2.0, layers=3).select("kind", "layer", *grid.CELL, "n", *r5("l2", "l3", "cx"))


@query("a19_adaptive_planes")
def adaptive_planes(spark, sf_dir):
    return stats.adaptive_planes(points(spark, sf_dir), 2.0, layers=3).select("layer", *grid.CELL, "n", *r5("l2", "l3"))


@query("a20_merge_moments", oracle("SELECT vx, vy, vz, CAST(n AS BIGINT) AS n, round(sx,5) AS sx, round(sxy,4)+0.0 AS sxy, round(szz,4)+0.0 AS szz FROM mo", "points", _VOX))
def merge_moments(spark, sf_dir):
    p = grid.cells(points(spark, sf_dir), 1.0)
    old, new = (stats.moments(p.where(c), grid.CELL) for c in ("frame_id % 2 = 0", "frame_id % 2 = 1"))
    out = stats.merge_moments(old.unionByName(new), grid.CELL)
    return out.select(*grid.CELL, "n", *r5("sx"), (F.round("sxy", 4) + 0.0).alias("sxy"), (F.round("szz", 4) + 0.0).alias("szz"))


@query("a21_align_pairs")
def align_pairs(spark, sf_dir):
    q, t = frames_pair(spark, sf_dir)
    near = neighbors.nearest(q, t, 1, 1.0).join(q.select(F.col("pt_id").alias("q_id"), "frame_id"), "q_id")
    return stats.align_pairs(near, "frame_id").select("frame_id", "n", *((F.round(n, 4) + 0.0).alias(n) for n in ("tx", "ty", "tz")))


@query("a21_trimmed_alignment")
def trimmed_alignment(spark, sf_dir):
    """Every frame moved off its place, and back onto the frame before in its session."""
    from scanfuse.operators.register import align_trimmed

    q, t = frames_pair(spark, sf_dir)
    off = q.withColumns({"x": F.col("x") + 0.08, "y": F.col("y") - 0.05})
    out = align_trimmed(off, t, q.select("frame_id").distinct())
    return out.select("frame_id", *((F.round(n, 2) + 0.0).alias(n) for n in ("tx", "ty", "qz", "mean_d2")))


@query("a22_hull_overlap")
def hull_overlap(spark, sf_dir):
    p = transform_points(points(spark, sf_dir), poses(spark, sf_dir)).withColumnRenamed("frame_id", "unit_id")
    f = p.select("unit_id").distinct()
    pairs = f.select(F.col("unit_id").alias("id1"), (F.col("unit_id") + 1).alias("id2"))
    return select.hull_overlap(p, pairs).select("id1", "id2", *((F.round(n, 4) + 0.0).alias(n) for n in ("area1", "area2", "overlap")))


@query("a22_shared_voxels", oracle("SELECT a.frame_id AS id1, b.frame_id AS id2, count(*) AS shared FROM (SELECT DISTINCT frame_id, floor(x) AS vx, floor(y) AS vy FROM p) a JOIN (SELECT DISTINCT frame_id, floor(x) AS vx, floor(y) AS vy FROM p) b ON b.frame_id=a.frame_id+1 AND a.vx=b.vx AND a.vy=b.vy GROUP BY 1,2", "points"))
def shared_voxels(spark, sf_dir):
    v = grid.cells(points(spark, sf_dir), 1.0).select("frame_id", "vx", "vy").distinct()
    both = v.select(F.col("frame_id").alias("id1"), (F.col("frame_id") + 1).alias("id2"), "vx", "vy").join(v.withColumnRenamed("frame_id", "id2"), ["id2", "vx", "vy"])
    return both.groupBy("id1", "id2").agg(F.count("*").alias("shared"))


@query("a23_polygon_area", oracle("SELECT frame_id, round(abs(sum(x*ny-y*nx))/2,5) AS area FROM (SELECT frame_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM img WHERE row_id=8 WINDOW w AS (PARTITION BY frame_id ORDER BY col_id)) q GROUP BY 1", "points", "pixels"))
def polygon_area(spark, sf_dir):
    p = project(points(spark, sf_dir), ROOM)
    ring = grid.nearest_returns(p).where("row_id = 8").select("pt_id", F.col("col_id").alias("no")).join(p.select("frame_id", "pt_id", "x", "y"), "pt_id")
    return select.polygon_area(ring, "frame_id").select("frame_id", *r5("area"))


@query("a23_ring_areas", oracle("SELECT frame_id*16+row_id AS ring_id, round(abs(sum(x*ny-y*nx))/2,4)+0.0 AS area FROM (SELECT frame_id, row_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM img WINDOW w AS (PARTITION BY frame_id, row_id ORDER BY col_id)) q GROUP BY 1", "points", "pixels"))
def ring_areas(spark, sf_dir):
    """Every row of every frame as a ring."""
    p = project(points(spark, sf_dir), ROOM)
    rings = grid.nearest_returns(p).select("pt_id", F.col("col_id").alias("no")).join(p.select("pt_id", (F.col("frame_id") * 16 + F.col("row_id")).alias("ring_id"), "x", "y"), "pt_id")
    return select.polygon_area(rings, "ring_id").select("ring_id", (F.round("area", 4) + 0.0).alias("area"))


@query("a24_submaps", oracle("SELECT session_id, frame_id, n, CAST(floor(coalesce(sum(n) OVER (PARTITION BY session_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)/7000.0) AS INT) AS submap FROM (SELECT CAST(floor(frame_id/10.0) AS INT) AS session_id, frame_id, count(*) AS n FROM p GROUP BY 1,2) q", "points"))
def submaps(spark, sf_dir):
    f = points(spark, sf_dir).groupBy(F.floor(F.col("frame_id") / 10.0).cast("int").alias("session_id"), "frame_id").agg(F.count("*").alias("n"))
    return grid.rolled_submaps(f, 7000)


@query("w14_recent", oracle("SELECT frame_id, count(*) AS n FROM p WHERE 0.1*frame_id >= (SELECT max(0.1*frame_id) FROM p) - 0.75 GROUP BY 1", "points"))
def recent(spark, sf_dir):
    return grid.recent(points(spark, sf_dir), 0.1 * F.col("frame_id"), 0.75).groupBy("frame_id").agg(F.count("*").alias("n"))


@query("u1_union", oracle("SELECT kind, count(*) AS n FROM (SELECT 'corner' AS kind FROM p WHERE ring<3 UNION ALL SELECT 'surf' FROM p WHERE ring>=3) q GROUP BY 1", "points"))
def union(spark, sf_dir):
    p = points(spark, sf_dir)
    both = p.where("ring < 3").withColumn("kind", F.lit("corner")).unionByName(p.where("ring >= 3").withColumn("kind", F.lit("surf")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("u2_difference", oracle("SELECT pt_id FROM p WHERE pt_id NOT IN (SELECT pt_id FROM img)", "points", "pixels"))
def difference(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.join(grid.nearest_returns(project(p, ROOM)).select("pt_id"), "pt_id", "left_anti").select("pt_id")


@query("u3_distinct_labels", oracle("SELECT DISTINCT frame_id, ring FROM p", "points"))
def distinct_labels(spark, sf_dir):
    return points(spark, sf_dir).select("frame_id", "ring").distinct()


@query("k2_by_azimuth", oracle("SELECT pt_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY az, pt_id) AS INT) AS order_by_az FROM p", "points"))
def by_azimuth(spark, sf_dir):
    p = points(spark, sf_dir)
    turned = p.withColumns({"x": F.cos(F.radians(F.col("az") * 2.0 - 180.0)), "y": F.sin(F.radians(F.col("az") * 2.0 - 180.0))})
    return select.by_azimuth(turned).select("pt_id", F.col("order").alias("order_by_az"))


@query("k6_trimmed", oracle("SELECT q_id, t_id FROM (SELECT q_id, t_id, row_number() OVER (PARTITION BY frame_id ORDER BY d2, q_id, t_id) AS r FROM nn WHERE nr=1) w WHERE r<=500", "points", _PAIRS))
def trimmed(spark, sf_dir):
    q, t = frames_pair(spark, sf_dir)
    near = neighbors.nearest(q, t, 1, 1.0).join(q.select(F.col("pt_id").alias("q_id"), "frame_id"), "q_id")
    return select.trimmed(near, "frame_id", 500).select("q_id", "t_id")


