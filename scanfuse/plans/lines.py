"""Queries: scan lines, clusters, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfuse.functions.profile import PROFILES
from scanfuse.operators import cluster, grid, neighbors, select
from scanfuse.operators import scanline as S
from scanfuse.operators.project import project
from scanfuse.plans.maps import frames_pair
from scanfuse.plans.registry import query
from scanfuse.sources.fixture import oracle, points, r5

ROOM = PROFILES["room"]
COLS = 180


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front surface of every frame, with its points."""
    return grid.front(project(points(spark, sf_dir), ROOM).drop("ring", "az"))


_FRAME = "PARTITION BY frame_id ORDER BY row_id, col_id"
_CURV = f"cu AS (SELECT *, CASE WHEN count(*) OVER f=11 THEN power(sum(rng) OVER f - 11*rng,2) END AS curvature FROM img WINDOW f AS ({_FRAME} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))"
_STEP = "sqrt((x-lag(x) OVER {w})*(x-lag(x) OVER {w})+(y-lag(y) OVER {w})*(y-lag(y) OVER {w})+(z-lag(z) OVER {w})*(z-lag(z) OVER {w}))"
_LINE = "PARTITION BY frame_id, row_id ORDER BY col_id"
_SEG = f"""sg0 AS (SELECT *, {_STEP.format(w="w")} AS gap FROM img WINDOW w AS ({_LINE})),
sg AS (SELECT *, CAST(sum(CASE WHEN gap > 1.06*(rng*sin(radians(0.2))/sin(radians(9.8))+0.09) OR gap > 9*pg THEN 1 ELSE 0 END) OVER ({_LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS segment FROM (SELECT *, lag(gap) OVER ({_LINE}) AS pg FROM sg0) q)"""


@query("w1_curvature", oracle("SELECT pt_id, round(curvature,4)+0.0 AS curvature FROM cu", "points", "pixels", _CURV))
def curvature(spark, sf_dir):
    return S.curvature(image(spark, sf_dir)).select("pt_id", (F.round("curvature", 4) + 0.0).alias("curvature"))


@query("w2_occlusion", oracle(f"""SELECT pt_id, greatest(h, nn, pp)=1 AS masked FROM (SELECT pt_id, max(here) OVER (f ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS h, coalesce(max(nxt) OVER (f ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),0) AS nn, pp FROM (
 SELECT *, CASE WHEN abs(lead(col_id) OVER f - col_id)<10 AND rng-lead(rng) OVER f > 0.3 THEN 1 ELSE 0 END AS here, CASE WHEN abs(lead(col_id) OVER f - col_id)<10 AND lead(rng) OVER f-rng > 0.3 THEN 1 ELSE 0 END AS nxt,
 CASE WHEN abs(lag(rng) OVER f-rng)>0.02*rng AND abs(lead(rng) OVER f-rng)>0.02*rng THEN 1 ELSE 0 END AS pp FROM img WINDOW f AS ({_FRAME})) a WINDOW f AS ({_FRAME})) b""", "points", "pixels"))
def occlusion(spark, sf_dir):
    return S.occlusion_mask(image(spark, sf_dir)).select("pt_id", "masked")


@query("w3_ranked_features", oracle("SELECT pt_id, CAST(floor(col_id*6/180.0) AS INT) AS sector FROM (SELECT *, row_number() OVER (PARTITION BY frame_id,row_id,CAST(floor(col_id*6/180.0) AS INT) ORDER BY round(curvature,9) DESC, pt_id) AS r FROM cu WHERE curvature IS NOT NULL) q WHERE r<=2", "points", "pixels", _CURV))
def ranked_features(spark, sf_dir):
    curved = S.curvature(image(spark, sf_dir)).where("curvature IS NOT NULL").withColumn("curvature", F.round("curvature", 9))
    return S.ranked_features(curved, COLS).where("sharp_rank <= 2").select("pt_id", "sector")


@query("k1_sector_sort", oracle("SELECT pt_id, CAST(row_number() OVER (PARTITION BY frame_id,row_id,CAST(floor(col_id*6/180.0) AS INT) ORDER BY round(curvature,9), pt_id) AS INT) AS flat_rank FROM cu WHERE curvature IS NOT NULL", "points", "pixels", _CURV))
def sector_sort(spark, sf_dir):
    curved = S.curvature(image(spark, sf_dir)).where("curvature IS NOT NULL").withColumn("curvature", F.round("curvature", 9))
    return S.ranked_features(curved, COLS).select("pt_id", "flat_rank")


@query("w3_picked_features")
def picked_features(spark, sf_dir):
    return S.pick_features(S.occlusion_mask(S.curvature(image(spark, sf_dir))), COLS).select("pt_id", "feature")


@query("w4_livox_features", oracle(f"SELECT pt_id, round(sqrt(lx*lx+ly*ly+lz*lz),5) AS left_curv, round(g,5) AS gap_left FROM (SELECT pt_id, {', '.join(f'lag({a},1) OVER w+lag({a},2) OVER w+lag({a},3) OVER w+lag({a},4) OVER w-4*{a} AS l{a}' for a in 'xyz')}, {_STEP.format(w='w')} AS g FROM img WINDOW w AS (PARTITION BY frame_id, row_id ORDER BY col_id)) q", "points", "pixels"))
def livox_features(spark, sf_dir):
    return S.livox_features(image(spark, sf_dir), "row_id", "col_id").select("pt_id", *r5("left_curv"), (F.round("gap_left", 5) + 0.0).alias("gap_left"))


@query("w4_livox_labels")
def livox_labels(spark, sf_dir):
    return S.livox_labels(image(spark, sf_dir), "row_id", "col_id").select("pt_id", "label")


@query("w5_segments", oracle("SELECT pt_id, segment FROM sg", "points", "pixels", _SEG))
def segments(spark, sf_dir):
    return S.line_segments(image(spark, sf_dir)).select("pt_id", "segment")


_ARC = f"ar AS (SELECT *, sum(coalesce(mv,0)) OVER (PARTITION BY frame_id,row_id,segment ORDER BY col_id) AS arc FROM (SELECT *, {_STEP.format(w='w')} AS mv FROM sg WINDOW w AS (PARTITION BY frame_id,row_id,segment ORDER BY col_id)) q)"


@query("w6_resampled", oracle("SELECT frame_id, row_id, segment, CAST(floor(round(arc,9)/0.3) AS INT) AS bucket, arg_min(pt_id, col_id) AS pt_id FROM ar GROUP BY 1,2,3,4", "points", "pixels", _SEG, _ARC))
def resampled(spark, sf_dir):
    return S.resample_lines(S.line_segments(image(spark, sf_dir)), 0.3)


_RUNS = """rn AS (SELECT *, coalesce(degrees(acos(greatest(-1.0,least(1.0,round(((x-px)*(nx-x)+(y-py)*(ny-y)+(z-pz)*(nz-z))/(sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz))*sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)+(nz-z)*(nz-z))),9)))))>45, false) AS turn, coalesce(sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz)),0) AS mv
 FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM sg WINDOW w AS (PARTITION BY frame_id,row_id,segment ORDER BY col_id)) q)"""


@query("w7_direction_lines", oracle("SELECT frame_id, row_id, segment, run, count(*) AS n, round(sum(mv),5) AS length, CASE WHEN count(*)>5 AND sum(mv)>0.5 THEN 'SURF' ELSE 'EDGE' END AS label FROM (SELECT *, CAST(coalesce(sum(CAST(turn AS INT)) OVER (PARTITION BY frame_id,row_id,segment ORDER BY col_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS INT) AS run FROM rn) q GROUP BY 1,2,3,4", "points", "pixels", _SEG, _RUNS))
def direction_lines(spark, sf_dir):
    return S.direction_lines(S.line_segments(image(spark, sf_dir))).select("frame_id", "row_id", "segment", "run", "n", *r5("length"), "label")


def _smooth_sql() -> str:
    parts = [(f"lag({{}},{-k}) OVER w" if k < 0 else f"lead({{}},{k}) OVER w") for k in (-3, -2, -1, 1, 2, 3)]
    w = [f"exp(-4*(({p.format('x')}-x)*({p.format('x')}-x)+({p.format('y')}-y)*({p.format('y')}-y)+({p.format('z')}-z)*({p.format('z')}-z)))" for p in parts]
    top = "+".join(f"coalesce({a}*({p.format('rng')}-rng),0)" for a, p in zip(w, parts))
    low = "+".join(f"coalesce({a},0)" for a in w)
    return f"SELECT pt_id, round(CASE WHEN low>0 THEN abs(top)/low END,5) AS smoothness FROM (SELECT pt_id, {top} AS top, {low} AS low FROM img WINDOW w AS ({_LINE})) q"


@query("w8_smoothness", oracle(_smooth_sql(), "points", "pixels"))
def smoothness(spark, sf_dir):
    return S.weighted_smoothness(image(spark, sf_dir)).select("pt_id", *r5("smoothness"))


@query("w9_polyline_splits")
def polyline_splits(spark, sf_dir):
    return S.polyline_splits(S.line_segments(image(spark, sf_dir)))


_COL = "PARTITION BY frame_id, col_id ORDER BY row_id"
_UP = f"up AS (SELECT *, lead(row_id) OVER w - row_id AS dr, row_id - lag(row_id) OVER w AS pr, degrees(atan2(lead(z) OVER w - z, sqrt((lead(x) OVER w-x)*(lead(x) OVER w-x)+(lead(y) OVER w-y)*(lead(y) OVER w-y)))) AS slope, degrees(atan2(z-lag(z) OVER w, sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)))) AS pslope FROM img WINDOW w AS ({_COL}))"
_GR = f"gr AS (SELECT *, fl OR coalesce(CASE WHEN pr=1 THEN lag(fl) OVER ({_COL}) END, false) AS is_ground FROM (SELECT *, coalesce(row_id<7 AND dr=1 AND abs(slope)<=10,false) AS fl FROM up) q)"


@query("w10_vertical_chains", oracle(f"""SELECT pt_id, coalesce(md OR lag(md) OVER w OR lead(md) OVER w, md) AS vertical, coalesce(abs(slope)<9,false) AS flat FROM (SELECT up.*, coalesce(dr=1 AND pr=1 AND abs(slope)>=45 AND abs(pslope)>=45 AND degrees(acos(greatest(-1.0,least(1.0,round(
 ((x-lag(x) OVER c)*(lead(x) OVER c-x)+(y-lag(y) OVER c)*(lead(y) OVER c-y)+(z-lag(z) OVER c)*(lead(z) OVER c-z))/({_STEP.format(w="c")}*sqrt((lead(x) OVER c-x)*(lead(x) OVER c-x)+(lead(y) OVER c-y)*(lead(y) OVER c-y)+(lead(z) OVER c-z)*(lead(z) OVER c-z))),9)))))<30,false) AS md
 FROM up WINDOW c AS ({_COL})) q WINDOW w AS ({_COL})""", "points", "pixels", _UP))
def vertical_chains(spark, sf_dir):
    return S.vertical_chains(image(spark, sf_dir)).select("pt_id", "vertical", "flat")


@query("w11_ground", oracle("SELECT pt_id, is_ground FROM gr", "points", "pixels", _UP, _GR))
def ground(spark, sf_dir):
    return S.ground_by_slope(image(spark, sf_dir)).select("pt_id", "is_ground")


@query("w12_relabel_ground", oracle(f"SELECT pt_id, bool_and(NOT coalesce(abs(pslope)>10,false)) OVER ({_COL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ground_run FROM up", "points", "pixels", _UP))
def relabel_ground(spark, sf_dir):
    return S.relabel_ground(image(spark, sf_dir)).select("pt_id", "ground_run")


@query("a6_farthest_ground", oracle("SELECT frame_id, col_id, round(max(rng),5) AS max_ground FROM gr WHERE is_ground GROUP BY 1,2", "points", "pixels", _UP, _GR))
def farthest_ground(spark, sf_dir):
    return S.farthest_ground(S.ground_by_slope(image(spark, sf_dir))).select("frame_id", "col_id", *r5("max_ground"))


@query("g3_above_ground", oracle("SELECT pt_id FROM gr JOIN (SELECT frame_id, col_id, max(rng) AS mg FROM gr WHERE is_ground GROUP BY 1,2) m USING (frame_id, col_id) WHERE NOT is_ground AND rng < mg", "points", "pixels", _UP, _GR))
def above_ground(spark, sf_dir):
    return S.above_ground(S.ground_by_slope(image(spark, sf_dir))).select("pt_id")


@query("g4_thinned", oracle(f"SELECT frame_id, row_id, CAST(min(i)+5 AS INT) AS start_idx, CAST(max(i)-5 AS INT) AS end_idx, count(*) AS n FROM (SELECT *, row_number() OVER ({_FRAME})-1 AS i FROM gr WHERE NOT is_ground OR col_id%5=0 OR col_id<=5) q GROUP BY 1,2", "points", "pixels", _UP, _GR))
def thinned(spark, sf_dir):
    return S.thinned(S.ground_by_slope(image(spark, sf_dir)))


_EDGES = """ed AS (SELECT a.frame_id, a.pt_id AS u, b.pt_id AS v, greatest(a.rng,b.rng) AS d1, least(a.rng,b.rng) AS d2 FROM img a JOIN img b ON a.frame_id=b.frame_id AND a.row_id=b.row_id AND b.col_id=(a.col_id+1)%180
 UNION ALL SELECT a.frame_id, a.pt_id, b.pt_id, greatest(a.rng,b.rng), least(a.rng,b.rng) FROM img a JOIN img b ON a.frame_id=b.frame_id AND b.row_id=a.row_id+1 AND b.col_id=a.col_id)"""


@query("g1_image_edges", oracle("SELECT frame_id, u, v FROM ed WHERE degrees(atan2(d2*sin(radians(2.0)), d1-d2*cos(radians(2.0)))) > 30", "points", "pixels", _EDGES))
def image_edges(spark, sf_dir):
    return cluster.image_edges(image(spark, sf_dir), COLS, 2.0, 2.0)


@query("g1_segments")
def image_segments(spark, sf_dir):
    return cluster.segments(image(spark, sf_dir), COLS, 2.0, 2.0).select("frame_id", "pt_id", "label", "size", "rows")


@query("g2_feature_clusters")
def feature_clusters(spark, sf_dir):
    return cluster.feature_clusters(image(spark, sf_dir), COLS).select("frame_id", "label", "n", "rows", "kept")


@query("g2_surf_clusters")
def surf_clusters(spark, sf_dir):
    return cluster.feature_clusters(image(spark, sf_dir), COLS, kind="surf").select("frame_id", "label", "n", "rows", "kept")


@query("c10_plane_ids")
def plane_ids(spark, sf_dir):
    from scanfuse.operators import stats

    near = neighbors.nearest_sets(*frames_pair(spark, sf_dir), 5, 1.0, complete=True, sums=True, in_order=True)  # a session's planes follow each other
    good = stats.neighbour_planes(near, 0.02).where("valid")
    return cluster.plane_ids(good.select("q_id", F.explode("near.t_id").alias("t_id")))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with the normal of their wall or floor, as plane features."""
    i = image(spark, sf_dir)
    n = {"nx": F.cos(F.radians(F.col("col_id") * 2.0)), "ny": F.sin(F.radians(F.col("col_id") * 2.0)), "nz": F.lit(0.0), "planarity": 1 - F.col("row_id") / 20.0}
    return i.withColumns(n)


_FEAT = "ft AS (SELECT frame_id, pt_id, x, y, z, cos(radians(col_id*2.0)) AS nx, sin(radians(col_id*2.0)) AS ny, 0.0 AS nz, 1-row_id/20.0 AS pl FROM img)"


@query("k3_observability", oracle("""SELECT DISTINCT frame_id, pt_id FROM (SELECT frame_id, pt_id, row_number() OVER (PARTITION BY frame_id, l ORDER BY s DESC, pt_id) AS r FROM (
 SELECT frame_id, pt_id, unnest(range(9)) AS l, unnest([round((y*nz-z*ny)*pl*pl,9), round((z*nx-x*nz)*pl*pl,9), round((x*ny-y*nx)*pl*pl,9), round(-(y*nz-z*ny)*pl*pl,9), round(-(z*nx-x*nz)*pl*pl,9), round(-(x*ny-y*nx)*pl*pl,9), round(abs(nx)*pl*pl,9), round(abs(ny)*pl*pl,9), round(abs(nz)*pl*pl,9)])+0.0 AS s FROM (SELECT * REPLACE (CAST(pl AS DOUBLE) AS pl, CAST(nz AS DOUBLE) AS nz) FROM ft) f) a) b WHERE r<=50""", "points", "pixels", _FEAT))
def observability(spark, sf_dir):
    return select.observability_lists(_features(spark, sf_dir), 50)


@query("k5_normal_moments", oracle("SELECT frame_id, count(*) AS n, round(sum(nx*nx),4)+0.0 AS sxx, round(sum(nx*ny),4)+0.0 AS sxy FROM ft GROUP BY 1", "points", "pixels", _FEAT))
def normal_moments(spark, sf_dir):
    return select.normal_moments(_features(spark, sf_dir)).select("frame_id", "n", (F.round("sxx", 4) + 0.0).alias("sxx"), (F.round("sxy", 4) + 0.0).alias("sxy"))


@query("k4_greedy_logdet")
def greedy_logdet(spark, sf_dir):
    return select.greedy_logdet(_features(spark, sf_dir))


@query("k5_constraint_sphere")
def constraint_sphere(spark, sf_dir):
    return select.constraint_sphere(_features(spark, sf_dir), 40)
