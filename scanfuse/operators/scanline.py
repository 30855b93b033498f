"""Window operators along scan lines, columns and Livox sequences. Windows are partitioned by frame and line, which a sensor bounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfuse.functions import geom as G
from scanfuse.operators.project import break_distance


def _frame():
    return Window.partitionBy("frame_id").orderBy("row_id", "col_id")


def _line():
    return Window.partitionBy("frame_id", "row_id").orderBy("col_id")


def _column():
    return Window.partitionBy("frame_id", "col_id").orderBy("row_id")

_XYZ = ("x", "y", "z")


def _step(w, k: int) -> G.Vec:
    """The vector from the row before (k = 1) or to the row after (k = −1)."""
    return tuple((F.col(a) - F.lag(a, 1).over(w)) if k == 1 else (F.lead(a, 1).over(w) - F.col(a)) for a in _XYZ)  # type: ignore[return-value]


def curvature(image: DataFrame) -> DataFrame:
    """Adds curvature: the squared sum of range differences to the five pixels on either side, over a frame's lines one after another. Null at the frame's ends."""
    w = _frame().rowsBetween(-5, 5)
    value = F.sum("rng").over(w) - 11 * F.col("rng")
    return image.withColumn("curvature", F.when(F.count("*").over(w) == 11, value * value))


def occlusion_mask(image: DataFrame) -> DataFrame:
    """Adds masked: six pixels on the far side of a jump in range between pixels at most ten columns apart, and beams nearly parallel to a surface."""
    r, nxt, prev = F.col("rng"), F.lead("rng").over(_frame()), F.lag("rng").over(_frame())
    close = F.abs(F.lead("col_id").over(_frame()) - F.col("col_id")) < 10
    parallel = (F.abs(prev - r) > 0.02 * r) & (F.abs(nxt - r) > 0.02 * r)
    flags = image.withColumns({
        "_here": F.coalesce(close & (r - nxt > 0.3), F.lit(False)).cast("int"),
        "_next": F.coalesce(close & (nxt - r > 0.3), F.lit(False)).cast("int"),
        "_parallel": F.coalesce(parallel, F.lit(False)).cast("int"),
    })
    back = F.max("_here").over(_frame().rowsBetween(0, 5))
    ahead = F.coalesce(F.max("_next").over(_frame().rowsBetween(-6, -1)), F.lit(0))
    return flags.withColumn("masked", F.greatest(back, ahead, F.col("_parallel")) == 1).drop("_here", "_next", "_parallel")


def ranked_features(curved: DataFrame, cols: int, sectors: int = 6) -> DataFrame:
    """Adds sector, and rank in it by falling (sharp_rank) and rising (flat_rank) curvature; no suppression of neighbours."""
    on = curved.withColumn("sector", F.floor(F.col("col_id") * sectors / cols).cast("int"))
    w = Window.partitionBy("frame_id", "row_id", "sector")
    return on.withColumns({"sharp_rank": F.row_number().over(w.orderBy(F.desc("curvature"), "pt_id")), "flat_rank": F.row_number().over(w.orderBy("curvature", "pt_id"))})


def pick_features(curved: DataFrame, cols: int, edge: float = 0.1, surf: float = 0.1, sharp: int = 2, less: int = 20, flat: int = 4, sectors: int = 6) -> DataFrame:
    """feature of each picked pixel: sharp, less_sharp, flat, or less_flat for the rest; masked pixels are never picked.

    In a sector the picks go by curvature and each keeps others off within five pixels, as far as columns run on within ten. One scan line is one group.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col_id").reset_index(drop=True)
        curv, col = pdf["curvature"].fillna(-1).to_numpy(), pdf["col_id"].to_numpy()
        taken, label = pdf["masked"].to_numpy(dtype=bool).copy(), np.full(len(pdf), "less_flat", dtype=object)
        sector = col * sectors // cols

        def suppress(k: int) -> None:
            taken[k] = True
            for side in (1, -1):
                for o in range(1, 6):
                    j = k + side * o
                    if not 0 <= j < len(col) or abs(col[j] - col[j - side]) > 10:
                        break
                    taken[j] = True

        for s in range(sectors):
            at = np.flatnonzero((sector == s) & (curv >= 0))
            count = 0
            for k in at[np.lexsort((pdf["pt_id"].to_numpy()[at], -curv[at]))]:
                if count >= less or curv[k] <= edge:
                    break
                if not taken[k]:
                    count += 1
                    label[k] = "sharp" if count <= sharp else "less_sharp"
                    suppress(k)
            count = 0
            for k in at[np.lexsort((pdf["pt_id"].to_numpy()[at], curv[at]))]:
                if count >= flat or curv[k] >= surf:
                    break
                if not taken[k]:
                    count += 1
                    label[k] = "flat"
                    suppress(k)
        return pd.DataFrame({"frame_id": pdf["frame_id"], "row_id": pdf["row_id"], "col_id": pdf["col_id"], "pt_id": pdf["pt_id"], "feature": label})

    return curved.groupBy("frame_id", "row_id").applyInPandas(pick, "frame_id int, row_id int, col_id int, pt_id long, feature string")


def livox_features(points: DataFrame, line: str = "line_id", order: str = "pt_id") -> DataFrame:
    """Per point of a Livox line: depth, the sums of the four neighbours on either side less the point (left_curv, right_curv), the angle's cosine between the sides and the gaps."""
    w = Window.partitionBy("frame_id", line).orderBy(order)
    lag, lead = (lambda a, k: F.lag(a, k).over(w)), (lambda a, k: F.lead(a, k).over(w))

    def curve(get) -> Column:
        parts = [get(a, 1) + get(a, 2) + get(a, 3) + get(a, 4) - 4 * F.col(a) for a in _XYZ]
        return G.norm(*parts)

    left_dir = tuple(sum((lag(a, k) for k in range(2, 5)), lag(a, 1)) / 4 - F.col(a) for a in _XYZ)
    right_dir = tuple(sum((lead(a, k) for k in range(2, 5)), lead(a, 1)) / 4 - F.col(a) for a in _XYZ)
    gap = [G.distance(G.vec(), tuple(g(a, 1) for a in _XYZ)) for g in (lag, lead)]
    cos = G.dot(left_dir, right_dir) / F.greatest(G.norm(*left_dir) * G.norm(*right_dir), F.lit(_TINY))
    return points.withColumns({"depth": G.norm(*map(F.col, _XYZ)), "left_curv": curve(lag), "right_curv": curve(lead), "cos_sides": cos, "gap_left": gap[0], "gap_right": gap[1]})


_TINY = 1e-12


def _toward(k: int) -> G.Vec:
    """The unit vector from a point to the one k places on (before it: negative), of the columns that livox_labels adds."""
    return tuple((F.col(f"b{k}.{a}") - F.col(a)) / F.col(f"size{k}") for a in _XYZ)  # type: ignore[return-value]


def _between(side: int, reach: int) -> G.Vec:
    """The mean direction of the next `reach` points of a side, the farther the weightier."""
    units = [(k, _toward(side * k)) for k in range(1, reach + 1)]
    return tuple(sum((k * u[i] for k, u in units[1:]), units[0][1][i]) / (reach * (reach + 1) / 2) for i in range(3))  # type: ignore[return-value]


def _cosine(a: G.Vec, b: G.Vec) -> Column:
    return F.abs(G.dot(a, b)) / F.greatest(G.norm(*a) * G.norm(*b), F.lit(_TINY))


def _spread(side: int) -> list[Column]:
    """The covariance (xx, xy, xz, yy, yz, zz) of the point and the three beside it."""
    four = [G.vec(), *(tuple(F.col(f"b{side * k}.{a}") for a in _XYZ) for k in (1, 2, 3))]
    total = lambda i, j: sum((p[i] * p[j] for p in four[1:]), four[0][i] * four[0][j]) / 4
    mean = [sum((p[i] for p in four[1:]), four[0][i]) / 4 for i in range(3)]
    return [total(i, j) - mean[i] * mean[j] for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]


def livox_labels(points: DataFrame, line: str = "line_id", order: str = "pt_id", corners_in_surf: bool = False) -> DataFrame:
    """Adds label, is_corner and is_surf to the points of Livox lines; every point is tested.

    bend of a point: squared length of its four neighbours' sum (two a side) less four times itself. Rules, the first that holds:
    outlier: both gaps over 0.1 of the depth. break: the gaps differ by over 0.1; the four points on the side of the smaller gap lie on a line and are evenly
    spaced (largest step under twice the smallest), that side's fourth neighbour is within 0.05 of the depth and not along the beam (cosine under 0.8), the
    point across the gap is farther, and the two sides' mean directions over three points have a cosine under 0.8; where only this last fails, other.
    corner: the bends two places before and after are under 0.01, the sides' directions over four points have a cosine under 0.5 and the fourth neighbours
    are over 0.05 away. surf: the bend is under 0.001. Else other. Points with fewer than five on a side can be surf with three a side, or edge_of_line.
    """
    w = Window.partitionBy("frame_id", line).orderBy(order)
    here = F.struct(*_XYZ)
    steps = [*range(-4, 0), *range(1, 5)]
    on = points.withColumns({**{f"b{k}": F.lead(here, k).over(w) for k in steps}, "before": F.row_number().over(w) - 1, "all": F.count("*").over(Window.partitionBy("frame_id", line))})
    on = on.withColumn("after", F.col("all") - F.col("before") - 1)
    bend = sum((G.dot(v, v) for v in [tuple(F.col(f"b-2.{a}") + F.col(f"b-1.{a}") + F.col(f"b1.{a}") + F.col(f"b2.{a}") - 4 * F.col(a) for a in _XYZ)]), F.lit(0.0))
    on = on.withColumn("bend", bend).withColumns({"bend_l": F.lag("bend", 2).over(w), "bend_r": F.lead("bend", 2).over(w)})
    for side, name in ((-1, "l"), (1, "r")):  # in steps, so that no expression holds another one many times
        on = on.withColumns({f"{name}{k}": v for k, v in enumerate(_spread(side))})
        xx, xy, xz, yy, yz, zz = (F.col(f"{name}{k}") for k in range(6))
        on = on.withColumn(f"{name}_q", (xx + yy + zz) / 3)
        q, p = F.col(f"{name}_q"), F.col(f"{name}_p")
        xx, yy, zz = xx - q, yy - q, zz - q
        on = on.withColumn(f"{name}_p", F.greatest(F.sqrt((xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)) / 6), F.lit(_TINY)))
        half_det = G.det3(xx, xy, xz, xy, yy, yz, xz, yz, zz) / (2 * p * p * p)
        on = on.withColumn(f"{name}_phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half_det))) / 3)
        phi = F.col(f"{name}_phi")
        on = on.withColumns({f"{name}_long": q + 2 * p * F.cos(phi), f"{name}_mid": q + 2 * p * F.cos(phi - 2 * math.pi / 3)})
    on = on.withColumns({f"size{k}": F.greatest(G.distance(tuple(F.col(f"b{k}.{a}") for a in _XYZ), G.vec()), F.lit(_TINY)) for k in steps})
    for k in (3, 4):
        on = on.withColumns({f"{name}{k}d{a}": v for name, side in (("from", -1), ("to", 1)) for a, v in zip(_XYZ, _between(side, k))})
        on = on.withColumn(f"cos{k}", _cosine(tuple(F.col(f"from{k}d{a}") for a in _XYZ), tuple(F.col(f"to{k}d{a}") for a in _XYZ)))
    depth = G.norm(*G.vec())
    far = {k: tuple(F.col(f"b{k}.{a}") for a in _XYZ) for k in (-4, -3, -2, -1, 1, 2, 3, 4)}
    gap_l, gap_r = G.distance(far[-1], G.vec()), G.distance(far[1], G.vec())

    def breaks(side: int) -> Column:
        steps = [G.distance(G.vec(), far[side]), G.distance(far[side], far[2 * side]), G.distance(far[2 * side], far[3 * side])]
        away = tuple(F.col(f"b{4 * side}.{a}") - F.col(a) for a in _XYZ)
        even = F.greatest(*steps) < 2 * F.least(*steps)
        return (F.col("l_long" if side < 0 else "r_long") > 100 * F.col("l_mid" if side < 0 else "r_mid")) & even & (G.norm(*away) < 0.05 * depth) & (_cosine(away, G.vec()) < 0.8) & (G.norm(*far[-side]) > G.norm(*far[side]))

    inside = (F.col("before") >= 5) & (F.col("after") >= 5)
    flat = F.col("bend") < 0.001
    candidate = (F.abs(gap_r - gap_l) > 0.1) & F.when(gap_r > gap_l, breaks(-1)).otherwise(breaks(1))
    corner = (F.col("bend_l") < 0.01) & (F.col("bend_r") < 0.01) & (F.col("cos4") < 0.5) & (G.distance(far[-4], G.vec()) > 0.05) & (G.distance(far[4], G.vec()) > 0.05)
    label = (
        F.when(~inside & flat & (F.col("before") >= 3) & (F.col("after") >= 3), "surf")
        .when(~inside, "edge_of_line")
        .when((gap_l > 0.1 * depth) & (gap_r > 0.1 * depth), "outlier")
        .when(candidate, F.when(F.col("cos3") < 0.8, "break").otherwise("other"))
        .when(corner, "corner")
        .when(flat, "surf")
        .otherwise("other")
    )
    out = on.withColumn("label", label).withColumn("is_corner", F.col("label").isin("break", "corner"))
    surf = F.col("label") == "surf"
    return out.select(*points.columns, "label", "is_corner", (surf | F.col("is_corner") if corners_in_surf else surf).alias("is_surf"))


def line_segments(image: DataFrame, factor: float = 1.06, jump: float = 9.0) -> DataFrame:
    """Adds segment, numbered from 0 along each scan line: it breaks where neighbours lie farther apart than factor × the adaptive distance or jump × the gap before."""
    gap = G.norm(*_step(_line(), 1))
    on = image.withColumn("gap", gap)
    far = (F.col("gap") > factor * break_distance(F.col("rng"))) | (F.col("gap") > jump * F.lag("gap").over(_line()))
    return on.withColumn("_break", F.coalesce(far, F.lit(False)).cast("int")).withColumn("segment", F.sum("_break").over(_line().rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_break")



def _segment():
    return Window.partitionBy("frame_id", "row_id", "segment").orderBy("col_id")



def resample_lines(segmented: DataFrame, step: float = 0.08) -> DataFrame:
    """One point per `step` metres of arc length of a segment: the first in each bucket."""
    moved = F.coalesce(G.norm(*_step(_segment(), 1)), F.lit(0.0))
    on = segmented.withColumn("_moved", moved).withColumn("arc", F.sum("_moved").over(_segment().rowsBetween(Window.unboundedPreceding, 0)))
    on = on.withColumn("bucket", F.floor(F.round(F.col("arc"), 9) / step).cast("int"))
    return on.groupBy("frame_id", "row_id", "segment", "bucket").agg(F.min(F.struct("col_id", "pt_id")).alias("m")).select("frame_id", "row_id", "segment", "bucket", "m.pt_id")


def direction_lines(segmented: DataFrame, turn: float = 45.0, least_points: int = 5, least_length: float = 0.5) -> DataFrame:
    """Runs of a segment between turns of more than `turn` degrees: frame_id, row_id, segment, run, n, length, label (SURF for long runs, else EDGE)."""
    a, b = _step(_segment(), 1), _step(_segment(), -1)
    cos = G.dot(a, b) / (G.norm(*a) * G.norm(*b))
    turning = F.coalesce(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(cos, 9))))) > turn, F.lit(False))
    on = segmented.withColumns({"_turn": turning.cast("int"), "_moved": F.coalesce(G.norm(*a), F.lit(0.0))})
    on = on.withColumn("run", F.coalesce(F.sum("_turn").over(_segment().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    runs = on.groupBy("frame_id", "row_id", "segment", "run").agg(F.count("*").alias("n"), F.sum("_moved").alias("length"))
    return runs.withColumn("label", F.when((F.col("n") > least_points) & (F.col("length") > least_length), "SURF").otherwise("EDGE"))


def weighted_smoothness(image: DataFrame) -> DataFrame:
    """Adds smoothness: range differences to three pixels on either side of the line, weighted by exp(−4·distance²)."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for k in (-3, -2, -1, 1, 2, 3):
        get = lambda a, k=k: F.lag(a, abs(k)).over(_line()) if k < 0 else F.lead(a, k).over(_line())
        w = F.exp(-4 * G.sq_distance(G.vec(), tuple(get(a) for a in _XYZ)))
        total = total + F.coalesce(w * (get("rng") - F.col("rng")), F.lit(0.0))
        weight = weight + F.coalesce(w, F.lit(0.0))
    return image.withColumn("smoothness", F.when(weight > 0, F.abs(total) / weight))


def polyline_splits(segmented: DataFrame, limit: float = 0.15) -> DataFrame:
    """The points that Douglas-Peucker keeps of each segment: frame_id, row_id, segment, col_id, pt_id. One scan line is one group."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["segment", "col_id"])
        keep = np.zeros(len(pdf), bool)
        p, seg = pdf[list(_XYZ)].to_numpy(), pdf["segment"].to_numpy()
        bounds = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True])
        stack = [(a, b - 1) for a, b in zip(bounds, bounds[1:])]
        while stack:
            a, b = stack.pop()
            keep[[a, b]] = True
            if b - a < 2:
                continue
            d = p[b] - p[a]
            off = p[a + 1 : b] - p[a]
            size = np.linalg.norm(d)
            away = np.linalg.norm(np.cross(off, d), axis=1) / size if size > 1e-12 else np.linalg.norm(off, axis=1)
            if away.max() > limit:
                k = a + 1 + int(away.argmax())
                stack += [(a, k), (k, b)]
        return pdf.loc[keep, ["frame_id", "row_id", "segment", "col_id", "pt_id"]]

    return segmented.groupBy("frame_id", "row_id").applyInPandas(split, "frame_id int, row_id int, segment int, col_id int, pt_id long")


def vertical_chains(image: DataFrame, bend: float = 30.0, steep: float = 45.0, flat: float = 9.0) -> DataFrame:
    """Adds up_slope (degrees to the pixel above), chain and vertical: three consecutive rows of a column that bend less than `bend` and rise at least `steep` make one chain."""
    a, b = _step(_column(), 1), _step(_column(), -1)
    adjacent = (F.col("row_id") - F.lag("row_id").over(_column()) == 1) & (F.lead("row_id").over(_column()) - F.col("row_id") == 1)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(G.dot(a, b) / (G.norm(*a) * G.norm(*b)), 9)))
    slope = lambda v: F.degrees(F.atan2(v[2], G.norm(v[0], v[1])))
    middle = F.coalesce(adjacent & (F.degrees(F.acos(cos)) < bend) & (F.abs(slope(a)) >= steep) & (F.abs(slope(b)) >= steep), F.lit(False)).cast("int")
    on = image.withColumns({"up_slope": slope(b), "_mid": middle})
    on = on.withColumn("vertical", F.greatest(F.col("_mid"), F.coalesce(F.lag("_mid").over(_column()), F.lit(0)), F.coalesce(F.lead("_mid").over(_column()), F.lit(0))) == 1)
    starts = (F.col("vertical") & ~F.coalesce(F.lag("vertical").over(_column()), F.lit(False))).cast("int")
    on = on.withColumn("_start", starts).withColumn("chain", F.when(F.col("vertical"), F.sum("_start").over(_column().rowsBetween(Window.unboundedPreceding, 0)).cast("int")))
    return on.withColumn("flat", F.coalesce(F.abs(F.col("up_slope")) < flat, F.lit(False))).drop("_mid", "_start")


def ground_by_slope(image: DataFrame, rows: int = 7, limit: float = 10.0, mount: float = 0.0) -> DataFrame:
    """Adds is_ground: both pixels of a pair of rows under `rows` whose slope differs from the mount angle by at most `limit` degrees."""
    v = _step(_column(), -1)
    pair = (F.col("row_id") < rows) & (F.lead("row_id").over(_column()) - F.col("row_id") == 1)
    flat = F.coalesce(pair & (F.abs(F.degrees(F.atan2(v[2], G.norm(v[0], v[1]))) - mount) <= limit), F.lit(False)).cast("int")
    return image.withColumn("_flat", flat).withColumn("is_ground", F.greatest(F.col("_flat"), F.coalesce(F.when(F.col("row_id") - F.lag("row_id").over(_column()) == 1, F.lag("_flat").over(_column())), F.lit(0))) == 1).drop("_flat")


def relabel_ground(image: DataFrame, limit: float = 10.0) -> DataFrame:
    """Adds ground_run: from the lowest row of a column up, ground as long as every pair of pixels so far is flat."""
    v = _step(_column(), 1)
    steep = F.coalesce(F.abs(F.degrees(F.atan2(v[2], G.norm(v[0], v[1])))) > limit, F.lit(False)).cast("int")
    return image.withColumn("_steep", steep).withColumn("ground_run", F.max("_steep").over(_column().rowsBetween(Window.unboundedPreceding, 0)) == 0).drop("_steep")


def farthest_ground(image: DataFrame) -> DataFrame:
    """max_ground: per column of a frame the range of its farthest ground pixel."""
    return image.where("is_ground").groupBy("frame_id", "col_id").agg(F.max("rng").alias("max_ground"))


def above_ground(image: DataFrame) -> DataFrame:
    """Pixels that are not ground and nearer than their column's farthest ground."""
    return image.where("NOT is_ground").join(farthest_ground(image), ["frame_id", "col_id"]).where(F.col("rng") < F.col("max_ground"))


def thinned(image: DataFrame, each: int = 5) -> DataFrame:
    """Segmented pixels and every fifth ground column, with start and end of each row in the output (index of the fifth pixel from either end)."""
    kept = image.where(~F.col("is_ground") | (F.col("col_id") % each == 0) | (F.col("col_id") <= 5))
    at = kept.withColumn("idx", (F.row_number().over(_frame()) - 1).cast("int"))
    return at.groupBy("frame_id", "row_id").agg((F.min("idx") + 5).alias("start_idx"), (F.max("idx") - 5).alias("end_idx"), F.count("*").alias("n"))


def line_density(image: DataFrame) -> DataFrame:
    """Mean planar range and number of pixels per scan line."""
    return image.groupBy("frame_id", "row_id").agg(F.avg(G.norm(F.col("x"), F.col("y"))).alias("mean_range"), F.count("*").alias("n"))
