"""Voxels and pixels: down-sampling, nearest returns, occupancy, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfuse.functions import geom as G

CELL = ["vx", "vy", "vz"]


def cells(points: DataFrame, leaf: float, leaf_z: float | None = None) -> DataFrame:
    """Adds the cell numbers vx, vy, vz; floor, so negative multiples stay in their own cell."""
    return points.withColumns({v: F.floor(F.col(a) / s).cast("long") for v, a, s in zip(CELL, ("x", "y", "z"), (leaf, leaf, leaf_z or leaf))})


def voxel_centroids(points: DataFrame, leaf: float, leaf_z: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """One centroid per voxel (and keys), with its number of points. Partial sums combine before the shuffle."""
    return cells(points, leaf, leaf_z).groupBy(*keys, *CELL).agg(*(F.avg(a).alias(a) for a in ("x", "y", "z")), F.count("*").alias("n"))


def voxel_samples(points: DataFrame, leaf: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Of each voxel the original point closest to its middle; the smaller pt_id wins a tie."""
    on = cells(points, leaf)
    off = sum(((F.col(a) - (F.col(v) + 0.5) * leaf) * (F.col(a) - (F.col(v) + 0.5) * leaf) for a, v in zip(("y", "z"), CELL[1:])), (F.col("x") - (F.col("vx") + 0.5) * leaf) * (F.col("x") - (F.col("vx") + 0.5) * leaf))
    best = F.min(F.struct(off.alias("off"), F.col("pt_id").alias("pt_id"), F.col("x").alias("x"), F.col("y").alias("y"), F.col("z").alias("z"))).alias("b")
    return on.groupBy(*keys, *CELL).agg(best).select(*keys, *CELL, "b.pt_id", "b.x", "b.y", "b.z")


def nearest_returns(pixels: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """The front surface: of each pixel the nearest point (smaller pt_id on a tie), with the number of returns."""
    return pixels.groupBy(*keys, "row_id", "col_id").agg(F.min(F.struct("rng", "pt_id")).alias("b"), F.count("*").alias("n")).select(*keys, "row_id", "col_id", "b.rng", "b.pt_id", "n")


def nearest_in_image(pixels: DataFrame) -> DataFrame:
    """As nearest_returns without keys: one image, which bounds the pixels, of any number of points.

    The ranges come first, then the points at them, both as minima of numbers, which combine by hash in each task; the minimum of a pair would sort all points.
    """
    least = pixels.groupBy("row_id", "col_id").agg(F.min("rng").alias("_rng"), F.count("*").alias("_n"))
    at = pixels.select("row_id", "col_id", "rng", "pt_id").join(F.broadcast(least), ["row_id", "col_id"]).where("rng = _rng")
    return at.groupBy("row_id", "col_id").agg(F.min("rng").alias("rng"), F.min("pt_id").alias("pt_id"), F.min("_n").alias("n"))


def front(pixels: DataFrame) -> DataFrame:
    """The rows of pixels that nearest_returns names, with all their columns. Rows are dealt by frame once: the windows and groups inside frames that follow need no further shuffle."""
    w = Window.partitionBy("frame_id", "row_id", "col_id").orderBy("rng", "pt_id")
    return pixels.repartition("frame_id").withColumn("_nr", F.row_number().over(w)).where("_nr = 1").drop("_nr")


def projection_counts(pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """Per frame: points that share a pixel with a nearer one, and points off the image by row and by column. pixels: not filtered by row or column."""
    inside = F.col("row_id").between(0, rows - 1) & F.col("col_id").between(0, cols - 1)
    per = pixels.groupBy("frame_id", "row_id", "col_id").agg(F.count("*").alias("n"), F.first(inside).alias("inside"))
    return per.groupBy("frame_id").agg(
        F.sum(F.when(F.col("inside"), F.col("n") - 1).otherwise(0)).alias("overlaps"),
        F.sum(F.when(~F.col("row_id").between(0, rows - 1), F.col("n")).otherwise(0)).alias("bad_rows"),
        F.sum(F.when(~F.col("col_id").between(0, cols - 1), F.col("n")).otherwise(0)).alias("bad_cols"),
    )


def last_returns(pixels: DataFrame) -> DataFrame:
    """Of each pixel the point that was written last, by pt_id."""
    return pixels.groupBy("frame_id", "row_id", "col_id").agg(F.max(F.struct("pt_id", "rng")).alias("b")).select("frame_id", "row_id", "col_id", "b.pt_id", "b.rng")


def outdoor_frames(pixels: DataFrame, far: float = 60.0, least: int = 20) -> DataFrame:
    return pixels.groupBy("frame_id").agg(F.count_if(F.col("rng") > far).alias("n_far"), (F.count_if(F.col("rng") > far) >= least).alias("outdoor"))


def capped_voxels(points: DataFrame, leaf: float, cap: int, centre: tuple[float, float, float] = (0, 0, 0), far: float = 100.0) -> DataFrame:
    """A voxel map that takes the first `cap` points of a voxel, by frame and pt_id, and forgets those farther than `far` from the centre."""
    w = Window.partitionBy(*CELL).orderBy("frame_id", "pt_id")
    near = points.where(G.distance(G.vec(), tuple(map(F.lit, centre))) <= far)
    return cells(near, leaf).withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= cap).drop("nr")


def crossed(segments: DataFrame, leaf: float, keep: tuple[str, ...]) -> DataFrame:
    """The voxels that each segment from (tx, ty, tz) to (x, y, z) passes: the columns to keep, vx, vy, vz and u, the share of the way at which the segment enters the voxel.

    Exact: a segment enters a voxel where it crosses a plane of the grid. All crossings of the three axes, sorted, cut it into pieces, and a piece's middle names its voxel. Pieces shorter than 1e-12 of the way,
    as at an edge or corner, name none.
    """
    ends = {v: (F.col("t" + v) / leaf, F.col(v) / leaf) for v in "xyz"}
    cuts = [F.array(F.lit(0.0), F.lit(1.0))]
    for a, b in ends.values():
        lo, hi = F.floor(F.least(a, b)) + 1, F.ceil(F.greatest(a, b)) - 1
        cuts.append(F.when(lo <= hi, F.transform(F.sequence(lo, hi), _share(a, b))).otherwise(F.array().cast("array<double>")))
    on = segments.select(*keep, *(e.alias(f"_{k}{v}") for v, (a, b) in ends.items() for k, e in (("a", a), ("b", b - a))), F.array_sort(F.concat(*cuts)).alias("_cuts"))
    n = F.size("_cuts") - 1
    on = on.withColumn("_piece", F.explode(F.arrays_zip(F.slice("_cuts", 1, n).alias("u"), F.slice("_cuts", 2, n).alias("w"))))
    u, w = F.col("_piece.u"), F.col("_piece.w")
    return on.where(w - u > 1e-12).select(*keep, *(F.floor(F.col("_a" + v) + (u + w) / 2 * F.col("_b" + v)).cast("long").alias(c) for v, c in zip("xyz", CELL)), u.alias("u"))


def _share(a: Column, b: Column) -> Callable[[Column], Column]:
    return lambda k: (k - a) / (b - a)


def occupancy(points: DataFrame, origins: DataFrame, leaf: float, step: float | None, hit: float = 0.85, miss: float = -0.4, low: float = -2.0, high: float = 3.5, far: float = 50.0) -> DataFrame:
    """vx, vy, vz, log_odds: voxels that ray ends hit and voxels that rays cross, each once per frame; a voxel hit in a frame is not missed in it.

    Rays start at the frame's origin (frame_id, tx, ty, tz). They are sampled every `step` metres, ends excluded; without a step every voxel that a ray passes is found. Sums are clamped once at the end, so order does not matter.
    """
    ray = points.join(origins.select("frame_id", "tx", "ty", "tz"), "frame_id")
    d = G.distance(G.vec(), G.vec("t"))
    ray = ray.withColumn("d", d).where(F.col("d") <= far)
    ends = cells(ray, leaf).select("frame_id", *CELL).distinct()
    if step is None:
        every = crossed(ray, leaf, ("frame_id",)).drop("u").distinct()
        return _log_odds(ends, every.join(ends, ["frame_id", *CELL], "left_anti"), hit, miss, low, high)
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("d") - leaf) / step).cast("int"), F.lit(0))))
    sample = ray.select("frame_id", "x", "y", "z", "tx", "ty", "tz", "d", k.alias("k")).withColumn("u", F.col("k") * step / F.col("d"))
    sample = sample.select("frame_id", *(F.floor((F.col("t" + a) + F.col("u") * (F.col(a) - F.col("t" + a))) / leaf).cast("long").alias(v) for a, v in zip(("x", "y", "z"), CELL))).distinct()
    return _log_odds(ends, sample.join(ends, ["frame_id", *CELL], "left_anti"), hit, miss, low, high)


def _log_odds(ends: DataFrame, free: DataFrame, hit: float, miss: float, low: float, high: float) -> DataFrame:
    odds = ends.withColumn("o", F.lit(hit)).unionByName(free.withColumn("o", F.lit(miss)))
    return odds.groupBy(*CELL).agg(F.greatest(F.lit(low), F.least(F.lit(high), F.sum("o"))).alias("log_odds"))


def occupied_points(points: DataFrame, grid: DataFrame, leaf: float, least: float = 0.4) -> DataFrame:
    """Points whose voxel is occupied with a probability of at least `least`."""
    full = grid.where(1 / (1 + F.exp(-F.col("log_odds"))) >= least).select(*CELL)
    return cells(points, leaf).join(full, CELL, "left_semi").drop(*CELL)


def visible_voxels(rays: DataFrame, grid: DataFrame, leaf: float, step: float | None, far: float, least: float = 0.5) -> DataFrame:
    """The first occupied voxel along each ray (ray_id, tx, ty, tz, dx, dy, dz of length 1): ray_id, t. Rays are sampled every `step` metres; without a step, t is where the ray enters the voxel, and none is missed."""
    full = grid.where(1 / (1 + F.exp(-F.col("log_odds"))) >= least).select(*CELL)
    if step is None:
        on = crossed(rays.withColumns({v: F.col("t" + v) + far * F.col("d" + v) for v in "xyz"}), leaf, ("ray_id",))
        return on.join(full, CELL, "left_semi").groupBy("ray_id").agg((F.min("u") * far).alias("t"))
    s = rays.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(int(far / step))))).withColumn("t", F.col("t") * step)
    s = s.select("ray_id", "t", *(F.floor((F.col("t" + a) + F.col("t") * F.col("d" + a)) / leaf).cast("long").alias(v) for a, v in zip(("x", "y", "z"), CELL)))
    return s.join(full, CELL, "left_semi").groupBy("ray_id").agg(F.min("t").alias("t"))


def recent(points: DataFrame, ts: Column, keep: float = 20.0) -> DataFrame:
    """Map points seen in the last `keep` seconds; the latest time is one number."""
    last = points.agg(F.max(ts).alias("_last"))
    return points.join(F.broadcast(last), ts >= F.col("_last") - keep).drop("_last")


def rolled_submaps(frames: DataFrame, most: int) -> DataFrame:
    """submap per frame (session_id, frame_id, n): a new one starts whenever another `most` points have gathered."""
    w = Window.partitionBy("session_id").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("submap", F.floor(F.coalesce(F.sum("n").over(w), F.lit(0)) / most).cast("int"))
