"""Change detection against a reference map and probabilistic fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfuse.functions.profile import SensorProfile
from scanfuse.operators import asof, grid, neighbors, stats
from scanfuse.operators.components import staged
from scanfuse.operators.project import project
from scanfuse.operators.trajectory import into_pose, transform_points, with_rotation

#: Probabilities of the statuses.
P_NEW, P_MOVED, P_STATIC, P_UNKNOWN = 0.55, 0.6, 0.4, 0.5


def covisible(reference: DataFrame, keyframes: DataFrame, reach: float = 60.0, least: int = 50_000, small: int = 20_000) -> DataFrame:
    """The reference points within ±reach in x of each keyframe's pose, in its frame: frame_id, pt_id, x, y, z. Keyframes with fewer than `least` drop.

    Cells in x, an eighth of the reach wide, tell how many points a keyframe sees: those strictly between its first and last cell it sees whole, and only where the two outer ones decide are points counted one by one.
    Keyframes that see enough carry their pose to their cells. Up to `small` of them go to every task, so points stay where they are; more of them meet the points by cell and one of 16 lots of points.
    """
    cell = lambda v: F.floor(v / (reach / 8)).cast("long")
    first, last = cell(F.col("tx") - reach), cell(F.col("tx") + reach)
    on = reference.where(~F.isnan("x")).select("pt_id", "x", "y", "z", cell(F.col("x")).alias("cell"))
    k = with_rotation(keyframes.withColumn("cell", F.explode(F.sequence(first, last))).withColumn("outer", F.col("cell").isin(first, last)), "frame_id", "cell", "outer")
    k = staged(k.join(on.groupBy("cell").agg(F.count("*").alias("n")), "cell"), "sees")  # keyframes by the cells that hold points
    sees = k.groupBy("frame_id").agg(F.sum(F.when(F.col("outer"), 0).otherwise(F.col("n"))).alias("sure"), F.sum("n").alias("most")).where(F.col("most") >= least)
    doubt = sees.where(F.col("sure") < least)
    some = sees.agg(F.count("*").alias("n"), F.count_if(F.col("sure") < least).alias("open")).first()
    within = F.col("x").between(F.col("__tx") - reach, F.col("__tx") + reach)
    meet = lambda rows, frames: _by_cell(on, rows.drop("n", "outer").join(frames.select("frame_id"), "frame_id", "left_semi"), some["n"] <= small).where(within)
    enough = sees.where(F.col("sure") >= least).select("frame_id")
    if some["open"]:
        counted = meet(k.where("outer"), doubt).groupBy("frame_id").agg(F.count("*").alias("n"))
        enough = enough.unionByName(doubt.join(counted, "frame_id").where(F.col("sure") + F.col("n") >= least).select("frame_id"))
    return into_pose(meet(k, enough), ["frame_id", "pt_id", "x", "y", "z"])


def _by_cell(points: DataFrame, keyframes: DataFrame, few: bool, lots: int = 16) -> DataFrame:
    """Points with the keyframes of their cell; few keyframes are broadcast."""
    if few:
        return points.join(F.broadcast(keyframes), "cell")
    lot = F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))
    return points.withColumn("lot", F.pmod("pt_id", F.lit(lots)).cast("int")).join(keyframes.withColumn("lot", lot), ["cell", "lot"])


def write_reference(reference: DataFrame, path: str, tile: float = 25.0) -> None:
    """The reference map (pt_id, x, y, z) as Parquet, a folder for each stretch of `tile` metres in x. Rows are dealt by (tile, pt_id) ranges, so that a crowded tile is several tasks' work."""
    on = reference.select("pt_id", "x", "y", "z", F.floor(F.col("x") / tile).cast("int").alias("tile_x"))
    on.repartitionByRange("tile_x", "pt_id").write.partitionBy("tile_x").parquet(path)


def covisible_tiles(spark: SparkSession, path: str, keyframes: DataFrame, reach: float = 60.0, least: int = 50_000, tile: float = 25.0, most: int = 10_000) -> DataFrame:
    """As `covisible`, of a map that write_reference has written: keyframes are joined by folder. Only folders that a keyframe can see are read: their numbers, `most` at the utmost, filter the scan; with more of them every folder is read and the join decides."""
    number = lambda v: F.floor(v / tile).cast("int")
    k = keyframes.select("frame_id", F.col("tx").alias("_tx"), F.explode(F.sequence(number(F.col("tx") - reach), number(F.col("tx") + reach))).alias("tile_x"))
    wanted = [r[0] for r in k.select("tile_x").distinct().limit(most + 1).collect()]
    ref = spark.read.schema("pt_id long, x double, y double, z double, tile_x int").parquet(path)
    near = (ref if len(wanted) > most else ref.where(F.col("tile_x").isin(wanted))).join(k, "tile_x")
    near = near.where(F.col("x").between(F.col("_tx") - reach, F.col("_tx") + reach)).select("frame_id", "pt_id", "x", "y", "z")
    enough = near.groupBy("frame_id").count().where(F.col("count") >= least).select("frame_id")
    return transform_points(near.join(enough, "frame_id", "left_semi"), keyframes, inverse=True)


def keyframe_changes(current: DataFrame, near: DataFrame, profile: SensorProfile, ratio: float = 0.06, far: float = 100.0) -> DataFrame:
    """Changes of keyframes of a moving sensor: each one's points against its own view of the reference. Both: frame_id, pt_id, x, y, z in the keyframe's frame; near as covisible gives it.

    A keyframe that sees too little of the reference says nothing: it has no rows.
    """
    seen = staged(view(near, profile), "seen")  # read twice: by its frames and by its pixels
    return difference(view(current, profile).join(seen.select("frame_id").distinct(), "frame_id", "left_semi"), seen, ratio, far)


def view(points: DataFrame, profile: SensorProfile, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """The view-traced cloud: the front surface that the sensor sees, one point per pixel."""
    pixels = project(points, profile)
    return grid.nearest_returns(pixels, keys) if keys else grid.nearest_in_image(pixels)


def reference_views(frames: DataFrame, seen: DataFrame, profile: SensorProfile) -> DataFrame:
    """The view (row_id, col_id, rng, pt_id) of a reference that every frame (frame_id) of a sensor at rest has before it.

    A frame brings its image's pixels, as many as the profile has, and these meet the view's by row and column. The view is the side to broadcast, one image of bounded size: left to estimates, which count frames and not
    their pixels, all frames' pixels went through the driver.
    """
    pixels = frames.select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(profile.rows - 1))).alias("row_id")).select("frame_id", "row_id", F.explode(F.sequence(F.lit(0), F.lit(profile.cols - 1))).alias("col_id"))
    return pixels.join(F.broadcast(seen.select("row_id", "col_id", "rng", "pt_id")), ["row_id", "col_id"])


def difference(current: DataFrame, reference: DataFrame, ratio: float = 0.06, far: float = 100.0) -> DataFrame:
    """Pixel-wise comparison (frame_id, row_id, col_id): change_type and the probabilities that current and reference points changed.

    Nothing is said of pixels beyond `far`, nor of those without a current return.
    """
    cur = current.select("frame_id", "row_id", "col_id", F.col("rng").alias("cur_rng"), F.col("pt_id").alias("cur_id"))
    ref = reference.select("frame_id", "row_id", "col_id", F.col("rng").alias("ref_rng"), F.col("pt_id").alias("ref_id"))
    out = cur.join(ref, ["frame_id", "row_id", "col_id"], "full_outer").withColumn("change_type", _kind(ratio, far))
    t = F.col("change_type")
    cur_prob = F.when(t == "new", P_NEW).when(t == "appeared", P_MOVED).when(t == "static", P_STATIC).otherwise(P_UNKNOWN)
    return out.withColumns({"cur_prob": cur_prob, "ref_prob": _ref_prob(t)})


def _kind(ratio: float, far: float) -> Column:
    c, r = F.col("cur_rng"), F.col("ref_rng")
    return (
        F.when((c > far) | (r > far), "skip")
        .when(c.isNull(), "unseen")
        .when(r.isNull(), "new")
        .when(r - c > ratio * r, "appeared")
        .when(r - c < -ratio * r, "disappeared")
        .otherwise("static")
    )


def _ref_prob(kind: Column) -> Column:
    return F.when(kind == "disappeared", P_MOVED).when(kind == "static", P_STATIC).otherwise(P_UNKNOWN)


def resting_observations(current: DataFrame, seen: DataFrame, profile: SensorProfile, ratio: float = 0.06, far: float = 100.0) -> DataFrame:
    """What the frames (points) of a sensor at rest say of a reference view's points: pt_id, frame_id, prob, as `difference` has it, of the pixels with a current return. All others are unseen, with a probability of one half: `fuse_status` counts these without rows.

    Of a pixel only the nearest range is wanted, which combines before the shuffle; the view, one image of bounded size, is the side to broadcast.
    """
    near = project(current, profile).groupBy("frame_id", "row_id", "col_id").agg(F.min("rng").alias("cur_rng"))
    on = near.join(F.broadcast(seen.select("row_id", "col_id", F.col("rng").alias("ref_rng"), "pt_id")), ["row_id", "col_id"])
    return on.select("pt_id", "frame_id", _ref_prob(_kind(ratio, far)).alias("prob"))


def fuse_status(observations: DataFrame, mode: str = "logodds", points: DataFrame | None = None, frames: DataFrame | None = None) -> DataFrame:
    """pt_id, change_prob of points observed with probabilities prob (pt_id, frame_id, prob).

    `logodds`: Bayes with a prior of one half; sums, so any order and any number of merges. `reference`: log-odds are added to the
    probability itself from one half on and cut to [0, 1], in keyframe order; a point that fell to 0 starts anew at one half.

    With points (pt_id, each once) and frames (frame_id, each once), every point is observed in every frame, with one half where observations, at most one a point and frame, have no row. Rows of one half are not made nor moved:
    they add nothing, and in the order of frames only whether one lies between two others is wanted.
    """
    logit = F.log(F.col("prob") / (1 - F.col("prob")))
    if mode == "logodds":
        sums = observations.groupBy("pt_id").agg(F.sum(logit).alias("s"))
        if points is not None:
            sums = points.join(frames.limit(1).select(F.lit(1)), F.lit(True), "left_semi").join(sums, "pt_id", "left").select("pt_id", F.coalesce("s", F.lit(0.0)).alias("s"))
        return sums.select("pt_id", (1 / (1 + F.exp(-F.col("s")))).alias("change_prob"))
    if points is not None:
        return _sparse_fold(observations.select("pt_id", "frame_id", logit.alias("l")).where("l <> 0"), points, frames)
    steps = F.transform(F.array_sort(F.collect_list(F.struct("frame_id", logit.alias("l")))), lambda s: s["l"])
    fold = F.aggregate("steps", F.lit(0.5), _step)
    return observations.groupBy("pt_id").agg(steps.alias("steps")).select("pt_id", fold.alias("change_prob"))


def _step(p: Column, l: Column) -> Column:
    return F.when(p > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), p + l))).otherwise(0.5)


def _sparse_fold(steps: DataFrame, points: DataFrame, frames: DataFrame) -> DataFrame:
    """The fold of fuse_status over steps (pt_id, frame_id, l) that are not 0. A step of 0 only takes a point at 0 to one half, and so do any number of them: a gap in the frames' numbers tells of one."""
    no = asof.scanned(frames.select(F.lit(0).alias("s"), "frame_id"), "s", "frame_id", no=(F.lit(1), "sum")).select("frame_id", F.col("no").cast("int").alias("no"))
    no = staged(no, "numbers")
    last = no.agg(F.max("no").alias("last"))
    after = F.when(F.col("p") > 0, F.col("p")).otherwise(0.5)

    def step(was: Column, s: Column) -> Column:
        p = F.when((was["p"] > 0) | (s["no"] == was["no"] + 1), was["p"]).otherwise(0.5)
        return F.struct(s["no"].alias("no"), _step(p, s["l"]).alias("p"))

    folded = F.aggregate("steps", F.struct(F.lit(0).alias("no"), F.lit(0.5).alias("p")), step)
    ends = steps.join(no, "frame_id").groupBy("pt_id").agg(F.array_sort(F.collect_list(F.struct("no", "l"))).alias("steps")).select("pt_id", folded.alias("e")).select("pt_id", "e.*")
    every = points.join(F.broadcast(last.where("last IS NOT NULL"))).join(ends, "pt_id", "left")
    return every.select("pt_id", F.when(F.col("p").isNull(), 0.5).when(F.col("no") == F.col("last"), F.col("p")).otherwise(after).alias("change_prob"))


def fuse_map(points: DataFrame, leaf: float, limit: float = 0.5) -> DataFrame:
    """A change-aware map of keyframe points (frame_id, pt_id, x, y, z, prob): per voxel the first keyframe's point nearest its middle and the fused status of later ones.

    A keyframe adds voxels only while the share of its voxels that are new stays under the limit; the first always does. Deterministic: voxels take the place of point-by-point insertion.
    """
    mine = grid.cells(points, leaf).groupBy(*grid.CELL, "frame_id").agg(F.sum(F.log(F.col("prob") / (1 - F.col("prob")))).alias("l"))
    owner = mine.groupBy(*grid.CELL).agg(F.min("frame_id").alias("owner"))
    on = mine.join(owner, grid.CELL)
    share = on.groupBy("frame_id").agg((F.avg((F.col("frame_id") == F.col("owner")).cast("double"))).alias("new_share"))
    first = F.broadcast(points.agg(F.min("frame_id").alias("first")))
    ok = share.join(first, (F.col("new_share") < limit) | (F.col("frame_id") == F.col("first"))).select(F.col("frame_id").alias("owner"))
    status = on.join(ok, "owner", "left_semi").groupBy(*grid.CELL, "owner").agg((1 / (1 + F.exp(-F.sum("l")))).alias("change_prob"), F.count("*").alias("seen"))
    best = grid.voxel_samples(points, leaf, ("frame_id",)).withColumnRenamed("frame_id", "owner")
    return status.join(best, [*grid.CELL, "owner"]).select("pt_id", "owner", "x", "y", "z", "seen", "change_prob")


def summary(changes: DataFrame) -> DataFrame:
    """Pixels per frame and change type, with the range of their columns."""
    return changes.groupBy("frame_id", "change_type").agg(F.count("*").alias("n"), F.min("col_id").alias("c_lo"), F.max("col_id").alias("c_hi"))


def confusion(changes: DataFrame, truth: str) -> DataFrame:
    """Counts of found against true change types."""
    return changes.groupBy(F.col(truth).alias("truth"), "change_type").agg(F.count("*").alias("n"))


def surfels(points: DataFrame, leaf: float, radius: float, k: int = 10, flat: float = 0.06, hits: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Surfels at voxel samples whose k nearest points lie within `flat` of their plane: pt_id, centre, covariance, normal's eigenvalue and confidence.

    Each hit (pt_id) adds ln(.55/.45) to a confidence of one half. With a key, each of its values is a map of its own, and the surfels carry it.
    """
    near = neighbors.sample_sets(points, leaf, k, radius, key)
    fits = stats.principal(stats.neighbour_planes(near, flat).where("valid"))
    out = fits.select(*([key] if key else []), F.col("q_id").alias("pt_id"), *((F.col("s" + a) / F.col("n")).alias("c" + a) for a in "xyz"), "l1", "cov_xx", "cov_xy", "cov_xz", "cov_yy", "cov_yz", "cov_zz", "nx", "ny", "nz", "worst")
    n = hits.groupBy("pt_id").agg(F.count("*").alias("hits")) if hits is not None else None
    out = out.join(n, "pt_id", "left") if n is not None else out.withColumn("hits", F.lit(0))
    return out.withColumn("confidence", 0.5 + F.coalesce("hits", F.lit(0)) * math.log(0.55 / 0.45))


def match_surfels(points: DataFrame, surfels_: DataFrame, radius: float, key: str | None = None) -> DataFrame:
    """Each point's nearest surfel inside the radius, by the surfel's true distance; with a key, of the surfels that share it."""
    targets = staged(surfels_.select(*([key] if key else []), "pt_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")), "surfels")  # read twice: counted and searched
    return neighbors.nearest(points, targets, 1, radius, key)

