"""Projections of points to range images and filters of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfuse.functions import geom as G
from scanfuse.functions.profile import SensorProfile


def spherical(points: DataFrame) -> DataFrame:
    """Adds rng, azimuth and elevation (degrees)."""
    return points.withColumns({"rng": G.norm(F.col("x"), F.col("y"), F.col("z")), "azimuth": G.azimuth(F.col("x"), F.col("y")), "elevation": G.elevation(F.col("x"), F.col("y"), F.col("z"))})


def column_of(profile: SensorProfile, turn: Column | None = None) -> Column:
    """turn: a column that holds `_turn`, for those who work it out once a row."""
    v = _turn(profile) if turn is None else turn
    near = F.when(F.abs(v - F.rint(v)) < 0.499, F.rint(v)).otherwise(F.round(v))  # as round, whose decimal arithmetic only what lies near a half needs
    first = (-near + profile.cols // 2).cast("int")
    return F.when(first >= profile.cols, first - profile.cols).otherwise(first)


def _turn(profile: SensorProfile) -> Column:
    return (G.azimuth(F.col("x"), F.col("y")) - 90.0) / profile.res_x


def _kept(points: DataFrame, row: Column, profile: SensorProfile) -> DataFrame:
    pixel = F.struct(row.alias("row_id"), _turn(profile).alias("_turn"), G.norm(F.col("x"), F.col("y"), F.col("z")).alias("rng"))
    kept = [c for c in points.columns if c not in ("row_id", "col_id", "rng")]
    out = points.select(*kept, F.inline(F.array(pixel)))  # worked out once a row, not again by the filter
    out = out.select(*kept, "row_id", column_of(profile, F.col("_turn")).alias("col_id"), "rng")
    return out.where(F.col("row_id").between(0, profile.rows - 1) & F.col("col_id").between(0, profile.cols - 1))


def project(points: DataFrame, profile: SensorProfile) -> DataFrame:
    """row_id, col_id, rng by evenly spread beams; points off the image drop. A row below the lowest beam is tested before the cast."""
    return _kept(points, G.whole((G.elevation(F.col("x"), F.col("y"), F.col("z")) + profile.bottom) / profile.res_y), profile)


def project_nearest_beam(points: DataFrame, profile: SensorProfile) -> DataFrame:
    """The row is the beam whose angle is closest; the lower beam wins a tie."""
    # in steps, each worked out once a row: the elevation, the smallest distance, the first beam that has it
    once = lambda df, name, value: df.select("*", F.inline(F.array(F.struct(value.alias(name)))))
    on = once(points, "_el", G.elevation(F.col("x"), F.col("y"), F.col("z")))
    off = [F.abs(F.lit(a) - F.col("_el")) for a in profile.beams]
    on = once(on, "_off", F.least(*off))
    row = F.lit(None).cast("int")
    for k, o in reversed(list(enumerate(off))):
        row = F.when(o == F.col("_off"), k).otherwise(row)
    return _kept(on, row, profile).drop("_el", "_off")


def project_with_ring(points: DataFrame, profile: SensorProfile) -> DataFrame:
    """The sensor's ring where it has one, else the computed row."""
    return _kept(points, F.coalesce(F.col("ring"), G.whole((G.elevation(F.col("x"), F.col("y"), F.col("z")) + profile.bottom) / profile.res_y)).cast("int"), profile)


def project_organised(points: DataFrame, index: Column, profile: SensorProfile, shift: tuple[int, ...]) -> DataFrame:
    """Pixels of a sensor that sends whole images: row and column from the place in the array, each row shifted by its own columns."""
    row = F.pmod(index, F.lit(profile.rows)).cast("int")
    by_row = F.element_at(F.array(*map(F.lit, shift)), row + 1)
    col = F.pmod(F.floor(index / profile.rows) + by_row, F.lit(profile.cols)).cast("int")
    return points.withColumns({"row_id": row, "col_id": col, "rng": G.norm(F.col("x"), F.col("y"), F.col("z"))})


def project_sphere(points: DataFrame, hres: float = 0.2, vres: float = 0.2, vfov: float = 60.0, max_range: float = 200.0) -> DataFrame:
    """Fine spherical image: row from the lower edge of the field of view, column from −180°."""
    out = points.withColumns({"row_id": F.round((G.elevation(F.col("x"), F.col("y"), F.col("z")) + vfov / 2) / vres).cast("int"), "col_id": F.round((G.azimuth(F.col("x"), F.col("y")) + 180.0) / hres).cast("int"), "rng": G.norm(F.col("x"), F.col("y"), F.col("z"))})
    return out.where(F.col("row_id").between(0, int(vfov / vres)) & F.col("col_id").between(0, int(360 / hres)) & (F.col("rng") < max_range))


def unproject_sphere(pixels: DataFrame, hres: float = 0.2, vres: float = 0.2, vfov: float = 60.0) -> DataFrame:
    """x, y, z of row_id, col_id, rng."""
    el, az = F.radians(F.col("row_id") * vres - vfov / 2), F.radians(F.col("col_id") * hres - 180.0)
    r = F.col("rng")
    return pixels.withColumns({"x": r * F.cos(el) * F.sin(az), "y": r * F.cos(el) * F.cos(az), "z": r * F.sin(el)})


def pass_through(points: DataFrame, field: str, low: float, high: float) -> DataFrame:
    return points.where(F.col(field).between(low, high))


def crop_around(points: DataFrame, centres: DataFrame, radius: float = 80.0, key: str = "frame_id") -> DataFrame:
    """Points inside the box of ±radius around their frame's pose. centres: key, tx, ty, tz; one row per frame, so it joins without growth."""
    near = [F.col(a).between(F.col(t) - radius, F.col(t) + radius) for a, t in (("x", "tx"), ("y", "ty"), ("z", "tz"))]
    return points.join(centres.select(key, "tx", "ty", "tz"), key).where(near[0] & near[1] & near[2]).select(points.columns)


def range_gate(points: DataFrame, high: float, low: float = 0.0) -> DataFrame:
    r = G.norm(F.col("x"), F.col("y"), F.col("z"))
    return points.where((r >= low) & (r < high))


def finite(points: DataFrame) -> DataFrame:
    ok = [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")) for n in ("x", "y", "z")]
    return points.where(ok[0] & ok[1] & ok[2])


@F.pandas_udf(T.DoubleType())
def _atan2(y: pd.Series, x: pd.Series) -> pd.Series:
    """The C library's atan2; Java's is off by one in the last place for about a fifth of all points, which decides times that lie between two decimals."""
    return np.arctan2(y, x)


def relative_time(points: DataFrame, scan_period: float = 0.1) -> DataFrame:
    """rel_time of each point in its sweep, from the azimuths of the sweep's first and last point; angles run clockwise and wrap at a turn."""
    az = F.col("_az")
    points = points.withColumn("_az", -_atan2("y", "x"))
    ends = points.groupBy("frame_id").agg(F.min_by(az, "pt_id").alias("start"), F.max_by(az, "pt_id").alias("end"))
    span = F.col("end") - F.col("start")
    turn = 2 * 3.141592653589793
    ends = ends.withColumn("span", F.when(span <= 0, span + turn).otherwise(span))
    on = points.join(ends, "frame_id").withColumn("off", az - F.col("start"))
    off = F.when(F.round("off", 9) < 0, F.col("off") + turn).otherwise(F.col("off"))
    return on.withColumn("rel_time", off / F.col("span") * scan_period).drop("start", "end", "span", "off", "_az")


def select_points(points: DataFrame, chosen: DataFrame, negative: bool = False) -> DataFrame:
    """The points whose pt_id is (or, negative, is not) in chosen."""
    return points.join(chosen.select("pt_id"), "pt_id", "left_anti" if negative else "left_semi")


def gnc_weight(sq_residual: Column, mu: "Column | float", eps: float) -> Column:
    """Weight of a graduated truncated least squares step."""
    mu = G.c(mu)
    e = eps * eps
    return F.when(sq_residual >= (mu + 1) / mu * e, 0.0).when(sq_residual <= mu / (mu + 1) * e, 1.0).otherwise(F.sqrt(e * mu * (mu + 1) / sq_residual) - mu)


def cauchy_weight(residual: Column, scale: float = 0.1) -> Column:
    return 1 / (1 + residual * residual / (scale * scale))


def break_distance(rng: Column, step: float = 0.2, incidence: float = 10.0, noise: float = 0.03) -> Column:
    """How far neighbours on one surface may lie apart at this range; step and incidence in degrees."""
    return rng * F.sin(F.radians(F.lit(step))) / F.sin(F.radians(F.lit(incidence - step))) + 3 * noise
