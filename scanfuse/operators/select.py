"""Selection of features and correspondences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfuse.functions import geom as G
from scanfuse.operators import stats

AXES = ((1, 0, 0), (0, 1, 0), (0, 0, 1))


def by_azimuth(points: DataFrame) -> DataFrame:
    """Adds order: the place of a point in its frame's turn, by atan2(y, x), then pt_id."""
    w = Window.partitionBy("frame_id").orderBy(F.atan2("y", "x"), "pt_id")
    return points.withColumn("order", F.row_number().over(w))


def observability_lists(features: DataFrame, best: int = 150) -> DataFrame:
    """Plane features (frame_id, pt_id, x, y, z, nx, ny, nz, planarity) that lead one of nine scores of their frame: distinct frame_id, pt_id.

    Scores: ±(p × n)·axis·planarity² for three axes, |n·axis|·planarity² for three.
    """
    turn, n, p2 = G.cross(G.vec(), G.vec("n")), G.vec("n"), F.col("planarity") * F.col("planarity")
    scores = [*(t * p2 for t in turn), *(-t * p2 for t in turn), *(F.abs(v) * p2 for v in n)]
    rows = features.select("frame_id", "pt_id", F.posexplode(F.array(*(F.round(s, 9) for s in scores))).alias("list", "score"))
    w = Window.partitionBy("frame_id", "list").orderBy(F.desc("score"), "pt_id")
    return rows.withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= best).select("frame_id", "pt_id").distinct()


def greedy_logdet(features: DataFrame, share: float = 0.4, tries: int = 20, seed: int = 7) -> DataFrame:
    """The `share` of a frame's plane features that a stochastic greedy choice by log det of JᵀJ takes: frame_id, pt_id. Seeded by the frame. A frame is one group."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pt_id")
        p, n = pdf[["x", "y", "z"]].to_numpy(), pdf[["nx", "ny", "nz"]].to_numpy()
        j = np.hstack([np.cross(p, n), n])
        rng, h = np.random.default_rng([seed, int(pdf["frame_id"].iloc[0])]), 1e-3 * np.eye(6)
        left, chosen = np.arange(len(j)), []
        for n_left in range(len(j), len(j) - int(np.ceil(share * len(j))), -1):  # left[:n_left] in order
            some = rng.choice(n_left, min(tries, n_left), replace=False)
            rows = j[left[some]]
            gain = np.einsum("ij,jk,ik->i", rows, np.linalg.inv(h), rows)  # det(H + jjᵀ) = det H · (1 + jᵀH⁻¹j)
            at = int(some[gain.argmax()])
            k = left[at]
            left[at : n_left - 1] = left[at + 1 : n_left]
            chosen.append(k)
            h += np.outer(j[k], j[k])
        return pdf.iloc[sorted(chosen)][["frame_id", "pt_id"]]

    return features.select("frame_id", "pt_id", *"xyz", "nx", "ny", "nz").groupBy("frame_id").applyInPandas(choose, "frame_id int, pt_id long")


def normal_moments(features: DataFrame) -> DataFrame:
    """Sums of the normals' products per frame: the ellipsoid of what the planes constrain, with its eigenvalues."""
    return stats.principal(stats.moments(features, ["frame_id"], ("nx", "ny", "nz")))


def constraint_sphere(features: DataFrame, most: int) -> DataFrame:
    """Up to `most` features of a frame, each time one whose normal is closest to the direction least constrained so far: frame_id, pt_id."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pt_id")
        n = pdf[["nx", "ny", "nz"]].to_numpy()
        h, left, chosen = 1e-6 * np.eye(3), np.ones(len(n), bool), []
        while left.any() and len(chosen) < most:
            weak = np.linalg.eigh(h)[1][:, 0]
            score = np.where(left, np.abs(n @ weak), -1)
            k = int(score.argmax())
            left[k] = False
            chosen.append(k)
            h += np.outer(n[k], n[k])
        return pdf.iloc[sorted(chosen)][["frame_id", "pt_id"]]

    return features.groupBy("frame_id").applyInPandas(choose, "frame_id int, pt_id long")


def trimmed(pairs: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` closest pairs per group."""
    w = Window.partitionBy(key).orderBy("d2", "q_id", "t_id")
    return pairs.withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= most).drop("nr")


def hull_overlap(points: DataFrame, pairs: DataFrame, key: str = "unit_id", strip: float = 1.0) -> DataFrame:
    """Overlap of the planar convex hulls of two units (id1, id2): area of the common part over the smaller area, with both areas."""

    kind = points.schema[key].dataType.simpleString()

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            group = np.cumsum(np.r_[True, ((pdf[key].to_numpy() != pdf[key].shift().to_numpy()) | (pdf["s"].to_numpy() != pdf["s"].shift().to_numpy()))[1:]][: len(pdf)])
            yield pdf.loc[_outer(pdf["x"].to_numpy(), pdf["y"].to_numpy(), group), [key, "x", "y"]]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: pdf[key].iloc[:1], "hull": [_hull(pdf[["x", "y"]].to_numpy()).ravel()]})

    # what can be a corner of a strip first: only that meets in the unit's group
    strips = points.select(key, F.col("x").cast("double"), F.col("y").cast("double"), F.floor(F.col("x") / strip).alias("s")).repartition(key, "s").sortWithinPartitions(key, "s", "x", "y")
    strips = strips.mapInPandas(part, f"{key} {kind}, x double, y double")
    hulls = strips.groupBy(key).applyInPandas(whole, f"{key} {kind}, hull array<double>")
    on = pairs.join(hulls.select(F.col(key).alias("id1"), F.col("hull").alias("h1")), "id1").join(hulls.select(F.col(key).alias("id2"), F.col("hull").alias("h2")), "id2")
    return on.withColumn("area", _areas("h1", "h2")).select("id1", "id2", F.col("area.a").alias("area1"), F.col("area.b").alias("area2"), (F.col("area.c") / F.least("area.a", "area.b")).alias("overlap"))


def _outer(x: np.ndarray, y: np.ndarray, group: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Places of the points, in order of (group, x, y), that may be corners of their group's hull; no corner is left out.

    A point that is not above the chord of the points before and after it is no corner of the upper hull, and these two may go at the same time without changing the hull. So do rounds over all groups at once,
    for the upper and the lower hull; what they leave inside does no harm.
    """
    found = []
    for side in (1, -1):
        at = np.arange(len(x))
        for _ in range(rounds):
            a, b, c = at[:-2], at[1:-1], at[2:]
            turn = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
            # points at one place, or under one another, are told apart by the exact hull later
            inner = (group[a] == group[c]) & (side * turn >= 0) & (x[a] < x[b]) & (x[b] < x[c])
            if not inner.any():
                break
            at = at[np.r_[True, ~inner, True]] if len(at) > 2 else at
        found.append(at)
    return np.unique(np.concatenate(found))


def _hull(p: np.ndarray) -> np.ndarray:
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def chain(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def _area(p: np.ndarray) -> float:
    return 0.5 * abs(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))) if len(p) > 2 else 0.0


def _clip(p: np.ndarray, by: np.ndarray) -> np.ndarray:
    for a, b in zip(by, np.roll(by, -1, axis=0)):
        side = (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) if len(p) else np.empty(0)
        s, t, before = np.roll(side, 1), side, np.roll(p, 1, axis=0)
        crosses = (s < 0) != (t < 0)
        cut = before + (p - before) * s[:, None] / np.where(crosses, s - t, 1.0)[:, None]
        p = np.stack([cut, p], axis=1).reshape(-1, 2)[np.stack([crosses, t >= 0], axis=1).ravel()]  # a cut comes before the point it leads to
    return p


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in "abc"]))
def _areas(one: pd.Series, two: pd.Series) -> pd.DataFrame:
    rows = [(_area(p := np.reshape(a, (-1, 2))), _area(q := np.reshape(b, (-1, 2))), _area(_clip(p, q))) for a, b in zip(one, two)]
    return pd.DataFrame(rows, columns=["a", "b", "c"], dtype=float)


def polygon_area(vertices: DataFrame, key: str) -> DataFrame:
    """Shoelace area of each polygon's vertices (no, x, y) in order."""
    w = Window.partitionBy(key).orderBy("no")
    first = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx = F.coalesce(F.lead("x").over(w), F.first("x").over(first))
    ny = F.coalesce(F.lead("y").over(w), F.first("y").over(first))
    return vertices.withColumn("part", F.col("x") * ny - F.col("y") * nx).groupBy(key).agg((F.abs(F.sum("part")) / 2).alias("area"))
