"""Mergeable statistics of point groups and fits on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfuse.functions import geom as G
from scanfuse.operators.components import staged

SUMS = ["n", "sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz"]
_NUMBERS = T.ArrayType(T.DoubleType())
_PAIRS = ["xx", "xy", "xz", "yy", "yz", "zz"]


def moments(points: DataFrame, keys: list[str], names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """n, Σv and Σvvᵀ per group: ten sums that combine before the shuffle and merge with stored ones."""
    v = dict(zip("xyz", map(F.col, names)))
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(v[a]).alias("s" + a) for a in "xyz"), *(F.sum(v[p[0]] * v[p[1]]).alias("s" + p) for p in _PAIRS))


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Folds stored and new sums of the same groups into one row each."""
    return parts.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in SUMS))


def covariance(sums: DataFrame) -> DataFrame:
    """Adds cov_xx … cov_zz, divided by n."""
    n = F.col("n")
    return sums.withColumns({"cov_" + p: F.col("s" + p) / n - F.col("s" + p[0]) / n * (F.col("s" + p[1]) / n) for p in _PAIRS})


def principal(sums: DataFrame) -> DataFrame:
    """Adds the covariance and its eigenvalues l1 ≤ l2 ≤ l3, all as columns."""
    cov = covariance(sums)
    return cov.withColumns(dict(zip(("l1", "l2", "l3"), G.eigenvalues(*(F.col("cov_" + p) for p in _PAIRS)))))


@F.pandas_udf(_NUMBERS)
def _eigenvectors(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
    m = np.empty((len(xx), 3, 3))
    for (i, j), v in zip(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)), (xx, xy, xz, yy, yz, zz)):
        m[:, i, j] = m[:, j, i] = v
    vectors = np.linalg.eigh(m)[1].transpose(0, 2, 1)
    first = np.take_along_axis(vectors, np.abs(vectors).argmax(2)[..., None], 2)
    return pd.Series(list((vectors * np.sign(first)).reshape(-1, 9)))


def eigenvectors(cov: DataFrame) -> DataFrame:
    """Adds `axes`: the unit vectors of l1, l2, l3, nine numbers; the largest part of each is positive. One call solves a batch of groups."""
    return cov.withColumn("axes", _eigenvectors(*(F.col("cov_" + p) for p in _PAIRS)))


def shape_class(pca: DataFrame, edge: float = 20.0, line: float = 3.0) -> DataFrame:
    """is_edge (l3 > edge·l2), is_line (l3 > line·l2), linearity and planarity."""
    l1, l2, l3 = (F.col(n) for n in ("l1", "l2", "l3"))
    return pca.withColumns({"is_edge": l3 > edge * l2, "is_line": l3 > line * l2, "linearity": (l3 - l2) / l3, "planarity": (l2 - l1) / l3})


def plane_from_sums(sums: DataFrame, keep: bool = False) -> DataFrame:
    """Least-squares plane a·x+b·y+c·z = −1 by Cramer's rule, as the unit normal nx, ny, nz and the offset d (n·p + d = 0). Rows without a plane drop; with keep they stay, with nulls."""
    s = {p: F.col("s" + p) for p in _PAIRS}
    b = [-F.col("s" + a) for a in "xyz"]
    m = [s["xx"], s["xy"], s["xz"], s["xy"], s["yy"], s["yz"], s["xz"], s["yz"], s["zz"]]
    # step by step: one formula for all would outgrow generated code
    on = sums.withColumn("_det", G.det3(*m))
    on = on.withColumn("_det", F.when(F.abs("_det") > 1e-12, F.col("_det"))) if keep else on.where(F.abs("_det") > 1e-12)
    on = on.withColumns({f"_a{k}": G.det3(*(b[i // 3] if i % 3 == k else m[i] for i in range(9))) / F.col("_det") for k in range(3)})
    on = on.withColumn("_size", G.norm(*(F.col(f"_a{k}") for k in range(3))))
    return on.withColumns({n: F.col(f"_a{k}") / F.col("_size") for k, n in enumerate(("nx", "ny", "nz"))} | {"d": 1 / F.col("_size")}).drop("_det", "_a0", "_a1", "_a2", "_size")


def neighbour_sums(neighbours: DataFrame) -> DataFrame:
    """q_id, the ten sums and near, the list of each query's neighbours. neighbours: a row each (q_id, tx, ty, tz), or neighbors.nearest_sets with its sums, which need no shuffle."""
    if "near" in neighbours.columns:
        return neighbours.select(*(c for c in neighbours.columns if c not in ("qx", "qy", "qz")))  # with the query's own columns
    v = dict(zip("xyz", map(F.col, ("tx", "ty", "tz"))))
    sums = [F.count("*").alias("n"), *(F.sum(v[a]).alias("s" + a) for a in "xyz"), *(F.sum(v[p[0]] * v[p[1]]).alias("s" + p) for p in _PAIRS)]
    return neighbours.groupBy("q_id").agg(*sums, F.collect_list(F.struct("tx", "ty", "tz")).alias("near"))


def neighbour_planes(neighbours: DataFrame, limit: float = 0.2) -> DataFrame:
    """Plane of each query's neighbours (as neighbour_sums takes them; a few each), with the largest distance of a neighbour and whether all are within the limit. One pass: sums and the neighbours themselves gather together."""
    fits = plane_from_sums(neighbour_sums(neighbours))
    off = lambda p: F.array_max(F.transform("near", lambda t: F.abs(p["nx"] * t["tx"] + p["ny"] * t["ty"] + p["nz"] * t["tz"] + p["d"])))
    plane = F.array(F.struct("nx", "ny", "nz", "d"))  # bound once a row: inside the loop its formula would be worked out for every neighbour
    return fits.withColumn("worst", F.get(F.transform(plane, off), F.lit(0))).withColumn("valid", F.col("worst") <= limit)


def neighbour_lines(neighbours: DataFrame, reach: float = 0.1) -> DataFrame:
    """Line of each query's neighbours: centre, direction, axes (as eigenvectors) and the points ±reach along it; is_line if l3 > 3·l2."""
    sums = neighbours.select("q_id", *SUMS) if "near" in neighbours.columns else moments(neighbours, ["q_id"], ("tx", "ty", "tz"))
    pca = eigenvectors(shape_class(principal(sums)))
    out = pca.select("q_id", "is_line", "axes", *((F.col("s" + a) / F.col("n")).alias("c" + a) for a in "xyz"), *(F.col("axes")[6 + k].alias("d" + a) for k, a in enumerate("xyz")))
    return out.withColumns({f"{side}{a}": F.col("c" + a) + sign * reach * F.col("d" + a) for side, sign in (("a", 1.0), ("b", -1.0)) for a in "xyz"})


def ransac_lines(points: DataFrame, key: str, threshold: float = 0.1, rounds: int = 50, seed: int = 7) -> DataFrame:
    """A line per group (one line feature's points): point, direction, inliers, length along the line and linearity. Seeded by the group, so repeatable. A call fits a batch of lines."""
    lines = points.groupBy(key).agg(F.collect_list(F.struct(F.col("pt_id").cast("long").alias("pt_id"), *(F.col(a).cast("double").alias(a) for a in "xyz"))).alias("p"))
    kinds = ", ".join(f"{n} double" for n in ("cx", "cy", "cz", "dx", "dy", "dz"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("p")
            bounds, rows = lists.offsets.to_numpy().astype(np.int64), lists.values
            pt_id, xyz = rows.field("pt_id").to_numpy(zero_copy_only=False), np.stack([rows.field(a).to_numpy(zero_copy_only=False) for a in "xyz"])
            ends = np.searchsorted(bounds, np.arange(bounds[0] + 20_000, bounds[-1], 20_000))  # slices of some 20,000 points, of whole lines
            for a, b in zip(cuts := np.unique(np.r_[0, ends, batch.num_rows])[:-1], np.r_[cuts[1:], batch.num_rows]):
                names, of, n = batch.column(key)[a : b], slice(bounds[a], bounds[b]), np.diff(bounds[a : b + 1])
                order = np.lexsort((pt_id[of], np.repeat(np.arange(b - a), n)))
                fits = _ransac(xyz[:, of][:, order], n, names.to_numpy(zero_copy_only=False), threshold, rounds, seed)
                yield pa.RecordBatch.from_pydict({key: names} | {k: pa.array(v) for k, v in fits.items()})

    return lines.mapInArrow(run, f"{key} {points.schema[key].dataType.simpleString()}, {kinds}, inliers long, length double, linearity double")


def _two_of(n: int, rounds: int, seed: list[int]) -> np.ndarray:
    """Two different places under n for each round. The draws are those of Generator.choice without replacement, all in one call."""
    first, second, swap = np.random.default_rng(seed).integers(0, np.tile([n - 1, n, 2], rounds)).reshape(rounds, 3).T
    second = np.where(second == first, n - 1, second)
    return np.where(swap == 0, (second, first), (first, second))


def _ransac(p: np.ndarray, n: np.ndarray, names: np.ndarray, threshold: float, rounds: int, seed: int) -> dict[str, np.ndarray]:
    """The fits of ransac_lines to lines of n points each, one after another in p (3 × all)."""
    start, of = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    picks = np.zeros((len(n), 2, rounds), np.int64)
    for i in np.flatnonzero(n > 1):
        picks[i] = _two_of(int(n[i]), rounds, [seed, abs(int(names[i]))])
    picks += start[:, None, None]
    best, most = np.zeros(p.shape[1], bool), np.zeros(len(n), np.int64)
    for k in range(rounds):
        a, d = p[:, picks[:, 0, k]], p[:, picks[:, 1, k]] - p[:, picks[:, 0, k]]
        size = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        ok = size > 1e-9
        off, (u, v, w) = p - a[:, of], (d / np.where(ok, size, 1.0))[:, of]
        x, y, z = off[1] * w - off[2] * v, off[2] * u - off[0] * w, off[0] * v - off[1] * u
        inside = np.sqrt(x * x + y * y + z * z) <= threshold
        found = np.add.reduceat(inside, start, dtype=np.int64)
        better = ok & (found > most)
        most = np.where(better, found, most)
        best = np.where(better[of], inside, best)
    chosen = best | (most < 2)[of]
    total = lambda v: np.add.reduceat(np.where(chosen, v, 0.0), start)
    count = total(1.0)
    centre = np.stack([total(v) / count for v in p])
    off = p - centre[:, of]
    cov = np.stack([[total(a * b) / count for a in off] for b in off]).transpose(2, 0, 1)
    values, vectors = np.linalg.eigh(cov)
    d = vectors[:, :, 2].T
    d = d * np.sign(np.take_along_axis(d, np.abs(d).argmax(0)[None], 0))
    along = (off * d[:, of]).sum(0)
    length = np.maximum.reduceat(np.where(chosen, along, -np.inf), start) - np.minimum.reduceat(np.where(chosen, along, np.inf), start)
    linearity = (values[:, 2] - values[:, 1]) / np.maximum(values[:, 2], 1e-12)
    return dict(zip(("cx", "cy", "cz", "dx", "dy", "dz"), (*centre, *d))) | {"inliers": most, "length": length, "linearity": linearity}


def normal_equations(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """JᵀJ (h00 … h55, upper part), Jᵀr (g0 … g5), Σr² and n per group, of plane residuals (x, y, z, nx, ny, nz, r, weight): rotation first, J = (p × n, n)."""
    j = [*G.cross(G.vec(), G.vec("n")), *G.vec("n")]
    w, r = F.col("weight"), F.col("r")
    sums = [F.sum(w * j[a] * j[b]).alias(f"h{a}{b}") for a in range(6) for b in range(a, 6)]
    return residuals.groupBy(*keys).agg(*sums, *(F.sum(w * j[a] * r).alias(f"g{a}") for a in range(6)), F.sum(w * r * r).alias("cost"), F.count("*").alias("n"))


def adaptive_planes(points: DataFrame, root: float = 1.0, ratio: float = 9.0, least: int = 7, layers: int = 5) -> DataFrame:
    """Voxels that hold a plane, at the coarsest of `layers` sizes at which they do: layer, vx, vy, vz, n, l1, l2, l3.

    A voxel whose middle eigenvalue is at least `ratio` times its smallest is accepted; the points of the others go on to voxels half the size. A voxel of fewer than `least` points ends.
    """
    from scanfuse.operators.grid import CELL, cells

    rest, found = points.select("pt_id", "x", "y", "z"), None
    for layer in range(layers):
        on = staged(cells(rest, root / 2**layer), "layer")  # read twice: by its sums and by what goes on
        pca = principal(moments(on, CELL)).where(F.col("n") >= least)
        flat = (F.col("l2") > 1e-9) & (F.col("l2") >= ratio * F.greatest(F.col("l1"), F.lit(0.0)))
        took = pca.where(flat).select(F.lit(layer).alias("layer"), *CELL, "n", "l1", "l2", "l3")
        found = took if found is None else found.unionByName(took)
        rest = on.join(pca.where(~flat).select(*CELL), CELL, "left_semi").select("pt_id", "x", "y", "z")
    return found


def adaptive_features(points: DataFrame, root: float = 1.0, plane: float = 9.0, line: float = 4.0, least: int = 7, layers: int = 5) -> DataFrame:
    """Planes and lines of points (pt_id, x, y, z, kind: "plane" or "line"), each at the coarsest of `layers` voxel sizes at which it holds: kind, layer, vx, vy, vz, n, l1, l2, l3, cx, cy, cz.

    A voxel of plane points is accepted where its middle eigenvalue is at least `plane` times its smallest, one of line points where its largest is at least `line` times its
    middle one; the two kinds share the descent and no voxel. The points of the others go on to voxels half the size. A voxel of fewer than `least` points ends.
    """
    from scanfuse.operators.grid import CELL, cells

    keys = ["kind", *CELL]
    rest, found = points.select("pt_id", "x", "y", "z", "kind"), None
    for layer in range(layers):
        on = staged(cells(rest, root / 2**layer), "layer")  # read twice: by its sums and by what goes on
        pca = principal(moments(on, keys)).where(F.col("n") >= least)
        flat = (F.col("l2") > 1e-9) & (F.col("l2") >= plane * F.greatest(F.col("l1"), F.lit(0.0)))
        thin = (F.col("l3") > 1e-9) & (F.col("l3") >= line * F.greatest(F.col("l2"), F.lit(0.0)))
        ok = F.when(F.col("kind") == "line", thin).otherwise(flat)
        pca = staged(pca.withColumn("ok", ok), "voxels")
        took = pca.where("ok").select("kind", F.lit(layer).alias("layer"), *CELL, "n", "l1", "l2", "l3", *((F.col("s" + a) / F.col("n")).alias("c" + a) for a in "xyz"), *("cov_" + p for p in _PAIRS))
        found = took if found is None else found.unionByName(took)
        rest = on.join(pca.where("NOT ok").select(*keys), keys, "left_semi").select("pt_id", "x", "y", "z", "kind")
    return found


def feature_axes(found: DataFrame) -> DataFrame:
    """adaptive_features with the unit vector nx, ny, nz: a plane's normal, a line's direction."""
    first = F.when(F.col("kind") == "line", 6).otherwise(0)
    return eigenvectors(found).withColumns({"n" + a: F.get("axes", first + k) for k, a in enumerate("xyz")}).drop("axes")


def align_pairs(pairs: DataFrame, key: str, keep: float = 0.8) -> DataFrame:
    """Rotation (nine numbers) and translation that move the queries (qx, qy, qz) of each group onto their targets (tx, ty, tz), by the closest `keep` of the pairs, with the number n of these and the sum of their d2 (energy).

    Sums of the trimmed pairs are columns; one call decomposes the 3 × 3 matrices of a batch of groups.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    near = pairs.withColumns({"nr": F.row_number().over(w.orderBy("d2", "q_id", "t_id")), "all": F.count("*").over(w)}).where(F.col("nr") <= F.ceil(F.col("all") * keep))
    sums = near.groupBy(key).agg(F.count("*").alias("n"), F.sum("d2").alias("energy"), *(F.avg(s + a).alias("m" + s + a) for s in "qt" for a in "xyz"), *(F.sum(F.col("q" + a) * F.col("t" + b)).alias(f"s{a}{b}") for a in "xyz" for b in "xyz"))
    h = [F.col(f"s{a}{b}") - F.col("n") * F.col("mq" + a) * F.col("mt" + b) for a in "xyz" for b in "xyz"]
    out = sums.withColumn("rot", _kabsch(F.array(*h)))
    r = [F.col("rot")[k] for k in range(9)]
    q, t = G.vec("mq"), G.vec("mt")
    moved = [t[k] - (r[3 * k] * q[0] + r[3 * k + 1] * q[1] + r[3 * k + 2] * q[2]) for k in range(3)]
    return out.select(key, "n", "energy", "rot", *(m.alias(n) for m, n in zip(moved, ("tx", "ty", "tz"))))


@F.pandas_udf(_NUMBERS)
def _kabsch(h: pd.Series) -> pd.Series:
    if not len(h):
        return pd.Series([], dtype=object)
    u, _, vt = np.linalg.svd(np.stack(h.to_numpy()).reshape(-1, 3, 3))
    flip = np.linalg.det(np.matmul(vt.transpose(0, 2, 1), u.transpose(0, 2, 1)))
    vt[:, 2] *= flip[:, None]
    return pd.Series(list(np.matmul(vt.transpose(0, 2, 1), u.transpose(0, 2, 1)).reshape(-1, 9)))


def solve_normal(h: list[Column], g: list[Column], damping: float = 1e-9) -> Column:
    """The step −H⁻¹g of each row's 6 × 6 normal equations (21 and 6 columns), a batch of rows per call."""
    return _solve(F.array(*h), F.array(*g), F.lit(damping))


@F.pandas_udf(_NUMBERS)
def _solve(h: pd.Series, g: pd.Series, damping: pd.Series) -> pd.Series:
    if not len(h):
        return pd.Series([], dtype=object)
    upper = np.stack(h.to_numpy())
    m = np.zeros((len(upper), 6, 6))
    i, j = np.triu_indices(6)
    m[:, i, j] = upper
    m[:, j, i] = upper
    m += damping.to_numpy()[:, None, None] * np.eye(6)
    return pd.Series(list(-np.linalg.solve(m, np.stack(g.to_numpy())[..., None])[..., 0]))
