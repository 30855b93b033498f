"""Rigid transforms of points and operators on trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfuse.functions import geom as G

POSE = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]


def quat(prefix: str = "") -> G.Quat:
    return tuple(F.col(prefix + n) for n in ("qx", "qy", "qz", "qw"))  # type: ignore[return-value]


def trans(prefix: str = "") -> G.Vec:
    return G.vec(prefix, ("tx", "ty", "tz"))


def transform_points(points: DataFrame, poses: DataFrame, key: str = "frame_id", inverse: bool = False) -> DataFrame:
    """Moves points by the pose of their key; inverse, into the pose's frame. Keys without a pose drop."""
    q = G.unit(quat("__"))
    p = G.vec()
    t = trans("__")
    new = G.rotate(G.conj(q), tuple(a - b for a, b in zip(p, t))) if inverse else tuple(a + b for a, b in zip(G.rotate(q, p), t))
    joined = points.join(poses.select(key, *(F.col(n).alias("__" + n) for n in POSE)), key)
    moved = F.inline(F.array(F.struct(*(v.alias(a) for v, a in zip(new, "xyz")))))  # worked out once a row: inlined, what reads x, y, z would repeat the rotation at each mention
    return joined.select(*(c for c in points.columns if c not in ("x", "y", "z")), moved).select(points.columns)


def with_rotation(poses: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, and each pose as its place (__tx …) and the nine entries of its rotation (__r0 …), worked out once a pose."""
    r = G.rotation_matrix(G.unit(quat()))
    return poses.select(*keep, *(F.col(n).alias("__" + n) for n in POSE[:3]), *(v.alias(f"__r{i}") for i, v in enumerate(r)))


def into_pose(points: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of points that carry their pose as with_rotation gives it, with x, y, z in the pose's frame."""
    off = [p - t for p, t in zip(G.vec(), trans("__"))]
    new = {a: F.col(f"__r{k}") * off[0] + F.col(f"__r{k + 3}") * off[1] + F.col(f"__r{k + 6}") * off[2] for k, a in enumerate("xyz")}
    return points.select(*(new[c].alias(c) if c in new else c for c in columns))


def relative(a: str, b: str) -> dict[str, Column]:
    """Columns of inverse(pose a) · pose b."""
    qa, qb = G.unit(quat(a)), G.unit(quat(b))
    t = G.rotate(G.conj(qa), tuple(y - x for x, y in zip(trans(a), trans(b))))
    return dict(zip(POSE, (*t, *G.qmul(G.conj(qa), qb))))


def relative_poses(poses: DataFrame) -> DataFrame:
    """The motion from each pose of a session to the next: session_id, frame_id (of the later), POSE."""
    w = Window.partitionBy("session_id").orderBy("ts", "frame_id")
    both = poses.select("session_id", "frame_id", *(F.col(n).alias("b_" + n) for n in POSE), *(F.lag(n).over(w).alias("a_" + n) for n in POSE))
    return both.where(F.col("a_qw").isNotNull()).select("session_id", "frame_id", *(v.alias(k) for k, v in relative("a_", "b_").items()))


def pose_matrix(poses: DataFrame) -> DataFrame:
    """Adds `matrix`, sixteen numbers by rows."""
    r = G.rotation_matrix(G.unit(quat()))
    zero, one = F.lit(0.0), F.lit(1.0)
    t = trans()
    return poses.withColumn("matrix", F.array(*r[0:3], t[0], *r[3:6], t[1], *r[6:9], t[2], zero, zero, zero, one))


def matrix_pose(matrices: DataFrame) -> DataFrame:
    """POSE columns from `matrix`."""
    m = [F.col("matrix")[k] for k in range(16)]
    q = G.matrix_quaternion([m[k] for k in (0, 1, 2, 4, 5, 6, 8, 9, 10)])
    return matrices.withColumns(dict(zip(POSE, (m[3], m[7], m[11], *q))))


def _mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y, z, w = a
    return np.array([[w, -z, y, x], [z, w, -x, y], [-y, x, w, z], [-x, -y, -z, w]]) @ b


def _compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pose a followed by b in a's frame; a and b are tx … qw."""
    q = _mul(a[3:], b[3:])
    v = _mul(_mul(a[3:], np.r_[b[:3], 0.0]), np.r_[-a[3:6], a[6]])
    return np.r_[a[:3] + v[:3], q / np.linalg.norm(q)]


def chain_poses(steps: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Poses from increments (session_id, frame_id, ok, POSE): each frame stands at the last one moved by its increment.

    A frame that is not ok takes the last valid increment of its session (none yet: no motion). Sessions are cut into chunks by frame
    number; each chunk is folded on its own, then moved by the product of the chunks before it, so a long session is many tasks' work.
    """
    still = F.struct(*(F.lit(1.0 if n == "qw" else 0.0).alias(n) for n in POSE))
    cut = steps.withColumn("chunk", F.floor(F.col("frame_id") / chunk).cast("long"))
    # what a chunk starts with: the last valid increment of the chunks before it, one row a chunk
    over = Window.partitionBy("session_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    lasts = cut.groupBy("session_id", "chunk").agg(F.max_by(F.when(F.col("ok"), F.struct(*POSE)), F.when(F.col("ok"), F.col("frame_id"))).alias("s"))
    lasts = lasts.select("session_id", "chunk", F.coalesce(F.last("s", ignorenulls=True).over(over), still).alias("before"))
    inner = Window.partitionBy("session_id", "chunk").orderBy("frame_id")
    used = F.coalesce(F.last(F.when(F.col("ok"), F.struct(*POSE)), ignorenulls=True).over(inner), F.col("before"))
    good = cut.join(lasts, ["session_id", "chunk"]).select("session_id", "frame_id", "chunk", used.alias("s")).select("session_id", "frame_id", "chunk", "s.*")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_id")
        at, out = np.array([0, 0, 0, 0, 0, 0, 1.0]), []
        for step in pdf[POSE].to_numpy():
            at = _compose(at, step)
            out.append(at)
        pdf[POSE] = np.array(out)
        return pdf

    inside = good.groupBy("session_id", "chunk").applyInPandas(fold, good.schema)
    ends = inside.groupBy("session_id", "chunk").agg(F.max_by(F.struct(*POSE), "frame_id").alias("s")).select("session_id", "chunk", F.col("chunk").alias("frame_id"), "s.*")
    moved = ends.groupBy("session_id").applyInPandas(fold, ends.schema)
    wc = Window.partitionBy("session_id").orderBy("chunk")
    base = moved.select("session_id", "chunk", *(F.lag(n).over(wc).alias("a_" + n) for n in POSE))
    both = inside.join(base, ["session_id", "chunk"])
    qa = quat("a_")
    new = (*(a + b for a, b in zip(trans("a_"), G.rotate(qa, trans()))), *G.unit(G.qmul(qa, quat())))
    return both.select("session_id", "frame_id", *(F.when(F.col("a_qw").isNull(), F.col(n)).otherwise(v).alias(n) for n, v in zip(POSE, new)))


def bracket(times: DataFrame, poses: DataFrame) -> DataFrame:
    """Each (session_id, at) of times with the pose numbers around it: first = the last pose at or before it, and its time and the next one's.

    times and poses are merged in one sort per session, so no time is compared with all poses. Times outside the trajectory drop.
    """
    w = Window.partitionBy("session_id").orderBy("ts")
    p = poses.withColumn("no", F.row_number().over(w)).select("session_id", F.col("ts").alias("at"), "no", "ts", F.lead("ts").over(w).alias("next_ts"))
    q = times.select("session_id", "at", F.lit(None).cast("int").alias("no"), F.lit(None).cast("double").alias("ts"), F.lit(None).cast("double").alias("next_ts"), F.lit(1).alias("asked"))
    both = p.withColumn("asked", F.lit(0)).unionByName(q)
    line = Window.partitionBy("session_id").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumns({n: F.last(F.when(F.col("asked") == 0, F.struct("no", "ts", "next_ts")), ignorenulls=True).over(line)[n] for n in ("no", "ts", "next_ts")})
    return got.where("asked = 1 AND next_ts IS NOT NULL").select("session_id", "at", "no", "ts", "next_ts")


def _neighbours(times: DataFrame, poses: DataFrame, offsets: tuple[int, ...]) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("ts")
    around = poses.withColumn("no", F.row_number().over(w)).select("session_id", "no", *(F.when(F.lead("session_id", o).over(w).isNotNull(), F.lead(F.struct(*POSE), o).over(w)).alias(f"p{k}") if o >= 0 else F.lag(F.struct(*POSE), -o).over(w).alias(f"p{k}") for k, o in enumerate(offsets)))
    got = bracket(times, poses).join(around, ["session_id", "no"])
    return got.withColumn("u", (F.col("at") - F.col("ts")) / (F.col("next_ts") - F.col("ts")))


def _blend(df: DataFrame, weights: list[Column]) -> DataFrame:
    """Adds POSE: translation as the weighted sum of p0, p1, …, rotation as a chain of slerps by running shares of the weights, one projection each."""
    names = [f"_w{k}" for k in range(len(weights))]
    df = df.withColumns(dict(zip(names, weights)))
    w = [F.col(n) for n in names]
    df = df.withColumns({n: sum((w[k] * F.col(f"p{k}.{n}") for k in range(1, len(w))), w[0] * F.col(f"p0.{n}")) for n in POSE[:3]} | {n: F.col(f"p0.{n}") for n in POSE[3:]})
    total = w[0]
    for k in range(1, len(w)):
        total = total + w[k]
        share = F.when(F.abs(total) > 1e-12, w[k] / total).otherwise(0.0)
        df = df.withColumns(dict(zip(POSE[3:], G.slerp(quat(), tuple(F.col(f"p{k}.{n}") for n in POSE[3:]), share))))
    return df.drop(*names)


def interpolate(times: DataFrame, poses: DataFrame, kind: str = "slerp") -> DataFrame:
    """Poses at (session_id, at): `slerp` between the two around it, or the four-pose splines `catmull` (through the poses) and `uniform`.

    Splines answer only where all four poses exist.
    """
    offsets = (0, 1) if kind == "slerp" else (-1, 0, 1, 2)
    got = _neighbours(times, poses, offsets)
    got = got.where(" AND ".join(f"p{k} IS NOT NULL" for k in range(len(offsets))))
    u = F.col("u")
    weights = {"slerp": lambda: [1 - u, u], "catmull": lambda: G.catmull_rom(u), "uniform": lambda: G.uniform_cubic(u)}[kind]()
    return _blend(got, weights).select("session_id", "at", *POSE)


def uniform_motion(times: DataFrame, poses: DataFrame) -> DataFrame:
    """Velocity and acceleration in the world of the uniform cubic spline over the poses' translations, at (session_id, at)."""
    got = _neighbours(times, poses, (-1, 0, 1, 2)).where("p0 IS NOT NULL AND p3 IS NOT NULL")
    u, dt = F.col("u"), F.col("next_ts") - F.col("ts")
    v = [(-1 + 2 * u - u * u) / 2, (-4 * u + 3 * u * u) / 2, (1 + 2 * u - 3 * u * u) / 2, u * u / 2]
    a = [1 - u, -2 + 3 * u, 1 - 3 * u, u]
    total = lambda ws, n, d: sum((w * F.col(f"p{k}.{n}") for k, w in enumerate(ws)), F.lit(0.0)) / d
    return got.select("session_id", "at", *(total(v, n, dt).alias("v" + n[1]) for n in POSE[:3]), *(total(a, n, dt * dt).alias("a" + n[1]) for n in POSE[:3]))


def spline_pose(windows: DataFrame, u: Column) -> DataFrame:
    """Pose at u in [0, 1] of the clamped cubic spline with five control poses c0 … c4 (structs of POSE)."""
    renamed = windows.withColumnsRenamed({f"c{k}": f"p{k}" for k in range(5)})
    return _blend(renamed, G.clamped_cubic(u)).drop(*(f"p{k}" for k in range(5)))


def control_poses(windows: DataFrame) -> DataFrame:
    """Control poses whose clamped cubic spline passes nearest five data poses (session_id, window_id, no 0 … 4, u, POSE): least squares on translations
    and on quaternions turned to one half-sphere. A task solves many windows."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        u = pdf["u"].to_numpy()
        a = np.stack([_clamped(x) for x in u])
        data = pdf[POSE].to_numpy().copy()
        data[:, 3:] *= np.where(data[:, 3:] @ data[0, 3:] < 0, -1.0, 1.0)[:, None]
        got = np.linalg.lstsq(a, data, rcond=None)[0]
        got[:, 3:] /= np.linalg.norm(got[:, 3:], axis=1, keepdims=True)
        pdf[POSE] = got
        return pdf[["session_id", "window_id", "no", *POSE]]

    kinds = ", ".join(f"{n} double" for n in POSE)
    key = windows.schema["session_id"].dataType.simpleString()
    return windows.groupBy("session_id", "window_id").applyInPandas(solve, f"session_id {key}, window_id long, no int, {kinds}")


def _clamped(u: float) -> np.ndarray:
    """The five weights by the recursion over the knots."""
    knots = np.array([0, 0, 0, 0, 0.5, 1, 1, 1, 1.0])
    if u >= 1:
        return np.array([0, 0, 0, 0, 1.0])
    n = np.array([1.0 if knots[k] <= u < knots[k + 1] else 0.0 for k in range(8)])
    for p in range(1, 4):
        n = np.array([(n[k] * (u - knots[k]) / (knots[k + p] - knots[k]) if knots[k + p] > knots[k] else 0.0) + (n[k + 1] * (knots[k + p + 1] - u) / (knots[k + p + 1] - knots[k + 1]) if knots[k + p + 1] > knots[k + 1] else 0.0) for k in range(len(n) - 1)])
    return n


def deskew(points: DataFrame, windows: DataFrame, keys: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """Moves each point (keys, ratio in [0, 1]) by the spline pose at its own time. windows: keys, c0 … c4. Windows that each session numbers anew need session_id among the keys."""
    at = spline_pose(points.join(windows, list(keys)), F.col("ratio"))
    new = tuple(a + b for a, b in zip(G.rotate(quat(), G.vec()), trans()))
    return at.withColumns(dict(zip(("x", "y", "z"), new))).select(points.columns)


def keyframes(poses: DataFrame, step: float = 4.0) -> DataFrame:
    """Frames that lie more than `step` from the keyframe before; a session's first is one. Greedy and in order: a task walks whole sessions' poses."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_id")
        p, keep, last = pdf[["tx", "ty", "tz"]].to_numpy(), [], None
        for x in p:
            new = last is None or np.linalg.norm(x - last) > step
            last = x if new else last
            keep.append(new)
        return pdf[np.array(keep)]

    return poses.groupBy("session_id").applyInPandas(walk, poses.schema)


def travel_keyframes(poses: DataFrame, step: float = 4.0) -> DataFrame:
    """The order-free form: the first frame in each stretch of `step` travelled metres."""
    w = Window.partitionBy("session_id").orderBy("frame_id")
    moved = F.coalesce(F.sqrt(G.sq_distance(trans(), tuple(F.lag(n).over(w) for n in POSE[:3]))), F.lit(0.0))
    at = poses.withColumn("moved", moved).withColumn("travelled", F.sum("moved").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("stretch", F.floor(F.round(F.col("travelled"), 9) / step).cast("int"))
    return at.groupBy("session_id", "stretch").agg(F.min("frame_id").alias("frame_id"))


def compound_covariance(steps: DataFrame) -> DataFrame:
    """Covariance of the chained pose per session: steps have session_id, frame_id, POSE and cov (36 numbers by rows, translation first).

    Second order with the fourth-order mixed terms of two independent uncertain poses.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_id")
        at, cov, out = np.array([0, 0, 0, 0, 0, 0, 1.0]), np.zeros((6, 6)), []
        for step, own in zip(pdf[POSE].to_numpy(), pdf["cov"]):
            cov = _compound(cov, _carried(at, np.array(own).reshape(6, 6)))
            at = _compose(at, step)
            out.append(cov.ravel())
        return pd.DataFrame({"session_id": pdf["session_id"], "frame_id": pdf["frame_id"], "cov": out})

    s = steps.schema
    return steps.groupBy("session_id").applyInPandas(fold, f"session_id {s['session_id'].dataType.simpleString()}, frame_id {s['frame_id'].dataType.simpleString()}, cov array<double>")


def _ad_basis() -> np.ndarray:
    """ad(e_k) for the six unit twists, translation first: ad is linear, so these six matrices are all of it."""
    unit = np.eye(3)
    hat = np.cross(unit[:, None], unit).transpose(0, 2, 1)  # hat[k] @ v = e_k x v
    basis = np.zeros((6, 6, 6))
    basis[:3, :3, 3:] = basis[3:, :3, :3] = basis[3:, 3:, 3:] = hat
    return basis


_AD = _ad_basis()


def _carried(pose: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """A covariance in the frame that the pose stands in: each unit twist's image is one column of the adjoint."""
    q = pose[3:] / np.linalg.norm(pose[3:])
    turned = np.stack([_mul(_mul(q, np.r_[e, 0.0]), np.r_[-q[:3], q[3]])[:3] for e in np.eye(3)], axis=1)
    adjoint = np.zeros((6, 6))
    adjoint[:3, :3] = adjoint[3:, 3:] = turned
    adjoint[:3, 3:] = np.cross(pose[:3], turned, axisb=0).T
    return adjoint @ cov @ adjoint.T


def _compound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Covariance of the product of two independent uncertain poses whose covariances stand in one frame, to fourth order.

    By the Baker-Campbell-Hausdorff series the product's error is x + y + [x, y]/2 + [x, [x, y]]/12 + [y, [y, x]]/12 for twists x and y of covariance
    a and b (T. D. Barfoot and P. T. Furgale, Associating Uncertainty With Three-Dimensional Poses, IEEE Trans. Robotics 30 (3), 2014).
    Its second moment keeps a, b, E[ad(x) y y' ad(x)']/4 and E[ad(x) ad(x)] b/12 and the like, each a sum over the six matrices of ad.
    """
    squared = lambda cov: np.einsum("kl,kij,ljm->im", cov, _AD, _AD)  # noqa: E731  E[ad(x) ad(x)]
    mixed = squared(a) @ b + squared(b) @ a
    return a + b + np.einsum("kl,kij,jm,lnm->in", a, _AD, b, _AD) / 4 + (mixed + mixed.T) / 12


def point_uncertainty(points: DataFrame, var_t: Column, var_r: Column, var_m: Column) -> DataFrame:
    """Adds cov_trace for isotropic pose and measurement variances: 3·var_t + 2·var_r·|p|² + 3·var_m, the trace of G·diag(Σpose, Σmeas)·Gᵀ."""
    x, y, z = G.vec()
    return points.withColumn("cov_trace", 3 * var_t + 2 * var_r * (x * x + y * y + z * z) + 3 * var_m)


def windows_of(frames: DataFrame, length: int = 5, stride: int = 2) -> DataFrame:
    """(session_id, window_id, frame_id, no): count-based windows over a session's frames in order; only whole windows."""
    w = Window.partitionBy("session_id").orderBy("frame_id")
    numbered = frames.select("session_id", "frame_id", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("session_id")).alias("n"))
    ids = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("i") - length + 1) / stride)).cast("int"), F.floor(F.col("i") / stride).cast("int"))
    out = numbered.where(F.floor(F.col("i") / stride) >= F.greatest(F.lit(0), F.ceil((F.col("i") - length + 1) / stride))).select("session_id", F.explode(ids).alias("window_id"), "frame_id", "i", "n")
    return out.where(F.col("window_id") * stride + length <= F.col("n")).select("session_id", "window_id", "frame_id", (F.col("i") - F.col("window_id") * stride).cast("int").alias("no"))


def absolute_error(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean and largest distance of poses with the same session and frame."""
    t = truth.select("session_id", "frame_id", *(F.col(n).alias("t_" + n) for n in POSE[:3]))
    d = estimate.join(t, ["session_id", "frame_id"]).select("session_id", F.sqrt(G.sq_distance(trans(), trans("t_"))).alias("d"))
    return d.groupBy("session_id").agg(F.avg("d").alias("mean_error"), F.max("d").alias("max_error"), F.count("*").alias("n"))
