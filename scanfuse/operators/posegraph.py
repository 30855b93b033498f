"""Pose graphs of many sessions: edges, loops, adjustment, re-assembly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanfuse.functions import geom as G
from scanfuse.operators.neighbors import _plus
from scanfuse.operators.trajectory import POSE, _compose, _mul, relative, trans, transform_points

EDGE = ["session_id", "id1", "id2", "kind", *POSE, "var"]


def _edges(pairs: DataFrame, kind: str, var) -> DataFrame:
    return pairs.select("session_id", "id1", "id2", F.lit(kind).alias("kind"), *(v.alias(k) for k, v in relative("a_", "b_").items()), var.alias("var"))


def odometry_edges(poses: DataFrame, noise: float = 0.01, bad_noise: float = 50.0) -> DataFrame:
    """Edges from each pose of a session to the next; the variance grows with the frames between and with a bad frame. poses may have `bad`."""
    w = Window.partitionBy("session_id").orderBy("frame_id")
    p = poses if "bad" in poses.columns else poses.withColumn("bad", F.lit(False))
    pairs = p.select("session_id", F.lag("frame_id").over(w).alias("id1"), F.col("frame_id").alias("id2"), "bad", *(F.lag(n).over(w).alias("a_" + n) for n in POSE), *(F.col(n).alias("b_" + n) for n in POSE)).where("id1 IS NOT NULL")
    return _edges(pairs, "odom", (F.col("id2") - F.col("id1")) * F.when(F.col("bad"), bad_noise).otherwise(noise))


def window_edges(poses: DataFrame, back: int = 2, noise: float = 0.01) -> DataFrame:
    """Edges from each pose to those 2 … back before it."""
    w = Window.partitionBy("session_id").orderBy("frame_id")
    out = None
    for k in range(2, back + 1):
        pairs = poses.select("session_id", F.lag("frame_id", k).over(w).alias("id1"), F.col("frame_id").alias("id2"), *(F.lag(n, k).over(w).alias("a_" + n) for n in POSE), *(F.col(n).alias("b_" + n) for n in POSE)).where("id1 IS NOT NULL")
        e = _edges(pairs, "window", (F.col("id2") - F.col("id1")) * noise)
        out = e if out is None else out.unionByName(e)
    return out


def unary_edges(poses: DataFrame, kind: str, var: float) -> DataFrame:
    """Prior or GPS edges: id1 is null, the relative pose is the pose itself."""
    return poses.select("session_id", F.lit(None).cast("int").alias("id1"), F.col("frame_id").alias("id2"), F.lit(kind).alias("kind"), *POSE, F.lit(var).alias("var"))


def loop_candidates(units: DataFrame, radius: float = 40.0, gap: int = 10) -> DataFrame:
    """Pairs (session_id, id1 < id2) of units within `radius` in the plane and at least `gap` apart, ranked per id2 by (distance, id1). A grid join, not all pairs."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    step = F.array(*(F.lit(k).cast("long") for k in (-1, 0, 1)))
    a = units.select("session_id", F.col("frame_id").alias("id2"), F.col("tx").alias("ax"), F.col("ty").alias("ay"), cell("tx").alias("cx"), cell("ty").alias("cy"))
    for c in ("cx", "cy"):
        a = a.withColumn(c, F.explode(F.transform(step, _plus(F.col(c)))))
    b = units.select("session_id", F.col("frame_id").alias("id1"), F.col("tx").alias("bx"), F.col("ty").alias("by"), cell("tx").alias("cx"), cell("ty").alias("cy"))
    pairs = a.join(b, ["session_id", "cx", "cy"]).where(F.col("id2") - F.col("id1") >= gap)
    pairs = pairs.withColumn("dist", G.norm(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).where(F.col("dist") <= radius)
    return pairs.withColumn("nr", F.row_number().over(Window.partitionBy("session_id", "id2").orderBy("dist", "id1"))).select("session_id", "id1", "id2", "dist", "nr")


def history(units: DataFrame, candidates: DataFrame, reach: int = 1) -> DataFrame:
    """The units around each candidate's id1: session_id, id2, unit."""
    near = candidates.select("session_id", "id1", "id2", F.explode(F.sequence(F.col("id1") - reach, F.col("id1") + reach)).alias("frame_id"))
    return near.join(units.select("session_id", "frame_id"), ["session_id", "frame_id"]).select("session_id", "id1", "id2", F.col("frame_id").alias("unit"))


def residuals(edges: DataFrame, poses: DataFrame) -> DataFrame:
    """Per binary edge the translation and rotation error of the present poses and χ² = (‖t‖² + ‖φ‖²) / var."""
    p = lambda s, i: poses.select("session_id", F.col("frame_id").alias(i), *(F.col(n).alias(s + n) for n in POSE))
    on = edges.where("id1 IS NOT NULL").join(p("a_", "id1"), ["session_id", "id1"]).join(p("b_", "id2"), ["session_id", "id2"])
    now = relative("a_", "b_")
    on = on.withColumns({"m_" + k: v for k, v in now.items()})
    t = G.distance(trans("m_"), trans())
    w = F.abs(sum((F.col("m_" + n) * F.col(n) for n in POSE[4:]), F.col("m_qx") * F.col("qx")))
    angle = 2 * F.acos(F.least(F.lit(1.0), F.round(w, 12)))
    return on.select("session_id", "id1", "id2", "kind", t.alias("t_err"), angle.alias("r_err"), ((t * t + angle * angle) / F.col("var")).alias("chi2"))


def adjust(poses: DataFrame, edges: DataFrame, rounds: int = 15) -> DataFrame:
    """Poses of every session after Gauss-Newton on all its edges. A session's graph is one group; sessions run beside each other. The first pose is held where no unary edge does."""
    nodes = poses.select("session_id", F.col("frame_id").alias("id2"), F.lit(None).cast("int").alias("id1"), F.lit("node").alias("kind"), *POSE, F.lit(1.0).alias("var"))
    both = nodes.unionByName(edges.select(*nodes.columns))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf[pdf["kind"] == "node"].sort_values("id2")
        e = pdf[pdf["kind"] != "node"]
        at = {i: k for k, i in enumerate(n["id2"])}
        x = n[POSE].to_numpy().copy()
        m = 6 * len(x)
        e = e[e["id2"].isin(at) & (e["id1"].isna() | e["id1"].isin(at))]
        for _ in range(rounds):
            h, g = np.zeros((m, m)), np.zeros(m)
            h[:6, :6] += np.eye(6) * 1e9 * (not e["id1"].isna().any())
            for i, j, rel, var in zip(e["id1"], e["id2"], e[POSE].to_numpy(), e["var"]):
                b = at[j]
                inv = np.r_[-rel[3:6], rel[6]]
                if np.isnan(i):
                    err = x[b][:3] - rel[:3], _mul(inv, x[b][3:])
                    jac = {b: np.block([[np.eye(3), np.zeros((3, 3))], [np.zeros((3, 3)), np.eye(3)]])}
                    rot = np.eye(3)
                else:
                    a = at[int(i)]
                    ra = _rotation(x[a][3:])
                    d = ra.T @ (x[b][:3] - x[a][:3])
                    err = d - rel[:3], _mul(inv, _mul(np.r_[-x[a][3:6], x[a][6]], x[b][3:]))
                    rot = _rotation(x[b][3:]).T @ ra
                    jac = {a: np.block([[-ra.T, _cross(d)], [np.zeros((3, 3)), -rot]]), b: np.block([[ra.T, np.zeros((3, 3))], [np.zeros((3, 3)), np.eye(3)]])}
                r = np.r_[err[0], 2 * err[1][:3] * (1 if err[1][3] >= 0 else -1)]
                for p, jp in jac.items():
                    g[6 * p : 6 * p + 6] += jp.T @ r / var
                    for q, jq in jac.items():
                        h[6 * p : 6 * p + 6, 6 * q : 6 * q + 6] += jp.T @ jq / var
            step = -np.linalg.solve(h + 1e-9 * np.eye(m), g).reshape(-1, 6)
            x[:, :3] += step[:, :3]
            for k, s in enumerate(step):
                q = _mul(x[k][3:], np.r_[s[3:] / 2, 1.0])
                x[k][3:] = q / np.linalg.norm(q)
            if np.abs(step).max() < 1e-9:
                break
        out = pd.DataFrame(x, columns=POSE)
        out.insert(0, "frame_id", n["id2"].to_numpy())
        out.insert(0, "session_id", n["session_id"].to_numpy())
        return out

    kinds = ", ".join(f"{n} double" for n in POSE)
    return both.groupBy("session_id").applyInPandas(solve, f"session_id {poses.schema['session_id'].dataType.simpleString()}, frame_id {poses.schema['frame_id'].dataType.simpleString()}, {kinds}")


def _rotation(q: np.ndarray) -> np.ndarray:
    one = np.array([0, 0, 0, 0, 0, 0, 1.0])
    return np.stack([_compose(np.r_[0, 0, 0, q], np.r_[v, one[3:]])[:3] for v in np.eye(3)], axis=1)


def _cross(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0.0]])


def reassemble(points: DataFrame, poses: DataFrame) -> DataFrame:
    """The units' clouds in the world of corrected poses."""
    return transform_points(points, poses)
