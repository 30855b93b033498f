"""Pose-graph adjustment of long sessions: block-sparse normal equations as rows, eliminated by stretches, the rest by conjugate gradients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfuse.functions import geom as G
from scanfuse.operators.components import discard, staged
from scanfuse.operators.trajectory import POSE, quat

_NUMBERS = T.ArrayType(T.DoubleType())
#: A block of the normal equations: i <= j, h (6 × 6, by rows), and on the diagonal the gradient g.
BLOCK = "session_id long, i long, j long, h array<double>, g array<double>"


def _turn(q: np.ndarray) -> np.ndarray:
    """Rotation matrices of unit quaternions (x, y, z, w)."""
    x, y, z, w = q.T
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    return np.array(rows).transpose(2, 0, 1)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = a[:, 3:] * b[:, :3] + b[:, 3:] * a[:, :3] + np.cross(a[:, :3], b[:, :3])
    return np.c_[v, a[:, 3] * b[:, 3] - (a[:, :3] * b[:, :3]).sum(axis=1)]


def _conj(q: np.ndarray) -> np.ndarray:
    return q * [-1.0, -1.0, -1.0, 1.0]


def _skew(v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(v), 3, 3))
    for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        out[:, b, a], out[:, a, b] = v[:, c], -v[:, c]
    return out


def _linearised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each edge's part in the normal equations at the present poses: two diagonal blocks with gradients and the one between them; a unary edge gives one."""
    for e in batches:
        if not len(e):
            continue
        m, w = e[POSE].to_numpy(float), 1 / e["var"].to_numpy(float)
        b = e[["b_" + n for n in POSE]].to_numpy(float)
        one = e["id1"].isna().to_numpy()
        a = e[["a_" + n for n in POSE]].to_numpy(float)
        a[one] = [0, 0, 0, 0, 0, 0, 1]
        ra = _turn(a[:, 3:])
        d = np.einsum("nji,nj->ni", ra, b[:, :3] - a[:, :3])
        q = _times(_conj(m[:, 3:]), _times(_conj(a[:, 3:]), b[:, 3:]))
        r = np.c_[d - m[:, :3], 2 * q[:, :3] * np.where(q[:, 3:] >= 0, 1, -1)]
        ja, jb = np.zeros((len(e), 6, 6)), np.zeros((len(e), 6, 6))
        ja[:, :3, :3], ja[:, :3, 3:], ja[:, 3:, 3:] = -ra.transpose(0, 2, 1), _skew(d), -_turn(_conj(b[:, 3:])) @ ra
        jb[:, :3, :3], jb[:, 3:, 3:] = ra.transpose(0, 2, 1), np.eye(3)
        side = {"a": (ja, e["id1"]), "b": (jb, e["id2"])}
        out = []
        for s, (jac, ids) in side.items():
            on = ~one if s == "a" else np.ones(len(e), bool)
            h = np.einsum("nki,nkj,n->nij", jac, jac, w)[on].reshape(-1, 36)
            g = np.einsum("nki,nk,n->ni", jac, r, w)[on]
            out.append(pd.DataFrame({"session_id": e["session_id"][on], "i": ids[on], "j": ids[on], "h": list(h), "g": list(g)}))
        h = np.einsum("nki,nkj,n->nij", ja, jb, w)
        turned = (e["id1"] > e["id2"]).to_numpy()
        h[turned] = h[turned].transpose(0, 2, 1)
        cross = pd.DataFrame({"session_id": e["session_id"], "i": np.where(turned, e["id2"], e["id1"]), "j": np.where(turned, e["id1"], e["id2"]), "h": list(h.reshape(-1, 36)), "g": None})[~one]
        yield pd.concat([*out, cross]).astype({"session_id": "int64", "i": "int64", "j": "int64"})


def _summed(name: str, n: int) -> Column:
    return F.when(F.count(name) > 0, F.array(*(F.sum(F.col(name)[k]) for k in range(n)))).alias(name)


def equations(poses: DataFrame, edges: DataFrame, damping: float = 1e-9) -> DataFrame:
    """Normal equations at the present poses, as blocks to be added: an edge gives its own rows. A little is added to every diagonal, and much to a session's first where no unary edge holds it."""
    at = lambda s, i: poses.select("session_id", F.col("frame_id").alias(i), *(F.col(n).alias(s + n) for n in POSE))
    on = edges.select("session_id", "id1", "id2", *POSE, "var").join(at("b_", "id2"), ["session_id", "id2"]).join(at("a_", "id1"), ["session_id", "id1"], "left").where("id1 IS NULL OR a_qw IS NOT NULL")
    parts = on.mapInPandas(_linearised, BLOCK)
    eye = lambda c: F.array(*((c if k % 7 == 0 else F.lit(0.0)) for k in range(36)))
    held = edges.where("id1 IS NULL").select("session_id").distinct()
    first = poses.groupBy("session_id").agg(F.min("frame_id").alias("frame_id")).join(held, "session_id", "left_anti").withColumn("much", F.lit(1e9))
    nodes = poses.select("session_id", "frame_id").join(first, ["session_id", "frame_id"], "left")
    more = nodes.select("session_id", F.col("frame_id").alias("i"), F.col("frame_id").alias("j"), eye(F.coalesce("much", F.lit(0.0)) + damping).alias("h"), F.array(*(F.lit(0.0) for _ in range(6))).alias("g"))
    return parts.unionByName(more)


def _eliminated(pdf: pd.DataFrame) -> pd.DataFrame:
    """A stretch without its inner poses: what these add to the blocks of its outer ones (kind 0), and each inner step as a linear function of the outer ones' (kind 1: h, over ends, and g)."""
    session = int(pdf["session_id"].iloc[0])
    diag = pdf[pdf["i"] == pdf["j"]].drop_duplicates("i").sort_values("i")
    ids, outer = diag["i"].to_numpy(), diag["outer"].to_numpy(bool)
    order = np.r_[np.flatnonzero(~outer), np.flatnonzero(outer)]
    at = {int(i): k for k, i in enumerate(ids[order])}
    n, cut = len(ids), int((~outer).sum())
    big, g = np.zeros((n, 6, n, 6)), np.zeros((n, 6))
    for i, j, h, gi in zip(pdf["i"], pdf["j"], pdf["h"], pdf["g"]):
        a, b, block = at[int(i)], at[int(j)], np.asarray(h, float).reshape(6, 6)
        big[a, :, b] += block
        if a != b:
            big[b, :, a] += block.T
        else:
            g[a] += np.asarray(gi, float)
    big, g, c = big.reshape(6 * n, 6 * n), g.reshape(-1), 6 * cut
    k = np.linalg.solve(big[:c, :c], np.c_[big[:c, c:], g[:c]]) if c else np.zeros((0, 6 * n - c + 1))
    rest, grad = big[c:, c:] - big[c:, :c] @ k[:, :-1], (g[c:] - big[c:, :c] @ k[:, -1]).reshape(-1, 6)
    rest, names = rest.reshape(n - cut, 6, n - cut, 6), ids[order]
    rows = []
    for a in range(n - cut):
        for b in range(a, n - cut):
            if a == b or np.any(rest[a, :, b]):
                x, y = (a, b) if names[cut + a] <= names[cut + b] else (b, a)
                rows.append((session, 0, int(names[cut + x]), int(names[cut + y]), rest[x, :, y].reshape(-1), grad[a] if a == b else None, None))
    ends = [int(i) for i in names[cut:]]
    for a in range(cut):
        part = k[6 * a : 6 * a + 6]
        rows.append((session, 1, int(names[a]), None, part[:, :-1].reshape(-1), part[:, -1], ends))
    return pd.DataFrame(rows, columns=["session_id", "kind", "i", "j", "h", "g", "ends"]).astype({"j": "Int64"})


def _product(h: Column, v: Column, turned: bool = False) -> Column:
    """h v, or hᵀ v."""
    return F.array(*(sum((h[6 * b + a if turned else 6 * a + b] * v[b] for b in range(1, 6)), h[a if turned else 6 * a] * v[0]) for a in range(6)))


def _plus(a: Column, b: Column, by: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * by)


def _dot(a: str, b: str) -> Column:
    return F.sum(sum((F.col(a)[k] * F.col(b)[k] for k in range(1, 6)), F.col(a)[0] * F.col(b)[0]))


@F.pandas_udf(_NUMBERS)
def _inverse(h: pd.Series) -> pd.Series:
    if not len(h):
        return pd.Series([], dtype=object)
    return pd.Series(list(np.linalg.inv(np.stack(h.to_numpy()).reshape(-1, 6, 6)).reshape(-1, 36)))


def conjugate_gradients(blocks: DataFrame, most: int = 2000, to: float = 1e-10) -> DataFrame:
    """session_id, i, step: the solution of the blocks' equations, preconditioned by the inverse diagonal blocks.

    A product is a join of the blocks with the direction at both ends and a grouped sum; the state of a pass is one row a pose, written. Ends where the
    preconditioned residual has fallen to `to` of its first; if it has not after `most` passes, an error says so.
    """
    blocks = staged(blocks.groupBy("session_id", "i", "j").agg(_summed("h", 36), _summed("g", 6)), "blocks")
    diag = blocks.where("i = j").select("session_id", "i", _inverse("h").alias("m"), F.transform("g", lambda x: -x).alias("r"))
    start = diag.withColumn("z", _product(F.col("m"), F.col("r")))
    state = staged(start.select("session_id", "i", "m", F.transform("r", lambda x: F.lit(0.0)).alias("x"), "r", F.col("z").alias("p"), "z"), "gradients")
    on_disk = state
    first = rz = state.agg(_dot("r", "z")).first()[0] or 0.0
    for _ in range(most):
        if rz <= first * to * to or rz == 0:
            return state.select("session_id", "i", F.col("x").alias("step"))
        p = state.select("session_id", "i", "p")
        left = blocks.join(p.withColumnRenamed("i", "j"), ["session_id", "j"]).select("session_id", "i", _product(F.col("h"), F.col("p")).alias("q"))
        right = blocks.where("i <> j").join(p, ["session_id", "i"]).select("session_id", F.col("j").alias("i"), _product(F.col("h"), F.col("p"), True).alias("q"))
        q = left.unionByName(right).groupBy("session_id", "i").agg(_summed("q", 6))
        done = staged(state.join(q, ["session_id", "i"]), "gradients")
        alpha = rz / done.agg(_dot("p", "q")).first()[0]
        on = done.withColumns({"x": _plus(F.col("x"), F.col("p"), alpha), "r": _plus(F.col("r"), F.col("q"), -alpha)}).drop("q")
        new = staged(on.withColumn("z", _product(F.col("m"), F.col("r"))), "gradients")
        was, rz = rz, new.agg(_dot("r", "z")).first()[0]
        discard(on_disk, done)
        state, on_disk = new.withColumn("p", _plus(F.col("z"), F.col("p"), rz / was)), new
    raise RuntimeError(f"conjugate gradients: residual at {(rz / first) ** 0.5:.1e} of its first after {most} passes")


def solve(blocks: DataFrame, size: int = 128, grow: int = 8, crowd: int = 400) -> DataFrame:
    """session_id, i, step of the block-sparse equations.

    Poses lie in stretches of `size` frame numbers. Inside a stretch all poses that only stretch-mates see are eliminated in one task; the outer ones, near the cuts and at loops, remain, in
    stretches `grow` times as long, until a session is one stretch and nothing remains. Where a stretch would hold over `crowd` poses, as loops across the session make
    it, conjugate gradients solve what remains. Then the steps go back down the levels by joins.
    """
    backs, found = [], None
    while True:
        group = lambda c: F.floor(F.col(c) / size)
        at = blocks.select("*", group("i").alias("group"), (group("i") == group("j")).alias("inner"))
        crowded = at.where("i = j").groupBy("session_id", "group").agg(F.count_distinct("i").alias("n")).agg(F.max("n")).first()[0]
        if crowded is None:
            break
        if crowded > crowd:
            found = staged(conjugate_gradients(blocks), "found")
            break
        cross = at.where("NOT inner")
        outer = cross.select("session_id", F.explode(F.array("i", "j")).alias("i")).distinct().withColumn("outer", F.lit(True))
        inside = at.where("inner").join(outer, ["session_id", "i"], "left").select("session_id", "group", "i", "j", "h", "g", F.coalesce("outer", F.lit(False)).alias("outer"))
        cut = staged(inside.groupBy("session_id", "group").applyInPandas(_eliminated, "session_id long, kind int, i long, j long, h array<double>, g array<double>, ends array<long>"), "eliminated")
        backs.append(cut.where("kind = 1"))
        blocks = staged(cut.where("kind = 0").select("session_id", "i", "j", "h", "g").unionByName(cross.select("session_id", "i", "j", "h", "g")), "blocks")
        size *= grow
    for back in reversed(backs):
        own = back.select("session_id", "i", F.transform("g", lambda x: -x).alias("step"))
        if found is not None:
            width = 6 * F.size("ends")
            block = lambda k: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda a: F.slice("h", a * width + 6 * k + 1, F.lit(6))))
            each = back.where(F.size("ends") > 0).select("session_id", F.col("i").alias("inner"), F.posexplode("ends").alias("k", "i"), "h", "ends").select("session_id", "inner", "i", block(F.col("k")).alias("h"))
            parts = each.join(found, ["session_id", "i"]).select("session_id", F.col("inner").alias("i"), F.transform(_product(F.col("h"), F.col("step")), lambda x: -x).alias("step"))
            own = own.unionByName(parts).groupBy("session_id", "i").agg(_summed("step", 6)).unionByName(found)
        found = staged(own, "found")
    return found


def adjust_long(poses: DataFrame, edges: DataFrame, rounds: int = 15, **how: int) -> DataFrame:
    """Poses (session_id, frame_id, POSE; ids are integers) after Gauss-Newton on all edges, for sessions of any length. No task holds a session; see `solve`.

    Edges whose poses are not there take no part. An empty table gives an empty result.
    """
    kinds = {n: poses.schema[n].dataType for n in ("session_id", "frame_id")}
    now = staged(poses.select(*(F.col(n).cast("long").alias(n) for n in kinds), *POSE), "poses")
    edges = staged(edges.select(*(F.col(n).cast("long").alias(n) for n in ("session_id", "id1", "id2")), *POSE, "var"), "edges")
    for _ in range(rounds):
        blocks = staged(equations(now, edges), "blocks")
        found = solve(blocks, **how)
        if found is None:
            break
        s = [F.col("step")[k] for k in range(6)]
        turned = G.unit(G.qmul(quat(), (s[3] / 2, s[4] / 2, s[5] / 2, F.lit(1.0))))
        on = now.join(found.withColumnRenamed("i", "frame_id"), ["session_id", "frame_id"])
        new = staged(on.select("session_id", "frame_id", *((F.col(n) + s[k]).alias(n) for k, n in enumerate(POSE[:3])), *(v.alias(n) for v, n in zip(turned, POSE[3:])), F.array_max(F.transform("step", F.abs)).alias("moved")), "poses")
        discard(now, blocks)
        now = new.drop("moved")
        if new.agg(F.max("moved")).first()[0] < 1e-9:
            break
    return now.select(*(F.col(n).cast(t).alias(n) for n, t in kinds.items()), *POSE)
