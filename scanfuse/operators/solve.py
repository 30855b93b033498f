"""Registration of the frames of one map in memory: what register.py runs in a group. Poses are rows tx … qw."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pyarrow as pa

from scanfuse.operators.groups import Columns, Nearest

Points = list[np.ndarray]


def _rows(points: Columns, ids: np.ndarray, by: str) -> tuple[Columns, np.ndarray]:
    """The points of the frames `ids` (ascending), frame by frame, and the place of each one's frame."""
    of = np.minimum(np.searchsorted(ids, points[by]), len(ids) - 1)
    some = np.flatnonzero(ids[of] == points[by])
    some = some[np.argsort(of[some], kind="stable")]
    return {c: v[some] for c, v in points.items()}, of[some]


def _start(poses: Columns, by: str) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(poses[by], kind="stable")
    return poses[by][order], np.stack(poses["pose"][order]).astype(float)


def _xyz(rows: Columns) -> Points:
    return [rows[a] for a in "xyz"]


def _unit(q: np.ndarray) -> np.ndarray:
    return q / np.sqrt((q * q).sum(axis=1, keepdims=True))


def _qmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (ax, ay, az, aw), (bx, by, bz, bw) = a.T, b.T
    return np.stack([aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz], axis=1)


def _rotate(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    t = 2 * np.cross(q[:, :3], p)
    return p + q[:, 3:] * t + np.cross(q[:, :3], t)


def _matrices(q: np.ndarray) -> np.ndarray:
    x, y, z, w = q.T
    return np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], axis=1)


def _moved(pose: np.ndarray, of: np.ndarray, p: Points) -> Points:
    r = _matrices(_unit(pose[:, 3:]))
    return [r[of, 3 * i] * p[0] + r[of, 3 * i + 1] * p[1] + r[of, 3 * i + 2] * p[2] + pose[of, i] for i in range(3)]


def _small_turn(step: np.ndarray) -> np.ndarray:
    """Quaternions of rotation vectors."""
    angle = np.sqrt((step * step).sum(axis=1))
    half = np.where(angle > 1e-12, np.sin(angle / 2) / np.where(angle > 1e-12, angle, 1.0), 0.5)
    return np.c_[step * half[:, None], np.cos(angle / 2)]


def _stepped(pose: np.ndarray, step: np.ndarray) -> np.ndarray:
    dq = _small_turn(step[:, :3])
    return np.c_[_rotate(dq, pose[:, :3]) + step[:, 3:], _unit(_qmul(dq, pose[:, 3:]))]


def _step(of: np.ndarray, frames: int, p: Points, n: Points, r: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The step of each frame by its plane residuals (zero without any), their number and Σ w r²."""
    j = [p[1] * n[2] - p[2] * n[1], p[2] * n[0] - p[0] * n[2], p[0] * n[1] - p[1] * n[0], *n]
    total = lambda v: np.bincount(of, v, frames)
    h, g = np.zeros((frames, 6, 6)), np.zeros((frames, 6))
    for a in range(6):
        jw = j[a] * w
        g[:, a] = total(jw * r)
        for b in range(a, 6):
            h[:, a, b] = h[:, b, a] = total(jw * j[b])
    count = np.bincount(of, minlength=frames)
    step = -np.linalg.solve(h + 1e-6 * np.eye(6), g[..., None])[..., 0]
    step[count == 0] = 0
    return step, count, total(w * r * r)


def _plane(t: Points, limit: float = 0.2) -> tuple[Points, np.ndarray, np.ndarray]:
    """Normals, offsets and whether all neighbours lie within the limit, of planes of neighbours (a row a query), as stats.neighbour_planes."""
    s = {a + b: (u * v).sum(axis=1) for i, (a, u) in enumerate(zip("xyz", t)) for b, v in list(zip("xyz", t))[i:]}
    m = [s["xx"], s["xy"], s["xz"], s["xy"], s["yy"], s["yz"], s["xz"], s["yz"], s["zz"]]
    b = [-v.sum(axis=1) for v in t]
    det3 = lambda m: m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    det = det3(m)
    with np.errstate(all="ignore"):
        a = [det3([b[i // 3] if i % 3 == k else m[i] for i in range(9)]) / det for k in range(3)]
        size = np.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
        n, d = [v / size for v in a], 1 / size
        worst = np.abs(n[0][:, None] * t[0] + n[1][:, None] * t[1] + n[2][:, None] * t[2] + d[:, None]).max(axis=1, initial=0)
        return n, d, (np.abs(det) > 1e-12) & (worst <= limit)


def _cauchy(r: np.ndarray, scale: float = 0.1) -> np.ndarray:
    return 1 / (1 + r * r / (scale * scale))


def _gnc(r: np.ndarray, mu: float, eps: float = 0.2) -> np.ndarray:
    e, r2 = eps * eps, r * r
    with np.errstate(all="ignore"):
        return np.where(r2 >= (mu + 1) / mu * e, 0.0, np.where(r2 <= mu / (mu + 1) * e, 1.0, np.sqrt(e * mu * (mu + 1) / r2) - mu))


def _near(p: Points, search: Nearest, known: Columns, k: int, radius: float) -> tuple[np.ndarray, Points]:
    """The points that have k neighbours, and these, a row a point."""
    at, _, have = search.find(p, k, radius)
    some = np.flatnonzero(have == k)
    return some, [known[a][at[some]] for a in "xyz"]


def register(poses: Columns, points: list[Columns], maps: list[Columns], rounds: int, k: int, radius: float, shrink: float, robust: str, edge_rounds: int | None) -> dict[str, Any]:
    """The rounds of register.register; points and maps may have edge points second."""
    ids, pose = _start(poses, "frame_id")
    rows = [_rows(p, ids, "frame_id") for p in points]
    searches = [Nearest(len(of), known["pt_id"], _xyz(known)) for (_, of), known in zip(rows, maps)]
    for it in range(rounds):
        weigh = _cauchy if robust == "cauchy" else lambda r, mu=float(2 ** min(it, 20)): _gnc(r, mu)
        got = []
        for kind, ((part, of), known) in enumerate(zip(rows, maps)):
            if kind and edge_rounds is not None and it >= edge_rounds:
                continue
            p = _moved(pose, of, _xyz(part))
            some, t = _near(p, searches[kind], known, k, radius / shrink**it)
            p, of = [a[some] for a in p], of[some]
            if kind:
                got += _across(p, of, t, weigh)
                continue
            n, d, ok = _plane(t)
            p, n, of = [a[ok] for a in p], [a[ok] for a in n], of[ok]
            r = n[0] * p[0] + n[1] * p[1] + n[2] * p[2] + d[ok]
            got.append((of, p, n, r, weigh(r)))
        step, count, cost = _step(np.concatenate([x[0] for x in got]), len(ids), *([np.concatenate([x[i][a] for x in got]) for a in range(3)] for i in (1, 2)), *(np.concatenate([x[i] for x in got]) for i in (3, 4)))
        pose = np.where((count > 0)[:, None], _stepped(pose, step), pose)
    return {"frame_id": pa.array(ids), "pose": pa.array(list(pose)), "n": pa.array(count.astype(np.int64), mask=count == 0), "cost": pa.array(cost, mask=count == 0)}


def _across(p: Points, of: np.ndarray, t: Points, weigh: Any) -> list[tuple]:
    """Residuals of points along the two axes across the lines of their neighbours, as register.line_residuals."""
    mean = [v.mean(axis=1) for v in t]
    m = np.empty((len(of), 3, 3))
    for a in range(3):
        for b in range(3):
            m[:, a, b] = (t[a] * t[b]).mean(axis=1) - mean[a] * mean[b]
    values, vectors = np.linalg.eigh(m)
    ok = values[:, 2] > 3 * values[:, 1]
    p, of, axes = [a[ok] for a in p], of[ok], vectors[ok]
    off = [a - c[ok] for a, c in zip(p, mean)]
    normals = [[axes[:, a, k] for a in range(3)] for k in (0, 1)]
    r = [off[0] * n[0] + off[1] * n[1] + off[2] * n[2] for n in normals]
    w = weigh(np.sqrt(r[0] * r[0] + r[1] * r[1]))
    return [(of, p, n, v, w) for n, v in zip(normals, r)]


def _weights(u: np.ndarray) -> np.ndarray:
    """geom.clamped_cubic, a row a point."""
    v, low = 1 - u, u < 0.5
    high = lambda x: 2 * x * (1 - 2 * x) ** 2 + 2 * x * (1 - x) * (1 - 2 * x) + 2 * x * (1 - x) * (1 - x)
    w0, w4 = np.where(low, (1 - 2 * u) ** 3, 0.0), np.where(low, 0.0, (2 * u - 1) ** 3)
    w1, w3 = np.where(low, high(u), 2 * v**3), np.where(low, 2 * u**3, high(v))
    return np.stack([w0, w1, 1 - w0 - w1 - w3 - w4, w3, w4], axis=1)


def _slerp(a: np.ndarray, b: np.ndarray, u: np.ndarray) -> np.ndarray:
    d = (a * b).sum(axis=1)
    angle = np.arccos(np.minimum(np.abs(d), 1.0))
    s = np.sin(angle)
    near = s < 1e-9
    s = np.where(near, 1.0, s)
    wa, wb = np.where(near, 1 - u, np.sin((1 - u) * angle) / s), np.where(near, u, np.sin(u * angle) / s) * np.where(d < 0, -1.0, 1.0)
    return _unit(wa[:, None] * a + wb[:, None] * b)


def _spline(control: np.ndarray, of: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and rotations of the points' own times; control: frames × 5 × 7."""
    place = np.einsum("nk,nkc->nc", w, control[of, :, :3])
    q, total = control[of, 0, 3:], w[:, 0]
    for k in range(1, 5):
        total = total + w[:, k]
        some = np.abs(total) > 1e-12
        q = _slerp(q, control[of, k, 3:], np.where(some, w[:, k] / np.where(some, total, 1.0), 0.0))
    return place, q


def register_windows(windows: Columns, points: Columns, known: Columns, rounds: int, k: int, radius: float, shrink: float, damping: float) -> dict[str, Any]:
    """The rounds of register.register_windows."""
    ids, control = _start(windows, "window_id")
    control = control.reshape(-1, 5, 7)
    rows, of = _rows(points, ids, "window_id")
    w, seen = _weights(rows["ratio"]), np.stack(_xyz(rows), axis=1)
    search = Nearest(len(of), known["pt_id"], _xyz(known))
    for it in range(rounds):
        place, q = _spline(control, of, w)
        lever = _rotate(q, seen)
        p = [lever[:, a] + place[:, a] for a in range(3)]
        some, t = _near(p, search, known, k, radius / shrink**it)
        n, d, ok = _plane(t)
        some, n = some[ok], [a[ok] for a in n]
        r = n[0] * p[0][some] + n[1] * p[1][some] + n[2] * p[2][some] + d[ok]
        weight = _cauchy(r)
        n = np.stack(n, axis=1)
        j = np.c_[np.cross(lever[some], n), n]
        bounds = np.searchsorted(of[some], np.arange(len(ids) + 1))
        cost, count = np.zeros(len(ids)), np.diff(bounds)
        for f in np.flatnonzero(count):
            at = slice(bounds[f], bounds[f + 1])
            jac = (w[some[at], :, None] * j[at, None]).reshape(-1, 30)
            jw = jac * weight[at, None]
            h, g = jw.T @ jac, jw.T @ r[at]
            step = -np.linalg.solve(h + damping * np.eye(30) * max(np.trace(h) / 30, 1e-9), g).reshape(5, 6)
            control[f] = np.c_[control[f, :, :3] + step[:, 3:], _unit(_qmul(_small_turn(step[:, :3]), control[f, :, 3:]))]
            cost[f] = (weight[at] * r[at] * r[at]).sum()
    return {"window_id": pa.array(ids), "pose": pa.array(list(control.reshape(-1, 35))), "cost": pa.array(cost, mask=count == 0), "n": pa.array(count.astype(np.int64), mask=count == 0)}


def _quaternion(m: np.ndarray) -> np.ndarray:
    """geom.matrix_quaternion of 3 × 3 matrices."""
    d0, d1, d2 = m[:, 0, 0], m[:, 1, 1], m[:, 2, 2]
    part = lambda d, sign: np.sqrt(np.maximum(d, 0.0)) / 2 * np.where(sign < 0, -1.0, 1.0)
    return _unit(np.stack([part(1 + d0 - d1 - d2, m[:, 2, 1] - m[:, 1, 2]), part(1 - d0 + d1 - d2, m[:, 0, 2] - m[:, 2, 0]), part(1 - d0 - d1 + d2, m[:, 1, 0] - m[:, 0, 1]), np.sqrt(np.maximum(1 + d0 + d1 + d2, 0.0)) / 2], axis=1))


def align_trimmed(points: Columns, known: Columns, rounds: int, ratio: float, keep: float, radius: float) -> dict[str, Any]:
    """The rounds of register.align_trimmed."""
    ids = np.unique(points["frame_id"])
    rows, of = _rows(points, ids, "frame_id")
    pose = np.tile([0, 0, 0, 0, 0, 0, 1.0], (len(ids), 1))
    mean, went, done = np.full(len(ids), np.nan), np.zeros(len(ids), np.int32), np.zeros(len(ids), bool)
    target, search = np.stack(_xyz(known), axis=1), Nearest(len(of), known["pt_id"], _xyz(known))
    for _ in range(rounds):
        open_ = np.flatnonzero(~done[of])
        if not len(open_):
            break
        p = _moved(pose, of[open_], [a[open_] for a in _xyz(rows)])
        at, d2, have = search.find(p, 1, radius, open_)
        hit = np.flatnonzero(have)
        frame, d2, at, p, q_id = of[open_][hit], d2[hit, 0], at[hit, 0], np.stack(p, axis=1)[hit], rows["pt_id"][open_][hit]
        order = np.lexsort((q_id, d2, frame))
        bounds = np.searchsorted(frame[order], np.arange(len(ids) + 1))
        for f in np.flatnonzero(~done):
            some = order[bounds[f] : bounds[f + 1]]
            some = some[: math.ceil(len(some) * keep)]
            if not len(some):
                done[f] = True
                continue
            q, t = p[some], target[at[some]]
            mq, mt = q.mean(axis=0), t.mean(axis=0)
            u, _, vt = np.linalg.svd(q.T @ t - len(some) * np.outer(mq, mt))
            vt[2] *= np.linalg.det(vt.T @ u.T)
            r = vt.T @ u.T
            dq = _quaternion(r[None])
            pose[f] = np.r_[_rotate(dq, pose[f : f + 1, :3])[0] + mt - r @ mq, _unit(_qmul(dq, pose[f : f + 1, 3:]))[0]]
            now = d2[some].sum() / len(some)
            done[f] = now >= ratio * mean[f] or now == 0
            mean[f], went[f] = now, went[f] + 1
    return {"frame_id": pa.array(ids), "pose": pa.array(list(pose)), "mean_d2": pa.array(mean, mask=np.isnan(mean)), "rounds": pa.array(went)}


def register_clouds(poses: Columns, points: Columns, known: Columns, radii: tuple[float, ...], leaf: float) -> dict[str, Any]:
    """The rounds of register.register_clouds."""
    ids, pose = _start(poses, "frame_id")
    rows, of = _rows(points, ids, "frame_id")
    xyz = _xyz(known)
    fine = np.isfinite(xyz[0] + xyz[1] + xyz[2])
    known = {c: v[fine] for c, v in known.items()}
    xyz = _xyz(known)
    _, cell, size = np.unique(np.stack([np.floor(a / leaf) for a in xyz], axis=1), axis=0, return_inverse=True, return_counts=True) if len(xyz[0]) else (None, np.zeros(0, int), np.zeros(0, int))
    cell = cell.reshape(-1)
    total = lambda v: np.bincount(cell, v, len(size))
    mean = [total(a) / size for a in xyz]
    cov = np.empty((len(size), 3, 3))
    for a in range(3):
        for b in range(a, 3):
            cov[:, a, b] = cov[:, b, a] = total(xyz[a] * xyz[b]) / size - mean[a] * mean[b]
    values, vectors = np.linalg.eigh(cov)
    flat = np.where(values[:, 1] > 20 * np.maximum(values[:, 0], 1e-9), 1.0, 0.1)
    some = np.flatnonzero(size[cell] >= 5)
    t, t_id, n, flat = [a[some] for a in xyz], known["pt_id"][some], vectors[cell[some], :, 0], flat[cell[some]]
    search = Nearest(len(of), t_id, t)
    for radius in (r for r in radii for _ in range(3)):
        p = _moved(pose, of, _xyz(rows))
        at, _, have = search.find(p, 1, radius)
        hit = np.flatnonzero(have)
        at, p = at[hit, 0], [a[hit] for a in p]
        normal = [n[at, a] for a in range(3)]
        r = sum((p[a] - t[a][at]) * normal[a] for a in range(3))
        step, count, _ = _step(of[hit], len(ids), p, normal, r, flat[at] * _cauchy(r, radius / 4))
        pose = np.where((count > 0)[:, None], _stepped(pose, step), pose)
    return {"frame_id": pa.array(ids), "pose": pa.array(list(pose))}
