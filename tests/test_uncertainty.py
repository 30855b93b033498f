"""Compounded covariances against sampled poses, and chains cut into chunks."""

from __future__ import annotations

import numpy as np
import pytest

from scanfuse.operators import trajectory


def _hat(v):
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def _exp(x):
    m, term, out = np.zeros((4, 4)), np.eye(4), np.eye(4)
    m[:3, :3], m[:3, 3] = _hat(x[3:]), x[:3]
    for k in range(1, 20):
        term = term @ m / k
        out = out + term
    return out


def _log(t):
    """By Newton's square roots and the series near the identity."""
    m, k = t, 0
    while np.linalg.norm(m - np.eye(4)) > 0.1:
        y, z = m, np.eye(4)
        for _ in range(12):
            y, z = (y + np.linalg.inv(z)) / 2, (z + np.linalg.inv(y)) / 2
        m, k = y, k + 1
    d, term, out = m - np.eye(4), np.eye(4), np.zeros((4, 4))
    for j in range(1, 25):
        term = term @ d
        out = out - (-1) ** j * term / j
    out *= 2**k
    return np.r_[out[:3, 3], out[2, 1], out[0, 2], out[1, 0]]


def test_compounding_is_nearer_to_samples_than_the_sum():
    rng = np.random.default_rng(11)
    a, b = (np.diag(v) for v in ([0.02, 0.05, 0.01, 0.02, 0.05, 0.15], [0.05, 0.02, 0.03, 0.1, 0.03, 0.08]))
    xs, ys = (rng.multivariate_normal(np.zeros(6), m, 20_000) for m in (a, b))
    errors = np.array([_log(_exp(x) @ _exp(y)) for x, y in zip(xs, ys)])
    sampled = errors.T @ errors / len(errors)
    own = (xs + ys).T @ (xs + ys) / len(xs)  # the samples' own sum, so that their noise counts on neither side
    off = lambda cov: np.linalg.norm(cov - (sampled - own + a + b))
    assert off(trajectory._compound(a, b)) < 0.5 * off(a + b)


def test_carried_is_the_adjoint():
    pose = np.array([1.0, -2.0, 0.5, 0.1, 0.2, 0.3, 0.9])
    q = pose[3:] / np.linalg.norm(pose[3:])
    t = np.eye(4)
    t[:3, :3] = np.eye(3) + 2 * q[3] * _hat(q[:3]) + 2 * _hat(q[:3]) @ _hat(q[:3])
    t[:3, 3] = pose[:3]
    x = np.array([0.01, -0.02, 0.015, 0.02, 0.01, -0.03])
    moved = _log(t @ _exp(x) @ np.linalg.inv(t))
    assert np.allclose(trajectory._carried(pose, np.outer(x, x)), np.outer(moved, moved), atol=1e-9)


@pytest.mark.parametrize("chunk", [3, 100])
def test_chains_by_chunks(spark, chunk):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for s in range(2):
        at, last = np.array([0, 0, 0, 0, 0, 0, 1.0]), np.array([0, 0, 0, 0, 0, 0, 1.0])
        for f in range(11):
            step = np.r_[rng.normal(0, 1, 3), rng.normal(0, 0.2, 3), 1.0]
            step[3:] /= np.linalg.norm(step[3:])
            ok = bool(f > s and (f < 3 or f > 7))
            rows.append((s, f, ok, *map(float, step)))
            last = step if ok else last
            at = trajectory._compose(at, last)
            want[s, f] = at
    df = spark.createDataFrame(rows, "session_id int, frame_id int, ok boolean, " + ", ".join(f"{n} double" for n in trajectory.POSE))
    got = {(r["session_id"], r["frame_id"]): np.array([r[n] for n in trajectory.POSE]) for r in trajectory.chain_poses(df, chunk).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
