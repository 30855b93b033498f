"""Column functions: angles, quaternions, splines, 3 × 3 matrices. Built-in expressions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]


def c(x: "Column | str | float") -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def vec(prefix: str = "", names: Sequence[str] = ("x", "y", "z")) -> Vec:
    return tuple(F.col(prefix + n) for n in names)  # type: ignore[return-value]


def norm(*xs: Column) -> Column:
    return F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))


def distance(a: Vec, b: Vec) -> Column:
    return norm(*(p - q for p, q in zip(a, b)))


def sq_distance(a: Vec, b: Vec) -> Column:
    d = [p - q for p, q in zip(a, b)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def azimuth(x: Column, y: Column) -> Column:
    """Degrees from the y axis, as range images count."""
    return F.degrees(F.atan2(x, y))


def elevation(x: Column, y: Column, z: Column) -> Column:
    return F.degrees(F.atan2(z, norm(x, y)))


def whole(x: Column) -> Column:
    return F.floor(x).cast("int")


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def unit(q: Quat) -> Quat:
    n = norm(*q)
    return tuple(x / n for x in q)  # type: ignore[return-value]


def conj(q: Quat) -> Quat:
    return -q[0], -q[1], -q[2], q[3]


def qmul(a: Quat, b: Quat) -> Quat:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def rotate(q: Quat, p: Vec) -> Vec:
    """p turned by the unit quaternion q."""
    axis = q[:3]
    t = tuple(2 * v for v in cross(axis, p))
    u = cross(axis, t)
    return tuple(p[k] + q[3] * t[k] + u[k] for k in range(3))  # type: ignore[return-value]


def rotation_matrix(q: Quat) -> list[Column]:
    """Nine entries by rows of the unit quaternion q."""
    x, y, z, w = q
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def matrix_quaternion(m: Sequence[Column]) -> Quat:
    """Unit quaternion with w ≥ 0 of the rotation matrix m (nine entries by rows)."""
    w = F.sqrt(F.greatest(1 + m[0] + m[4] + m[8], F.lit(0.0))) / 2
    part = lambda d, sign: F.sqrt(F.greatest(d, F.lit(0.0))) / 2 * F.when(sign < 0, -1.0).otherwise(1.0)
    return part(1 + m[0] - m[4] - m[8], m[7] - m[5]), part(1 - m[0] + m[4] - m[8], m[2] - m[6]), part(1 - m[0] - m[4] + m[8], m[3] - m[1]), w


def slerp(a: Quat, b: Quat, u: Column) -> Quat:
    """Along the shorter arc from a to b."""
    d = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(d), F.lit(1.0)))
    near = F.sin(angle) < 1e-9
    wa = F.when(near, 1 - u).otherwise(F.sin((1 - u) * angle) / F.sin(angle))
    wb = F.when(near, u).otherwise(F.sin(u * angle) / F.sin(angle)) * sign
    return unit(tuple(wa * p + wb * q for p, q in zip(a, b)))  # type: ignore[arg-type]


def clamped_cubic(u: Column) -> list[Column]:
    """The five cubic B-spline weights with knots 0,0,0,0,½,1,1,1,1 at u in [0, 1]."""
    low = u < 0.5
    v = 1 - u
    pick = lambda a, b: F.when(low, a).otherwise(b)
    first = F.pow(1 - 2 * u, F.lit(3.0))
    last = F.pow(2 * u - 1, F.lit(3.0))
    second = 2 * u * (1 - 2 * u) * (1 - 2 * u) + 2 * u * (1 - u) * (1 - 2 * u) + 2 * u * (1 - u) * (1 - u)
    second_high = 2 * v * v * v
    mirror = 2 * v * (1 - 2 * v) * (1 - 2 * v) + 2 * v * (1 - v) * (1 - 2 * v) + 2 * v * (1 - v) * (1 - v)
    w0, w4 = pick(first, F.lit(0.0)), pick(F.lit(0.0), last)
    w1, w3 = pick(second, second_high), pick(2 * u * u * u, mirror)
    return [w0, w1, 1 - w0 - w1 - w3 - w4, w3, w4]


def catmull_rom(u: Column) -> list[Column]:
    """Weights of four neighbouring poses between the middle two."""
    u2, u3 = u * u, u * u * u
    return [(-u3 + 2 * u2 - u) / 2, (3 * u3 - 5 * u2 + 2) / 2, (-3 * u3 + 4 * u2 + u) / 2, (u3 - u2) / 2]


def half_clamped(u: Column) -> list[Column]:
    """Weights of a cubic B-spline that is clamped at its start and uniform at its end, for its first span."""
    u2, u3 = u * u, u * u * u
    v = 1 - u
    return [v * v * v, (7 * u3 - 18 * u2 + 12 * u) / 4, (-11 * u3 + 18 * u2) / 12, u3 / 6]


def uniform_cubic(u: Column) -> list[Column]:
    u2, u3 = u * u, u * u * u
    return [(1 - 3 * u + 3 * u2 - u3) / 6, (4 - 6 * u2 + 3 * u3) / 6, (1 + 3 * u + 3 * u2 - 3 * u3) / 6, u3 / 6]


def det3(a: Column, b: Column, d: Column, e: Column, f: Column, g: Column, h: Column, i: Column, j: Column) -> Column:
    return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)


def eigenvalues(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> tuple[Column, Column, Column]:
    """Of a symmetric matrix, ascending, in closed form."""
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    det = det3(xx - q, xy, xz, xy, yy - q, yz, xz, yz, zz - q)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))
    phi = F.when(p > 0, F.acos(r) / 3).otherwise(0.0)
    high = q + 2 * p * F.cos(phi)
    low = q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return low, 3 * q - high - low, high
