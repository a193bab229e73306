"""Rigid-body and camera arithmetic as column expressions.

Quaternions are scalar-last ``(x, y, z, w)`` and rotate actively unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


def rotate(v: Vec, q: Vec) -> tuple[Column, Column, Column]:
    """Active rotation of ``v`` by ``q``."""
    x, y, z = v
    qx, qy, qz, qw = q
    tx, ty, tz = 2 * (qy * z - qz * y), 2 * (qz * x - qx * z), 2 * (qx * y - qy * x)
    return (
        x + qw * tx + (qy * tz - qz * ty),
        y + qw * ty + (qz * tx - qx * tz),
        z + qw * tz + (qx * ty - qy * tx),
    )


def rotate_translate(v: Vec, q: Vec, t: Vec) -> tuple[Column, Column, Column]:
    """Rotate, then translate."""
    return tuple(r + d for r, d in zip(rotate(v, q), t))


def euler_to_quat(rx: Column, ry: Column, rz: Column) -> tuple[Column, Column, Column, Column]:
    """Quaternion of the rotation about x, then y, then z; 32-bit output."""
    cx, sx = F.cos(rx / 2), F.sin(rx / 2)
    cy, sy = F.cos(ry / 2), F.sin(ry / 2)
    cz, sz = F.cos(rz / 2), F.sin(rz / 2)
    return (
        (sx * cy * cz - cx * sy * sz).cast("float"),
        (cx * sy * cz + sx * cy * sz).cast("float"),
        (cx * cy * sz - sx * sy * cz).cast("float"),
        (cx * cy * cz + sx * sy * sz).cast("float"),
    )


def yaw(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Heading about z of a scalar-first quaternion."""
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def quat_product(a: Vec, b: Vec) -> tuple[Column, Column, Column, Column]:
    """``a`` applied after ``b``."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def normalised(q: Vec) -> tuple[Column, ...]:
    norm = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    return tuple(c / norm for c in q)


def horner(coefficients: Column, x: Column) -> Column:
    """``c0 + c1*x + c2*x^2 + ...`` of an ascending coefficient array."""
    return F.aggregate(F.reverse(coefficients.cast("array<double>")), F.lit(0.0), lambda acc, c: acc * x + c)
