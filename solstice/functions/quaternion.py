"""Quaternions as struct<x,y,z,w> columns, scalar last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clip


def quaternion(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"), w.cast("double").alias("w"))


def about_axis(axis: str, radians: Column) -> Column:
    """The rotation about one of the axes x, y, z."""
    s, zero = F.sin(radians / 2), F.lit(0.0)
    return quaternion(*[s if a == axis else zero for a in "xyz"], F.cos(radians / 2))


def inverse(q: Column) -> Column:
    """Of a unit quaternion."""
    return quaternion(-q.x, -q.y, -q.z, q.w)


def multiply(a: Column, b: Column) -> Column:
    """The rotation b, then a."""
    return quaternion(
        a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y,
        a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x,
        a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w,
        a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z,
    )


def dot(a: Column, b: Column) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z + a.w * b.w


def rotate(q: Column, x: Column, y: Column, z: Column) -> Column:
    """struct<x,y,z>: the vector turned by q."""
    tx, ty, tz = (2 * (q.y * z - q.z * y), 2 * (q.z * x - q.x * z), 2 * (q.x * y - q.y * x))
    return F.struct(
        (x + q.w * tx + q.y * tz - q.z * ty).alias("x"),
        (y + q.w * ty + q.z * tx - q.x * tz).alias("y"),
        (z + q.w * tz + q.x * ty - q.y * tx).alias("z"),
    )


def slerp_weights(dot: Column, t: Column) -> tuple[Column, Column]:
    """What the ends of the shorter arc weigh at t, from 0 to 1; nearly equal ends are mixed linearly."""
    sign = F.when(dot < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    near = clip(F.abs(dot), 0.0, 1.0)
    small = near > 1 - 1e-12
    angle, sine = F.acos(near), F.nullif(F.sin(F.acos(near)), F.lit(0.0))
    return F.when(small, 1 - t).otherwise(F.sin((1 - t) * angle) / sine), sign * F.when(small, t).otherwise(F.sin(t * angle) / sine)


def rotation_vector(q: Column) -> Column:
    """struct<x,y,z>: axis times angle, at most half a turn."""
    flip = F.when(q.w < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    size = F.sqrt(q.x * q.x + q.y * q.y + q.z * q.z)
    factor = F.when(size < 1e-12, F.lit(2.0)).otherwise(2 * F.atan2(size, flip * q.w) / F.nullif(size, F.lit(0.0)))
    return F.struct(*[(factor * flip * q[c]).alias(c) for c in "xyz"])


def heading(q: Column) -> Column:
    """Radians of the turned x axis around z; null if it points up or down (within 1e-6)."""
    v = rotate(q, F.lit(1.0), F.lit(0.0), F.lit(0.0))
    return F.when(F.sqrt(v.x * v.x + v.y * v.y) > 1e-6, F.atan2(v.y, v.x))
