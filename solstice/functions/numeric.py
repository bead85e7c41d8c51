"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Whether x is a number that is neither NaN nor infinite; null gives false."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def smoothstep(x: Column) -> Column:
    """0 up to 0, 1 from 1, and the cubic with flat ends between."""
    t = clip(x, 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def angle_between(dot: Column) -> Column:
    """Degrees between unit vectors of which the dot product is given."""
    return F.degrees(F.acos(clip(dot, -1.0, 1.0)))


def chord_angle(length: Column) -> Column:
    """Degrees of arc of a chord of the unit circle."""
    return F.degrees(2.0 * F.asin(F.least(F.lit(1.0), length / 2.0)))


def round_half_even_ratio(numerator: Column, denominator: Column) -> Column:
    """The whole number nearest to numerator / denominator, a tie to the even one; exact for whole decimals, denominator > 0."""
    whole = F.floor(numerator / denominator)
    # decimal division rounds; step to the true floor
    down = F.when(whole * denominator > numerator, whole - 1).when((whole + 1) * denominator <= numerator, whole + 1).otherwise(whole)
    twice = 2 * (numerator - down * denominator)
    up = (twice > denominator) | ((twice == denominator) & (F.pmod(down, F.lit(2)) == 1))
    return F.when(up, down + 1).otherwise(down)


def within_relative(a: Column, b: Column, relative: float, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= relative * F.abs(b) + absolute
