"""Flags, distances and labels of a value against its reference range. Bounds may be null (one-sided or no range)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BETTER, HIGH, LOW, NORMAL, SAME, SUFFICIENCY, WORSE

CHANGE_EPSILON = 0.01
MIN_INTENSITY, FULL_AT = 0.3, 0.5
SLIGHT, LARGE = 0.25, 1.0
NO_LIMIT = 1e12


def flag(value: Column, low: Column, high: Column) -> Column:
    """Strict comparisons, the lower bound first; null without a value or a range."""
    return F.when(value.isNull() | (low.isNull() & high.isNull()), None).when(value < low, LOW).when(value > high, HIGH).otherwise(NORMAL)


def out_of_range(f: Column) -> Column:
    return F.coalesce(f.isin(HIGH, LOW), F.lit(False))


def width(low: Column, high: Column) -> Column:
    """The width of a two-sided range, else the size of its only bound (1 for a bound of 0)."""
    bound = F.coalesce(high, low)
    return F.when(high > low, high - low).when(bound.isNotNull(), F.when(bound == 0, 1.0).otherwise(F.abs(bound)))


def distance(value: Column, low: Column, high: Column) -> Column:
    w = width(low, high)
    return F.when(value.isNull() | w.isNull(), None).when(value < low, -(low - value) / w).when(value > high, (value - high) / w).otherwise(0.0)


def position(value: Column, low: Column, high: Column) -> Column:
    """0 inside, else 0.3 to 1 with the sign of the side; full at half a width away."""
    d = distance(value, low, high)
    size = MIN_INTENSITY + (1 - MIN_INTENSITY) * F.least(F.abs(d) / FULL_AT, F.lit(1.0))
    return F.when(d == 0, 0.0).when(d < 0, -size).when(d > 0, size)


def deviation_label(d: Column) -> Column:
    side = F.when(d > 0, HIGH).otherwise(LOW)
    return F.when(d.isNull(), None).when(d == 0, "dentro del rango").when(F.abs(d) < SLIGHT, F.concat(F.lit("ligeramente "), side)).when(F.abs(d) >= LARGE, F.concat(F.lit("muy "), side)).otherwise(side)


def change_size(previous: Column, value: Column, low: Column, high: Column) -> Column:
    return (value - previous) / width(low, high)


def change_status(previous: Column, value: Column, low: Column, high: Column) -> Column:
    """Both values against the current range."""
    before, after = F.abs(distance(previous, low, high)), F.abs(distance(value, low, high))
    return F.when(before.isNull() | after.isNull(), None).when(after > before + CHANGE_EPSILON, WORSE).when(after < before - CHANGE_EPSILON, BETTER).otherwise(SAME)


def normalized(value: Column, low: Column, high: Column) -> Column:
    """(kind, value, from, to) on one scale; a bound of 0 counts as missing on a one-sided range."""
    point = lambda kind, v, a, b: F.struct(F.lit(kind).alias("kind"), v.cast("double").alias("v"), F.lit(a).cast("double").alias("a"), F.lit(b).cast("double").alias("b"))
    return (
        F.when(value.isNull(), None)
        .when(high > low, point("both", F.try_divide(value - low, high - low), 0, 1))
        .when(high.isNotNull() & (high != 0), point("upper", F.try_divide(value, high), -NO_LIMIT, 1))
        .when(low.isNotNull() & (low != 0), point("lower", F.try_divide(value, low), 1, NO_LIMIT))
    )


def fraction_inside(p0: Column, p1: Column, a: Column, b: Column) -> Column:
    """Share of the straight line from p0 to p1 that lies within [a, b]."""
    ta, tb = F.try_divide(a - p0, p1 - p0), F.try_divide(b - p0, p1 - p0)
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(ta, tb)) - F.greatest(F.lit(0.0), F.least(ta, tb)))
    return F.when(p0 == p1, F.when((p0 >= a) & (p0 <= b), 1.0).otherwise(0.0)).otherwise(inside)


def sufficiency(n: Column, least: int = 4) -> Column:
    none, one, few, enough = SUFFICIENCY
    return F.when(n == 0, none).when(n == 1, one).when(n < max(2, least), few).otherwise(enough)
