"""Monotone cubic interpolation (Fritsch-Carlson slopes, Hermite basis) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def secant(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.try_divide(y1 - y0, x1 - x0)  # null for repeated positions


def interior_slope(x0, y0, x1, y1, x2, y2) -> Column:
    """Slope at (x1, y1): weighted harmonic mean of both secants, 0 at a local extremum."""
    h0, h1 = x1 - x0, x2 - x1
    d0, d1 = secant(x0, y0, x1, y1), secant(x1, y1, x2, y2)
    w0, w1 = h1 * 2 + h0, h1 + h0 * 2
    return F.when(d0 * d1 <= 0, F.lit(0.0)).otherwise(F.try_divide(w0 + w1, F.try_divide(w0, d0) + F.try_divide(w1, d1)))


def end_slope(x0, y0, x1, y1, x2, y2) -> Column:
    """Slope at the outer point (x0, y0) of either end; a straight line when there is no third point."""
    h0, h1 = F.abs(x1 - x0), F.abs(x2 - x1)
    d0, d1 = secant(x0, y0, x1, y1), secant(x1, y1, x2, y2)
    d = F.try_divide((h0 * 2 + h1) * d0 - h0 * d1, h0 + h1)
    shaped = (
        F.when(F.signum(d) != F.signum(d0), F.lit(0.0))
        .when((F.signum(d0) != F.signum(d1)) & (F.abs(d) > F.abs(d0) * 3), d0 * 3)
        .otherwise(d)
    )
    return F.when(x2.isNull(), d0).otherwise(shaped)


def hermite(x, x0, y0, m0, x1, y1, m1) -> Column:
    h = x1 - x0
    t = F.try_divide(x - x0, h)
    t2, t3 = t * t, t * t * t
    return (
        (t3 * 2 - t2 * 3 + 1) * y0 + (t3 - t2 * 2 + t) * h * m0 + (t2 * 3 - t3 * 2) * y1 + (t3 - t2) * h * m1
    )
