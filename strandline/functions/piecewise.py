"""Piecewise-constant rates: the interval of a value, the rate's integral and its inverse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval_of(value: Column, knots: list[float]) -> Column:
    """The number of the last knot at or below the value; -1 below the first."""
    out = F.lit(-1)
    for i, k in enumerate(knots):
        out = F.when(value >= k, i).otherwise(out)
    return out


def integral(t: Column, knots: list[float], rates: list[float]) -> Column:
    """What a rate adds up to from the first knot to t; the last rate goes on."""
    out = F.lit(0.0)
    for i, (k, r) in enumerate(zip(knots, rates, strict=True)):
        end = F.least(t, F.lit(knots[i + 1])) if i + 1 < len(knots) else t
        out = out + F.greatest(end - k, F.lit(0.0)) * r
    return out


def inverse_integral(w: Column, knots: list[float], rates: list[float]) -> Column:
    """The t at which ``integral`` reaches w."""
    done, out = 0.0, F.lit(None).cast("double")
    for i, (k, r) in enumerate(zip(knots, rates, strict=True)):
        if r > 0:
            out = F.when(w >= done, k + (w - done) / r).otherwise(out)
        done += (knots[i + 1] - k) * r if i + 1 < len(knots) else 0.0
    return out


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation between points, constant beyond the ends."""
    out = F.lit(float(ys[0]))
    for (a, b), (c, d) in zip(zip(xs, xs[1:], strict=False), zip(ys, ys[1:], strict=False), strict=True):
        out = F.when(x >= a, F.least((x - a) / (b - a), F.lit(1.0)) * (d - c) + c).otherwise(out)
    return out
