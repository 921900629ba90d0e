"""Column expressions: scalars and aggregates that keep NULL as the only sign of a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NULL for NaN and for both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def rescale(c: Column, low: Column, high: Column, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    """Linear map of [low, high] to [to_low, to_high]; NULL for an interval of no width."""
    return (c - low) * (to_high - to_low) / F.nullif(high - low, F.lit(0.0)) + to_low


def geometric_mean(c: Column) -> Column:
    """Over values above zero."""
    return F.exp(F.avg(F.when(c > 0, F.ln(c))))


def harmonic_mean(c: Column) -> Column:
    """Over values other than zero."""
    x = F.nullif(c, F.lit(0))
    return F.count(x) / F.nullif(F.sum(1.0 / x), F.lit(0.0))


def median(c: Column) -> Column:
    return F.percentile(c, 0.5)


FILLS = {"zero": lambda c: F.lit(0.0), "mean": F.avg, "median": median, "min": F.min, "max": F.max, "geo": geometric_mean, "harmonic": harmonic_mean}


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays of numbers."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def rbf(distance: Column, gamma: float = 0.5) -> Column:
    return F.exp(-gamma * distance * distance)


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")
