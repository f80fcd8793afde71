"""Numeric expressions whose rounding and zero cases the metrics depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of the prior of a shrunk rate.
SHRINK = 8


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^digits + 1/2) / 10^digits, also below zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale if digits else F.floor(x + 0.5).cast("double")


def norm(a: Column, b: Column) -> Column:
    """Signed share (a - b) / (a + b), 0 if both are 0."""
    return F.when(a + b == 0, F.lit(0.0)).otherwise((a - b) / (a + b))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def shrunk_rate(x: Column, n: Column) -> Column:
    """x of n, drawn towards 1/2 as if SHRINK more had been seen."""
    return F.when(n <= 0, F.lit(0.5)).otherwise((x + SHRINK * 0.5) / (n + SHRINK))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def coarse_label(p: Column) -> Column:
    return F.when(p >= 0.6, "mostly me").when(p <= 0.4, "mostly other").otherwise("similar")


def shown(x: Column) -> Column:
    """A number as it is written: whole ones without a fraction."""
    return F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")


def rate_display(x: Column, n: Column, need: int) -> Column:
    """A percentage to one place, or a coarse label where the sample is below 1.5 times what is needed."""
    p = shrunk_rate(x, n)
    return F.when(n < need * 1.5, coarse_label(p)).otherwise(shown(half_up(p * 1000) / 10))


def nearest_rank(values: Column, p: float) -> Column:
    """values sorted, at min(n - 1, floor(p n)); null if empty."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.least(F.size(values) - 1, F.floor(F.size(values) * p).cast("int")))
