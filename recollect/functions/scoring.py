"""Scores and vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column) -> Column:
    """Divided by its length; the zero vector stays."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(F.transform(v, lambda x: x.cast("double")))


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(float(k)) + rank)


def age_days(then: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(then)) / F.lit(8.64e10))


def decay_factor(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(float(half_life)))


def keyword_axes(text: Column, axes: list[list[str]]) -> Column:
    """A vector for tests: per axis, how many of its words a text holds, at length one."""
    low = F.lower(text)
    counts = F.array(*(sum((F.contains(low, F.lit(w)).cast("double") for w in axis), F.lit(0.0)) for axis in axes))
    return l2_normalised(counts)
