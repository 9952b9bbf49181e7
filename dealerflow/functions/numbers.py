"""Arithmetic with explicit rules for missing values and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_nearest(x: Column, digits: int = 0) -> Column:
    """Round to the nearest of the two neighbouring decimals, ties to even.

    Distances are taken in double arithmetic, so 0.15 at one digit gives 0.1:
    the stored double lies below the tie.
    """
    if digits == 0:
        return F.rint(x)
    scale = 10.0**digits
    steps = F.floor(x * scale)
    low, high = steps / F.lit(scale), F.ceil(x * scale) / F.lit(scale)
    down, up = x - low, high - x
    return F.when((down < up) | ((down == up) & (steps % 2 == 0)), low).otherwise(high)


def sum_or_zero(x: Column) -> Column:
    """Sum that skips missing values; zero if nothing is left."""
    return F.coalesce(F.sum(x), F.lit(0).cast("bigint"))


def growth_pct(now: Column, before: Column) -> Column:
    """Percent change to one digit; null unless both counts are there."""
    return round_nearest((F.try_divide(now, before) - 1.0) * 100.0, 1)
