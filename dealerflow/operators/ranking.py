"""Ranks and the points they earn.

Rank inputs hold one row per manager, after aggregation: their size follows the
staff list and not the facts, so the one sorting task of a global rank is small
whatever the volume of contracts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def rank_of(
    metric: Column,
    ties: Sequence[str],
    descending: bool = True,
    within: Sequence[str] = (),
) -> Column:
    """Row number by ``metric``; missing metrics stay unranked.

    Equal metrics rank in ascending order of the ``ties`` columns.
    """
    order = metric.desc_nulls_last() if descending else metric.asc_nulls_last()
    window = Window.partitionBy(*within).orderBy(
        order, *[F.col(tie).asc_nulls_last() for tie in ties]
    )
    return F.when(metric.isNotNull(), F.row_number().over(window))


def points_for(rank: Column, scale: tuple[tuple[float, ...], float]) -> Column:
    """Points of the first ranks, then one number for every other row."""
    first, other = scale
    points = F.when(rank == 1, F.lit(first[0]))
    for place, value in enumerate(first[1:], start=2):
        points = points.when(rank == place, F.lit(value))
    return points.otherwise(F.lit(other))
