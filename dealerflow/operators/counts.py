"""Conditional counts per manager in one pass over the contracts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANAGER = ["manager_id", "manager"]


def manager_counts(
    contracts: DataFrame,
    rows: Mapping[str, Column] | None = None,
    channels: Mapping[str, Column] | None = None,
    scope: Column | None = None,
) -> DataFrame:
    """One row per manager: contracts and distinct channels under each condition.

    ``rows`` maps an output name to the condition whose rows are counted,
    ``channels`` to the condition whose distinct channels are counted, a missing
    channel being one value. A count nobody reaches is null, not zero: the
    manager has no row in that KPI. ``scope`` may name a simpler filter that
    holds wherever one of the conditions does; by default any of them.

    Distinct channels come from grouping by manager and channel first, which
    combines on the map side and spreads a busy manager over many tasks; no
    row is duplicated per distinct count.
    """
    rows, channels = dict(rows or {}), dict(channels or {})
    conditions = {**rows, **channels}
    if scope is None:
        scope = reduce(or_, conditions.values())
    flagged = contracts.filter(scope).select(
        *MANAGER,
        "channel_id",
        *[F.when(test, 1).otherwise(0).alias(name) for name, test in conditions.items()],
    )
    if channels:
        flagged = flagged.groupBy(*MANAGER, "channel_id").agg(
            *[F.sum(name).alias(name) for name in rows],
            *[F.max(name).alias(name) for name in channels],
        )
    return (
        flagged.groupBy(*MANAGER)
        .agg(*[F.nullif(F.sum(name), F.lit(0).cast("bigint")).alias(name) for name in conditions])
        .filter(F.coalesce(*conditions).isNotNull())
    )
