"""Joins whose keys match missing to missing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _matches(keys: Sequence[str], twin: dict[str, str]) -> Column:
    return reduce(and_, [F.col(key).eqNullSafe(F.col(twin[key])) for key in keys])


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi-join on same-named keys with ``<=>``; one copy of each key remains.

    ``<=>`` stays an equi-key for the planner, so this shuffles or broadcasts
    like any equality join. A full join takes each key from the side that has it.
    """
    twin = {key: f"{key}__right" for key in keys}
    renamed = right.withColumnsRenamed(twin)
    joined = left.join(renamed, _matches(keys, twin), how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "full_outer", "right"):
        joined = joined.withColumns({key: F.coalesce(key, twin[key]) for key in keys})
    return joined.drop(*twin.values())


def left_join_in_parts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join as matched rows plus rows without a match.

    A left outer join can only broadcast or split its right and left side
    respectively. The inner part here may broadcast whichever side the planner
    finds small and may split a hot key on either side; the other part looks up
    distinct keys only. For a short list on the left of a long table.
    """
    matched = null_safe_join(left, right, keys, "inner")
    unmatched = null_safe_join(left, right.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)
