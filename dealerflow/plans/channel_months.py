"""Stored monthly sets of active channels, so that a year's base is merged and not read again.

A set has one row per manager and channel with an effective contract in the
month. Sets of several months merge by counting distinct channels over them, as
the single pass over the contracts does. A run reads the facts of the months it
stores and nothing else of the year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerflow.functions.dates import in_month
from dealerflow.operators.counts import MANAGER, manager_counts
from dealerflow.params import ReportParams
from dealerflow.plans.kpis import ACTIVE, is_included, with_active

MONTH = "eff_month"


def channel_months(contracts: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Managers, channels and months with an effective contract, each once; of the given months or of all.

    A missing channel or manager is a value like any other. A month given is
    stated on the month number and on the date, so only its files are read.
    """
    rows = contracts.filter(F.col(MONTH).isNotNull())
    if months is not None:
        wanted = F.lit(False)
        for month in months:
            wanted = wanted | in_month(F.col(MONTH), F.col("eff_date"), month)
        rows = rows.filter(wanted)
    return rows.select(*MANAGER, "channel_id", MONTH).distinct()


def store_channel_months(contracts: DataFrame, folder: str, months: Sequence[str] | None = None) -> str:
    """Write the sets of the given months, of all by default, and return their path.

    A month that is stored again is replaced; the other months stay as they are.
    """
    path = f"{folder}/channel_months"
    sets = channel_months(contracts, months)
    sets.hint("rebalance", MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    return path


def _active_in(first: str, last: str):
    return F.col(MONTH).between(int(first), int(last))


def merged_active_year(sets: DataFrame, p: ReportParams) -> DataFrame:
    """``active_channels_year`` from monthly sets."""
    return manager_counts(sets, channels={"active_year": _active_in(f"{p.active_year}01", f"{p.active_year}12")})


def merged_active_score(sets: DataFrame, p: ReportParams) -> DataFrame:
    """``active_store_score`` from monthly sets."""
    counts = manager_counts(sets, channels={
        "active_cur": _active_in(p.month, p.month),
        "active_year": _active_in(f"{p.active_year}01", f"{p.active_year}12"),
    })
    base = counts.filter(F.col("active_cur").isNotNull() & is_included(p))
    return with_active(base).select(*MANAGER, *ACTIVE)
