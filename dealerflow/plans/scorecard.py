"""The manager scorecard and the overdue fast-track list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerflow.operators.counts import MANAGER, manager_counts
from dealerflow.operators.joins import null_safe_join
from dealerflow.params import ReportParams
from dealerflow.plans import kpis

SCORECARD_COLUMNS = [
    *kpis.ACTIVE, *kpis.NEW_STORES, *kpis.OVERDUE, *kpis.LCV, *kpis.PARTNER, *kpis.USED,
]
DETAIL_COLUMNS = [
    "overdue_level", "paid_terms", "product", "channel_id", "store_entity", "app_id",
    "apply_date", "remaining_principal", "fin_amt", "customer_name", "advisor", "manager",
]


def scorecard(
    contracts: DataFrame, channels: DataFrame, roster: DataFrame, p: ReportParams
) -> DataFrame:
    """One row per manager active this month: six KPIs, their points, the total.

    The contracts are read and shuffled once for all counts. Ranks are taken
    over every manager that has the KPI, then the table is cut to the managers
    active this month; missing figures become 0.
    """
    counts = manager_counts(
        contracts, kpis.row_conditions(p), kpis.channel_conditions(p), kpis.counts_scope(p)
    )
    ranked = kpis.with_used(
        kpis.with_partner(kpis.with_lcv(kpis.with_overdue(kpis.with_active(counts)), p), p), p
    )
    base = ranked.filter(F.col("active_cur").isNotNull() & kpis.is_included(p))
    opened = kpis.new_store_score(channels, roster, p).withColumnsRenamed(
        {"supervisor_id": "manager_id", "supervisor": "manager"}
    )
    total = (
        (F.col("active_score") + F.col("new_score")) * 0.3
        + F.col("overdue_score")
        + F.col("lcv_score")
        + F.col("partner_score")
        + F.col("used_score")
    )
    return (
        null_safe_join(base, opened, MANAGER)
        .na.fill(0, SCORECARD_COLUMNS)
        .select(*MANAGER, *SCORECARD_COLUMNS, total.alias("total_score"))
    )


def scorecard_top(card: DataFrame, n: int = 4) -> DataFrame:
    """First managers of the scorecard by id and name."""
    return card.orderBy(*[F.col(key).asc_nulls_last() for key in MANAGER]).limit(n)


def _overdue_contracts(
    contracts: DataFrame, p: ReportParams, customer_name: str
) -> DataFrame:
    if customer_name not in ("keep", "hash", "drop"):
        raise ValueError(f"customer_name must be 'keep', 'hash' or 'drop', not {customer_name!r}")
    shown = contracts.filter(kpis.is_overdue_fast_track(p)).select(
        "eff_date",
        *[
            F.date_format("apply_date", "yyyy-MM-dd").alias(name) if name == "apply_date"
            else F.col(name).cast("string").alias(name) if name == "app_id"
            else F.sha2(name, 256).alias(name) if name == "customer_name" and customer_name == "hash"
            else F.col(name)
            for name in DETAIL_COLUMNS
        ],
    )
    return shown.drop("customer_name") if customer_name == "drop" else shown


def overdue_detail(
    contracts: DataFrame,
    p: ReportParams,
    customer_name: str = "keep",
    newest_first: bool = False,
) -> DataFrame:
    """Overdue fast-track contracts; the customer's name can be hashed or left out.

    ``newest_first`` sorts by effective date, for a list that is written as it is.
    """
    rows = _overdue_contracts(contracts, p, customer_name)
    if newest_first:
        rows = rows.orderBy(F.col("eff_date").desc_nulls_last(), F.col("app_id").cast("bigint"))
    return rows.drop("eff_date")


def overdue_top(
    contracts: DataFrame, p: ReportParams, n: int = 10, customer_name: str = "keep"
) -> DataFrame:
    """The latest overdue fast-track contracts, ties by application and row content."""
    rows = _overdue_contracts(contracts, p, customer_name)
    rest = [c for c in rows.columns if c not in ("eff_date", "app_id")]
    return (
        rows.orderBy(
            F.col("eff_date").desc_nulls_last(),
            F.col("app_id").cast("bigint").asc_nulls_last(),
            *[F.col(c).asc_nulls_last() for c in rest],
        )
        .limit(n)
        .drop("eff_date")
    )
