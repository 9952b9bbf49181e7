"""The six monthly KPIs of a finance manager.

Every KPI that reads contracts is a conditional count per manager. Each
``*_score`` function gives one KPI table on its own, reading only the rows it
needs; the scorecard takes all counts from one pass and applies the same
``with_*`` steps. A count is null where the manager has no row in the KPI.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerflow.functions import vocabulary as words
from dealerflow.functions.dates import in_month, in_months, month_of, since
from dealerflow.functions.numbers import growth_pct, round_nearest
from dealerflow.functions.text import is_blank
from dealerflow.operators.counts import MANAGER, manager_counts
from dealerflow.operators.joins import null_safe_join
from dealerflow.operators.ranking import points_for, rank_of
from dealerflow.params import ReportParams

ACTIVE = ["active_cur", "active_year", "active_pct", "active_score"]
NEW_STORES = ["new_stores", "heads", "new_per_head_pct", "new_rank", "new_score"]
OVERDUE = ["overdue_cnt", "fast_cnt", "overdue_rate", "overdue_rank", "overdue_score"]
LCV = ["lcv_prev", "lcv_cur", "lcv_mom_pct", "lcv_rank", "lcv_score"]
PARTNER = ["partner_cur", "partner_rank", "partner_score"]
USED = ["used_prev", "used_cur", "used_mom_pct", "used_rank", "used_score"]


def _effective_in(month: str) -> Column:
    return in_month(F.col("eff_month"), F.col("eff_date"), month)


def in_year(p: ReportParams) -> Column:
    """Effective in the calendar year whose active channels are the base."""
    first, last = f"{p.active_year}01", f"{p.active_year}12"
    return in_months(F.col("eff_month"), F.col("eff_date"), first, last)


def is_fast_track(p: ReportParams) -> Column:
    """Effective since the cutoff, on one of the three fast routes, numbered.

    A blank sure-pass type counts as present unless ``blank_is_missing``; only a
    missing one is absent.
    """
    sure_pass = F.col("sure_pass_type").isNotNull()
    if p.blank_is_missing:
        sure_pass = sure_pass & ~is_blank(F.col("sure_pass_type"))
    route = (
        (F.col("instant_type") == words.FIXED_RATIO)
        | ~is_blank(F.col("flash_choice"))
        | sure_pass
    )
    recent = since(F.col("eff_month"), F.col("eff_date"), p.fast_track_from)
    return recent & route & (F.col("app_id") > 0)


def is_overdue_fast_track(p: ReportParams) -> Column:
    return is_fast_track(p) & (F.col("overdue_days") >= 1)


def is_included(p: ReportParams) -> Column:
    """The manager has a name and is not on the exclusion list."""
    named = F.col("manager").isNotNull()
    return named & ~F.col("manager").isin(*p.excluded) if p.excluded else named


def channel_conditions(p: ReportParams) -> dict[str, Column]:
    return {"active_cur": _effective_in(p.month), "active_year": in_year(p)}


def row_conditions(p: ReportParams) -> dict[str, Column]:
    lcv = (F.col("is_lcv") == words.YES) & (F.col("vehicle_type") == words.NEW_VEHICLE)
    partner = (F.col("partner") == p.partner) & (F.col("vehicle_type") == words.NEW_VEHICLE)
    used = (F.col("fin_amt") <= words.SMALL_AMOUNT) & (F.col("vehicle_type") == words.USED_VEHICLE)
    now, before = _effective_in(p.month), _effective_in(p.prev_month)
    return {
        "fast_cnt": is_fast_track(p),
        "overdue_cnt": is_overdue_fast_track(p),
        "lcv_prev": lcv & before,
        "lcv_cur": lcv & now,
        "partner_cur": partner & now,
        "used_prev": used & before,
        "used_cur": used & now,
    }


def counts_scope(p: ReportParams) -> Column:
    """One date bound that holds for every contract any of the KPIs counts."""
    month_starts = [date(int(m[:4]), int(m[4:]), 1) for m in (p.month, p.prev_month)]
    earliest = min(p.fast_track_from, date(p.active_year, 1, 1), *month_starts)
    return since(F.col("eff_month"), F.col("eff_date"), earliest)


def _counted(contracts: DataFrame, p: ReportParams, *names: str) -> DataFrame:
    conditions = row_conditions(p)
    return manager_counts(contracts, {name: conditions[name] for name in names})


def _any_of(*names: str) -> Column:
    return F.coalesce(*names).isNotNull()


# Active stores ---------------------------------------------------------------

def active_channels_year(contracts: DataFrame, p: ReportParams) -> DataFrame:
    """Distinct channels with an effective contract in the base year."""
    return manager_counts(contracts, channels={"active_year": in_year(p)})


def with_active(counts: DataFrame) -> DataFrame:
    """Share of the year's channels active this month, and its points."""
    pct = F.col("active_pct")
    banded = (
        F.when(pct >= 50, F.lit(60 * 0.3))
        .when(pct <= 40, F.lit(0.0))
        .otherwise((pct - 40.0) * 6.0)
    )
    return counts.withColumn(
        "active_pct",
        round_nearest(F.try_divide("active_cur", "active_year"), 2) * 100.0,
    ).withColumn("active_score", banded * 0.3)


def active_store_score(contracts: DataFrame, p: ReportParams) -> DataFrame:
    counts = manager_counts(contracts, channels=channel_conditions(p))
    base = counts.filter(_any_of("active_cur") & is_included(p))
    return with_active(base).select(*MANAGER, *ACTIVE)


# New stores per head -----------------------------------------------------------

def team_headcount(roster: DataFrame, p: ReportParams) -> DataFrame:
    """Staff per superior in the branch."""
    return (
        roster.filter(F.col("dept_l6") == p.need("branch"))
        .groupBy("superior_id", "superior_name")
        .agg(F.count(F.lit(1)).alias("heads"))
    )


def new_store_score(channels: DataFrame, roster: DataFrame, p: ReportParams) -> DataFrame:
    """Channels opened this month per head of the supervisor's team."""
    opened = (
        channels.filter(in_month(month_of(F.col("open_date")), F.col("open_date"), p.month))
        .groupBy("supervisor_id", "supervisor")
        .agg(F.count(F.lit(1)).alias("new_stores"))
    )
    heads = team_headcount(roster, p).withColumnsRenamed(
        {"superior_id": "supervisor_id", "superior_name": "supervisor"}
    )
    keys = ["supervisor_id", "supervisor"]
    return (
        null_safe_join(opened, heads, keys)
        .withColumn(
            "new_per_head_pct", round_nearest(F.try_divide("new_stores", "heads") * 100.0, 1)
        )
        .withColumn("new_rank", rank_of(F.col("new_per_head_pct"), keys))
        .withColumn("new_score", points_for(F.col("new_rank"), words.NEW_STORE_POINTS))
        .select(*keys, *NEW_STORES)
    )


# Fast track and overdue ----------------------------------------------------------

def fast_track_count(contracts: DataFrame, p: ReportParams) -> DataFrame:
    return _counted(contracts, p, "fast_cnt")


def with_overdue(counts: DataFrame) -> DataFrame:
    """Overdue share of the fast-track contracts; the lowest share ranks first.

    Only managers with an overdue contract are in this KPI.
    """
    present = F.col("overdue_cnt").isNotNull()
    return (
        counts.withColumn("fast_cnt", F.when(present, F.col("fast_cnt")))
        .withColumn(
            "overdue_rate", round_nearest(F.try_divide("overdue_cnt", "fast_cnt") * 100.0, 1)
        )
        .withColumn("overdue_rank", rank_of(F.col("overdue_rate"), MANAGER, descending=False))
        .withColumn(
            "overdue_score",
            F.when(present, points_for(F.col("overdue_rank"), words.OVERDUE_POINTS)),
        )
    )


def overdue_score(contracts: DataFrame, p: ReportParams) -> DataFrame:
    counts = _counted(contracts, p, "fast_cnt", "overdue_cnt")
    return with_overdue(counts.filter(_any_of("overdue_cnt"))).select(*MANAGER, *OVERDUE)


# Light commercial vehicles ----------------------------------------------------------

def with_lcv(counts: DataFrame, p: ReportParams) -> DataFrame:
    """Month-on-month growth of new LCV contracts, ranked in ``rank_scope``."""
    within = ["manager_id"] if p.rank_scope == "manager" else []
    present = _any_of("lcv_prev", "lcv_cur")
    return (
        counts.withColumn("lcv_mom_pct", growth_pct(F.col("lcv_cur"), F.col("lcv_prev")))
        .withColumn("lcv_rank", rank_of(F.col("lcv_mom_pct"), MANAGER, within=within))
        .withColumn(
            "lcv_score", F.when(present, points_for(F.col("lcv_rank"), words.LCV_POINTS))
        )
    )


def lcv_score(contracts: DataFrame, p: ReportParams) -> DataFrame:
    return with_lcv(_counted(contracts, p, "lcv_prev", "lcv_cur"), p).select(*MANAGER, *LCV)


# Partner project ------------------------------------------------------------------

def with_partner(counts: DataFrame, p: ReportParams) -> DataFrame:
    """Partner contracts of the month. Within a manager everyone ranks first."""
    if p.rank_scope == "manager":
        rank = F.when(F.col("partner_cur").isNotNull(), F.lit(1))
    else:
        rank = rank_of(F.col("partner_cur"), MANAGER)
    return counts.withColumn("partner_rank", rank).withColumn(
        "partner_score",
        F.when(
            F.col("partner_cur").isNotNull(),
            points_for(F.col("partner_rank"), words.PARTNER_POINTS),
        ),
    )


def partner_score(contracts: DataFrame, p: ReportParams) -> DataFrame:
    return with_partner(_counted(contracts, p, "partner_cur"), p).select(*MANAGER, *PARTNER)


# Small used-car contracts -----------------------------------------------------------

def with_used(counts: DataFrame, p: ReportParams) -> DataFrame:
    """Month-on-month growth of small used-car contracts.

    A first month counts as 100 percent. Excluded managers are out before the
    ranking.
    """
    inside = is_included(p) & _any_of("used_prev", "used_cur")
    now, before = F.col("used_cur"), F.col("used_prev")
    growth = (
        F.when(before.isNull() & now.isNotNull(), F.lit(100.0))
        .when((before == 0) & (now == 0), F.lit(0.0))
        .otherwise(growth_pct(now, before))
    )
    return (
        counts.withColumn("used_mom_pct", F.when(inside, growth))
        .withColumn("used_rank", rank_of(F.col("used_mom_pct"), MANAGER))
        .withColumn(
            "used_score", F.when(inside, points_for(F.col("used_rank"), words.USED_POINTS))
        )
    )


def used_small_score(contracts: DataFrame, p: ReportParams) -> DataFrame:
    counts = _counted(contracts, p, "used_prev", "used_cur").filter(is_included(p))
    return with_used(counts, p).select(*MANAGER, *USED)
