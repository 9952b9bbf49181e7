"""Brand reports: month detail with total, all-months pivot, levels, brand list."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from dealerflow.functions.dates import month_label
from dealerflow.functions.numbers import round_nearest, sum_or_zero
from dealerflow.functions import vocabulary as words
from dealerflow.operators.cells import effective_rows
from dealerflow.operators.joins import left_join_in_parts, null_safe_join
from dealerflow.params import ReportParams
from dealerflow.plans.funnel import funnel

STORE_COLUMNS = ["channel_id", "store_name", "address", "owner", "supervisor", "channel_status"]
COUNTS = ["preapp_cnt", "preapp_pass", "apply_cnt", "apply_pass", "eff_cnt"]
REPORT_BRAND = "report_brand"
MONTH_NAME = re.compile(r"\d{6}")
NO_MONTH = "null"


def stack_brands(frames: Sequence[DataFrame]) -> DataFrame:
    """One store list from one frame per brand; columns are matched by name."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame)
    return stacked


def brand_stores(stores: DataFrame, channels: DataFrame) -> DataFrame:
    """Stores of each brand with their channel; a store may have several or none.

    The store list is usually short, the channel list long: the join is written
    so that the planner can broadcast the stores if their size allows, and
    shuffle both sides if not.
    """
    named = channels.select(
        F.col("entity_name").alias("store_name"),
        "channel_id", "owner", "supervisor", "channel_status",
    )
    return left_join_in_parts(stores, named, ["store_name"]).select(
        "brand", "store_name", "address", "channel_id", "owner", "supervisor", "channel_status"
    )


def brand_choices(stores: DataFrame) -> DataFrame:
    """Brands of the store list, in order of first appearance if rows are numbered."""
    if "position" not in stores.columns:
        return stores.select("brand").distinct()
    return stores.groupBy("brand").agg(F.min("position").alias("first_position"))


def _stores_of(stores: DataFrame, channels: DataFrame, brand: str) -> DataFrame:
    """Stores of one brand; the report's brand column comes from the measures."""
    return brand_stores(stores.filter(F.col("brand") == brand), channels).drop("brand")


def channel_month(cells: DataFrame) -> DataFrame:
    """Cells rolled up to brand, month and channel.

    Amounts are rounded per cell before they are summed. The other measures are
    whole numbers already; a cell with an open decision adds no passes.
    """
    return cells.groupBy("brand", "month", "channel_id").agg(
        *[sum_or_zero(F.col(name)).alias(name) for name in COUNTS],
        sum_or_zero(round_nearest(F.col("eff_amt"))).alias("eff_amt"),
    )


def brand_month_detail(
    preapps: DataFrame, contracts: DataFrame, stores: DataFrame, channels: DataFrame, p: ReportParams
) -> DataFrame:
    """This month's measures for every store of the brand, matched or not."""
    measures = channel_month(funnel(preapps, contracts, p.need("brand"), p.month))
    listed = _stores_of(stores, channels, p.need("brand"))
    return null_safe_join(listed, measures, ["channel_id"]).select(
        "brand", "month", *STORE_COLUMNS, *COUNTS, "eff_amt"
    )


def total_rows(detail: DataFrame, p: ReportParams) -> DataFrame:
    """Sum of every numeric column per brand and month, under the total label."""
    numeric = [f.name for f in detail.schema if isinstance(f.dataType, NumericType)]
    keys = [name for name in (REPORT_BRAND, "brand", "month") if name in detail.columns]
    return (
        detail.filter(F.col("brand").isNotNull())
        .groupBy(*keys)
        .agg(*[sum_or_zero(F.col(name)).alias(name) for name in numeric])
        .withColumns({
            "channel_id": F.lit(words.TOTAL_LABEL),
            "month": F.lit(p.total_month),
        })
    )


def brand_month_report(
    preapps: DataFrame, contracts: DataFrame, stores: DataFrame, channels: DataFrame, p: ReportParams
) -> DataFrame:
    """Month detail with its total row underneath.

    Both parts read the same shuffled measures; the planner runs them once.
    """
    detail = brand_month_detail(preapps, contracts, stores, channels, p)
    return detail.unionByName(total_rows(detail, p), allowMissingColumns=True)


def _stores_of_all(stores: DataFrame, channels: DataFrame) -> DataFrame:
    """Stores of every brand, under the brand whose report they belong to."""
    listed = brand_stores(stores.filter(F.col("brand").isNotNull()), channels)
    return listed.withColumnRenamed("brand", REPORT_BRAND)


def _of_own_report(measures: DataFrame) -> DataFrame:
    """Measures of a brand go to that brand's report; without a brand, to none."""
    return measures.filter(F.col("brand").isNotNull()).withColumn(REPORT_BRAND, F.col("brand"))


def brand_month_reports(
    preapps: DataFrame, contracts: DataFrame, stores: DataFrame, channels: DataFrame, p: ReportParams
) -> DataFrame:
    """The month report of every brand on the store list, from one pass over the facts.

    ``report_brand`` says whose report a row belongs to; ``brand`` stays missing
    on stores without measures, as in a single report.
    """
    measures = _of_own_report(channel_month(funnel(preapps, contracts, month=p.month)))
    listed = _stores_of_all(stores, channels)
    detail = null_safe_join(listed, measures, [REPORT_BRAND, "channel_id"]).select(
        REPORT_BRAND, "brand", "month", *STORE_COLUMNS, *COUNTS, "eff_amt"
    )
    return detail.unionByName(total_rows(detail, p), allowMissingColumns=True)


def _effective_by_month(
    preapps: DataFrame, contracts: DataFrame, brand: str | None = None
) -> DataFrame:
    """Brand, month and channel of every cell row, with its effective count.

    Which channels have a cell in a month depends on neither the contract of a
    pre-approval nor how often it matches, so no lookup join is needed here.
    """
    if brand is not None:
        preapps = preapps.filter(F.col("brand") == brand)
        contracts = contracts.filter(F.col("brand") == brand)
    present = preapps.select(
        "brand", "channel_id", F.explode(F.array("preapp_month", "apply_month")).alias("month")
    ).withColumn("month", month_label(F.col("month")))
    counted = effective_rows(contracts).select("brand", "channel_id", "month", "eff_cnt")
    return present.withColumn("eff_cnt", F.lit(0).cast("bigint")).unionByName(counted)


def month_level(count: Column) -> Column:
    """Level of a month's count: up to 1, up to 2, above; none without a cell."""
    return F.when(count <= 1, 1).when(count <= 2, 2).when(count > 2, 3)


def _months_of_stores(rows: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Listed stores with a row for each month that has a cell, and one without month or count where none has."""
    sums = rows.groupBy("brand", "channel_id", "month").agg(F.sum("eff_cnt").alias("eff_cnt"))
    own = [key for key in keys if key != "channel_id"]
    return null_safe_join(listed, sums.withColumns({key: F.col("brand") for key in own}), keys).select(
        *own, "brand", *STORE_COLUMNS, "month", "eff_cnt",
        F.when(F.col("month").isNotNull(), month_level(F.col("eff_cnt"))).alias("level"),
    )


def brand_months(
    preapps: DataFrame, contracts: DataFrame, stores: DataFrame, channels: DataFrame, p: ReportParams
) -> DataFrame:
    """Effective contracts and level of every store of the brand, one row per month that has a cell.

    The long form of the all-months table: no month has to be known before, and
    the facts are read once. ``eff_cnt`` is 0 where no contract of the cells is
    effective and null only for a store without any cell.
    """
    rows = _effective_by_month(preapps, contracts, p.need("brand"))
    return _months_of_stores(rows, _stores_of(stores, channels, p.brand), ["channel_id"])


def brand_months_tables(
    preapps: DataFrame, contracts: DataFrame, stores: DataFrame, channels: DataFrame
) -> DataFrame:
    """``brand_months`` of every brand on the store list, under ``report_brand``, from one pass."""
    rows = _effective_by_month(preapps, contracts).filter(F.col("brand").isNotNull())
    return _months_of_stores(rows, _stores_of_all(stores, channels), [REPORT_BRAND, "channel_id"])


def months_of(long: DataFrame) -> list[str | None]:
    """Months of a long form in order, None last if some cell has no month; a bounded driver read."""
    months = long.filter(F.col("eff_cnt").isNotNull()).select("month").distinct()
    return sorted((row.month for row in months.collect()), key=lambda m: (m is None, m))


def _month_name(month: str | None) -> str:
    return NO_MONTH if month is None else month


def widen(long: DataFrame, months: Sequence[str | None] | None = None) -> DataFrame:
    """A long form with one row per store and one column per month: null without a cell.

    Without ``months`` all months of the long form are columns, ``null`` for
    cells without a month; that reads ``long`` twice, so let it be a stored
    table. A store that is listed twice alike is one row.
    """
    if months is None:
        months = months_of(long)
    keys = [name for name in (REPORT_BRAND, "brand", *STORE_COLUMNS) if name in long.columns]
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("month").eqNullSafe(F.lit(month)), F.col("eff_cnt"))).alias(_month_name(month))
        for month in months
    ]) if months else long.select(*keys).distinct()


def brand_all_months(
    preapps: DataFrame,
    contracts: DataFrame,
    stores: DataFrame,
    channels: DataFrame,
    p: ReportParams,
    months: Sequence[str | None] | None = None,
) -> DataFrame:
    """Effective contracts of every store of the brand, one column per month.

    With ``months`` given the facts are read once. Otherwise the months come from
    the data, and rows without a month get a column named ``null``; to read the
    facts once then too, store ``brand_months`` and ``widen`` it. A month without
    a cell is null, one whose cells hold no effective contract is 0.
    """
    return widen(brand_months(preapps, contracts, stores, channels, p), months)


def brand_all_months_tables(
    preapps: DataFrame,
    contracts: DataFrame,
    stores: DataFrame,
    channels: DataFrame,
    months: Sequence[str | None] | None = None,
) -> DataFrame:
    """The all-months table of every brand on the store list; ``months`` as in ``brand_all_months``."""
    return widen(brand_months_tables(preapps, contracts, stores, channels), months)


def month_columns(table: DataFrame) -> list[str]:
    """Columns named like a month, six digits."""
    return [name for name in table.columns if MONTH_NAME.fullmatch(name)]


def brand_month_levels(all_months: DataFrame) -> DataFrame:
    """The pivot with each month cell replaced by its level: up to 1, up to 2, above."""
    return all_months.withColumns({
        name: month_level(F.col(f"`{name}`")) for name in month_columns(all_months)
    })
