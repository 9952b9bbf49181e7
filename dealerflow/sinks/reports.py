"""Dated report tables: one folder per run date, one table per sheet.

The tables of a report are published together. They are written to a folder
beside the published ones, a marker commits them all at once, and then they are
moved into place. A failure before the marker leaves the old tables as they were;
after it, ``report_path`` already answers with the new ones, and the next write
finishes the moves. One writer a run date at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerflow.files import Folder
from dealerflow.functions.vocabulary import TOTAL_LABEL
from dealerflow.operators.counts import MANAGER
from dealerflow.params import ReportParams
from dealerflow.plans.brand import widen

FORMATS = ("parquet", "orc", "json", "csv")
STAGED, COMMIT, WORK = "_staged-", "_commit-", "_work"

#: A table, or what makes it from the report's stored working tables.
Sheet = DataFrame | Callable[[Mapping[str, DataFrame]], DataFrame]


def run_folder(folder: str, as_of: date) -> str:
    return f"{folder}/run_date={as_of:%Y-%m-%d}"


def _write(table: DataFrame, path: str, fmt: str) -> None:
    writer = table.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.options(header=True, escape='"', emptyValue="")
    writer.format(fmt).save(path)


def _committed(base: Folder) -> list[str]:
    """Runs that are committed but not yet moved into place."""
    return [name.removeprefix(COMMIT) for name in base.names(f"{COMMIT}*")]


def publish(spark: SparkSession, folder: str, as_of: date) -> None:
    """Move committed tables into place and remove what no commit belongs to."""
    base = Folder(spark, run_folder(folder, as_of))
    for run in _committed(base):
        for name in base.names(f"{STAGED}{run}/[!_]*"):
            base.remove(name)
            base.move(f"{STAGED}{run}/{name}", name)
        base.remove(f"{STAGED}{run}")
        base.remove(f"{COMMIT}{run}")
    for left in base.names(f"{STAGED}*"):
        base.remove(left)


def report_path(spark: SparkSession, folder: str, as_of: date, name: str) -> str:
    """Where the committed table of a run date lies; all tables of a report answer from the same run."""
    base = Folder(spark, run_folder(folder, as_of))
    for run in _committed(base):
        if base.exists(f"{STAGED}{run}/{name}"):
            return f"{base.path}/{STAGED}{run}/{name}"
    return f"{base.path}/{name}"


def write_report(
    tables: Mapping[str, Sheet], folder: str, p: ReportParams, fmt: str = "parquet",
    work: Mapping[str, DataFrame] | None = None,
) -> dict[str, str]:
    """Write the tables under ``run_date=<as_of>`` together and return the paths.

    A rerun of the same date replaces its tables. ``work`` are tables that are
    stored for the run, so that sheets made from them read their sources once,
    and not published. Files are written by the executors; nothing is gathered on
    the driver.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown report format {fmt!r}")
    work = work or {}
    spark = next(t for t in (*work.values(), *tables.values()) if isinstance(t, DataFrame)).sparkSession
    publish(spark, folder, p.as_of)
    base, run = Folder(spark, run_folder(folder, p.as_of)), uuid.uuid4().hex
    staged = f"{base.path}/{STAGED}{run}"
    stored = {}
    for name, table in work.items():
        _write(table, f"{staged}/{WORK}/{name}", "parquet")
        stored[name] = spark.read.schema(table.schema).parquet(f"{staged}/{WORK}/{name}")
    for name, table in tables.items():
        _write(table if isinstance(table, DataFrame) else table(stored), f"{staged}/{name}", fmt)
    base.mark(f"{COMMIT}{run}")
    publish(spark, folder, p.as_of)
    return {name: f"{base.path}/{name}" for name in tables}


def export_scorecard(
    scorecard: DataFrame, overdue: DataFrame, folder: str, p: ReportParams, fmt: str = "parquet"
) -> dict[str, str]:
    """The scorecard by manager, and the overdue list in its own order."""
    by_manager = scorecard.orderBy(*[F.col(key).asc_nulls_last() for key in MANAGER])
    return write_report({"scorecard": by_manager, "overdue_detail": overdue}, folder, p, fmt)


def export_brand(
    month_report: DataFrame, all_months: DataFrame, folder: str, p: ReportParams,
    fmt: str = "parquet", months: list[str | None] | None = None,
) -> dict[str, str]:
    """The month report of a brand, total last, and its all-months table.

    ``all_months`` may be the long form ``brand_months``: it is stored first and
    widened from there, to ``months`` or to all it holds.
    """
    is_total = F.col("channel_id").eqNullSafe(F.lit(TOTAL_LABEL))
    by_store = [F.col(name).asc_nulls_last() for name in ("store_name", "channel_id")]
    is_long = "eff_cnt" in all_months.columns
    return write_report(
        {
            "brand_month_report": month_report.orderBy(is_total, *by_store),
            "brand_all_months": lambda work: widen(work["long"], months).orderBy(*by_store)
            if is_long
            else all_months.orderBy(*by_store),
        },
        folder, p, fmt, {"long": all_months} if is_long else None,
    )
