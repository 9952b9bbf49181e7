"""Batch jobs: landed extracts in, dated report tables out.

``land`` cleans the five extracts and the store list into Parquet tables;
``scorecard`` and ``brand`` write the two report families from those tables;
``refresh`` appends newly arrived files to the landed tables; ``channel-months``
stores the monthly sets of active channels.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from dealerflow.functions import vocabulary as words
from dealerflow.operators import cleaning
from dealerflow.params import ReportParams
from dealerflow.plans import brand, scorecard
from dealerflow.plans.channel_months import store_channel_months
from dealerflow.session import build_session
from dealerflow.sinks import reports
from dealerflow.sources.extracts import read_extract
from dealerflow.sources.landing import land
from dealerflow.sources.rejects import set_aside, split_rejects
from dealerflow.sources.schemas import EXTRACTS
from dealerflow.streaming.refresh import refresh

CLEAN: dict[str, Callable[[DataFrame], DataFrame]] = {
    "contracts": cleaning.clean_contracts,
    "preapprovals": cleaning.clean_preapprovals,
    "channels": cleaning.clean_channels,
    "visits": cleaning.clean_visits,
    "roster": cleaning.clean_roster,
    "brand_stores": lambda stores: stores,
}


def land_extracts(
    spark: SparkSession, inbox: str, landed: str, names: Sequence[str] = tuple(CLEAN), fmt: str = "csv",
    multi_line: bool = False, max_rejects: int = 0,
) -> list[str]:
    """Clean and land extracts found in ``inbox`` under their names.

    A CSV row with too few or too many cells fails the landing; ``multi_line``
    takes line breaks inside quoted cells as part of them. With ``max_rejects``
    up to so many malformed rows of an extract are set aside in the table
    ``_rejects/<name>`` (file, row text, reason) and the others land, at the price
    of a second reading; more of them fail the landing and leave the landed table as
    it was.
    """
    paths = []
    for name in names:
        source = f"{inbox}/{name}"
        if max_rejects and fmt == "csv":
            rows, rejects = split_rejects(spark, EXTRACTS[name], source, multi_line)
            set_aside(rejects, name, landed, max_rejects)
        else:
            rows = read_extract(spark, EXTRACTS[name], source, fmt, multi_line, strict=True)
        paths.append(land(CLEAN[name](rows), name, landed))
    return paths


def _tables(spark: SparkSession, landed: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{landed}/{name}") for name in names]


def run_scorecard(spark: SparkSession, landed: str, out: str, p: ReportParams, fmt: str = "parquet",
                  customer_name: str = "keep") -> dict[str, str]:
    """Scorecard and overdue list."""
    contracts, channels, roster = _tables(spark, landed, "contracts", "channels", "roster")
    return reports.export_scorecard(
        scorecard.scorecard(contracts, channels, roster, p),
        scorecard.overdue_detail(contracts, p, customer_name, newest_first=True),
        out, p, fmt,
    )


def run_brand(spark: SparkSession, landed: str, out: str, p: ReportParams, fmt: str = "parquet",
              months: Sequence[str] | None = None) -> dict[str, str]:
    """Month report with total and all-months table of one brand."""
    inputs = _tables(spark, landed, "preapprovals", "contracts", "brand_stores", "channels")
    return reports.export_brand(
        brand.brand_month_report(*inputs, p),
        brand.brand_months(*inputs, p),
        f"{out}/brand={p.brand}", p, fmt, months,
    )


def run_brands(spark: SparkSession, landed: str, out: str, p: ReportParams, fmt: str = "parquet",
               months: Sequence[str] | None = None) -> dict[str, str]:
    """Month reports and all-months tables of every brand, each from one pass."""
    inputs = _tables(spark, landed, "preapprovals", "contracts", "brand_stores", "channels")
    return reports.write_report(
        {
            "brand_month_reports": brand.brand_month_reports(*inputs, p),
            "brand_all_months_tables": lambda work: brand.widen(work["long"], months),
        },
        out, p, fmt, {"long": brand.brand_months_tables(*inputs)},
    )


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)
    landing = jobs.add_parser("land")
    landing.add_argument("inbox")
    landing.add_argument("landed")
    landing.add_argument("--format", default="csv")
    landing.add_argument("--max-rejects", type=int, default=0, help="malformed rows an extract may have; they are set aside")
    landing.add_argument("--multi-line", action="store_true", help="quoted cells may hold line breaks")
    again = jobs.add_parser("refresh")
    again.add_argument("inbox")
    again.add_argument("landed")
    again.add_argument("--extract", action="append", choices=sorted(set(CLEAN) - {"brand_stores"}), required=True)
    again.add_argument("--multi-line", action="store_true", help="quoted cells may hold line breaks")
    sets = jobs.add_parser("channel-months")
    sets.add_argument("landed")
    sets.add_argument("--month", action="append", help="months to store again; all if left out")
    for name in ("scorecard", "brand"):
        job = jobs.add_parser(name)
        job.add_argument("landed")
        job.add_argument("out")
        job.add_argument("--as-of", type=date.fromisoformat, required=True)
        job.add_argument("--format", default="parquet")
        if name == "scorecard":
            job.add_argument("--branch", required=True)
            job.add_argument("--exclude", action="append", default=[])
            job.add_argument("--rank-scope", default="manager")
            job.add_argument("--customer-name", default="keep")
            job.add_argument("--prev", default="minus30", help="month before: minus30 or add_months")
            job.add_argument("--year", type=int, help="year whose active channels are the base")
            job.add_argument("--cutoff", type=date.fromisoformat, help="first day of fast-track contracts")
            job.add_argument("--partner", default=words.PARTNER_PROJECT)
            job.add_argument("--blank-is-missing", action="store_true")
        else:
            job.add_argument("--brand", help="one brand; all brands of the store list if left out")
            job.add_argument("--label-month", help="month shown in total rows")
            job.add_argument("--month", action="append", help="months of the all-months table; all if left out")
    for job in jobs.choices.values():
        job.add_argument("--shuffle-bytes", type=int, help="expected size of the largest shuffle")
        job.add_argument("--cores", type=int, default=8, help="cores that a shuffle should keep busy")
    args = parser.parse_args(argv)
    spark = build_session(shuffle_bytes=args.shuffle_bytes, cores=args.cores)
    if args.job == "land":
        land_extracts(spark, args.inbox, args.landed, fmt=args.format, multi_line=args.multi_line, max_rejects=args.max_rejects)
    elif args.job == "refresh":
        for name in args.extract:
            refresh(spark, EXTRACTS[name], f"{args.inbox}/{name}", args.landed, multi_line=args.multi_line)
    elif args.job == "channel-months":
        store_channel_months(*_tables(spark, args.landed, "contracts"), args.landed, args.month)
    elif args.job == "scorecard":
        p = ReportParams(
            as_of=args.as_of, branch=args.branch, excluded=tuple(args.exclude), rank_scope=args.rank_scope,
            prev=args.prev, year=args.year, cutoff=args.cutoff, partner=args.partner,
            blank_is_missing=args.blank_is_missing,
        )
        run_scorecard(spark, args.landed, args.out, p, args.format, args.customer_name)
    else:
        run = run_brand if args.brand else run_brands
        p = ReportParams(as_of=args.as_of, brand=args.brand, label_month=args.label_month)
        run(spark, args.landed, args.out, p, args.format, args.month)


if __name__ == "__main__":
    main()
