"""Typed, parsed tables from raw extracts.

A raw extract carries the build names with text dates and raw amounts, as read
from CSV; columns that a Parquet or ORC extract already delivers as dates or
timestamps are taken as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerflow.functions import dates
from dealerflow.functions.text import strip_parentheses
from dealerflow.functions.vocabulary import AMOUNT_UNIT


def _day(raw: DataFrame, name: str, parse: Callable[[Column], Column]) -> Column:
    kind = raw.schema[name].dataType.typeName()
    if kind == "date":
        return F.col(name)
    if kind.startswith("timestamp"):
        return F.to_date(name)
    return parse(F.col(name))


def _stamp(raw: DataFrame, name: str) -> Column:
    if raw.schema[name].dataType.typeName().startswith("timestamp"):
        return F.date_trunc("second", name).cast("timestamp_ntz")
    return dates.parse_timestamp(F.col(name))


def _hour(raw: DataFrame, name: str) -> Column:
    if raw.schema[name].dataType.typeName().startswith("timestamp"):
        return dates.two_digit_hour(F.col(name))
    return dates.hour_of(F.col(name))


def _time_text(raw: DataFrame, name: str) -> Column:
    """Approval time as text; a typed column has no blank other than null."""
    if raw.schema[name].dataType.typeName().startswith("timestamp"):
        return F.coalesce(F.date_format(name, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return F.col(name)


def _number(raw: DataFrame, name: str, kind: str) -> Column:
    if raw.schema[name].dataType.simpleString() == kind:
        return F.col(name)
    if kind == "double":
        return F.col(name).try_cast(kind)
    # A whole number may be written with decimals; those are cut off.
    return F.coalesce(F.col(name).try_cast(kind), F.col(name).try_cast("double").try_cast(kind))


def clean_contracts(raw: DataFrame) -> DataFrame:
    """Contracts with amounts in units of 10 000, parsed dates and plain names.

    ``eff_month`` (the effective date's month as ``yyyymm``) is the column a landed
    table is partitioned by.
    """
    return raw.withColumns({
        "app_id": _number(raw, "app_id", "bigint"),
        "manager_id": _number(raw, "manager_id", "bigint"),
        "overdue_days": _number(raw, "overdue_days", "int"),
        "paid_terms": _number(raw, "paid_terms", "int"),
        "remaining_principal": _number(raw, "remaining_principal", "double"),
        "fin_amt": _number(raw, "fin_amt", "double") / AMOUNT_UNIT,
        "apply_date": _day(raw, "apply_date", dates.parse_ymd),
        "eff_date": _day(raw, "eff_date", dates.parse_ymd),
        "manager": strip_parentheses(F.col("manager")),
        "advisor": strip_parentheses(F.col("advisor")),
    }).withColumn("eff_month", dates.month_of(F.col("eff_date")))


def clean_preapprovals(raw: DataFrame) -> DataFrame:
    """Pre-approvals with the hour and date of application and plain names.

    The two approval times stay text: they are compared as text, and a blank is
    earlier than any time.
    """
    hour = _hour(raw, "apply_ts")
    return (
        raw.withColumns({
            "app_id": _number(raw, "app_id", "bigint"),
            "apply_hour": hour,
            "apply_date": _day(raw, "apply_ts", dates.date_of),
            "preapp_date": _day(raw, "preapp_date", dates.date_of),
            "manager": strip_parentheses(F.col("manager")),
            "advisor": strip_parentheses(F.col("advisor")),
            "manual_ts": _time_text(raw, "manual_ts"),
            "auto_ts": _time_text(raw, "auto_ts"),
        })
        .drop("apply_ts")
        .withColumns({
            "preapp_month": dates.month_of(F.col("preapp_date")),
            "apply_month": dates.month_of(F.col("apply_date")),
        })
    )


def clean_channels(raw: DataFrame) -> DataFrame:
    """Dealer channels with parsed dates, plain names, integer supervisor id."""
    return raw.withColumns({
        "owner": strip_parentheses(F.col("owner")),
        "supervisor": strip_parentheses(F.col("supervisor")),
        "supervisor_id": _number(raw, "supervisor_id", "bigint"),
        "open_date": _day(raw, "open_date", dates.parse_ymd),
        "close_date": _day(raw, "close_date", dates.parse_ymd),
    })


def clean_visits(raw: DataFrame) -> DataFrame:
    """Store visits with wall-clock timestamps and minutes as a number."""
    return raw.withColumns({
        "visit_start": _stamp(raw, "visit_start"),
        "visit_end": _stamp(raw, "visit_end"),
        "visit_minutes": _number(raw, "visit_minutes", "double"),
        "visitor": strip_parentheses(F.col("visitor")),
        "supervisor": strip_parentheses(F.col("supervisor")),
    })


def clean_roster(raw: DataFrame) -> DataFrame:
    """Staff roster with an integer superior id; names stay as delivered."""
    return raw.withColumn("superior_id", _number(raw, "superior_id", "bigint"))
