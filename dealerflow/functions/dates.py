"""Date expressions. Unparsable text gives null, also under ANSI mode."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}"
_DAY_TIME = _DAY + r"( \d{1,2}:\d{2}(:\d{2})?)?"
_YMD = r"^\s*(\d{4})(?:[-/. 年](\d{1,2})[-/. 月](\d{1,2})日?|(\d{2})(\d{2}))\s*$"
_DASHED_DAY = r"^\d{4}-\d{1,2}-\d{1,2}"
_FULL_TIME = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}"


def _leading(text: Column, pattern: str) -> Column:
    """The part of a date-time text that matches, with dashes; null if none."""
    found = F.nullif(F.trim(F.regexp_extract(text, pattern, 0)), F.lit(""))
    return F.translate(found, "/", "-")


def _usual(text: Column, form: str, kind: str) -> Column:
    """The plain cast where the text has the usual form, null elsewhere.

    Checking first keeps rows in other forms from raising and catching.
    """
    return F.when(text.rlike(form), text.try_cast(kind))


def parse_ymd(text: Column) -> Column:
    """A date written year, month, day with a separator or as eight digits."""
    dashed = F.regexp_replace(text, _YMD, "$1-$2$4-$3$5")
    other = F.when(text.rlike(_YMD), dashed.try_cast("date"))
    return F.coalesce(_usual(text, _DASHED_DAY + "$", "date"), other)


def date_of(text: Column) -> Column:
    """The date at the start of a date-time text; what follows is ignored."""
    usual = _usual(text, _DASHED_DAY + "( |$)", "date")
    return F.coalesce(usual, _leading(text, _DAY).try_cast("date"))


def parse_timestamp(text: Column) -> Column:
    """Wall-clock timestamp to the second, independent of the session time zone."""
    usual = _usual(text, _FULL_TIME + "$", "timestamp_ntz")
    return F.coalesce(usual, _leading(text, _DAY_TIME).try_cast("timestamp_ntz"))


def hour_of(text: Column) -> Column:
    """Two-digit hour of a full ``yyyy-MM-dd HH:mm:ss`` text, else null."""
    usual = _usual(text, _FULL_TIME + "$", "timestamp_ntz")
    start = F.nullif(F.regexp_extract(F.ltrim(text), _FULL_TIME, 0), F.lit(""))
    return two_digit_hour(F.coalesce(usual, start.try_cast("timestamp_ntz")))


def two_digit_hour(stamp: Column) -> Column:
    return F.lpad(F.hour(stamp).cast("string"), 2, "0")


def month_of(day: Column) -> Column:
    """Month of a date as the number ``yyyymm``: cheap to make and to partition by."""
    return F.year(day) * 100 + F.month(day)


def month_label(month: Column) -> Column:
    """The month number as the text the reports show."""
    return month.cast("string")


def in_months(month: Column, day: Column, first: str, last: str) -> Column:
    """Rows of a run of months, stated on the month number and on the date.

    The number prunes the partitions of a landed table, the date range reaches
    the row-group statistics where the table is not partitioned by it.
    """
    start = date(int(first[:4]), int(first[4:]), 1)
    end = (date(int(last[:4]), int(last[4:]), 1) + timedelta(days=31)).replace(day=1)
    return month.between(int(first), int(last)) & (day >= F.lit(start)) & (day < F.lit(end))


def in_month(month: Column, day: Column, label: str) -> Column:
    return in_months(month, day, label, label)


def since(month: Column, day: Column, start: date) -> Column:
    """Rows from a date on, stated on the month number as well."""
    return (month >= int(f"{start:%Y%m}")) & (day >= F.lit(start))
