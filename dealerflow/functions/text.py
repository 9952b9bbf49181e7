"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_parentheses(text: Column) -> Column:
    """Drop the text from the first opening to the last closing parenthesis.

    The half-width pair goes first, then the full-width pair; both are greedy
    and run over line breaks.
    """
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\(.*\)", ""), r"(?s)（.*）", "")


def is_blank(text: Column) -> Column:
    """True for an empty string, null for a missing one."""
    return text == F.lit("")
