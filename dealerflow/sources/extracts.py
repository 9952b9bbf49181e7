"""Reading landed extracts under their build names."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerflow.functions.vocabulary import MISSING_TEXT
from dealerflow.sources.schemas import Extract, plain_header

# Any text no cell holds: keeps literal NA and unquoted blanks apart on reading.
_NO_CELL = "\u0001"


class ExtractUnavailable(RuntimeError):
    """The extract is not at its path."""


class MissingColumns(ValueError):
    """The extract lacks columns the reports need."""


def csv_options(multi_line: bool = False) -> dict[str, object]:
    return {
        "header": True, "encoding": "UTF-8", "quote": '"', "escape": '"', "nullValue": _NO_CELL,
        "enforceSchema": False, "multiLine": multi_line,
    }


def read_extract(
    spark: SparkSession,
    extract: Extract,
    path: str | list[str],
    fmt: str = "csv",
    multi_line: bool = False,
    named: bool = True,
    strict: bool = False,
) -> DataFrame:
    """The extract's columns by header, in any order, extra columns ignored.

    CSV is read as UTF-8 text with a header row in every file; every column is
    a string until the cleaning step. In text columns of a CSV a blank cell is an
    empty string and the word ``NA`` is missing. ``multi_line`` allows line breaks in
    quoted cells, at the price of one task per file. Other formats keep their
    own types and nulls. Build names are accepted in place of the headers; with ``named``
    off the table comes as found, unchecked.
    """
    reader = spark.read
    if fmt == "csv":
        reader = reader.options(**csv_options(multi_line))
        if strict:  # a row whose cells don't match the header is an error, not padded
            reader = reader.options(mode="FAILFAST", columnPruning=False)
    try:
        found = reader.format(fmt).load(path)
    except AnalysisException as error:
        raise ExtractUnavailable(f"extract {extract.name} cannot be read from {path}: {error}") from error
    return name_columns(found, extract, settle_blanks=fmt == "csv") if named else found


def name_columns(found: DataFrame, extract: Extract, settle_blanks: bool = True) -> DataFrame:
    """Check the headers, rename to build names, settle blanks of CSV text columns."""
    present = {plain_header(column): column for column in found.columns}
    chosen = {
        name: present.get(plain_header(header), present.get(name))
        for header, name in extract.headers.items()
    }
    missing = [header for header, name in extract.headers.items() if chosen[name] is None]
    if missing:
        raise MissingColumns(f"extract {extract.name} lacks {', '.join(missing)}")

    def value(name: str):
        column = F.col(f"`{chosen[name]}`")
        if settle_blanks and name in extract.text:
            column = F.when(column == MISSING_TEXT, None).otherwise(
                F.coalesce(column, F.lit(""))
            )
        return column.alias(name)

    return found.select(*[value(name) for name in extract.columns])
