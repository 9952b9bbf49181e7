"""Malformed CSV rows set aside instead of failing a whole extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dealerflow.sources.extracts import csv_options, name_columns, read_extract
from dealerflow.sources.schemas import Extract

#: What stands between two quotes, doubled quotes inside.
_QUOTED = r'"(?:[^"]|"")*"'


class TooManyRejects(ValueError):
    """More rows of an extract are malformed than the load allows."""


def _reason(row: Column, expected: int) -> Column:
    """Cells found and expected, or a quote that is never closed."""
    bare = F.regexp_replace(row, _QUOTED, "")
    cells = F.size(F.split(bare, ",", -1))
    counted = F.concat(cells.cast("string"), F.lit(f" cells, {expected} expected"))
    return F.when(F.contains(bare, F.lit('"')), "open quote").otherwise(counted)


def split_rejects(
    spark: SparkSession, extract: Extract, path: str | list[str], multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The extract's well-formed rows under their build names, and its rejects.

    A row is malformed if its cells don't match the header. Rejects are ``file``,
    ``row_text`` as it stands in the file, ``reason``, and how many of the header's
    cells were ``filled``. Headers are checked as
    in ``read_extract``: an extract without a column fails as a whole.
    """
    header = read_extract(spark, extract, path, multi_line=multi_line, named=False).columns
    raw = "_malformed"
    while raw in header:
        raw += "_"
    schema = StructType([StructField(column, StringType()) for column in [*header, raw]])
    options = csv_options(multi_line) | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": raw, "columnPruning": False}
    found = spark.read.schema(schema).options(**options).csv(path)
    # Spark reads no row text on its own, so the cells are asked for too.
    filled = F.size(F.filter(F.array(*[F.col(f"`{c}`") for c in header]), lambda cell: cell != ""))
    accepted = found.filter(F.col(f"`{raw}`").isNull() & (filled >= 0)).drop(raw)
    rejects = found.filter(F.col(f"`{raw}`").isNotNull() & (filled >= 0)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col(f"`{raw}`").alias("row_text"),
        _reason(F.col(f"`{raw}`"), len(header)).alias("reason"),
        filled.alias("filled"),
    )
    return name_columns(accepted, extract), rejects


def set_aside(rejects: DataFrame, name: str, folder: str, most: int) -> str:
    """Write an extract's rejects beside the landed tables and return their path.

    They replace those of the last load. More than ``most`` rows are an error; the
    table is there to look at then too.
    """
    path = f"{folder}/_rejects/{name}"
    rejects.write.mode("overwrite").parquet(path)
    found = rejects.sparkSession.read.schema(rejects.schema).parquet(path).count()
    if found > most:
        raise TooManyRejects(f"extract {name}: {found} malformed rows, {most} allowed; see {path}")
    return path
