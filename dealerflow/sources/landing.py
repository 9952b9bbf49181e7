"""Cleaned tables written once, partitioned by month, and read by every report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dealerflow.files import Folder

PARTITION = {"contracts": "eff_month", "preapprovals": "preapp_month"}
_SORT = {"contracts": "eff_date", "preapprovals": "apply_date"}


def land(cleaned: DataFrame, name: str, folder: str) -> str:
    """Write a cleaned table as Parquet and return its path.

    Facts are partitioned by month. The rebalance hint brings a month's rows
    together into files of the advisory size and splits a month that is far
    larger than the others; rows are sorted inside files so that date filters
    skip row groups. The table is replaced as a whole, refreshed rows with it, so
    the record of files that a refresh has taken is removed.
    """
    path = f"{folder}/{name}"
    month = PARTITION.get(name)
    _forget_refresh(cleaned.sparkSession, folder, name)
    if month is None:
        cleaned.write.mode("overwrite").parquet(path)
        return path
    (
        cleaned.hint("rebalance", month)
        .sortWithinPartitions(month, _SORT[name])
        .write.mode("overwrite")
        .partitionBy(month)
        .parquet(path)
    )
    return path


def _forget_refresh(spark: SparkSession, folder: str, name: str) -> None:
    progress = Folder(spark, f"{folder}/_progress")
    for entry in (name, f"{name}-staged"):
        progress.remove(entry)


def read_landed(spark: SparkSession, like: DataFrame, name: str, folder: str) -> DataFrame:
    """A landed table with the schema of its cleaned form.

    The schema is given: nothing is inferred from files or folder names.
    """
    return spark.read.schema(like.schema).parquet(f"{folder}/{name}").select(*like.columns)
