"""Refresh of a landed table from a folder that receives new extract files.

For extracts delivered as a growing set of files, a refresh need not read what
it has read before: a file stream with the available-now trigger takes the
files that arrived since the last run, cleans them, appends them by month and
stops. An extract that is replaced as a whole is landed again instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from dealerflow.operators import cleaning
from dealerflow.sources.extracts import csv_options, name_columns, read_extract
from dealerflow.sources.landing import PARTITION
from dealerflow.sources.schemas import Extract

CLEAN = {
    "contracts": cleaning.clean_contracts,
    "preapprovals": cleaning.clean_preapprovals,
    "channels": cleaning.clean_channels,
    "visits": cleaning.clean_visits,
    "roster": cleaning.clean_roster,
}


def extract_stream(spark: SparkSession, extract: Extract, folder: str, multi_line: bool = False) -> DataFrame:
    """New CSV files of an extract as a cleaned stream; all files share one header.

    As in landing, a row with too few or too many cells is an error, and
    ``multi_line`` takes line breaks inside quoted cells as part of them.
    """
    header = read_extract(spark, extract, folder, multi_line=multi_line, named=False).columns
    schema = StructType([StructField(column, StringType()) for column in header])
    options = csv_options(multi_line) | {"mode": "FAILFAST", "columnPruning": False}
    files = spark.readStream.schema(schema).options(**options).csv(folder)
    return CLEAN[extract.name](name_columns(files, extract))


def _publish(spark: SparkSession, staged: str, table: str, tag: str) -> None:
    """Move staged files into the table under names that begin with ``tag``.

    What an earlier try of the same batch has moved goes first, so a batch that is
    run again leaves every row once.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    for pattern in (f"{table}/{tag}-*", f"{table}/*/{tag}-*"):
        for old in files.globStatus(path(pattern)) or []:
            files.delete(old.getPath(), False)
    files.mkdirs(path(table))
    found = [f.getPath() for p in (f"{staged}/part-*", f"{staged}/*/part-*") for f in files.globStatus(path(p)) or []]
    for i, file in enumerate(found):
        parent = file.getParent().getName()
        folder = f"{table}/{parent}" if "=" in parent else table
        files.mkdirs(path(folder))
        if not files.rename(file, path(f"{folder}/{tag}-{i:05d}.parquet")):
            raise OSError(f"cannot move {file} into {folder}")


def refresh(
    spark: SparkSession, extract: Extract, folder: str, landed: str, checkpoints: str | None = None,
    multi_line: bool = False,
) -> StreamingQuery:
    """Append the files that arrived since the last refresh; returns when done.

    Each batch is written beside the table and then moved into it, so the table
    stays plain Parquet that ``land`` may have written before. The record of files
    taken lies beside the landed table unless ``checkpoints`` says otherwise: it
    is worth exactly as much as the table it describes, and landing the extract
    anew removes it. A malformed row fails the batch, and nothing of it is moved.
    """
    progress = f"{checkpoints or landed + '/_progress'}/{extract.name}"
    table = f"{landed}/{extract.name}"

    def append(batch: DataFrame, number: int) -> None:
        staged = f"{progress}-staged/{number}"
        writer = batch.write.mode("overwrite")
        if extract.name in PARTITION:
            writer = writer.partitionBy(PARTITION[extract.name])
        writer.parquet(staged)
        _publish(batch.sparkSession, staged, table, f"refresh{number:08d}")

    query = (
        extract_stream(spark, extract, folder, multi_line)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
