"""Helpers shared by the corpus operators: shared scratch tables, row identity, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once.
CHUNK = 1 << 21
#: Numbers of a list that is broadcast, at most.
SHORT = 1 << 19
#: Column of the number that tells rows apart.
ROW_KEY = "row_key"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session, for runs from a plain checkout."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    if package.name in {Path(p).stem for p in context._python_includes}:
        return
    archive = Path(tempfile.mkdtemp(prefix="llm-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where none is set a local session (tests) gets one of its own; on a cluster
    that is an error, as executors share no local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='llm-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths of the tables that ``saved`` has written and nothing has removed yet.
_WRITTEN: list[str] = []


def saved(table: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: lineage ends here, any executor may go.

    The files go with the session, or before with the ``scratch`` they were written in.
    """
    spark = table.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    with swept(spark):
        table.write.parquet(path)
    _WRITTEN.append(path)
    store, at = _stored(spark, path)
    store.deleteOnExit(at)
    return spark.read.schema(table.schema).parquet(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it is done, and don't wait for the driver's garbage collector."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _stored(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes in the end what ``saved`` wrote inside, but for the tables given to the function it yields.

    What is read from the others must be written by then.
    """
    first, kept = len(_WRITTEN), set()

    def keep(table: DataFrame) -> DataFrame:
        out = saved(table)
        kept.add(_WRITTEN[-1])
        return out

    try:
        yield keep
    finally:
        drop(spark, [path for path in _WRITTEN[first:] if path not in kept])


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that ``saved`` wrote."""
    for path in paths:
        store, at = _stored(spark, path)
        store.delete(at, True)
        _WRITTEN.remove(path)


@dataclass(frozen=True)
class Numbered:
    """All rows as ``key``, ``id`` and values; ``key`` is a whole number of each row's own, in the order of ids.

    ``plain``: the key is the id itself.
    """

    rows: DataFrame
    plain: bool

    def with_id(self, table: DataFrame, key: str, name: str) -> DataFrame:
        """``table`` with the ids of the rows that its column ``key`` numbers, under ``name``."""
        if self.plain:
            return table.withColumn(name, F.col(key).cast(self.rows.schema["id"].dataType))
        ids = self.rows.select(F.col("key").alias("_number"), F.col("id").alias(name))
        return table.join(ids, table[key] == ids["_number"], "left").drop("_number")


def numbered(rows: DataFrame) -> Numbered:
    """The rows of a table (id and values), none left out: a null id or one that repeats is told apart by the number.

    Null ids come last; rows of one id are in the order of a digest of their values.
    """
    plain, values = _own_ids(rows, "id"), [c for c in rows.columns if c != "id"]
    if plain:
        return Numbered(rows.select(F.col("id").cast("bigint").alias("key"), "id", *values), plain)
    return Numbered(_sorted_rows(rows, "id").select("key", "row.*"), plain)


#: Rows of a group that counts as heavy, at least, and heavy groups at most.
HEAVY_ROWS, HEAVY_GROUPS = 1024, 8192


def join_groups(members: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Each member with the columns of its group; ``groups`` has its number of members as ``n``, ``total`` is their sum.

    Members of heavy groups meet them by broadcast and are not shuffled: there are
    at most ``HEAVY_GROUPS`` groups of that size in the table. No other group is
    large enough to make a task uneven. Keys are never null.
    """
    least = max(HEAVY_ROWS, total // HEAVY_GROUPS + 1)
    heavy = groups.where(F.col("n") >= least)
    light = members.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return members.join(F.broadcast(heavy), keys).unionByName(light.join(groups.where(F.col("n") < least), keys))


def one_row_per_id(docs: DataFrame, id_col: str, *values: str) -> DataFrame:
    """``id_col`` and ``values``, one row per id.

    Rows without id are left out. Where an id repeats, the row with the smallest
    values stays; the ids alone are shuffled to find that out, and the values
    only if some id repeats.
    """
    kept = docs.select(id_col, *values).where(F.col(id_col).isNotNull())
    repeats = kept.select(id_col).groupBy(id_col).count().where("count > 1").limit(1)
    if not repeats.count():
        return kept
    row = F.min(F.struct(*values)).alias("row")
    return kept.groupBy(id_col).agg(row).select(id_col, *(F.col(f"row.{v}").alias(v) for v in values))


def _own_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether every row has a whole number of its own as id; only ids are shuffled to find that out."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return False
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).groupBy("id").count()
    return ids.where("id is null or count > 1").isEmpty()


def with_row_key(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All rows and columns with ``row_key``, a whole number of each row's own, in the order of ids.

    Where every row has a whole number of its own as id, that is the key. Else all
    rows are sorted by id (null last) and content, numbered and stored once. Rows
    alike in every column may swap numbers, so the numbers are the same in every
    run.
    """
    if _own_ids(docs, id_col):
        return docs.withColumn(ROW_KEY, F.col(id_col).cast("bigint"))
    return _sorted_rows(docs, id_col).select("row.*", F.col("key").alias(ROW_KEY))


def numbered_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All rows as ``key`` and a struct ``row`` of all their columns, whatever these are called; keys as in ``with_row_key``."""
    if _own_ids(docs, id_col):
        return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return _sorted_rows(docs, id_col)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (key, row) but for the keys in ``gone``, a stored table; a list that is short is broadcast, and no row moves."""
    return rows.join(F.broadcast(gone) if gone.count() <= SHORT else gone, "key", "left_anti")


def _sorted_rows(docs: DataFrame, id_col: str) -> DataFrame:
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # A digest spreads rows of one id over tasks, the place in the input those that are alike.
    content = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    row = docs.select(
        F.struct(*columns).alias("row"), F.col(f"`{id_col}`").alias("id"), content.alias("content"), F.monotonically_increasing_id().alias("place")
    )
    order = [F.col("id").asc_nulls_last(), "content", "place"]
    row = row.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of the number are the task, the lower 33 its rows from 0 on.
    placed = saved(row.select("row", F.monotonically_increasing_id().alias("at")))
    task = F.shiftright("at", 33)
    sizes = sorted(placed.groupBy(task.alias("task")).count().collect())  # a row for each task
    firsts, first = [], 0
    for number, n in sizes:
        firsts.append((number, first))
        first += n
    starts = placed.sparkSession.createDataFrame(firsts, "task bigint, first bigint")
    key = F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("task", task).join(F.broadcast(starts), "task").select(key.alias("key"), "row")


def text_chunks(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of text: slice, bytes, document offsets.

    A longer text is a slice of its own. A null text has no bytes.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        if not batch.num_rows:
            continue
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(column):
            last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), len(column))
            yield (
                batch.slice(first, last - first),
                raw[ends[first] : ends[last]],
                ends[first : last + 1] - ends[first],
            )
            first = last


def texts_of(batch: pa.RecordBatch, text: str = "text") -> Iterator[str]:
    """The texts one by one, null as empty, without a list of all of them."""
    column = batch.column(batch.schema.get_field_index(text))
    for i in range(len(column)):
        yield column[i].as_py() or ""
