"""From raw documents to packed training sequences: five stages, each a corpus operator.

Every stage works on all that the one before kept. All but the last return the
columns of documents; the last returns the pieces of packed sequences.

Rows are judged, not ids: a stage numbers its rows where ids are null or repeat,
and the number stays inside the stage, beside a struct of the row's own columns,
so no column name can clash with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerflow.llm import mixing, ngram_join, packing, quality, radix_dedup
from dealerflow.llm.common import numbered_rows, read_table, saved, scratch, ship_package, without
from dealerflow.llm.queries import KEEP_FROM, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The classifier and the mixing have no SQL twin, so the pipeline has none.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, every row judged on its own."""
    ship_package(spark)
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).where(F.col("score") >= KEEP_FROM).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship_package(spark)
    rows = numbered_rows(docs)
    found = radix_dedup.duplicates(rows.select("key", "row.text"))
    return without(rows, saved(found.where("key <> keep").select("key"))).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest key of each component of near copies.

    Near copies are what op3 says: of the sets of four words in a row, 85 percent are shared.
    """
    ship_package(spark)
    rows = numbered_rows(docs)
    found = ngram_join.components_of(rows.select("key", "row.text"))
    return without(rows, saved(found.where("key <> component").select("key"))).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times."""
    ship_package(spark)
    rows = numbered_rows(docs)
    copies = mixing.copies_of(rows.select("key", "row.source", "row.text")).where("copies > 0").select("key", "copies")
    every = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return rows.join(copies, "key").select("row", every.alias("copy")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 2048 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return docs
