"""Session settings the reports are meant to run with."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

MIB = 1024**2

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    # Hash instead of sort in shuffle joins whose partitions are seen to be small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # No stack inspection per column expression while a plan is built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def initial_partitions(shuffle_bytes: int, cores: int, target: int = 128 * MIB) -> int:
    """Partitions a shuffle starts with: full ones of ``target`` bytes, all cores busy.

    Adaptive execution merges the ones that turn out small, and splits none but
    skewed joins, so the number must not be too low for the largest shuffle.
    """
    return max(cores, math.ceil(shuffle_bytes / target))


def build_session(
    app: str = "dealerflow",
    master: str | None = None,
    shuffle_bytes: int | None = None,
    cores: int = 8,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """A session with these settings; ``settings`` come on top."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    chosen = dict(SETTINGS)
    if shuffle_bytes is not None:
        number = str(initial_partitions(shuffle_bytes, cores))
        chosen["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = number
    for name, value in (chosen | (settings or {})).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
