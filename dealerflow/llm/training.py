"""Training on every labelled text: steps in shards on the executors, averaged after each epoch.

A state is a list of tables of numbers. In an epoch every shard takes its steps
from the same state. Then each row of a table becomes the mean of what the shards
that moved it have made of it, so a word that few shards have learns as fast as one
that all have. One shard alone is plain training. The driver holds the state, of
fixed size, and no texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerflow.llm.common import SHORT, one_row_per_id, swept, text_chunks

State = list[np.ndarray]
Steps = Callable[[State, pa.Table, int], None]

#: Bytes of text in a shard, about, and rows of a table that are averaged in one group.
SHARD, BLOCK = 1 << 24, 1 << 13


def labelled(docs: DataFrame, known: DataFrame, *values: str) -> DataFrame:
    """The texts (id, ``values``) of all labelled ids (id, label), one row per id; a short list of labels is broadcast."""
    found = docs.join(F.broadcast(known) if known.count() <= SHORT else known, "id")
    return one_row_per_id(found, "id", *values, "label")


def chunks(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    return text_chunks(iter(table.combine_chunks().to_batches()))


def shards_of(bytes_of_text: int) -> int:
    return max(1, -(-bytes_of_text // SHARD))


def trained(texts: DataFrame, shards: int, state: State, steps: Steps, epochs: int) -> State:
    """The state after some epochs over a stored table of ``texts`` (id, text and more).

    ``steps`` changes a state in place by the rows of a shard, in order of ids, in
    the epoch of a number. A shard is the same in every run, and so is the result.
    """
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    for number in range(epochs):
        with swept(texts.sparkSession):
            state = _epoch(dealt, state, steps, number)
    return state


def _epoch(dealt: DataFrame, state: State, steps: Steps, number: int) -> State:
    shared = dealt.sparkSession.sparkContext.broadcast(state)
    forms = [(a.shape, a.dtype.str) for a in state]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = [a.copy() for a in shared.value]
        steps(own, table.sort_by("id"), number)
        out = []
        for k, (was, now) in enumerate(zip(shared.value, own, strict=True)):
            moved = np.flatnonzero((was != now).any(axis=1))
            for block in np.unique(moved // BLOCK):
                at = moved[moved // BLOCK == block]
                out.append((k, int(block), key[0].as_py(), at.astype("<i8").tobytes(), now[at].tobytes()))
        fields = zip(*out, strict=True) if out else [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(f, kind) for f, kind in zip(fields, kinds, strict=True)], ["part", "block", "shard", "places", "numbers"])

    def mean(table: pa.Table) -> pa.Table:
        rows = table.sort_by("shard").to_pylist()
        part, block = rows[0]["part"], rows[0]["block"]
        (_, width), kind = forms[part]
        total, n = np.zeros((BLOCK, width)), np.zeros(BLOCK)
        for row in rows:
            at = np.frombuffer(row["places"], "<i8") - block * BLOCK
            total[at] += np.frombuffer(row["numbers"], kind).reshape(-1, width)
            n[at] += 1
        at = np.flatnonzero(n)
        numbers = (total[at] / n[at, None]).astype(kind)
        return pa.table([pa.array([part], pa.int32()), pa.array([(at + block * BLOCK).astype("<i8").tobytes()]), pa.array([numbers.tobytes()])], ["part", "places", "numbers"])

    moved = dealt.groupBy("shard").applyInArrow(run, "part int, block int, shard int, places binary, numbers binary")
    means = moved.groupBy("part", "block").applyInArrow(mean, "part int, places binary, numbers binary")
    after = [a.copy() for a in state]
    for row in means.collect():  # at most the state
        (_, width), kind = forms[row["part"]]
        after[row["part"]][np.frombuffer(row["places"], "<i8")] = np.frombuffer(row["numbers"], kind).reshape(-1, width)
    shared.destroy()
    return after
