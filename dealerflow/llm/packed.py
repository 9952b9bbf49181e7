"""Exchange of very many (key, document) pairs as packed arrays instead of rows.

A task sorts its pairs by key and writes one row for each range of keys, so a
shuffle of a hundred million pairs moves a few thousand rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerflow.llm.words import mix

#: Pairs that a task gathers before it writes them, and that a range of keys holds on average.
GATHER = 1 << 20

SCHEMA = "bucket bigint, base bigint, keys binary, owners binary"


def buckets_for(docs: DataFrame, text_col: str, pairs_per_byte: float) -> int:
    """Ranges of keys so that one holds about ``GATHER`` pairs, by the size of all texts."""
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    return max(1, int(total * pairs_per_byte / GATHER) + 1)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Range of each key: the upper half of the key scaled to the number of ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def unique_pairs(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[new], owners[new]


def planes(values: np.ndarray) -> bytes:
    """Little-endian numbers as planes of 16 bits, the high ones first: these hardly change along sorted keys and small ids, so shuffles compress them away."""
    return np.ascontiguousarray(values.view("<u2").reshape(len(values), -1)[:, ::-1].T).tobytes()


def unplaned(data: bytes, kind: str) -> np.ndarray:
    """The numbers of ``planes``."""
    parts = np.dtype(kind).itemsize // 2
    return np.ascontiguousarray(np.frombuffer(data, "<u2").reshape(parts, -1)[::-1].T).view(kind).reshape(-1)


def packed_rows(keys: np.ndarray, owners: np.ndarray, buckets: int, by: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of pairs by range of ``by`` (sorted; the keys, if not given); owners are four bytes from ``base`` where that is enough."""
    at = np.searchsorted(bucket_of(keys if by is None else by, buckets), np.arange(buckets + 1, dtype=np.uint64))
    full = np.flatnonzero(at[1:] > at[:-1])
    base = int(owners.min()) if len(owners) else 0
    narrow = len(owners) and int(owners.max()) - base < 1 << 32
    values = (owners - base).astype("<u4" if narrow else "<i8")
    cut = lambda a: pa.array([planes(a[at[b] : at[b + 1]]) for b in full], pa.binary())
    arrays = [pa.array(full, pa.int64()), pa.array(np.full(len(full), base), pa.int64()), cut(keys.astype("<u8")), cut(values)]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "base", "keys", "owners"])


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and owners of all rows."""
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for base, k, o in zip(*(table.column(c).to_pylist() for c in ("base", "keys", "owners")), strict=True):
        keys.append(unplaned(k, "<u8"))
        owners.append(unplaned(o, "<u4" if 2 * len(o) == len(k) else "<i8").astype(np.int64) + base)
    return np.concatenate(keys), np.concatenate(owners)


class Gatherer:
    """Collects pairs over the slices of a task and gives them out whenever there are ``GATHER``."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray, owners: np.ndarray) -> bool:
        self.keys.append(keys)
        self.owners.append(owners)
        self.n += len(keys)
        return self.n >= GATHER

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = unique_pairs(np.concatenate(self.keys), np.concatenate(self.owners)) if self.keys else unique_pairs(
            np.zeros(0, np.uint64), np.zeros(0, np.int64)
        )
        self.keys, self.owners, self.n = [], [], 0
        return pairs


def in_smaller_document(
    table: DataFrame, pairs_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], buckets: int
) -> DataFrame:
    """``id`` and ``names`` (binary): the keys of each document that a smaller id has too, one row an id.

    ``pairs_of`` gives keys and ids of a batch. In a task all but the smallest id
    of a key are settled at once and only that one is sent, so a key that a third
    of all documents share reaches its range once a task, not once a document.
    What is settled goes on, packed, to ranges of ids.
    """

    def settled(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Of sorted pairs which go on to their range, and those a smaller id has."""
        again = np.zeros(len(keys), bool)
        again[1:] = keys[1:] == keys[:-1]
        return ~again, (keys[again], owners[again])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gatherer()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, owners = gathered.take()
            first, known = settled(keys, owners)
            yield _flagged(packed_rows(keys[first], owners[first], buckets), False)
            yield _flagged(_by_id(*known, buckets), True)

        for batch in batches:
            for keys, owners in pairs_of(batch):
                if gathered.add(keys, owners):
                    yield from flush()
        if gathered.n:
            yield from flush()

    def settle(part: pa.Table) -> pa.Table:
        known = part.column("known")
        _, found = settled(*unique_pairs(*unpack(part.filter(pc.invert(known)))))
        passed = part.filter(known).select(["bucket", "base", "keys", "owners"])
        return pa.concat_tables([pa.Table.from_batches([_by_id(*found, buckets)], schema=passed.schema), passed])

    sent = table.mapInArrow(send, f"{SCHEMA}, known boolean")
    found = sent.groupBy("bucket").applyInArrow(settle, SCHEMA)
    return found.groupBy("bucket").applyInArrow(_lists, "id bigint, names binary")


def _flagged(batch: pa.RecordBatch, known: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array(np.full(batch.num_rows, known))], ["bucket", "base", "keys", "owners", "known"]
    )


def _by_id(keys: np.ndarray, owners: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows by range of the ids' hashes."""
    spread = mix(owners.astype(np.uint64))
    order = np.argsort(spread, kind="stable")
    return packed_rows(keys[order], owners[order], buckets, spread[order])


def _lists(part: pa.Table) -> pa.Table:
    """One row an id with all its keys."""
    keys, owners = unpack(part)
    order = np.argsort(owners, kind="stable")
    keys, owners = keys[order], owners[order]
    ids, first = np.unique(owners, return_index=True)
    at = [*first.tolist(), len(keys)]
    names = [keys[a:b].astype("<u8").tobytes() for a, b in zip(at, at[1:], strict=False)]
    return pa.table({"id": pa.array(ids, pa.int64()), "names": pa.array(names, pa.binary())})
