"""Exact duplicates by distributed radix partitioning, most significant bytes first.

All documents start in one group. Each round splits every open group by the next
block of bytes of its texts. A group with one document left is settled, and so
is a group whose texts end in the block: they agreed in every byte so far, so
they are equal, and no digest is involved. A text's length is written in front
of it, so texts of different lengths part in the first round. Blocks grow
eightfold from round to round, so the number of rounds follows the logarithm of
the longest text that still has company. A wide block travels in parts: each part
is named by the smallest row of its group that has the same bytes there, and the
list of names stands for the block.

The texts are not moved to learn which of them are still open: the heads of open
groups set bits in a map of fixed size, and a text whose bit is not set sends no
block. A map that fills up lets blocks of settled texts through, which the join
with the open documents removes; it never keeps one back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerflow.llm.common import join_groups, numbered, saved, text_chunks

#: Bytes of the first block, growth per round, and the most bytes of a block in one row.
FIRST, GROWTH, PART = 64, 8, 1 << 20
BLANKS = b"\t\n\x0b\x0c\r "
#: Bits of the map of open heads: 1 MB for the driver and each executor, at any size of the table.
BITS = 1 << 23


def _bytes(raw: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """Each text's bytes without the characters ``[\\x20\\x09-\\x0D]``."""
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        yield raw[a:b].tobytes().translate(None, BLANKS)


def _head(text: bytes) -> bytes:
    """A text's first block: its length in eight bytes, then its first bytes."""
    return len(text).to_bytes(8, "big") + text[:FIRST]


def _slot(head: bytes) -> int:
    return zlib.crc32(head) % BITS


def first_blocks(rows: DataFrame) -> DataFrame:
    """id, code points and digest of the text, first block, its place in the map, and whether the text ends in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in text_chunks(batches):
            starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            chars = np.diff(starts[offsets])
            found = [(sha256(t).hexdigest(), head := _head(t), _slot(head), len(t) <= FIRST) for t in _bytes(raw, offsets)]
            digests, blocks, slots, ended = zip(*found, strict=True)
            arrays = [pa.array(digests), pa.array(blocks, pa.binary()), pa.array(slots, pa.int64()), pa.array(ended)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chars), *arrays], ["id", "n_chars", "text_sha256", "block", "slot", "ended"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_chars bigint, text_sha256 string, block binary, slot bigint, ended boolean")


def open_map(open_: DataFrame) -> np.ndarray:
    """A bit for the head of every open document, ``BITS`` in all, built from partial maps."""
    bits = np.zeros(BITS // 8, np.uint8)
    place = F.col("slot") + 1  # bucket 1 begins with place 1
    part = F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("part")
    for at, piece in open_.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(part).toLocalIterator():
        first = (at - 1) * len(piece)
        bits[first : first + len(piece)] |= np.frombuffer(piece, np.uint8)
    return bits


def next_blocks(rows: DataFrame, at: int, width: int, bits: np.ndarray) -> DataFrame:
    """id, the block of ``width`` bytes from ``at`` in numbered parts and whether the text ends in it, of texts that reach it with their bit set."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def is_open(text: bytes) -> bool:
            slot = _slot(_head(text))
            return len(text) > at and bool(known[slot >> 3] >> (slot & 7) & 1)

        def batch_of(part: pa.RecordBatch, found: list[tuple[int, int, bytes, bool]]) -> pa.RecordBatch:
            place, numbers, blocks, ended = zip(*found, strict=True)
            arrays = [part.column(0).take(pa.array(place)), pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary()), pa.array(ended)]
            return pa.RecordBatch.from_arrays(arrays, ["id", "part", "block", "ended"])

        for part, raw, offsets in text_chunks(batches):
            found, held = [], 0
            for i, t in enumerate(_bytes(raw, offsets)):
                if not is_open(t):
                    continue
                end = min(at + width, len(t))
                for k, first in enumerate(range(at, end, PART)):
                    found.append((i, k, t[first : min(first + PART, end)], len(t) <= at + width))
                    held += len(found[-1][2])
                    if held > 16 * PART:
                        yield batch_of(part, found)
                        found, held = [], 0
            if found:
                yield batch_of(part, found)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.where(F.octet_length("text") > at).mapInArrow(run, f"id {kind}, part int, block binary, ended boolean")


def _split(members: DataFrame, total: int) -> DataFrame:
    """New groups (``gid`` is the smallest id in it) from old group, block and ``ended``; ``total``: rows of the table.

    Counted with partial sums first and joined back; the members of a group of
    copies with a third of all rows are not shuffled for that.
    """
    keys = ["gid", "block", "ended"]
    groups = members.groupBy(*keys).agg(F.min("id").alias("new_gid"), F.count(F.lit(1)).alias("n"))
    joined = join_groups(members, groups, keys, total)
    return saved(joined.select("id", F.col("new_gid").alias("gid"), "slot", "ended", "n"))


def _whole_blocks(parts: DataFrame, width: int, total: int) -> DataFrame:
    """One row per id: its block, or for a block of several parts the list of their names as ``block``."""
    if width <= PART:
        return parts.drop("part")
    keys = ["gid", "part", "block"]
    names = parts.groupBy(*keys).agg(F.min("id").alias("name"), F.count(F.lit(1)).alias("n"))
    named = join_groups(parts, names, keys, total)
    listed = F.sort_array(F.collect_list(F.struct("part", "name"))).alias("block")
    return named.groupBy("id", "gid", "slot", "ended").agg(listed)


def equal_groups(rows: DataFrame, heads: DataFrame, total: int) -> DataFrame:
    """``id`` and ``gid`` of every row of ``rows`` (id, text); ``heads`` has the first blocks."""
    step = _split(heads.select("id", F.lit(0).cast("bigint").alias("gid"), "block", "slot", "ended"), total)
    done = [step.where("ended or n = 1").select("id", "gid")]
    at, width = FIRST, FIRST * GROWTH
    while True:
        open_ = step.where("not ended and n > 1").select("id", "gid", "slot")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        parts = saved(next_blocks(rows, at, width, open_map(open_)).join(open_, "id"))
        step = _split(_whole_blocks(parts, width, total), total)
        done.append(step.where("ended or n = 1").select("id", "gid"))
        at, width = at + width, width * GROWTH


def duplicates(rows: DataFrame) -> DataFrame:
    """``key``, ``keep`` (the key that stays), ``group_size``, ``text_sha256`` of rows (key, text) with keys of their own."""
    rows = rows.select(F.col("key").alias("id"), "text")
    info = saved(first_blocks(rows))
    total = info.count()
    members = saved(equal_groups(rows, info, total).join(info.drop("block", "slot", "ended"), "id"))
    best = F.min(F.struct((-F.col("n_chars")).alias("m"), "id")).alias("best")
    groups = members.groupBy("gid").agg(best, F.count(F.lit(1)).alias("n"))
    return join_groups(members, groups, ["gid"], total).select(
        F.col("id").alias("key"), F.col("best.id").alias("keep"), F.col("n").alias("group_size"), "text_sha256"
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if they are the same without blanks; of equal texts the one
    with most code points stays, then the smallest id (null last), then the one
    whose text has the smaller digest. A null text is empty, and empty texts equal
    each other. Rows with a null or a repeated id are rows like any other, and
    ``keep_id`` is the id of the row that stays. Other columns are not read.
    """
    known = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    found = duplicates(known.rows.select("key", "text")).withColumnsRenamed({"key": "_key", "keep": "_keep"})
    found = known.with_id(known.with_id(found, "_key", id_col), "_keep", "keep_id")
    return found.select(id_col, "keep_id", "group_size", (F.col("_key") == F.col("_keep")).alias("kept"), "text_sha256")
