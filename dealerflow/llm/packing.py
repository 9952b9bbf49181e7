"""Token sequences packed by swap-based local search.

Documents are tokenised, cut only where longer than a sequence, and dealt into
blocks of a bounded number of pieces. Each block is filled by best fit and then
improved: the emptiest bin gives its pieces to fuller ones, by moving a piece,
exchanging one for one or two for one, as long as the sum of squared fills
rises, until the bin is empty or nothing helps. What is still underfull goes
into the next round, where bins of different blocks meet.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerflow.llm.common import saved, texts_of

#: Tokens of a sequence, the id that ends a document, pieces of a block.
LENGTH, END_ID, BLOCK = 2048, 0, 32_768
#: Words whose ids a worker remembers, at most.
REMEMBERED = 1_000_000
#: Bits of a sequence's number for its bin and, above them, its block; the round is on top.
BIN_BITS, BLOCK_BITS = 28, 30


# Fixed values of byte-level BPE: how a text is cut, and the bytes that stand for themselves.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
# The other bytes are shown as the characters from 256 on, in order.
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class _Odd(Exception):
    """The text has runs of blanks, which are not split at every blank."""


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer file, little-endian unsigned 32-bit.

    Such a tokenizer cuts before every single blank or line break between two
    other characters, so the stretches between them are encoded once and
    remembered. Texts with other runs of white space are encoded as a whole, and
    so are texts with one of the tokenizer's added tokens, which gets its own id.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.marks = {mark: self.stretch(mark) for mark in ".,"}
        self.line = self.word("\n")
        outer = self

        class Known(dict):
            def __missing__(self, part: str) -> bytes:
                line = part[:1] == "\n"
                body = part[1:] if line else part
                if not body or body[0].isspace() or body[-1].isspace():
                    raise _Odd
                if body[-1] in ".," and body[-2:-1].isalpha():
                    ids = self[part[:-1]] + outer.marks[body[-1]]
                elif body.isalpha():  # one piece, or a line break and one
                    ids = outer.line + outer.word(body) if line else outer.word(f" {body}")
                else:
                    ids = outer.stretch(part if line else f" {part}")
                if len(self) < REMEMBERED:
                    self[part] = ids
                return ids

        self.known = Known()

    def word(self, piece: str) -> bytes:
        """Ids of a text that is not cut any more."""
        shown = piece.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def stretch(self, text: str) -> bytes:
        """Ids of a text of few words."""
        return b"".join(map(self.word, _PIECE.findall(text)))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        if first and (first[0].isspace() or first[-1].isspace()):
            return self.whole(text)
        try:
            return self.stretch(first) + b"".join(map(self.known.__getitem__, rest))
        except _Odd:
            return self.whole(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece of every row, in one narrow pass.

    A document longer than ``length`` is cut so that all pieces but the first are full.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = array("I", [END_ID]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows: list[tuple[int, int, int, int, int]] = []
                for i, text in enumerate(texts_of(batch)):
                    ids = encode(text) + end if text else end
                    n = len(ids) // 4
                    start, size = 0, n % length or length
                    for k in range(math.ceil(n / length)):
                        rows.append((i, k, start, size, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + size)])))
                        start, size = start + size, length
                owner, *numbers = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                arrays = [batch.column(0).take(pa.array(owner)), *map(pa.array, numbers)]
                yield pa.RecordBatch.from_arrays(arrays, [id_col, "piece", "start", "length", "ids_crc32"])

    rows = docs.select(id_col, docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """Bin of each piece, longest pieces first, each into the fullest bin that has room."""
    bins, by_room, rooms, n = np.empty(len(sizes), np.int64), [[] for _ in range(length + 1)], 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        higher = rooms >> size
        if higher:
            room = size + (higher & -higher).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, n = length, n, n + 1
        bins[i] = b
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


def local_search(sizes: np.ndarray, bins: np.ndarray, length: int) -> np.ndarray:
    """Improved bins: pieces go from the emptiest bin to fuller ones while squared fills rise."""
    bins = bins.copy()
    fill = np.bincount(bins, sizes).astype(np.int64)
    under = np.flatnonzero((fill > 0) & (fill < length))
    items = np.flatnonzero(np.isin(bins, under))
    size, home = sizes[items], bins[items].copy()
    for giver in under[np.argsort(fill[under], kind="stable")].tolist():
        while 0 < fill[giver] < length:
            own = np.flatnonzero(home == giver)
            room = length - fill[home]
            other = home != giver
            best: tuple[int, tuple[int, ...], int] | None = None
            singles = [((int(k),), int(size[k])) for k in own[np.argsort(-size[own])]]
            # A piece into a bin with room for it; the fullest such bin.
            for group, s in singles:
                fits = np.flatnonzero(other & (room >= s) & (fill[home] + s > fill[giver]))
                if len(fits):
                    best = (int(home[fits[np.argmin(room[fits])]]), group, -1)
                    break
            if best is None:
                pairs = [((int(a), int(b)), int(size[a] + size[b])) for i, a in enumerate(own) for b in own[i + 1 :]]
                most = 0
                for group, s in [*singles, *pairs]:
                    gain = s - size
                    fits = np.flatnonzero(other & (gain > most) & (gain <= room) & (fill[home] + gain > fill[giver]))
                    if len(fits):
                        back = fits[np.argmax(gain[fits])]
                        most, best = int(gain[back]), (int(home[back]), group, int(back))
            if best is None:
                break
            taker, group, back = best
            moved = int(size[list(group)].sum())
            home[list(group)] = taker
            if back >= 0:
                home[back] = giver
                moved -= int(size[back])
            fill[taker] += moved
            fill[giver] -= moved
    bins[items] = home
    return bins


def _block(length: int, fresh: bool, tag: int):
    def pack(rows: pa.Table) -> pa.Table:
        # Ids stay in Arrow: null beside a large number would cost it its last digits elsewhere.
        order = pc.sort_indices(rows, sort_keys=[(name, "ascending") for name in (rows.column_names[0], "piece", "start", "ids_crc32")])
        rows = rows.take(order)
        sizes = rows.column("length").to_numpy()
        bins = best_fit(sizes, length) if fresh else np.unique(rows.column("sequence_id").to_numpy(), return_inverse=True)[1]
        bins = local_search(sizes, bins, length)
        order = np.lexsort((np.arange(len(bins)), bins))
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        fill = np.bincount(bins, sizes).astype(np.int64)
        block = rows.column("block")[0].as_py()
        made = {"sequence_id": (tag << BIN_BITS + BLOCK_BITS) + (block << BIN_BITS) + bins, "offset": offset, "fill": fill[bins]}
        columns = [c for c in rows.column_names if c != "block"]
        return pa.table([pa.array(made[c]) if c in made else rows.column(c) for c in columns], columns)

    return pack


def deal(rows: DataFrame, key: Column, blocks: int, block: int) -> DataFrame:
    """``rows`` of a stored table with their ``block``: by ``key``, and a block of more than twice its size in parts.

    Rows with one key, as pieces of rows that share a null or repeated id, are
    told apart by their place in the table.
    """
    dealt = rows.withColumn("block", F.pmod(key, F.lit(blocks)))
    if blocks == 1:
        return dealt
    large = dealt.groupBy("block").count().where(F.col("count") > 2 * block).orderBy("block").collect()
    if not large:
        return dealt
    # A row of ``large`` stands for more than two blocks of pieces.
    parts = [math.ceil(r["count"] / block) for r in large]
    firsts = np.cumsum([blocks, *parts]).tolist()
    listed = [(r["block"], first, n) for r, first, n in zip(large, firsts, parts, strict=False)]
    table = rows.sparkSession.createDataFrame(listed, "block bigint, first bigint, parts bigint")
    placed = dealt.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(table), "block", "left")
    part = F.col("first") + F.pmod(F.xxhash64("block", "place"), "parts")
    return placed.withColumn("block", F.coalesce(part, "block")).select(*rows.columns, "block")


def pack(cut: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """The pieces with ``sequence_id`` and gapless ``offset``; ``cut`` must read a stored table.

    Every row is a piece to pack, repeated ones too. Sequences never hold more
    than ``length`` tokens. An empty table gives an empty result.
    """
    columns = cut.columns
    done, rest, tag, blocks = [], cut, 0, 0
    while True:
        count = rest.count()
        wanted = max(1, math.ceil(count / block))
        if tag and wanted * 2 > blocks and blocks > 1 and tag > 1:  # other neighbours do not help any more
            done.append(rest)
            break
        blocks = wanted
        key = F.xxhash64(F.lit(tag), *(F.col(c) for c in (("sequence_id",) if tag else (columns[0], "piece", "start"))))
        dealt = deal(rest, key, blocks, block)
        if not tag:
            dealt = dealt.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint"), "fill": F.lit(0).cast("bigint")})
        schema = dealt.drop("block").schema
        packed = saved(dealt.groupBy("block").applyInArrow(_block(length, not tag, tag), schema))
        if blocks == 1:
            done.append(packed)
            break
        done.append(packed.where(F.col("fill") == length))
        rest, tag = packed.where(F.col("fill") < length), tag + 1
    return reduce(DataFrame.unionByName, done).select(*columns, "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """Every row's ids, closed by id 0, in sequences of at most ``length`` tokens; one row per piece.

    A null or empty text is the closing id alone. Rows with a null id and rows
    that repeat an id are packed each for themselves. Other columns are not read.
    """
    return pack(saved(pieces(docs, tokenizer, length, id_col, text_col)), length, block)
