"""Long repeated passages by recompression.

Every word gets a name, and in rounds runs of one name and pairs of names are
named anew: first each run ``aaa``, then each neighbouring pair whose first name
is "left" and whose second is "right" by a bit of the names themselves. A name is
a 64-bit hash of what it stands for, so it is the same in all documents and a
round needs no exchange. Equal passages get the same names in their interior,
whatever stands around them, and the longer the passage the higher the names.

Names that stand for at least a window of words are exchanged first: where a
smaller document has the name too, all windows inside are settled. The windows
that are left - at the edges of repeats, in short repeats, in new text - are then
exchanged one by one. A window in no settled name of its smallest document is
always sent by that document, so nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerflow.llm.common import numbered, saved, text_chunks
from dealerflow.llm.packed import buckets_for, in_smaller_document
from dealerflow.llm.words import mix, sequence_hashes, word_hashes

#: Words of a window, and rounds at most (a document is one name long before).
WINDOW, ROUNDS = 13, 64
_U = np.uint64
_RUN, _TIMES, _FIRST, _SECOND = (_U(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def long_names(words: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, first word and end of every symbol of at least ``least`` words, over all rounds.

    ``words`` are the names of all words, ``at`` where documents begin.
    """
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    name, start, size = words, np.arange(len(words)), np.ones(len(words), np.int64)
    names, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def note(made: np.ndarray) -> None:
        made = made[size[made] >= least]
        names.append(name[made])
        starts.append(start[made])
        ends.append(start[made] + size[made])

    full = np.count_nonzero(np.diff(at))
    for level in range(ROUNDS):
        if len(name) == full:
            break
        together = doc[1:] == doc[:-1]
        head = np.ones(len(name), bool)
        head[1:] = ~(together & (name[1:] == name[:-1]))
        if not head.all():
            heads = np.flatnonzero(head)
            times = np.diff(np.append(heads, len(name)))
            size = np.add.reduceat(size, heads)
            name, start, doc = name[heads], start[heads], doc[heads]
            run = times > 1
            name = np.where(run, mix(name * _RUN + times.astype(np.uint64) * _TIMES), name)
            note(np.flatnonzero(run))
            together = doc[1:] == doc[:-1]
        left = (mix(name + _U(level + 1)) & _U(1)).astype(bool)
        pair = np.flatnonzero(together & left[:-1] & ~left[1:])
        if len(pair):
            name, size = name.copy(), size.copy()
            name[pair] = mix(name[pair] * _FIRST + mix(name[pair + 1] + _SECOND))
            size[pair] += size[pair + 1]
            stays = np.ones(len(name), bool)
            stays[pair + 1] = False
            merged = np.zeros(len(name), bool)
            merged[pair] = True
            name, start, size, doc, merged = (x[stays] for x in (name, start, size, doc, merged))
            note(np.flatnonzero(merged))
    return np.concatenate(names), np.concatenate(starts), np.concatenate(ends)


def _member(doc: np.ndarray, names: np.ndarray, lists: list[bytes]) -> np.ndarray:
    """Whether each name is in its document's list."""
    own = [np.frombuffer(x, "<u8") for x in lists]
    owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
    salt = lambda d: mix(d.astype(np.uint64) + _U(1))
    known = np.concatenate([np.zeros(0, np.uint64), *own]) ^ salt(owner)
    return np.isin(names ^ salt(doc), known)


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    depth = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(depth)[:n] > 0


def _names(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def _settled(words: np.ndarray, at: np.ndarray, lists: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the symbols that a smaller document has."""
    if not any(lists):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, starts, ends = long_names(words, at, least)
    known = _member(np.searchsorted(at, starts, "right") - 1, names, lists)
    return starts[known], ends[known]


def _window_docs(at: np.ndarray, n: int, window: int) -> np.ndarray:
    """Document of each window start, -1 where a window would leave its document."""
    first = np.arange(max(0, n - window + 1))
    doc = np.searchsorted(at, first, "right") - 1
    return np.where(first + window <= at[doc + 1], doc, -1) if len(first) else first


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``kept_sha256``, without what a smaller id has.

    A window is ``window`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one
    document; a word is removed if a window over it also stands in a document
    with a smaller id. Windows are judged on the input. A null or empty text has no words,
    and shorter texts no window. Rows with a null or a repeated id are rows like any
    other: null ids come last, and of rows with one id the one whose text has the
    smaller digest counts as smaller. Other columns are not read.
    Names are 64-bit hashes: among ``n`` windows one is mistaken with
    probability ``n / 2^64``.
    """
    known = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = known.rows.select(F.col("key").alias("id"), "text")
    buckets = buckets_for(rows, "text", 1 / 8)

    def symbols(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part, raw, offsets in text_chunks(iter([batch])):
            words, _, _, at = word_hashes(raw, offsets)
            names, starts, _ = long_names(words, at, window)
            yield names, part.column(0).to_numpy()[np.searchsorted(at, starts, "right") - 1]

    def windows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part, raw, offsets in text_chunks(iter([batch])):
            words, _, _, at = word_hashes(raw, offsets)
            starts, ends = _settled(words, at, _names(part, "symbols"), window)
            doc = _window_docs(at, len(words), window)
            open_ = doc >= 0
            if len(starts):
                open_ &= ~_covered(len(words), starts, ends - window + 1)[: len(doc)]
            first = np.flatnonzero(open_)
            yield sequence_hashes(words, window)[first], part.column(0).to_numpy()[doc[first]]

    shared = in_smaller_document(rows.select("id", "text"), symbols, max(1, buckets // 4))
    shared = saved(shared.withColumnRenamed("names", "symbols"))
    with_symbols = rows.join(shared, "id", "left").select("id", "text", "symbols")
    left = in_smaller_document(with_symbols, windows, buckets).withColumnRenamed("names", "windows")
    both = with_symbols.join(left, "id", "left").select("id", "text", "symbols", "windows")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in text_chunks(batches):
            words, _, _, at = word_hashes(raw, offsets)
            starts, ends = _settled(words, at, _names(part, "symbols"), window)
            lists = _names(part, "windows")
            if any(lists):
                doc = _window_docs(at, len(words), window)
                inside = np.flatnonzero(doc >= 0)
                hit = inside[_member(doc[inside], sequence_hashes(words, window)[inside], lists)]
                starts, ends = np.concatenate([starts, hit]), np.concatenate([ends, hit + window])
            gone = _covered(len(words), starts, ends)
            removed, digests = [], []
            for i in range(part.num_rows):
                own = raw[offsets[i] : offsets[i + 1]].tobytes().split()
                out = gone[at[i] : at[i + 1]]
                removed.append(int(out.sum()))
                kept = compress(own, (~out).tolist()) if removed[-1] else own
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            arrays = [part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_removed", "kept_sha256"])

    out = both.mapInArrow(strip, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return known.with_id(out.withColumnRenamed("id", "_key"), "_key", id_col).select(id_col, "n_words", "n_removed", "kept_sha256")
