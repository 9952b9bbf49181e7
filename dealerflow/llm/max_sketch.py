"""Ranked lexical search by hashed max-sketches: upper bounds first, exact scores only where they may count.

The index holds for every document its length, its terms with their numbers of
occurrences, and a sketch: a vector into whose coordinates the terms are hashed
and which keeps the largest number of occurrences of each coordinate's terms. A
term's impact rises with its occurrences, so the impact at its coordinate is
never below its own, whatever else was folded into it.

Queries come in batches. All their terms are looked up in the sketches of many
documents at once, and a matrix product with the terms' weights gives an upper
bound for every document and query. A task then scores documents exactly in the
order of falling bounds, until the next bound lies below the score that the best
``k`` so far require; that threshold stays for all further documents of the task.
The best of all tasks are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealerflow.llm.common import saved, text_chunks
from dealerflow.llm.words import MARKS, word_hashes

#: Best documents of an item.
BEST = 10
#: Coordinates of a sketch for each distinct term of its document, at least; coordinates are a power of two.
SPREAD = 8
#: Items of a batch; terms of a batch, beyond which it takes no further item.
ITEMS, TERMS = 256, 1 << 15
#: Documents whose bounds are computed at once, and that are scored before the threshold is looked at again.
GROUP, STEP = 256, 8
#: Occurrences from which on a sketch tells nothing more.
FULL = 255
INDEX = "n bigint, terms binary, occurrences binary, sketch binary"


def coordinates(distinct: int) -> int:
    """Size of the sketch of a document with so many distinct terms."""
    return 1 << max(3, (SPREAD * distinct - 1).bit_length())


def sketch(terms: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
    """The largest number of occurrences, up to ``FULL``, of the terms hashed to each coordinate."""
    out = np.zeros(coordinates(len(terms)), np.uint8)
    np.maximum.at(out, (terms & np.uint64(len(out) - 1)).astype(np.int64), np.minimum(occurrences, FULL).astype(np.uint8))
    return out


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, number of terms ``n``, sorted hashes of the distinct terms, their occurrences, sketch; one row per row of ``docs``.

    Terms are runs of digits, letters and characters beyond ASCII in the whole
    text, with A-Z as a-z, and told apart by 64-bit hashes. A null text has none.
    Rows are independent, so ids may be null or repeat; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in text_chunks(batches):
            words, _, _, at = word_hashes(raw, offsets, True, MARKS)
            names, counts, sketches = [], [], []
            for i in range(part.num_rows):
                terms, times = np.unique(words[at[i] : at[i + 1]], return_counts=True)
                names.append(terms.astype("<u8").tobytes())
                counts.append(times.astype("<u4").tobytes())
                sketches.append(sketch(terms, times).tobytes() if len(terms) else b"")
            arrays = [part.column(0), pa.array(np.diff(at).astype(np.int64)), *(pa.array(x, pa.binary()) for x in (names, counts, sketches))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "terms", "occurrences", "sketch"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {INDEX}")


@dataclass(frozen=True)
class Batch:
    """Terms of the batch's items, sorted; of each item its number, the places of its terms, and their weights."""

    terms: np.ndarray
    items: np.ndarray
    places: tuple[np.ndarray, ...]
    weights: tuple[np.ndarray, ...]

    def weighed(self, found: np.ndarray, documents: int) -> Batch:
        """With weights by the number of documents that hold each term; terms that none holds are left out."""
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in found.tolist()], np.int64)
        held = found > 0
        place = np.cumsum(held) - 1
        places = tuple(place[p[held[p]]] for p in self.places)
        return Batch(self.terms[held], self.items, places, tuple(weight[held][p] for p in places))

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.terms), len(self.items)), np.float32)
        for i, (p, w) in enumerate(zip(self.places, self.weights, strict=True)):
            out[p, i] = w
        return out


def batches_of(items: DataFrame) -> Iterator[tuple[Batch, list[Row]]]:
    """The items (number, id, hashes of terms) in batches of bounded size, read one after the other."""
    rows: list[Row] = []
    terms = 0
    for row in items.toLocalIterator():
        if rows and (len(rows) == ITEMS or terms + len(row["terms"]) // 8 > TERMS):
            yield _batch(rows), rows
            rows, terms = [], 0
        rows.append(row)
        terms += len(row["terms"]) // 8
    if rows:
        yield _batch(rows), rows


def _batch(rows: list[Row]) -> Batch:
    own = [np.frombuffer(r["terms"], "<u8").astype(np.uint64) for r in rows]
    terms = np.unique(np.concatenate(own))
    places = tuple(np.searchsorted(terms, t) for t in own)
    return Batch(terms, np.arange(len(rows)), places, tuple(np.zeros(len(p), np.int64) for p in places))


def document_counts(index: DataFrame, batch: Batch) -> np.ndarray:
    """Documents that hold each of the batch's terms: a row for each task and term is summed."""
    shared = index.sparkSession.sparkContext.broadcast(batch.terms)  # TERMS, but for a longer single item

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for part in rows:
            flat = _numbers(part.column(0), "<u8")
            if len(flat) and len(wanted):
                slot = np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1)
                total += np.bincount(slot[wanted[slot] == flat], minlength=len(wanted))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "n"])

    out = np.zeros(len(batch.terms), np.int64)
    for row in index.select("terms").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers of all rows of a binary column, one after the other."""
    offsets, data = np.frombuffer(column.buffers()[1], np.int32), column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, kind)
    first, last = int(offsets[column.offset]), int(offsets[column.offset + len(column)])
    return np.frombuffer(data.slice(first, last - first).to_pybytes(), kind)


def impacts(occurrences: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied with: rises with its occurrences, falls with ``m``."""
    occurrences = occurrences.astype(np.int64)
    return (1_000_000_000 * occurrences) // np.maximum(1000 * occurrences + 8 * m, 1)


class Searcher:
    """Best documents of every item of a batch among those that one task has seen."""

    def __init__(self, batch: Batch, documents: int, terms: int, best: int) -> None:
        self.batch, self.best = batch, best
        self.documents, self.total = documents, terms
        self.matrix = batch.matrix()
        self.held: list[list[tuple[int, bool, int]]] = [[] for _ in batch.items]  # (-score, id is null, id)
        self.least = np.zeros(len(batch.items))  # scores below it can't be among the best
        self.scored = 0

    def bounds(self, sketches: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Upper bounds, documents x items, for sketches of one size."""
        spots = (self.batch.terms & np.uint64(sketches.shape[1] - 1)).astype(np.int64)
        top = sketches[:, spots].astype(np.float32)
        top = np.where(top >= FULL, np.float32(1e6), np.float32(1e9) * top / (1000 * top + 8 * m[:, None].astype(np.float32)))
        return (top @ self.matrix) * np.float32(1.001) + 1  # above any rounding

    def take(self, ids: list, sizes: np.ndarray, sketches: np.ndarray, terms: list[bytes], occurrences: list[bytes]) -> None:
        """Documents whose sketches have one size: bounds of all, then exact scores by falling bound."""
        m = 10 + (90 * sizes * self.documents) // self.total
        bounds = self.bounds(sketches, m)
        table = np.zeros((len(ids), len(self.batch.terms)), np.int64)  # impacts of the batch's terms, document by document
        known = np.zeros(len(ids), bool)
        for item in np.flatnonzero((bounds >= np.maximum(self.least, 2)).any(axis=0)):
            places, weights = self.batch.places[item], self.batch.weights[item]
            bound = bounds[:, item]
            order = np.argsort(-bound, kind="stable")
            for first in range(0, len(order), STEP):
                some = order[first : first + STEP]
                some = some[bound[some] >= max(self.least[item], 2)]
                if not len(some):
                    break
                for d in some[~known[some]]:
                    own, times = np.frombuffer(terms[d], "<u8"), np.frombuffer(occurrences[d], "<u4")
                    slot = np.minimum(np.searchsorted(self.batch.terms, own), len(self.batch.terms) - 1)
                    hit = self.batch.terms[slot] == own
                    table[d, slot[hit]] = impacts(times[hit], m[d])
                    known[d] = True
                self.scored += len(some)
                self._add(item, ids, some, table[some][:, places] @ weights)

    def _add(self, item: int, ids: list, rows: np.ndarray, scores: np.ndarray) -> None:
        held = self.held[item]
        held += [(-s, ids[r] is None, 0 if ids[r] is None else ids[r]) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) if s > 0 and s >= self.least[item]]
        if len(held) >= self.best:
            held.sort()
            del held[self.best :]
            self.least[item] = -held[-1][0]


def search(
    index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id", best: int = BEST
) -> DataFrame:
    """``item_id``, ``rank`` from 1, ``doc_id`` and ``score`` of each item's ``best`` documents with a score above 0.

    ``index`` is a stored result of ``build_index``. With ``N`` documents that hold
    a term and ``L`` terms in all, a document of ``n`` terms has ``m = 10 + 90 n N
    div L`` and scores the sum, over the item's distinct terms, of ``w * (10^9 tf
    div (1000 tf + 8 m))``, where ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``.
    Equal scores go by the smaller id, null last. Each row of ``items`` is asked
    on its own, also where its id is null or repeats; items without terms and
    empty tables give no rows. A batch of items is one pass over the index.
    """
    facts = index.agg(F.sum((F.col("n") > 0).cast("bigint")).alias("documents"), F.sum("n").alias("terms")).first()
    documents, terms = facts["documents"] or 0, facts["terms"] or 0
    spark, kind = index.sparkSession, index.schema["id"].dataType.simpleString()
    asked = build_index(items, id_col, text_col).where("n > 0").select(F.monotonically_increasing_id().alias("number"), "id", "terms")
    asked = saved(asked)
    found = []
    for batch, rows in batches_of(asked):
        batch = batch.weighed(document_counts(index, batch), documents)
        shared = spark.sparkContext.broadcast((batch, documents, terms))
        near = index.where("n > 0").mapInArrow(_task(shared, best, kind), f"item bigint, id {kind}, score bigint")
        numbers = spark.createDataFrame([(i, r["number"]) for i, r in enumerate(rows)], "item bigint, number bigint")
        found.append(near.join(F.broadcast(numbers), "item").select("number", "id", "score"))  # a row for each item of the batch
    out = [F.col("item.id").alias(id_col), "rank", F.col("near.id").alias(doc_col), "score"]
    if not found:
        found.append(spark.createDataFrame([], f"number bigint, id {kind}, score bigint"))
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    top = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return top.alias("near").join(asked.alias("item"), "number").select(*out)


def _task(shared, best: int, kind: str):
    """Passes over the index: searches it in groups of documents with sketches of one size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, documents, total = shared.value
        searcher = Searcher(batch, documents, total, best)
        waiting: dict[int, list[tuple]] = {}

        def flush(size: int) -> None:
            ids, n, terms, occurrences, sketches = zip(*waiting.pop(size), strict=True)
            laid = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(ids), size)
            searcher.take(list(ids), np.array(n, np.int64), laid, terms, occurrences)

        for part in batches:
            for row in zip(*(part.column(c).to_pylist() for c in ("id", "n", "terms", "occurrences", "sketch")), strict=True):
                size = len(row[-1])
                waiting.setdefault(size, []).append(row)
                if len(waiting[size]) * size >= GROUP << 13 or len(waiting[size]) >= GROUP:
                    flush(size)
        for size in list(waiting):
            flush(size)
        rows = [(i, None if null else d, -score) for i, held in enumerate(searcher.held) for score, null, d in sorted(held)[:best]]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        types = (pa.int64(), {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item", "id", "score"])

    return run
