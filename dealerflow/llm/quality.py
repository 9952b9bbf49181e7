"""Quality classifier: a factorisation machine over hashed words, text structure and metadata.

The score of a document with features ``x`` is the logistic of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

The pairwise part is half of ``sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2``, so
it costs as much as there are features, not pairs. Training sees every labelled
document, in shards on the executors; scoring is one narrow pass over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerflow.llm import training
from dealerflow.llm.common import saved, scratch, text_chunks
from dealerflow.llm.training import State
from dealerflow.llm.words import word_hashes

#: Passes over the labelled documents, documents of a step, size and penalty of the steps, seed of the start and the order.
EPOCHS, BATCH, RATE, PENALTY, SEED = 8, 128, 0.05, 1e-5, 7
#: Buckets of hashed words, bins of a statistic, and the rank of the interactions.
WORDS, BINS, RANK = 1 << 14, 16, 8
STATS = ("length", "words", "distinct", "top_word", "repeats", "upper", "digits", "marks", "bars", "lines", "word_length", "metadata")
SIZE = WORDS + BINS * len(STATS)

_UPPER, _LETTER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bin of a share, finer near 0."""
    return np.minimum(BINS - 1, np.sqrt(part / np.maximum(whole, 1)) * BINS).astype(np.int64)


def _size(n: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 2, np.log2(n + 1.0)).astype(np.int64)


def features(raw: np.ndarray, offsets: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values, and where each document's features begin, for a chunk of whole texts.

    Words are weighed by the square root of their count, to length 1; every
    statistic and the metadata (NaN: missing) is one of ``BINS`` bins.
    """
    n = len(offsets) - 1
    hashes, starts, ends, at = word_hashes(raw, offsets, lower=True)
    owner = np.repeat(np.arange(n), np.diff(at))
    pairs, counts = np.unique((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)), return_counts=True)
    doc = (pairs >> np.uint64(40)).astype(np.int64)
    bucket = ((pairs & np.uint64((1 << 40) - 1)) % np.uint64(WORDS)).astype(np.int64)
    weight = np.sqrt(counts)
    norm = np.sqrt(np.bincount(doc, counts, n))
    n_bytes, n_words = np.diff(offsets), np.diff(at)
    distinct = np.bincount(doc, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc, counts)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    letters = _per_doc(_LETTER[raw], offsets)
    stats = [
        _size(n_bytes), _size(n_words), _share(distinct, n_words), _share(top, n_words), _share(_per_doc(again, at), n_words),
        _share(_per_doc(_UPPER[raw], offsets), letters), _share(_per_doc(_DIGIT[raw], offsets), n_bytes),
        _share(_per_doc(_MARK[raw], offsets), n_bytes), _share(_per_doc(raw == 124, offsets), n_words),
        _share(_per_doc(raw == 10, offsets), n_words),
        np.minimum(BINS - 1, _per_doc(np.ones(len(raw), bool), offsets) // np.maximum(n_words, 1)),
        np.where(np.isnan(meta), BINS - 1, _size(np.maximum(np.nan_to_num(meta), 0))),
    ]
    fixed = np.stack(stats, axis=1) + WORDS + BINS * np.arange(len(STATS))
    index = np.concatenate([bucket, fixed.ravel()])
    value = np.concatenate([weight / norm[doc], np.full(fixed.size, 0.5)])
    owner = np.concatenate([doc, np.repeat(np.arange(n), len(STATS))])
    order = np.argsort(owner, kind="stable")
    return index[order], value[order], np.concatenate([[0], np.cumsum(distinct + len(STATS))])


@dataclass(frozen=True)
class Model:
    """Fixed-size arrays, whatever the corpus: bias, ``SIZE`` weights, ``SIZE`` x ``RANK`` factors."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Every document has the statistics as features, so no stretch is empty."""
        v = self.factors[index] * value[:, None]
        starts = at[:-1]
        linear = np.add.reduceat(self.weights[index] * value, starts)
        sums, squares = np.add.reduceat(v, starts, axis=0), np.add.reduceat(v * v, starts, axis=0)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1)

    def scores(self, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(at) - 1:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margins(index, value, at), -30, 30)))


def _start(rng: np.random.Generator) -> np.ndarray:
    return rng.normal(0, 0.02, (SIZE, RANK))


def _first_state(n: int, positive: float) -> State:
    """Weights, factors and bias, then the sums of squared steps of each."""
    bias = np.full((1, 1), np.log(positive / (n - positive)))
    return [np.zeros((SIZE, 1)), _start(np.random.default_rng(SEED)), bias, np.full((SIZE, 1), 1e-6), np.full((SIZE, RANK), 1e-6), np.full((1, 1), 1e-6)]


def _model(state: State) -> Model:
    return Model(float(state[2][0, 0]), state[0][:, 0], state[1])


def _one_kind(positive: float, n: int) -> Model:
    """Without labels of both kinds the score is the same for all: 1 for no labels at all, else near the one kind there is."""
    return Model(30.0 if positive == n else -30.0, np.zeros(SIZE), np.zeros((SIZE, RANK)))


def _order(n: int, epoch: int) -> np.ndarray:
    """In which order an epoch takes ``n`` documents."""
    rng = np.random.default_rng(SEED)
    _start(rng)
    return [rng.permutation(n) for _ in range(epoch + 1)][-1]


def fit(index: np.ndarray, value: np.ndarray, at: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """A model of documents in memory."""
    n, positive = len(labels), float(labels.sum())
    if not n or positive in (0.0, float(n)):
        return _one_kind(positive, n)
    state = _first_state(n, positive)
    for epoch in range(epochs):
        steps(state, index, value, at, labels, _order(n, epoch))
    return _model(state)


def steps(state: State, index: np.ndarray, value: np.ndarray, at: np.ndarray, labels: np.ndarray, order: np.ndarray) -> None:
    """Adaptive gradient steps on the logistic loss over small batches, in place."""
    weights, factors, bias, gw, gv, gb = state
    weights, gw = weights[:, 0], gw[:, 0]
    for first in range(0, len(order), BATCH):
        rows = order[first : first + BATCH]
        sizes = at[rows + 1] - at[rows]
        inner = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(at[rows] - inner[:-1], sizes) + np.arange(inner[-1])
        i, x = index[take].astype(np.int64), value[take].astype(float)
        error = (_model(state).scores(i, x, inner) - labels[rows]) / len(rows)
        v = factors[i] * x[:, None]
        sums = np.add.reduceat(v, inner[:-1], axis=0)
        own = np.repeat(np.arange(len(rows)), sizes)
        scaled = (error[own] * x)[:, None]
        used, slot = np.unique(i, return_inverse=True)
        dw = np.bincount(slot, scaled[:, 0]) + PENALTY * weights[used]
        step = scaled * (sums[own] - v)
        dv = np.stack([np.bincount(slot, step[:, f]) for f in range(RANK)], axis=1) + PENALTY * factors[used]
        db = error.sum()
        gw[used] += dw**2
        gv[used] += dv**2
        gb += db**2
        weights[used] -= RATE * dw / np.sqrt(gw[used])
        factors[used] -= RATE * dv / np.sqrt(gv[used])
        bias -= RATE * db / np.sqrt(gb)


def held_out(id_col: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_col: str | None = "n_chars",
    label_col: str = "quality",
) -> Model:
    """Fit on all labelled documents, whole texts, without the held-out ones, in shards on the executors.

    What comes to the driver is the model.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("label"))
    meta = F.col(meta_col).cast("double") if meta_col else F.lit(None).cast("double")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), meta.alias("meta"))

    def shard(state: State, table: pa.Table, epoch: int) -> None:
        steps(state, *_shard_features(table), table["label"].to_numpy(), _order(table.num_rows, epoch))

    with scratch(docs.sparkSession):
        rows = saved(training.labelled(rows, known, "text", "meta").select("id", "text", "meta", "label"))
        n, positive, size = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        if positive in (0.0, float(n)):
            return _one_kind(positive, n)
        return _model(training.trained(rows, training.shards_of(size), _first_state(n, positive), shard, EPOCHS))


def _shard_features(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of all documents of a shard, values to seven digits."""
    parts = [features(raw, offsets, _metadata(part)) for part, raw, offsets in training.chunks(table)]
    sizes = np.concatenate([np.diff(at) for _, _, at in parts])
    index = np.concatenate([i.astype(np.int32) for i, _, _ in parts])
    value = np.concatenate([x.astype(np.float32) for _, x, _ in parts])
    return index, value, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _metadata(part: pa.RecordBatch) -> np.ndarray:
    return np.array([np.nan if x is None else x for x in part.column("meta").to_pylist()], float)


def score_documents(
    docs: DataFrame, model: Model, text_col: str = "text", meta_col: str | None = "n_chars"
) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with its ``score``.

    All columns pass through unseen, whatever their names, nulls and repeats; no
    join and no shuffle. A null text is an empty one and scored by its
    statistics. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors))  # fixed size
    meta = F.col(meta_col).cast("double") if meta_col else F.lit(None).cast("double")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col(text_col).alias("text"), meta.alias("meta"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for part, raw, offsets in text_chunks(batches):
            scores = own.scores(*features(raw, offsets, _metadata(part)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
