"""Toxicity: a convolutional text classifier over hashed words, trained with numpy.

A word's vector is the sum of three rows of one hashed table: the word's own and
those of its first four and five bytes, so forms of a stem share what they learn.
Filters of several widths slide over the words, each filter keeps its largest
response in the text, and a linear layer on these gives the margin. Largest
responses can be merged, so a text of any length is read in blocks of words.

The margin at which a text counts as toxic is calibrated by language on labelled
texts that the training doesn't see. The language is guessed from the text itself
by frequent words; a table's language column is never read. Scores are shifted by
that margin, so 0.5 is the threshold in every language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerflow.llm import training
from dealerflow.llm.common import saved, scratch, text_chunks
from dealerflow.llm.training import State
from dealerflow.llm.words import MARKS, mix, word_hashes

#: Rows and components of the table of embeddings, bytes of the starts of a word that have rows too.
BUCKETS, DIMS, STARTS = 1 << 17, 12, (4, 5)
#: Widths of the filters, filters of a width.
WIDTHS, FILTERS = (1, 2, 3), 16
#: Words whose responses are computed at once.
BLOCK = 1 << 15
#: Passes over the labelled texts, texts of a step, size of the steps, seed of the start and the order.
EPOCHS, BATCH, RATE, SEED = 5, 16, 0.05, 5
#: Steps of the grid, per unit, on which margins are counted, and where it ends.
GRID, FAR = 256, 128
#: One of so many labelled texts is for calibration; labelled texts of either kind that a language needs for a margin of its own.
CALIBRATE, ENOUGH = 4, 12
# Frequent words that tell languages apart.
FREQUENT = {
    "de": "der die das und ein ist nicht mit von auf",
    "en": "the of and to in is that was for with",
    "es": "el los las del que por una y con no",
    "fr": "le les des et une dans est pour qui pas",
}
LANGUAGES = (*FREQUENT, "other")
PAD = max(WIDTHS)


def _markers() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the frequent words, sorted, and their languages."""
    names, owners = [], []
    for number, text in enumerate(FREQUENT.values()):
        raw = np.frombuffer(text.encode(), np.uint8)
        names.append(word_hashes(raw, np.array([0, len(raw)]), True, MARKS)[0])
        owners.append(np.full(len(names[-1]), number))
    order = np.argsort(np.concatenate(names))
    return np.concatenate(names)[order], np.concatenate(owners)[order]


_NAMES, _OWNERS = _markers()


def languages(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of each document's language in ``LANGUAGES``: the one with most frequent words, the last without any."""
    slot = np.minimum(np.searchsorted(_NAMES, words), len(_NAMES) - 1)
    hit = np.flatnonzero(_NAMES[slot] == words)
    n = len(at) - 1
    doc = np.searchsorted(at, hit, "right") - 1
    counts = np.bincount(doc * len(LANGUAGES) + _OWNERS[slot[hit]], minlength=n * len(LANGUAGES)).reshape(n, -1)
    counts[:, -1] = counts.max(axis=1) == 0
    return counts.argmax(axis=1)


def buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the table for every word (words x 3, of the starts and the word), where documents' words begin, languages."""
    words, starts, ends, at = word_hashes(raw, offsets, True, MARKS)
    lower = raw + np.where((raw >= 65) & (raw <= 90), 32, 0).astype(np.uint8)
    padded = np.concatenate([lower, np.zeros(max(STARTS), np.uint8)])
    rows = [words]
    for size in STARTS:
        name = np.full(len(words), size, np.uint64)
        for k in range(size):
            name = name * np.uint64(257) + np.where(starts + k < ends, padded[starts + k], 0)
        rows.append(mix(name))
    return (np.stack(rows, axis=1) & np.uint64(BUCKETS - 1)).astype(np.int32), at, languages(words, at)


@dataclass(frozen=True)
class Model:
    """Arrays of fixed size: embeddings, filters by width, output layer, margin by language."""

    table: np.ndarray  # bucket, dims
    filters: tuple[np.ndarray, ...]  # width x dims, filter
    weights: np.ndarray  # width x filter
    bias: float
    margins: np.ndarray

    def responses(self, vectors: np.ndarray, width: int) -> np.ndarray:
        """Response of the filters of a width at every place that has ``width`` vectors behind it."""
        n = len(vectors) - width + 1
        wide = np.hstack([vectors[j : j + n] for j in range(width)]) if width > 1 else vectors
        return wide @ self.filters[WIDTHS.index(width)]

    def pooled(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Largest responses of every document, at least 0: documents x filters of all widths.

        Behind its last word a text goes on in empty places.
        """
        n = len(at) - 1
        out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        laid, begins = _padded(rows, at)
        for first in range(0, len(laid) - PAD, BLOCK):
            last = min(first + BLOCK, len(laid) - PAD)
            vectors = _vectors(self.table, laid[first : last + PAD])
            docs = np.arange(np.searchsorted(begins, first, "right") - 1, np.searchsorted(begins, last, "left"))
            cuts = np.maximum(begins[docs] - first, 0)
            for w, width in enumerate(WIDTHS):
                found = self.responses(vectors, width)[: last - first]
                found[laid[first:last, 0] < 0] = 0  # a place behind a text sees nothing of the next one
                part = out[docs, w * FILTERS : (w + 1) * FILTERS]
                out[docs, w * FILTERS : (w + 1) * FILTERS] = np.maximum(part, np.maximum.reduceat(found, cuts, axis=0))
        return out

    def peaks(self, laid: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By width: the first place of every document where a filter responds most, and this response, documents x filters."""
        shape = len(begins), FILTERS
        places, tops = [np.zeros(shape, np.int64) for _ in WIDTHS], [np.full(shape, -np.inf, np.float32) for _ in WIDTHS]
        for first in range(0, len(laid) - PAD, BLOCK):
            last = min(first + BLOCK, len(laid) - PAD)
            vectors = _vectors(self.table, laid[first : last + PAD])
            inside = np.flatnonzero((begins < last) & (ends > first))
            if not len(inside):
                continue
            spans = np.stack([np.maximum(begins[inside], first), np.minimum(ends[inside], last)], axis=1) - first
            for w, width in enumerate(WIDTHS):
                found = self.responses(vectors, width)
                place = np.stack([b + found[b:e].argmax(axis=0) for b, e in spans])
                top = np.take_along_axis(found, place, axis=0)
                more = top > tops[w][inside]
                places[w][inside] = np.where(more, place + first, places[w][inside])
                tops[w][inside] = np.where(more, top, tops[w][inside])
        return places, tops

    def raw_margins(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.pooled(rows, at).astype(float) @ self.weights + self.bias

    def scores(self, rows: np.ndarray, at: np.ndarray, language: np.ndarray) -> np.ndarray:
        margin = self.raw_margins(rows, at) - self.margins[language]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _padded(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``PAD`` empty places (-1) behind every document and at the end, and where documents begin."""
    sizes = np.diff(at)
    begins = at[:-1] + PAD * np.arange(len(sizes))
    laid = np.full((len(rows) + PAD * (len(sizes) + 1), rows.shape[1]), -1, np.int32)
    laid[np.arange(len(rows)) + PAD * np.repeat(np.arange(len(sizes)), sizes)] = rows
    return laid, begins


def _vectors(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the table's rows; its last row is that of empty places."""
    out = table[rows[:, 0]]
    for c in range(1, rows.shape[1]):
        out += table[rows[:, c]]
    return out


def _start(rng: np.random.Generator) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    table = rng.normal(0, 0.1, (BUCKETS + 1, DIMS)).astype(np.float32)
    table[-1] = 0  # where -1 points
    filters = [rng.normal(0, (w * DIMS) ** -0.5, (w * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    return table, filters, rng.normal(0, 0.1, len(WIDTHS) * FILTERS)


def _first_state() -> State:
    """Table, filters, output weights and bias, then the sums of squared steps of each."""
    table, filters, weights = _start(np.random.default_rng(SEED))
    sums = [np.full(table.shape, 1e-6, np.float32), *(np.full(f.shape, 1e-6) for f in filters), np.full((1, len(weights)), 1e-6), np.full((1, 1), 1e-6)]
    return [table, *filters, weights[None], np.zeros((1, 1)), *sums]


def _model(state: State) -> Model:
    """The model of a state, without margins; its arrays are the state's own."""
    table, *filters, weights, bias = state[: len(state) // 2]
    return Model(table, tuple(filters), weights[0], float(bias[0, 0]), np.zeros(len(LANGUAGES)))


def _one_kind(n: int) -> Model:
    """Without labels of both kinds the score is near the one kind there is, and near 0 without any."""
    table, filters, weights = _start(np.random.default_rng(SEED))
    return Model(table, tuple(filters), np.zeros_like(weights), 10.0 if n else -10.0, np.zeros(len(LANGUAGES)))


def _order(n: int, epoch: int) -> np.ndarray:
    """In which order an epoch takes ``n`` texts."""
    rng = np.random.default_rng(SEED)
    _start(rng)
    return [rng.permutation(n) for _ in range(epoch + 1)][-1]


def fit(rows: np.ndarray, at: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """A model of texts in memory; both kinds of label weigh alike."""
    n, positive = len(labels), int((labels > 0).sum())
    if positive in (0, n):
        return _one_kind(positive)
    state = _first_state()
    for epoch in range(epochs):
        steps(state, rows, at, labels, (n, positive), _order(n, epoch), rate)
    return _model(state)


def steps(state: State, rows: np.ndarray, at: np.ndarray, labels: np.ndarray, counts: tuple[int, int], order: np.ndarray, rate: float) -> None:
    """Adaptive gradient steps on the logistic loss over small batches, in place.

    ``counts``, of all texts and the positive ones, make both kinds of label weigh
    alike. Only the places with the largest responses have a gradient, so a step
    touches few rows of the table.
    """
    n, positive = counts
    worth = np.where(labels > 0, n / (2 * positive), n / (2 * (n - positive)))
    half = len(state) // 2
    (table, *filters, weights, bias), (table_sum, *filter_sums, weight_sum, bias_sum) = state[:half], state[half:]
    for first in range(0, len(order), BATCH):
        chosen = order[first : first + BATCH]
        sizes = at[chosen + 1] - at[chosen]
        inner = np.concatenate([[0], np.cumsum(sizes)])
        laid, begins = _padded(rows[np.repeat(at[chosen] - inner[:-1], sizes) + np.arange(inner[-1])], inner)
        peaks, tops = _model(state).peaks(laid, begins, begins + sizes + 1)
        pooled = np.maximum(np.hstack(tops), 0).astype(float)
        error = 1 / (1 + np.exp(-np.clip(pooled @ weights[0] + bias[0, 0], -30, 30))) - labels[chosen]
        error *= worth[chosen] / len(chosen)
        grad = (error[:, None] * weights * (pooled > 0)).astype(np.float32)
        dw, db = pooled.T @ error, error.sum()
        touched, moved = [], []
        for w, (width, peak) in enumerate(zip(WIDTHS, peaks, strict=True)):
            g, df = grad[:, w * FILTERS : (w + 1) * FILTERS], []
            for j in range(width):
                at_peak = laid[peak + j].reshape(-1, laid.shape[1])
                df.append(np.einsum("bf,bfd->df", g, _vectors(table, at_peak).reshape(*peak.shape, DIMS)))
                touched.append(at_peak)
                moved.append((g[:, :, None] * filters[w][j * DIMS : (j + 1) * DIMS].T[None]).reshape(-1, DIMS))
            df = np.vstack(df)
            filter_sums[w] += df**2
            filters[w] -= (rate * df / np.sqrt(filter_sums[w])).astype(np.float32)
        used, slot = np.unique(np.concatenate(touched).T.ravel(), return_inverse=True)
        moved = np.tile(np.concatenate(moved), (laid.shape[1], 1))
        dt = np.stack([np.bincount(slot, moved[:, d], len(used)) for d in range(DIMS)], axis=1).astype(np.float32)
        dt[used < 0] = 0
        table_sum[used] += dt**2
        table[used] -= rate * dt / np.sqrt(table_sum[used])
        weight_sum += dw**2
        bias_sum += db**2
        weights -= rate * dw / np.sqrt(weight_sum)
        bias -= rate * db / np.sqrt(bias_sum)


def best_margin(margin: np.ndarray, label: np.ndarray, count: np.ndarray | int = 1) -> float:
    """The middle of the widest gap between margins at which fewest texts, as shares of their kinds, are on the wrong side."""
    value, slot = np.unique(margin, return_inverse=True)
    kinds = [np.bincount(slot, np.where(label > 0, count, 0)), np.bincount(slot, np.where(label > 0, 0, count))]
    missed = np.concatenate([[0], np.cumsum(kinds[0])]) / max(1, kinds[0].sum())
    false = np.concatenate([np.cumsum(kinds[1][::-1])[::-1], [0]]) / max(1, kinds[1].sum())
    bad = missed + false
    edges = np.concatenate([[value[0] - 1], value, [value[-1] + 1]])
    middle, gap = (edges[1:] + edges[:-1]) / 2, np.diff(edges)
    return float(middle[max(np.flatnonzero(bad <= bad.min() + 1e-12), key=lambda k: gap[k])])


def _margins(margin: np.ndarray, language: np.ndarray, labels: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A margin for each language; few labelled texts of a language: the margin of all; none of either kind: 0."""
    margins = np.zeros(len(LANGUAGES))
    enough = lambda own, least: min(count[own & (labels > 0)].sum(), count[own & (labels == 0)].sum()) >= least
    if enough(np.ones(len(margin), bool), 1):
        margins[:] = best_margin(margin, labels, count)
    for number in range(len(LANGUAGES)):
        own = language == number
        if enough(own, ENOUGH):
            margins[number] = best_margin(margin[own], labels[own], count[own])
    return margins


def calibrate(model: Model, rows: np.ndarray, at: np.ndarray, language: np.ndarray, labels: np.ndarray) -> Model:
    """The model with the margins of texts in memory."""
    return replace(model, margins=_margins(model.raw_margins(rows, at), language, labels, np.ones(len(labels), np.int64)))


def held_out(id_col: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """Fit and calibrate on all labelled whole texts, in shards on the executors.

    Held-out rows, rows without id or label and null texts are left out; of an id
    that repeats in either table the smallest label or text counts. What comes to
    the driver is the model, and how many texts have which margin.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").cast("double").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    texts = training.labelled(texts, known, "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.append_column("own", pa.array([_calibrates(x) for x in part.column(0).to_pylist()], pa.bool_()))

    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    with scratch(spark):
        texts = saved(texts.select("id", "text", (F.col("label") > 0).alias("label")).mapInArrow(split, f"id {kind}, text string, label boolean, own boolean"))
        fitted = texts.where("not own")
        n, positive, size = fitted.agg(F.count("*"), F.count_if("label"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        model = _one_kind(positive)
        if positive not in (0, n):

            def shard(state: State, table: pa.Table, epoch: int) -> None:
                rows, at = _hashed(table)
                steps(state, rows, at, table["label"].to_numpy().astype(float), (n, positive), _order(table.num_rows, epoch), RATE)

            model = _model(training.trained(fitted, training.shards_of(size), _first_state(), shard, EPOCHS))
        return replace(model, margins=_margins(*_counted(texts.where("own"), model)))


def _calibrates(name: object) -> bool:
    return int(mix(np.array([_digest(name)], np.uint64))[0] >> np.uint64(40)) % CALIBRATE == 0


def _digest(name: object) -> int:
    return int.from_bytes(str(name).encode()[-8:], "little")


def _hashed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the model's table for the words of all texts, and where texts begin."""
    parts = [buckets(raw, offsets)[:2] for _, raw, offsets in training.chunks(table)]
    sizes = np.concatenate([np.diff(at) for _, at in parts])
    return np.concatenate([rows for rows, _ in parts]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _counted(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Margins on a grid, languages, labels and how many of ``texts`` (text, label) have them; as many rows as the grid at most."""
    shared = _shared(texts, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for part, raw, offsets in text_chunks(batches):
            rows, at, language = buckets(raw, offsets)
            place = np.rint(np.clip(own.raw_margins(rows, at), -FAR, FAR) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(language), part.column(1)], ["place", "language", "label"])

    places = texts.select("text", "label").mapInArrow(run, "place bigint, language bigint, label boolean")
    got = places.groupBy("place", "language", "label").agg(F.count("*").alias("n")).collect()
    column = lambda name, kind: np.array([r[name] for r in got], kind)
    return column("place", float) / GRID, column("language", np.int64), column("label", float), column("n", np.int64)


def _shared(docs: DataFrame, model: Model) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast((model.table, model.filters, model.weights, model.bias, model.margins))  # 6 MB


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` but its text as a struct ``row``, with its ``score``; no join and no shuffle.

    Nothing but the text is read, whatever other columns hold or are called.
    A null text is an empty one; all texts without words have the same score.
    An empty table gives an empty result.
    """
    shared = _shared(docs, model)
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != text_col)).alias("row"), docs[f"`{text_col}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for part, raw, offsets in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.scores(*buckets(raw, offsets)))], ["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
