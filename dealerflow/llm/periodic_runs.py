"""Periodic runs of words: Kruskal's union of suffix classes by falling length of their common prefix.

A run is a stretch of consecutive words with smallest period ``q``, at least
``LEAST`` words and ``TIMES`` periods long, that no neighbouring word extends.
Where a run starts at ``i``, the suffixes at ``i`` and ``i + q`` have a common
prefix of the run's length less ``q``, and no suffix between them shares as much
with either. So the suffixes of a document are united to classes in the order of
falling common prefixes, each class an ordered set of positions; when two classes
become one, the positions that become neighbours and lie no further apart than
the common prefix allows are seeds of runs, and every run has such a seed at its
first word. Only prefixes long enough for a run are united, which spares nearly
all suffixes of ordinary text.

A document is worked on in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerflow.llm.common import text_chunks
from dealerflow.llm.words import mix, sequence_hashes, word_hashes

#: Words and periods that a run has at least.
LEAST, TIMES = 24, 3
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def shortest_prefix(least: int, times: int) -> int:
    """Words that the suffixes at a run's start and one period on have in common, at least, whatever the period."""
    return min(max(least - q, (times - 1) * q) for q in range(1, max(least, 2)))


def repeating(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Documents in which some ``length`` words in a row start at two places."""
    hashes = sequence_hashes(words, length)
    doc = np.searchsorted(at, np.arange(len(hashes)), "right") - 1
    inside = np.flatnonzero(np.arange(len(hashes)) + length <= at[doc + 1])
    doc = doc[inside]
    keys = hashes[inside] ^ mix(doc.astype(np.uint64))
    order = np.argsort(keys)
    again = order[1:][keys[order[1:]] == keys[order[:-1]]]
    return np.unique(doc[again])


def suffix_ranks(values: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... values; in the last all differ.

    Suffixes alike in so many values have the same rank, the first place of their
    class in sorted order. Only classes of several suffixes are sorted again.
    """
    order = np.argsort(values, kind="stable")
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[order[1:]] != values[order[:-1]]
    rank = np.empty(len(values), np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(values)), 0))
    ranks, step = [rank], 1
    alone = fresh & np.append(fresh[1:], True)
    left = order[~alone]
    while len(left):
        group = rank[left]
        behind = left + step
        second = np.where(behind < len(rank), rank[np.minimum(behind, len(rank) - 1)], -1)
        order = np.lexsort((second, group))
        left, group, second = left[order], group[order], second[order]
        place = np.arange(len(left))
        first = np.ones(len(left), bool)
        first[1:] = group[1:] != group[:-1]
        fresh = first.copy()
        fresh[1:] |= second[1:] != second[:-1]
        begins = np.maximum.accumulate(np.where(first, place, 0))
        rank = rank.copy()
        rank[left] = group + np.maximum.accumulate(np.where(fresh, place, 0)) - begins
        ranks.append(rank)
        left = left[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return ranks


def common_prefixes(ranks: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``x`` and ``y``, by the ranks' powers of two."""
    x, y, total = x.copy(), y.copy(), np.zeros(len(x), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        more = (ranks[k][x] == ranks[k][y]).astype(np.int64) << k
        x, y, total = x + more, y + more, total + more
    return total


def seeds(places: list[int], prefixes: list[int], order: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """Start, distance and common prefix of positions that become neighbours and begin a run.

    ``places`` are positions in the order of their suffixes; ``prefixes[k]`` is
    what ``places[k]`` and ``places[k + 1]`` share; ``order`` lists the pairs by
    falling prefix. A class is a stretch of ``places``, found by its ends, with
    its positions in ascending order; the smaller of two goes into the larger.
    """
    held: list[list[int] | None] = [[p] for p in places]
    first, last = list(range(len(places))), list(range(len(places)))
    found = []
    for k in order:
        shared = prefixes[k]
        low, high = first[k], last[k + 1]
        large, small = held[low], held[k + 1]
        held[k + 1] = None
        if len(large) < len(small):
            large, small = small, large
        at, most = [bisect_left(large, p) for p in small], len(small) - 1
        for j, (p, i) in enumerate(zip(small, at, strict=True)):
            # A neighbour of the other class, unless one of its own class is nearer.
            if i and (j == 0 or small[j - 1] < large[i - 1]):
                gap = p - large[i - 1]
                if (times - 1) * gap <= shared and gap + shared >= least:
                    found.append((large[i - 1], gap, shared))
            if i < len(large) and (j == most or small[j + 1] > large[i]):
                gap = large[i] - p
                if (times - 1) * gap <= shared and gap + shared >= least:
                    found.append((p, gap, shared))
        if most * 32 < len(large):
            for p, i in zip(reversed(small), reversed(at), strict=True):
                large.insert(i, p)
        else:  # two ascending stretches, which sorting merges in one pass
            large.extend(small)
            large.sort()
        held[low], first[high], last[low] = large, low, high
    return found


def runs_of(words: np.ndarray, at: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Runs (start, length, period) by document, start and period, and where each document's begin.

    ``words`` are the words' hashes, document after document; ``at`` tells where
    each begins and has one entry more.
    """
    n = len(at) - 1
    shortest = shortest_prefix(least, times)
    busy = repeating(words, at, shortest)
    none = np.zeros((0, 3), np.int64)
    if not len(busy):
        return none, np.zeros(n + 1, np.int64)
    sizes = np.diff(at)[busy]
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # each document and a value of its own behind it
    doc = np.repeat(np.arange(len(busy)), sizes)
    place = np.arange(sizes.sum()) + doc
    taken = words[np.repeat(at[busy] - starts[:-1] + np.arange(len(busy)), sizes) + place - doc]
    order = np.lexsort((taken, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (doc[order[1:]] != doc[order[:-1]]) | (taken[order[1:]] != taken[order[:-1]])
    values = np.empty(starts[-1], np.int64)
    values[place[order]] = np.cumsum(fresh)
    values[starts[1:] - 1] = -1 - np.arange(len(busy))
    ranks = suffix_ranks(values)
    sorted_places = np.argsort(ranks[-1])
    x, y = sorted_places[:-1], sorted_places[1:]
    level = min(shortest.bit_length(), len(ranks)) - 1
    close = np.flatnonzero(ranks[level][x] == ranks[level][y])
    shared = np.zeros(len(x), np.int64)
    shared[close] = common_prefixes(ranks, x[close], y[close])
    edges = np.flatnonzero(shared >= shortest)
    if not len(edges):
        return none, np.zeros(n + 1, np.int64)
    # Only the ends of such pairs, in the order of suffixes.
    used = np.unique(np.concatenate([edges, edges + 1]))
    slot = np.searchsorted(used, edges)
    prefixes = np.zeros(len(used), np.int64)
    prefixes[slot] = shared[edges]
    falling = slot[np.argsort(-shared[edges], kind="stable")]
    found = np.array(seeds(sorted_places[used].tolist(), prefixes.tolist(), falling.tolist(), least, times), np.int64).reshape(-1, 3)
    begin, period, prefix = found.T
    # The first word of a run: the word before it breaks the period.
    first = values[begin - 1] != values[begin + period - 1]
    begin, period, prefix = begin[first], period[first], prefix[first]
    own = np.searchsorted(starts, begin, "right") - 1
    order = np.lexsort((period, begin))
    runs = np.stack([begin - starts[own], prefix + period, period], axis=1)[order]
    return runs, np.searchsorted(busy[own[order]], np.arange(n + 1))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Numbers of the words that stay: of every run, its first period does."""
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(gone)[:n] == 0)


def find_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Every row's other columns as a struct ``row``, with ``n_words``, ``runs`` and the ``collapsed`` text.

    Words are ``[^\\x20\\x09-\\x0D]+``, told apart by 64-bit hashes. ``runs`` lists
    start (word number from 0), length and smallest period of every run, by start
    and period; runs may overlap. ``collapsed`` has one blank between the words
    that no run contains after its first period. Null and empty texts have no
    words, no runs and an empty collapsed text. Rows are taken one by one, so
    null or repeated ids are values like any other, and no column name clashes.
    A text of any length is one task's work, in memory of about 200 bytes a word.
    An empty table gives an empty result.
    """
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != text_col)).alias("row"), docs[f"`{text_col}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in text_chunks(batches):
            words, _, _, at = word_hashes(raw, offsets)
            runs, begin = runs_of(words, at, least, times)
            sizes, texts = np.diff(at), []
            for i in range(part.num_rows):
                tokens = raw[offsets[i] : offsets[i + 1]].tobytes().split()  # on the same six bytes
                if begin[i + 1] > begin[i]:
                    tokens = [tokens[k] for k in kept_words(len(tokens), runs[begin[i] : begin[i + 1]]).tolist()]
                texts.append(b" ".join(tokens))
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in runs.T.copy()], fields=list(_RUN)))
            collapsed = pa.array(texts, pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes.astype(np.int64)), lists, collapsed.cast(pa.string()) if collapsed.nbytes < 1 << 31 else collapsed],
                ["row", "n_words", "runs", "collapsed"],
            )

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string")
