"""Short licence notices in texts, exact and with a few edits.

A notice that may carry ``k`` edits is split into ``k + 1`` pieces: an occurrence
with at most ``k`` edits leaves at least one piece untouched (pigeonhole), so
searching the pieces as exact seeds finds every candidate place. The ``regex``
library then matches the whole notice with a bounded number of errors around
each seed and gives span and edits. A notice without edits has one seed, itself.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dealerflow.llm.common import texts_of


@dataclass(frozen=True)
class Notice:
    """A notice as lower-case words with single spaces, and the edits it may carry."""

    label: str
    text: str
    edits: int = 0
    base: bool = False


# Phrases and labels that are searched exactly.
BASE = (
    Notice("cc-by", "cc by", base=True),
    Notice("gpl", "general public license", base=True),
    Notice("reserved", "all rights reserved", base=True),
)

#: Opening or naming words of common licences, about one edit for eight characters.
FUZZY = (
    Notice("apache-2.0", "licensed under the apache license version 2 0", 5),
    Notice("bsd", "redistribution and use in source and binary forms", 6),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 2),
    Notice("gpl", "gnu general public license version", 4),
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person", 7),
    Notice("mpl", "mozilla public license version", 3),
    Notice("reserved", "all rights reserved", 2),
)

MATCH = "array<struct<label:string,base:boolean,word:bigint,n_words:int,start:bigint,end:bigint,edits:int,similarity:double>>"

# Every byte as it counts in a word: a-z for A-Z, a blank for what is in no word.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def seeds(notice: Notice) -> list[tuple[int, str]]:
    """Offset and text of ``edits + 1`` pieces that together are the notice."""
    n, parts = len(notice.text), notice.edits + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=256)
def _verifier(notice: Notice) -> regex.Pattern:
    return regex.compile(f"(?b)(?<= )(?:{regex.escape(notice.text)}){{e<={notice.edits}}}(?= )")


def _finds(text: str, needle: str) -> Iterator[int]:
    at = text.find(needle)
    while at >= 0:
        yield at
        at = text.find(needle, at + 1)


def _free(taken: list[tuple[int, int, int]], low: int, high: int) -> Iterator[tuple[int, int]]:
    """What the ``taken`` places, sorted and apart from each other, leave of a region."""
    i = bisect(taken, (low,))
    if i and taken[i - 1][1] > low:
        low = taken[i - 1][1]
    while i < len(taken) and taken[i][0] < high:
        yield low, taken[i][0]
        low, i = taken[i][1], i + 1
    yield low, high


def places(flat: str, notice: Notice) -> list[tuple[int, int, int]]:
    """Start, end and edits of the notice's places in a normalised text.

    Exact notices: every place. Others: places that do not overlap, found in the
    regions around their seeds, those with fewer edits first, until no further
    place fits between them. A region is one notice long, so the work follows the
    number of seeds.
    """
    size = len(notice.text)
    if not notice.edits:
        return [(at + 1, at + 1 + size, 0) for at in _finds(flat, f" {notice.text} ")]
    starts = sorted({at - offset for offset, piece in seeds(notice) for at in _finds(flat, piece)})
    regions, i = [], 0
    while i < len(starts):
        first = starts[i]
        while i < len(starts) and starts[i] <= first + notice.edits:  # most often seeds of one place
            last, i = starts[i], i + 1
        regions.append((max(0, first - notice.edits - 1), min(last + size + notice.edits + 1, len(flat))))
    taken: list[tuple[int, int, int]] = []
    search, least = _verifier(notice).search, size - notice.edits + 2
    while regions:
        best = [(m, region) for region in regions if (m := search(flat, *region))]
        found = sorted((sum(m.fuzzy_counts), m.start(), m.end()) for m, _ in best)
        for edits, start, end in found:
            i = bisect(taken, (start,))
            if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or taken[i][0] >= end):
                taken.insert(i, (start, end, edits))
        regions = sorted({part for _, region in best for part in _free(taken, *region) if part[1] - part[0] >= least})
    return taken


def normalise(text: str) -> tuple[str, int]:
    """The words in lower case, each between single blanks, and their number."""
    words = text.encode().translate(_BYTES).split()
    return f" {b' '.join(words).decode()} ", len(words)


def scan_text(text: str, notices: Sequence[Notice]) -> tuple[int, list[dict]]:
    """Number of words and the matches in order of place."""
    flat, n = normalise(text)
    found = [(a, b, edits, notice) for notice in notices for a, b, edits in places(flat, notice)]
    if not found:
        return n, []
    found.sort(key=lambda x: (x[0], x[1], x[3].label, not x[3].base))
    matches, seen, index = [], 0, 0
    for a, b, edits, notice in found:
        index += flat.count(" ", seen, a) if a > seen else 0
        seen = max(seen, a)
        matches.append({
            "label": notice.label, "base": notice.base, "word": index - 1, "n_words": flat.count(" ", a, b) + 1,
            "edits": edits, "similarity": 1 - edits / len(notice.text),
        })
    firsts = {m["word"] for m in matches}
    lasts = {m["word"] + m["n_words"] - 1 for m in matches}
    start, end = {}, {}
    for i, m in enumerate(_WORD.finditer(text)):
        if i in firsts:
            start[i] = m.start()
        if i in lasts:
            end[i] = m.end()
    for m in matches:
        m["start"], m["end"] = start[m["word"]], end[m["word"] + m["n_words"] - 1]
    return n, matches


def scan_notices(
    docs: DataFrame, notices: Sequence[Notice] = (*BASE, *FUZZY), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words`` and ``matches`` (spans in code points of the text).

    One narrow pass without shuffle; a task holds one text and its matches.
    A null text is empty: no words, no matches. Rows with a null id and repeated
    rows are scanned like any other. Other columns are not read. An empty table
    gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = tuple(notices)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                rows = [scan_text(text, chosen) for text in texts_of(batch)]
                counts = pa.array([n for n, _ in rows], pa.int64())
                matches = pa.array([m for _, m in rows], _MATCHES)
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, matches], [id_col, "n_words", "matches"])

    table = docs.select(id_col, docs[text_col].alias("text"))
    return table.mapInArrow(scan, f"`{id_col}` {kind}, n_words bigint, matches {MATCH}")


_MATCHES = pa.list_(
    pa.struct([
        ("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()), ("n_words", pa.int32()),
        ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64()),
    ])
)
