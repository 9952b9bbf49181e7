"""Words and word sequences as 64-bit hashes, computed over whole chunks of text with numpy.

A hash depends on nothing but the word's bytes, so equal words get equal names
in every task of every job.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

U64 = np.uint64
#: Bytes hashed in one go, and the longest word that is hashed that way.
SEGMENT, LONGEST = 1 << 20, 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = U64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _spaces() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


SPACE = _spaces()
#: Bytes between terms: all of ASCII but digits and letters.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@lru_cache(maxsize=4)
def _tables(lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = np.arange(256, dtype=np.uint64)
    if lower:
        letters[65:91] += U64(32)
    inverse = pow(_BASE, -1, 1 << 64)
    powers = np.ones(SEGMENT + 1, np.uint64)
    inverses = np.ones(SEGMENT + 1, np.uint64)
    powers[1:], inverses[1:] = U64(_BASE), U64(inverse)
    return mix(letters * U64(0xA24BAED4963EE407) + U64(1)), np.cumprod(powers), np.cumprod(inverses)


def _lowered(word: bytes, lower: bool) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in word) if lower else word


def _segment(raw: np.ndarray, at: np.ndarray, lower: bool, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one segment; ``at``: where documents start in it."""
    table, powers, inverses = _tables(lower)
    n = len(raw)
    word = ~gaps[raw]
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = ~word[:-1]
    fresh[at] = True
    starts = np.flatnonzero(word & fresh[:n])
    over = np.ones(n, bool)
    over[:-1] = ~word[1:]
    cut = at[(at > 0) & (at < n)]
    over[cut - 1] = True
    ends = np.flatnonzero(word & over) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[raw] * powers[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONGEST):
        hashes[i] = xxhash.xxh64_intdigest(_lowered(raw[starts[i] : ends[i]].tobytes(), lower))
    return hashes, starts, ends


def word_hashes(
    raw: np.ndarray, offsets: np.ndarray, lower: bool = False, gaps: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of concatenated documents, by default ``[^\\x20\\x09-\\x0D]+``; ``gaps`` marks the bytes between words.

    Returns the words' hashes, starts and ends in ``raw``, and for every document
    where its words begin (one more entry than documents). ``lower`` takes A-Z
    as a-z. Segments end between words; a word longer than ``LONGEST`` bytes is
    hashed on its own.
    """
    parts, pos, n = [], 0, len(raw)
    while pos < n:
        end = min(pos + SEGMENT, n)
        if end < n:
            inner = offsets[np.searchsorted(offsets, end, side="right") - 1]
            found = np.flatnonzero(gaps[raw[pos:end]])
            cut = max(int(inner), pos + int(found[-1]) + 1 if len(found) else pos)
            if cut <= pos:  # one word fills the segment
                limit = int(offsets[np.searchsorted(offsets, pos, side="right")])
                end = pos + SEGMENT
                while end < limit and not gaps[raw[end : end + SEGMENT]].any():
                    end += SEGMENT
                end = min(end, limit)
                if end < limit:
                    end = min(limit, end + int(np.flatnonzero(gaps[raw[end : end + SEGMENT]])[0]))
                name = xxhash.xxh64_intdigest(_lowered(raw[pos:end].tobytes(), lower))
                parts.append((np.array([name], np.uint64), np.array([pos]), np.array([end])))
                pos = end
                continue
            end = cut
        lo, hi = np.searchsorted(offsets, [pos, end])
        at = np.unique(offsets[lo:hi] - pos)
        hashes, starts, ends = _segment(raw[pos:end], at, lower, gaps)
        parts.append((hashes, starts + pos, ends + pos))
        pos = end
    if not parts:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of ``length`` consecutive words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = words[:n].copy()
    for k in range(1, length):
        acc *= _STEP
        acc += words[k : k + n]
    return mix(acc)
