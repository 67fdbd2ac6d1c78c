"""Sets of word shingles as sorted arrays of 64-bit hashes, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .batches import byte_slices

WORDS = 5
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256)], np.uint8)
#: Powers of an odd number, by a byte's place in its word; longer words start again with a mixed value.
_POWERS = np.cumprod(np.full(4096, 0xC2B2AE3D27D4EB4F, np.uint64), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def _word_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and each row's first word among them."""
    low = _LOWER[data]
    ink = low != 32
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    at_row = rows[:-1][rows[:-1] < len(data)]
    start[at_row] = ink[at_row]
    place = np.flatnonzero(ink)
    begin = np.flatnonzero(start)
    first_word = np.searchsorted(begin, rows)
    if not len(begin):
        return np.zeros(0, np.uint64), first_word
    word_at = np.searchsorted(place, begin)
    length = np.diff(np.append(word_at, len(place)))
    index = np.arange(len(place)) - np.repeat(word_at, length)
    value = (low[place].astype(np.uint64) + np.uint64(1)) * _POWERS[index % len(_POWERS)] + _M1 * (index // len(_POWERS)).astype(np.uint64)
    return _mix(np.add.reduceat(value, word_at) + length.astype(np.uint64) * _M1), first_word


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text (null: empty) its distinct shingles, sorted (uint64).

    Words are what stands between ASCII white space, with A-Z lower-cased. A
    text with fewer words than a shingle has is one shingle; one without words
    has none.
    """
    for first, end, data, rows in byte_slices(texts):
        h, at = _word_hashes(data, rows)
        s = h[: max(0, len(h) - words + 1)]
        for j in range(1, words):
            s = s * _M1 + h[j : len(h) - words + 1 + j]
            s = s ^ (s >> np.uint64(29))
        s = _mix(s * _M1)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= words:
                yield np.unique(s[a : b - words + 1])
            elif b > a:
                short = np.uint64(b - a)
                for x in h[a:b]:
                    short = np.uint64((int(short) * int(_M2) + int(x)) % (1 << 64))
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
