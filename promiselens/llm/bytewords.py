"""Words of many texts at once: UTF-8 bytes of a whole Arrow column to one 64-bit hash per word, with numpy.

A word's hash is a polynomial of its bytes (each mapped to a random 64-bit value) modulo 2**64, taken from running
sums, and mixed. Nothing here knows about Spark; operators call it on the batches of ``mapInArrow``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RANDOM = np.random.default_rng(20240229)
_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20  # texts are worked on in groups of about this size; a longer text is a group of its own

ASCII_FOLD = np.arange(256, dtype=np.uint8)
ASCII_FOLD[65:91] += 32
NO_FOLD = np.arange(256, dtype=np.uint8)
NOT_WHITE = np.ones(256, dtype=bool)
NOT_WHITE[[0x20, 9, 10, 11, 12, 13]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown on demand, but for very long texts."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


def running_sums(data: np.ndarray) -> np.ndarray:
    """Entry i is the polynomial of the first i bytes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range [start, end), the same wherever the range lies."""
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start])


def word_ranges(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word and the number of words of every text; words never cross texts."""
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = inside[last]
    counts = np.diff(np.searchsorted(start, offsets))
    return start, np.flatnonzero(ends) + 1, counts


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text)."""
    folded = fold[data]
    start, end, counts = word_ranges(folded, offsets, is_word)
    return range_hash(running_sums(folded), start, end), counts
