"""Vectorised text primitives over the byte buffers of an Arrow column.

A batch of texts is one byte array with offsets; words, spans and hashes are
found for all texts of a slice at once, without a Python loop over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once, except that one text is never cut.
SLICE = 2_000_000
MOST_ROWS = 8192

_RANDOM = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of slices of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = min(max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE, "right")) - 1), at + MOST_ROWS, n)
        yield at, to - at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def word_table(kept: str, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, hash value) by byte; bytes from 128 up belong to words."""
    word = np.zeros(256, bool)
    word[[ord(c) for c in kept]] = True
    word[128:] = True
    value = _RANDOM.copy()
    if lower:
        value[65:91] = value[97:123]
        word[65:91] = word[97:123]
    return word, value


ALNUM = word_table("abcdefghijklmnopqrstuvwxyz0123456789")


def words(data: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of the maximal runs of word bytes; runs end with their text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = word[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[(offs[1:] - 1)[offs[1:] > 0]] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def prefix_sums(data: np.ndarray, value: np.ndarray) -> np.ndarray:
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * _power(_BASE, len(data)), out=s[1:])
    return s


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes hash alike wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    return mix((sums[end] - sums[start]) * _power(_INVERSE, int(start.max()) + 1)[start] + (end - start).astype(np.uint64))
