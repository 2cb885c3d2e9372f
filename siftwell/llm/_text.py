"""Vectorised tokenising and hashing of Arrow string columns with numpy.

All functions work on UTF-8 bytes. Documents are taken in slices of a few MB, so
memory depends on the longest single document, never on the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IDENTITY = np.arange(256, dtype=np.uint8)

#: Words between ASCII white space.
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words of digits, a-z and everything beyond ASCII, after lower-casing A-Z.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True
#: Words with their case, and runs of other marks, as tokens of two classes.
WORD_OR_MARK = np.full(256, 2, np.uint8)
WORD_OR_MARK[0x30:0x3A] = WORD_OR_MARK[0x41:0x5B] = WORD_OR_MARK[0x61:0x7B] = 1
WORD_OR_MARK[0x80:] = 1
WORD_OR_MARK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, _MULT, _U)]))


_POW = _powers(256)


class Words(NamedTuple):
    """Byte ranges of words in `data` (after case folding) and the row that each stands in."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    rows: int


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1) of a string or binary array; null is empty."""
    kind = column.type
    if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about `most` bytes, at least one row each."""
    data, offsets = utf8(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray = LOWER) -> Words:
    """Maximal runs of bytes of one class above 0 in the table `inside`; no run crosses two rows."""
    data = fold[data]
    n = len(data)
    kind = inside.view(np.uint8)[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    change = np.ones(n + 1, dtype=bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= cut
    start = np.flatnonzero((kind > 0) & change[:n])
    end = np.flatnonzero((kind > 0) & change[1:]) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, start, end, row, len(offsets) - 1)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal in every process."""
    global _POW
    if not len(w.start):
        return np.zeros(0, _U)
    length = w.end - w.start
    if length.max() > len(_POW):
        _POW = _powers(int(length.max()) * 2)
    stop = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(stop[-1]) - np.repeat(stop[:-1], length)
    at = place + np.repeat(w.start, length)
    with np.errstate(over="ignore"):
        terms = (w.data[at].astype(_U) + _U(1)) * _POW[place]
        return mix(np.add.reduceat(terms, stop[:-1]) + length.astype(_U))


def hash_word(word: str) -> int:
    """word_hashes of one word that is already folded."""
    raw = np.frombuffer(word.encode(), np.uint8)
    one = np.array([0])
    return int(word_hashes(Words(raw, one, one + len(raw), one, 1))[0])


def shingle_hashes(h: np.ndarray, row: np.ndarray, k: int, rows: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in each row, and their rows. With `whole`, a row with n < k words has one shingle, all its words, hashed as an n-word one."""
    n = len(h)
    with np.errstate(over="ignore"):
        full = n - k + 1
        if full > 0:
            out = h[:full].copy()
            for i in range(1, k):
                out = out * _U(_MULT) + h[i : i + full]
            keep = row[:full] == row[k - 1 :]
            out, at = mix(out[keep] + _U(k)), row[:full][keep]
        else:
            out, at = np.zeros(0, _U), np.zeros(0, row.dtype)
        count = np.bincount(row, minlength=rows)
        short = np.flatnonzero((count > 0) & (count < k))
        if whole and len(short):
            first = np.searchsorted(row, short)
            more = h[first].copy()
            for i in range(1, k - 1):
                has = count[short] > i
                more[has] = more[has] * _U(_MULT) + h[first[has] + i]
            out = np.concatenate([out, mix(more + count[short].astype(_U))])
            at = np.concatenate([at, short])
    return out, at


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted table, which of h are there)."""
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h
