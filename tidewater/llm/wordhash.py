"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than the ASCII blanks 0x20 and 0x09-0x0D.
UTF-8 never uses those bytes inside a longer character, so all of this works on
the column's raw bytes, without building Python strings.  Whole texts are read;
a column is walked in blocks of about ``BLOCK`` bytes (a longer text is a block
of its own), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = np.asarray(x, U).copy()
    x += U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_WEIGHT = mix(np.arange(4096)) | U(1)


def _weights(n: int) -> np.ndarray:
    return _WEIGHT if n <= len(_WEIGHT) else mix(np.arange(n)) | U(1)


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive blocks;
    a null text is an empty one."""
    if pa.types.is_large_string(texts.type) or not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, where, data = texts.buffers()
    at = np.frombuffer(where, np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, start byte, length in bytes) of every word of a block, and
    the index of each text's first word (one more entry than texts)."""
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = at[:-1][at[:-1] < len(data)]
    first[cut] = solid[cut]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, U), start, start, np.zeros(len(at), np.int64)
    of = np.cumsum(first)[solid] - 1
    length = np.bincount(of, minlength=len(start))
    body = (_LOWER[data] if lower else data)[solid].astype(U) + U(1)
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    body *= _weights(int(length.max()))[np.arange(len(of)) - begin[of]]
    h = np.add.reduceat(body, begin) + mix(length) * U(3)
    return mix(h), start, length, np.searchsorted(start, at)


_STEP = mix(np.arange(1000, 1064)) | U(1)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Per text: the sorted distinct 64-bit hashes of its shingles of ``width``
    lower-cased words; fewer words make one shingle, no word an empty set."""
    for _, _, data, at in blocks(texts):
        h, _, _, w = words(data, at)
        n = len(h) - width + 1
        full = np.zeros(max(n, 0), U)
        for k in range(width):
            full += h[k:k + max(n, 0)] * _STEP[k]
        full = mix(full)
        for a, b in zip(w[:-1], w[1:]):
            if b - a >= width:
                yield np.unique(full[a:b - width + 1])
            elif b > a:
                yield mix((h[a:b] * _STEP[:b - a]).sum(dtype=U, keepdims=True) + _STEP[width + b - a])
            else:
                yield np.zeros(0, U)
