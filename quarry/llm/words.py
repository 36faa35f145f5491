"""Words and word shingles of Arrow text columns, as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The word boundary of every operator here: space and the controls 9 to 13.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are worked on at once, but for a longer text.
AT_ONCE = 1 << 21
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows in them) of a string column without nulls."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length) of each word, and for each row the number of words before it, with the total at the end."""
    inside = ~SPACES[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a row's end is a word's end
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    begins = np.flatnonzero(begin)
    return begins, np.flatnonzero(end) + 1 - begins, np.searchsorted(begins, offsets)


def hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes eight at a time."""
    filled = np.zeros(len(data) + 8, np.uint8)
    filled[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", buffer=filled, strides=(1,))
    out = mix((length.astype(np.uint64) + _M1) * _M1)
    rows, k = None, 0
    while k == 0 or len(rows):
        at, n, h = (begin, length, out) if rows is None else (begin[rows], length[rows], out[rows])
        h = mix((h ^ (eights[at + k] & _MASK[np.minimum(n - k, 8)])) * _M1 + _M2)
        if rows is None:
            out = h
        else:
            out[rows] = h
        k += 8
        rows = np.flatnonzero(length > k) if rows is None else rows[n > k]
    return out


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each row; fewer words than `size` make one shingle, none make none."""
    data, offsets = raw(column)
    if len(data) > AT_ONCE and len(column) > 1:  # what is made on the way is many times the text
        half = min(max(1, int(np.searchsorted(offsets, len(data) // 2))), len(column) - 1)
        return shingle_sets(column.slice(0, half), size) + shingle_sets(column.slice(half), size)
    data = LOWER[data]
    begin, length, first = split(data, offsets)
    if not len(begin):
        return [np.zeros(0, np.uint64)] * len(column)
    h = hashes(data, begin, length)
    factors = [mix(np.uint64([k + 1]) * _M1)[0] | np.uint64(1) for k in range(size)]
    n = len(h) - size + 1
    full = np.zeros(0, np.uint64)
    if n > 0:
        full = h[:n] * factors[0]
        for k in range(1, size):
            full += h[k : k + n] * factors[k]
        full = mix(full)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= size:
            s = np.sort(full[a : z - size + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif z > a:
            out.append(mix(np.array([(h[a:z] * np.array(factors[: z - a])).sum() + np.uint64(z - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
