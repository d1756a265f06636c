"""Views of Arrow string columns as UTF-8 byte arrays, and vectorised word hashes.

A record batch keeps the strings of a column in one buffer.  The operators work
on that buffer with numpy, so no Python string is made for a word or a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; keeps the arrays below inside the cache.
CHUNK = 1 << 20
#: Longest tables of powers that a worker keeps.
KEPT = 1 << 21

_U = np.uint64


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


#: Fixed random word for each byte value, and a base that is odd, so it has an inverse modulo 2**64.
BYTE = _odd(11, 256)
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n-1; tables for very long texts aren't kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    m = n if n > KEPT else 1 << (n - 1).bit_length()
    made = []
    for b in (BASE, _INVERSE):
        a = np.full(m, b, _U)
        a[0] = 1
        made.append(np.multiply.accumulate(a))
    if m <= KEPT:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit hashes (a bijection)."""
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and their n + 1 offsets; null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text; a longer text is alone in its slice."""
    column = batch.column(batch.schema.get_field_index(text))
    _, at = view(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def runs(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first-run indexes per text (n + 1) of maximal runs of bytes for which ``inside`` is true."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    good = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start, end = good.copy(), good.copy()
    start[1:] &= ~good[:-1] | edge[1:n]
    end[:-1] &= ~good[1:] | edge[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, at)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+``, as ``runs`` gives them."""
    return runs(data, at, ~SPACE)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e] with A-Z lower-cased."""
    if not len(s):
        return np.zeros(0, _U)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE[LOWER[data]] * up[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))


class HashIndex:
    """Places of 64-bit hashes in a sorted array of different hashes, by their top bits."""

    def __init__(self, names: np.ndarray) -> None:
        bits = min(20, max(8, len(names).bit_length() + 3))  # a few times as many as names, and small enough for the cache
        self.names, self.shift = names, _U(64 - bits)
        self.first = np.searchsorted(names, np.arange(1 << bits, dtype=_U) << self.shift).astype(np.int32)
        self.most = int(np.bincount((names >> self.shift).astype(np.int64)).max()) if len(names) else 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        for k in range(self.most):
            i = np.minimum(at + k, len(self.names) - 1)
            np.copyto(out, i, where=self.names[i] == hashes)
        return out
