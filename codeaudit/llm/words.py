"""Words, lines and shingles of a batch of texts as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is
`[^\\x20\\x09-\\x0D]+` over code points. Hashes are 64-bit: a polynomial over the bytes,
read off prefix sums for any span, then mixed. No Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  # texts are worked on in chunks of about this size; a longer text is a chunk of its own

_U = np.uint64
BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of the first n of eight bytes
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _power, _inverse
    if len(_power) < n:
        n = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1))
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, out=p))
        _power, _inverse = both
    return _power, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Hasher:
    """Hashes of any spans of one byte buffer, or of an array of 64-bit values."""

    def __init__(self, buf: np.ndarray):
        power, self._inverse = _powers(len(buf) + 1)
        self._prefix = np.zeros(len(buf) + 1, np.uint64)
        values = _BYTES[buf] if buf.dtype == np.uint8 else buf
        np.cumsum(values * power[: len(buf)], out=self._prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._prefix[ends] - self._prefix[starts]) * self._inverse[starts])


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes that do not overlap: their length, then eight bytes at a time."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray(len(buf) + 1, np.uint64, padded, strides=(1,))  # the eight bytes from each place on
    left = ends - starts
    out = mix(left.astype(np.uint64) * _U(BASE))
    some, at = slice(None), starts
    while len(left):
        out[some] = mix(out[some] ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        more = left > 8
        some = np.flatnonzero(more) if isinstance(some, slice) else some[more]
        at, left = at[more] + 8, left[more] - 8
    return out


@dataclass
class Chunk:
    """Rows lo..hi of a batch; text r is buf[offsets[r]:offsets[r + 1]]."""

    lo: int
    hi: int
    buf: np.ndarray
    offsets: np.ndarray

    def spans(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all runs of bytes that are not `space`, in order."""
        # Compared, not looked up, for the usual set.
        word = (self.buf != 32) & (self.buf - np.uint8(9) > 4) if space is SPACE else ~space[self.buf]
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(word))]
        start[cut] = word[cut]
        end[cut - 1] = word[cut - 1]
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    def per_row(self, starts: np.ndarray) -> np.ndarray:
        """For ordered positions: their index range of row r is result[r]:result[r + 1]."""
        return np.searchsorted(starts, self.offsets)


def texts(batch: pa.RecordBatch | pa.Table, name: str = "text") -> Iterator[Chunk]:
    """The chunks of a string column; null is the empty text."""
    column = batch.column(name)
    for col in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        wide = pa.types.is_large_string(col.type)
        _, off, data = col.buffers()
        n = len(col)
        offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1
            hi = min(max(hi, lo + 1), n)
            yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Order-keeping hashes of every k consecutive values."""
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * _U(BASE) + h[i : i + n])
    return out


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per row of `counts`, filled from `values` in order."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
