"""Vectorised text kernels over Arrow string columns.

A batch of texts is one byte buffer with document offsets; words, n-grams and
lines are index arrays into it, so that no Python object is made per word.
A range is hashed as the sum of its values, each times a random odd number that
belongs to its place in the range, modulo 2**64, finished by a bijective mixer.
(A polynomial would take structured words of 1,024 letters for one.)  N-grams, of
at most a few dozen words, are polynomials of words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_WORD_MUL = 0xD1342543DE82EF95
SLICE_BYTES = 1 << 20

_BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)

#: Bytes that separate words `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that separate words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_PLACES = mix(np.arange(1 << 16).astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x6A09E667F3BCC908)) | U64(1)


def _places(n: int) -> np.ndarray:
    """A random odd number for each place."""
    if n <= len(_PLACES):
        return _PLACES
    return mix(np.arange(n).astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x6A09E667F3BCC908)) | U64(1)


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for ascending ranges that don't overlap, independent of where a range stands."""
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    done = np.cumsum(size)
    place = np.arange(int(done[-1])) - np.repeat(done - size, size)
    gaps = int(starts[0]) != 0 or int(done[-1]) != int(ends[-1])
    inner = values[place + np.repeat(starts, size)] if gaps else values[: int(ends[-1])]
    total = np.zeros(len(inner) + 1, U64)
    np.cumsum(inner * _places(int(size.max()))[place], out=total[1:])
    return mix(total[done] - total[done - size] + size.astype(U64) * U64(0x9E3779B97F4A7C15))


def byte_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range; ranges as for `range_hash`."""
    return range_hash(_BYTE_CODE[data], starts, ends)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring values; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, U64)
    done, out, size, power = 0, None, 1, h
    while True:
        if n & size:
            if out is None:
                out = power
            else:
                m = len(h) - done - size + 1
                out = out[:m] * U64(pow(_WORD_MUL, size, 1 << 64)) + power[done : done + m]
            done += size
        size *= 2
        if size > n:
            return mix(out)
        m = len(h) - size + 1
        power = power[:m] * U64(pow(_WORD_MUL, size // 2, 1 << 64)) + power[size // 2 : size // 2 + m]


@dataclass
class Words:
    """Words of some texts: byte ranges, and the range of words of each text."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first[d] : first[d + 1] are the words of text d

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text)

    def whole(self, n: int) -> np.ndarray:
        """Whether the n-gram at each position lies in one text."""
        d = self.text_of()
        return d[: len(d) - n + 1] == d[n - 1 :] if len(d) >= n else np.zeros(0, bool)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of whole rows with at most about ``limit`` bytes of text each; a longer text stands alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
    # workers live on between tasks: what Arrow's pool keeps for later goes back
    pa.default_memory_pool().release_unused()


def find_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> Words:
    """The maximal runs of bytes that aren't separators, none across two texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the ranges that begin at ``at``, one after the other."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(at - (ends - size), size) + np.arange(total)


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``length`` words that starts at one of ``starts``."""
    edge = np.zeros(n + length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:n] > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's words."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return np.ascontiguousarray(x, U64).view(np.int64)
