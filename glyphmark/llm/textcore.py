"""Word tokenising and hashing of whole Arrow text columns with numpy.

Texts stay UTF-8 bytes: the separators of both word classes are ASCII, so bytes
split exactly as code points do.  Word hashes are 64 bits, position independent
and the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: Separators of `[^\x20\x09-\x0D]+`, and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
SPACE, ALNUM = _SPACE, _ALNUM

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, CHUNK_BYTES)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(m, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if m > 4 * CHUNK_BYTES:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return _FOLD[data]


class Chunk:
    """Rows lo..hi of a batch: their bytes, and where each row begins."""

    __slots__ = ("lo", "hi", "data", "bounds", "starts", "ends", "first")

    def __init__(self, lo: int, hi: int, data: np.ndarray, bounds: np.ndarray):
        self.lo, self.hi, self.data, self.bounds = lo, hi, data, bounds

    def split(self, separators: np.ndarray) -> Chunk:
        """Finds words; those of row r are first[r]..first[r + 1]."""
        n = len(self.data)
        inside = np.zeros(n + 1, bool)
        np.logical_not(separators[self.data], out=inside[:n])
        cut = np.zeros(n + 1, bool)
        cut[self.bounds] = True
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | cut))
        self.ends = np.flatnonzero(before & (~inside | cut))
        self.first = np.searchsorted(self.starts, self.bounds)
        return self

    def hashes(self) -> np.ndarray:
        powers, inverse = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * powers[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def chunks(column: pa.Array, lower: bool, separators: np.ndarray):
    """The column in pieces of about CHUNK_BYTES, whole rows each; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(hi, n)
        piece = data[offsets[lo] : offsets[hi]]
        yield Chunk(lo, hi, fold(piece) if lower else piece, offsets[lo : hi + 1] - offsets[lo]).split(separators)
        lo = hi


def windows(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive words; fewer words give none."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(odd_numbers(width, seed)):
        out += h[j : j + n] * c
    return mix(out)
