"""Whole Arrow text columns as byte arrays: word bounds, word hashes and rolling window hashes, all in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from turfline.llm import by_value

by_value(__name__)

#: Bytes of text worked on at once inside a task; one longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Bases of the two window polynomials (odd, so that they have an inverse modulo 2**64).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), at


def chunk_rows(lengths: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes (or one longer row)."""
    ends = np.cumsum(lengths)
    row = 0
    while row < len(lengths):
        before = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield row, stop
        row = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text) of the words ``[^\\x20\\x09-\\x0D]+``; no word spans two texts."""
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: int = 1):
    """A 64-bit multilinear hash of every (not empty) word: each byte times a key of its place in the word; or several."""
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    most = int(lengths.max(initial=0))
    place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    values = data[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    out = []
    for base in BASES[:hashes]:
        keys = mixed(np.arange(1, most + 1, dtype=np.uint64) * np.uint64(base)) | np.uint64(1)
        sums = np.add.reduceat(values * keys[place], begin) if len(begin) else np.zeros(0, np.uint64)
        out.append(mixed(sums + lengths.astype(np.uint64)))
    return out[0] if hashes == 1 else out


class Windows:
    """Hashes of windows of consecutive words by prefix sums: any window costs one subtraction and one product."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        inverse = pow(base, -1, 1 << 64)
        powers = np.full(n + 1, np.uint64(base), np.uint64)
        self.back = np.full(n + 1, np.uint64(inverse), np.uint64)
        powers[0] = self.back[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers[:n], out=self.sums[1:])

    def of(self, at: np.ndarray, width: int) -> np.ndarray:
        return mixed((self.sums[at + width] - self.sums[at]) * self.back[at])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``start, start + 1, ...`` with ``count`` values for every pair."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - np.asarray(starts, dtype=np.int64), counts)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
