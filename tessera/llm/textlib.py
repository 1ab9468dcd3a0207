"""Vectorised word and n-gram hashing over Arrow string columns.

Texts are read straight from Arrow's buffers, so no Python string is made for a
word.  Work goes in slices of about a quarter of a megabyte: memory, some fifty bytes
a byte, is bounded by the slice, or by one document where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
U64 = np.uint64

#: Bytes that separate words: tab, line feed, vertical tab, form feed, carriage return, space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Lower-cases A-Z and leaves all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits, so that every output bit depends on every input bit."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class Lane:
    """One independent polynomial hash family modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.base = int(rng.integers(2**40, 2**60)) * 8 + 3
        self.inverse = pow(self.base, -1, 2**64)
        self.step = int(rng.integers(2**40, 2**60)) * 8 + 5
        self.up = self.down = np.ones(0, U64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, b, U64)])) for b in (self.base, self.inverse))

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte range ``buf[starts[i]:ends[i]]``."""
        n = len(buf)
        self.powers(n + 1)
        c = np.zeros(n + 1, U64)
        np.cumsum(self.table[buf] * self.up[:n], out=c[1:])
        return mix((c[ends] - c[starts]) * self.down[starts])

    def grams(self, words: np.ndarray, n: int) -> np.ndarray:
        """Hash of each run of n consecutive words; ``len(words) - n + 1`` of them."""
        size = max(0, len(words) - n + 1)
        g = words[:size].copy()
        for j in range(1, n):
            g *= U64(self.step)
            g += words[j : j + size]
        return mix(g)


#: Fixed seeds: the same text has the same hash in every task, run and batch.
LANE, CHECK = Lane(20250101), Lane(20250202)


@dataclass
class Slice:
    """Some consecutive rows of a batch. Byte offsets count from the start of ``buf``."""

    first: int
    buf: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def words(self, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and where each row's words begin (one more entry than rows)."""
        tok = ~sep[self.buf]
        if not len(tok):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self.offs), np.int64)
        before, after = np.empty_like(tok), np.empty_like(tok)
        before[1:], after[:-1] = tok[:-1], tok[1:]
        before[0] = after[-1] = False
        edge = self.offs[(self.offs > 0) & (self.offs < len(tok))]
        before[edge] = False
        after[edge - 1] = False
        starts = np.flatnonzero(tok & ~before)
        return starts, np.flatnonzero(tok & ~after) + 1, np.searchsorted(starts, self.offs)


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Rows of a string column, about ``size`` bytes at a time; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield Slice(i, whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches, some rows at a time, for work that copies all texts it gets: a batch holds up to 10,000."""
    for b in batches:
        yield from (b.slice(i, rows) for i in range(0, b.num_rows, rows))


def room(ptr: np.ndarray) -> np.ndarray:
    """For every word, the words from it to the end of its row, itself included."""
    n = np.diff(ptr)
    return np.repeat(ptr[1:], n) - np.arange(ptr[-1])


def code_points(buf: np.ndarray) -> np.ndarray:
    """True at each byte that begins a code point."""
    return (buf & 0xC0) != 0x80


def crc32_rem(column: str, n: int) -> str:
    """SQL for the fold of a row: crc32 of its id as text, modulo n."""
    return f"crc32(cast(cast({column} AS string) AS binary)) % {n}"
