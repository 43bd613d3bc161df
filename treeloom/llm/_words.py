"""Words of whole Arrow text columns as numpy arrays: no Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in blocks of about so many bytes, so that the arrays beside them stay small; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


@dataclass
class Block:
    """Words of the rows first .. first + rows - 1 of a batch."""

    first: int
    rows: int
    folded: np.ndarray  # bytes, lower-cased; 0 where no word is
    start: np.ndarray  # of each word in folded
    end: np.ndarray
    row: np.ndarray  # of each word, from 0 within the block
    hash: np.ndarray  # 64 bits of each word

    def text(self, i: int, n: int) -> str:
        """The words i .. i + n - 1, joined by one space."""
        return b" ".join(self.folded[s:e].tobytes() for s, e in zip(self.start[i : i + n], self.end[i : i + n], strict=True)).decode()

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        if chr(b).isascii() and chr(b).isalnum() or b >= 128:
            table[b] = ord(chr(b).lower()) if b < 128 else b
    return table


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        made = []
        for base in (_BASE, _BACK):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers[:] = made
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of x reaches every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of rows with about BLOCK_BYTES bytes; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(column: pa.Array) -> Iterator[Block]:
    """Words [0-9A-Za-z and all above U+007F]+ with A-Z lower-cased, of every row."""
    table = _table()
    for first, rows, data, offsets in blocks(column):
        folded = table[data]
        edge = np.zeros(len(data) + 1, bool)  # a text begins here
        edge[offsets[:-1]] = True
        inside = folded != 0
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        forth, back = _power(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * forth[: len(data)], out=sums[1:])
        value = mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
        yield Block(first, rows, folded, start, end, np.searchsorted(offsets, start, "right") - 1, value)
