"""Words and hashed word n-grams of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19  # bytes of text worked on at once: a task takes many times as much memory; a longer text is worked on alone
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def slices(col: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) for runs of rows with at most `most` bytes; null counts as empty."""
    col = col.cast(pa.large_string()).fill_null("") if col.null_count or not pa.types.is_large_string(col.type) else col
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words (runs of bytes other than space and \\t to \\r) of a slice: `hash` of each, `first[i]:first[i+1]` are those of row i."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        rows = len(off) - 1
        n = len(data) + rows
        b = np.full(n, 32, np.uint8)  # with a space after each row, so no word spans two
        b[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(off))] = data
        inside = ~SPACE[b]
        edge = np.flatnonzero(np.diff(inside, prepend=False))  # starts and ends alternate, as each row ends in a space
        start, end = edge[::2], edge[1::2]
        self.bytes, self.inside, self.row_start = b, inside, off[:-1] + np.arange(rows)
        self.row_end = off[1:] + np.arange(rows)
        self.first = np.concatenate([np.searchsorted(start, self.row_start), [len(start)]])
        length = end - start
        if len(start):
            at = np.flatnonzero(inside)
            pos = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
            weight = mix(np.arange(1, int(length.max()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            self.hash = mix(np.add.reduceat((b[at].astype(np.uint64) + np.uint64(1)) * weight[pos], np.cumsum(length) - length) + length.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sums of a value per byte over each row."""
        c = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return c[self.row_end] - c[self.row_start]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one row."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = self.hash[: n - k + 1].copy()
        for i in range(1, k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + self.hash[i : n - k + 1 + i])
        row = self.rows()
        return h, row[: n - k + 1] == row[k - 1 :]

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
