"""Vectorised text kernels shared by the operators that run numpy inside tasks.

A batch of texts is one ``uint8`` buffer of UTF-8 plus document offsets, so
words, lines and windows of all documents are found with a handful of array
passes.  Nulls are empty texts.  Batches are cut to a bounded number of bytes
(one longer text makes one longer batch), so a task's memory does not depend on
how many rows its partition has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 4 << 20  # bytes of text handled at once
LESS = 1 << 20  # the same where some dozens of 8-byte arrays of the text's length are held
_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _mix
BYTE_CODE = _mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
NOT_BLANK = ~BLANK
ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and all beyond ASCII
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


class _Powers:
    """Powers of the multiplier and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
            self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _MULT)]))
            self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class SpanHash:
    """64-bit polynomial hashes of any span ``[start, end)`` of a code sequence."""

    def __init__(self, codes: np.ndarray) -> None:
        up, self.down = _POWERS.get(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return _mix(raw + (end - start).astype(np.uint64) * _MULT)


class Texts:
    """Texts of one batch: ``data`` (bytes) and ``offs`` (n + 1 offsets)."""

    def __init__(self, column: pa.Array) -> None:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        _, offs, data = column.buffers()
        at = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offs = at - at[0]
        self.n = n

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[self.offs])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of marked bytes that do not cross texts: starts, ends and offsets of each text's runs."""
        n = len(inside)
        edges = self.offs[1:-1]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[edges[edges < n]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offs)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``\\n``-split lines of all texts (an empty text has one empty line): starts, ends, text of each."""
        cut = np.flatnonzero(self.data == 10)
        of_cut = np.searchsorted(self.offs, cut, side="right") - 1
        starts = np.concatenate([self.offs[:-1], cut + 1])
        ends = np.concatenate([cut, self.offs[1:]])
        of_start = np.concatenate([np.arange(self.n), of_cut])
        of_end = np.concatenate([of_cut, np.arange(self.n)])
        by_start, by_end = np.lexsort((starts, of_start)), np.lexsort((ends, of_end))
        return starts[by_start], ends[by_end], of_start[by_start]


def owner(pointer: np.ndarray) -> np.ndarray:
    """For each item, the text that owns it, from the texts' item offsets."""
    return np.repeat(np.arange(len(pointer) - 1), np.diff(pointer))


def repeated(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items whose value occurs again in their group, and those that follow an equal one."""
    key = _mix(value ^ _mix(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:][same]] = True
    later[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in at least one ``[start, start + length)``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def chunked(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(size), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
