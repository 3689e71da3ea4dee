"""Words of a whole Arrow batch at once: places, rows and 64-bit hashes, as NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from .common import ASCII_LOWER, _powers

_LOWER = np.frombuffer(ASCII_LOWER, dtype=np.uint8)
#: Bytes that are hashed together.
HASHED = 1 << 17
#: Space, and tab to carriage return.
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

_UP, _DOWN = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a run and the word or run after it."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def offsets_of(texts: pa.Array) -> np.ndarray:
    """Where each text of a string or binary array starts and, last, where the last one ends."""
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def gathered(batches, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in batches with `most` bytes in a column at least, but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, the place among them of each): as np.unique, but only the distinct ones are sorted."""
    inverse, found = pd.factorize(x, sort=True)
    return found, inverse


def chunks(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with about `most` bytes of text each; a longer text is a slice of its own."""
    if len(texts) == 0:
        return
    offsets = offsets_of(texts)
    ends = offsets[1:] - offsets[0]
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


class Words:
    """The words of texts with A-Z in lower case, split at ASCII blanks.

    raw     the texts' bytes, one after the other
    starts, ends, row    where each word starts and ends in raw, and the row of its text
    """

    def __init__(self, texts: pa.Array):
        offsets = offsets_of(texts) if len(texts) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.codes = _LOWER[data]
        n = len(data)
        inside = np.zeros(n + 1, dtype=bool)
        np.logical_not(BLANK[data], out=inside[:n])
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        self.starts = np.nonzero(inside & (~before | cut))[0]
        self.ends = np.nonzero(before & (~inside | cut))[0]
        self.row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.starts, offsets)))
        self.rows = len(texts)

    def raw(self) -> bytes:
        return self.codes.tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: equal words have equal ones, others as good as never."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        # Sums of so few bytes at a time stay in a core's cache, as do the powers, which are the same each time.
        while at < len(out):
            base = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, base + HASHED, side="right")))
            starts, ends = self.starts[at:to] - base, self.ends[at:to] - base
            n = int(ends[-1])
            up, down = _grown(n)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.multiply(self.codes[base : base + n], up[:n], out=sums[1:])
            sums[1:] += up[:n]
            np.cumsum(sums, out=sums)
            out[at:to] = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
            at = to
        return out


_tables: list[np.ndarray] = []


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse, n + 1 at least."""
    if not _tables or len(_tables[0]) <= n:
        _tables[:] = [_powers(_UP, max(1 << 16, n + 1)), _powers(_DOWN, max(1 << 16, n + 1))]
    return _tables
