"""Monotone sequences after Elias and Fano, as NumPy arrays that may be memory-mapped, with whole arrays of queries at once.

A sequence of n values below u takes about 2 + log2(u / n) bits a value: the low bits of each value are packed, the high
ones stand in unary in one bit vector. Every fourth one (for access) or zero (for the successor search) has its place
noted, so a query reads a 64-bit window and seldom a second one.
"""

from __future__ import annotations

import json

import numpy as np

_ONE = np.uint64(1)


def _u(x) -> np.ndarray:
    return np.asarray(x).astype(np.uint64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits each, one after the other in 64-bit words."""
    out = np.zeros(len(values) * width // 64 + 3, dtype=np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, _u(at & 63)
        np.bitwise_or.at(out, word, values << shift)
        np.bitwise_or.at(out, word + 1, (values >> (np.uint64(63) - shift)) >> _ONE)
    return out


def window(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64 bits from each place on."""
    word, shift = at >> 6, _u(at & 63)
    return (words[word] >> shift) | ((words[word + 1] << (np.uint64(63) - shift)) << _ONE)


def unpack(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(at), dtype=np.uint64)
    return window(words, at * width) & np.uint64((1 << width) - 1)


def _trailing(w: np.ndarray) -> np.ndarray:
    return np.bitwise_count((w & (~w + _ONE)) - _ONE).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of numbers below 2^63."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.low_bits = (int(x) for x in parts["head"])
        self.low, self.high = parts["low"], parts["high"]
        self.ones, self.zeros = parts.get("ones"), parts.get("zeros")
        self.before = parts["before"].astype(np.int64)
        self.zeros_before = np.arange(len(self.before)) * 512 - self.before

    @staticmethod
    def build(values: np.ndarray, access: bool = True, find: bool = True) -> dict[str, np.ndarray]:
        values, n = _u(values), len(values)
        last = int(values[-1]) if n else 0
        width = max(0, (last // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(width)).astype(np.int64)
        at = high + np.arange(n)
        bits = np.zeros((n + (last >> width) + 2 + 63) // 64 * 64 + 192, dtype=np.uint8)
        bits[at] = 1
        out = {"head": np.array([n, width], dtype=np.int64), "low": pack(values & np.uint64((1 << width) - 1), width), "high": np.packbits(bits, bitorder="little").view(np.uint64)}
        kind = np.uint32 if len(bits) < 1 << 32 else np.int64
        counts = np.bitwise_count(out["high"]).astype(np.int64)
        counts = np.add.reduceat(counts, np.arange(0, len(counts), 8))
        out["before"] = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(kind)
        if access:
            out["ones"] = at[::4].astype(kind)
        if find:
            out["zeros"] = np.nonzero(bits == 0)[0][::4].astype(kind)
        return out

    def _select(self, rank: np.ndarray, noted: np.ndarray, turned: bool) -> np.ndarray:
        at, rest = noted[rank >> 2].astype(np.int64), rank & 3
        w = window(self.high, at)
        w = ~w if turned else w
        found = np.bitwise_count(w).astype(np.int64)
        short = np.nonzero(rest >= found)[0]
        if len(short):
            # Far from the noted place: the block of 512 bits that has it, then its words.
            before = self.zeros_before if turned else self.before
            block = np.searchsorted(before, rank[short], side="right") - 1
            at[short], rest[short] = block * 512, rank[short] - before[block]
            while len(short):
                v = self.high[at[short] >> 6]
                w[short] = ~v if turned else v
                found = np.bitwise_count(w[short]).astype(np.int64)
                more = rest[short] >= found
                short, found = short[more], found[more]
                rest[short] -= found
                at[short] += 64
        for _ in range(int(rest.max()) if len(rest) else 0):
            more = (rest > 0).astype(np.uint64)
            w &= w - more
            rest = rest - 1
        return at + _trailing(w)

    def _value(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (_u(at - i) << np.uint64(self.low_bits) | unpack(self.low, i, self.low_bits)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        return self._value(i, self._select(i, self.ones, False))

    def pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and i + 1."""
        at = self._select(i, self.ones, False)
        w = window(self.high, at + 1)
        then = at + 1 + _trailing(w)
        far = np.nonzero(w == 0)[0]
        if len(far):
            then[far] = self._select(i[far] + 1, self.ones, False)
        return self._value(i, at), self._value(i + 1, then)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first place of each value, -1 where it isn't in the sequence: its successor's place, if that is equal."""
        values = _u(values)
        out = np.full(len(values), -1, dtype=np.int64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        top = int(self.__getitem__(np.array([self.n - 1]))[0]) >> self.low_bits if self.n else -1
        live = np.nonzero(high <= top)[0]
        h = high[live]
        # Values with the same high bits stand in [first, end); their low bits are halved down to the successor's place.
        at, later = np.zeros(len(live), dtype=np.int64), h > 0
        at[later] = self._select(h[later] - 1, self.zeros, True) + 1
        w = window(self.high, at)
        first, run = at - h, _trailing(~w)
        end, long = first + run, np.nonzero(w == np.uint64(0xFFFFFFFFFFFFFFFF))[0]
        if len(long):
            end[long] = self._select(h[long], self.zeros, True) - h[long]
        want, stop = low[live], end.copy()
        open_ = np.nonzero(first < stop)[0]
        while len(open_):
            mid = (first[open_] + stop[open_]) >> 1
            less = unpack(self.low, mid, self.low_bits) < want[open_]
            first[open_[less]] = mid[less] + 1
            stop[open_[~less]] = mid[~less]
            open_ = open_[first[open_] < stop[open_]]
        there = np.nonzero(first < end)[0]
        hit = there[unpack(self.low, first[there], self.low_bits) == want[there]]
        out[live[hit]] = first[hit]
        return out


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays in one file: the length of a JSON directory, the directory, the arrays at multiples of 64 bytes."""
    where, at = {}, 0
    for name, x in arrays.items():
        where[name] = [at, x.dtype.str, len(x)]
        at += -(-x.nbytes // 64) * 64
    head = json.dumps(where).encode()
    head += b" " * (-(len(head) + 8) % 64)
    body = bytearray(at)
    for name, x in arrays.items():
        body[where[name][0] : where[name][0] + x.nbytes] = x.tobytes()
    return len(head).to_bytes(8, "little") + head + bytes(body)


def load(data: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a file, given as (mapped) bytes; nothing is copied."""
    size = int.from_bytes(bytes(data[:8]), "little")
    return {name: data[8 + size + at :][: n * np.dtype(kind).itemsize].view(kind) for name, (at, kind, n) in json.loads(bytes(data[8 : 8 + size])).items()}


def nested(arrays: dict[str, dict[str, np.ndarray] | np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{k}.{x}" if x else k: v for k, part in arrays.items() for x, v in (part.items() if isinstance(part, dict) else [("", part)])}


def part(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano({k.removeprefix(f"{name}."): v for k, v in arrays.items() if k.startswith(f"{name}.")})
