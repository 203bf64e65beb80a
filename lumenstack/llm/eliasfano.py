"""Elias-Fano coded monotone sequences over numpy arrays, which may be memory maps.

n values below u take about 2 + log2(u / n) bits each: the low bits are packed, the high parts stand in unary
in a bit vector with a count of ones before each of its words. Look-ups take arrays of queries.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low `bits` bits of each value, one after another in 64-bit words, with a spare word."""
    if not bits or not len(values):
        return np.zeros(2, U64)
    parts, step = [], 1 << 14  # 64 values fill `bits` words, so slices end at words
    for i in range(0, len(values), step):
        each = np.unpackbits(np.ascontiguousarray(values[i : i + step]).view(np.uint8).reshape(-1, 8), axis=1, count=bits, bitorder="little")
        parts.append(np.packbits(each.ravel(), bitorder="little").tobytes())
    data = b"".join(parts)
    return np.frombuffer(data + bytes(8 + -len(data) % 8), U64)


def unpack(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), U64)
    place = at.astype(U64) * U64(bits)
    word, shift = (place >> U64(6)).astype(np.int64), place & U64(63)
    over = words[word + 1] << (U64(63) - shift) << U64(1)
    return (words[word] >> shift | over) & U64((1 << bits) - 1)


def select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number rank (from 0) of each word."""
    words, rank, place = words.copy(), rank.astype(np.int64), np.zeros(len(words), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(words & U64((1 << half) - 1)).astype(np.int64)
        up = rank >= below
        rank, place = np.where(up, rank - below, rank), place + np.where(up, half, 0)
        words = np.where(up, words >> U64(half), words)
    return place


class EliasFano:
    """parts: header (n, low bits), low words, high words, ones before each high word."""

    def __init__(self, parts: tuple[np.ndarray, ...]):
        self.header, self.low, self.high, self.ones = parts
        self.n, self.bits = int(self.header[0]), int(self.header[1])

    @staticmethod
    def parts_of(values: np.ndarray) -> tuple[np.ndarray, ...]:
        """values: ascending (repeats allowed) unsigned numbers below 2^63."""
        values, n = values.astype(U64), len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        high = (values >> U64(bits)).astype(np.int64)
        ones = np.zeros((int(high[-1]) if n else 0) + n + 2, np.uint8)
        ones[high + np.arange(n)] = 1
        data = np.packbits(ones, bitorder="little").tobytes()
        words = np.frombuffer(data + bytes(-len(data) % 8), U64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(U64)
        return np.array([n, bits], U64), pack(values & U64((1 << bits) - 1), bits), words, before

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values number `at`."""
        at = at.astype(np.int64)
        word = np.searchsorted(self.ones, at.astype(U64), side="right") - 1
        place = select_in_word(self.high[word], at - self.ones[word].astype(np.int64)) + 64 * word
        return (place - at).astype(U64) << U64(self.bits) | unpack(self.low, self.bits, at)

    def bucket_start(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part below `high`: ones before the zero number high - 1."""
        if not hasattr(self, "zeros"):
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones.astype(np.int64)
        zero = high - 1
        total = int(self.zeros[-1])
        out = np.where(high <= 0, 0, self.n)
        inside = np.flatnonzero((high > 0) & (zero < total))
        word = np.searchsorted(self.zeros, zero[inside], side="right") - 1
        place = select_in_word(~self.high[word], zero[inside] - self.zeros[word]) + 64 * word
        out[inside] = place + 1 - high[inside]
        return np.minimum(out, self.n)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Number of the first value that is not less than each of `values`; n if there is none."""
        values = values.astype(U64)
        high, low = (values >> U64(self.bits)).astype(np.int64), values & U64((1 << self.bits) - 1)
        a, b = self.bucket_start(high), self.bucket_start(high + 1)
        while len(open_ := np.flatnonzero(a < b)):
            middle = (a[open_] + b[open_]) >> 1
            less = unpack(self.low, self.bits, middle) < low[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
        return a
