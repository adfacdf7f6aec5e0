"""Monotone sequences in about 2 + log2(universe / n) bits a number, searched for many at once.

Elias-Fano: the low bits of every number side by side, the high bits in unary in a bit vector, whose
ones and zeros are found by counts kept for every 64 bits (a third bit a number). The parts are plain
arrays, so they may be views of a memory-mapped file. Many searches at once are sorted first, which
keeps what they touch close together.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

_U = np.uint64


class EliasFano:
    """``values`` must not decrease. ``parts`` are the arrays it is made of, ``over`` makes it of them."""

    def __init__(self, values: np.ndarray, universe: int | None = None):
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(universe if universe is not None else (values[-1] + _U(1) if n else 1))
        low = max(0, (universe // max(1, n)).bit_length() - 1)
        high = (values >> _U(low)).astype(np.int64)
        zeros = (universe >> low) + 2
        bits = np.zeros(-(-(n + zeros) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(
            np.int32 if len(bits) < 1 << 31 else np.int64)
        packed = np.zeros((n * low + 7) // 8 + 16, np.uint8)
        if low:
            spread = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & _U(1)).astype(np.uint8) if n < 1 << 16 else None
            if spread is not None:
                flat = np.packbits(spread.ravel(), bitorder="little")
                packed[:len(flat)] = flat
            else:  # the same, in slices whose bits end on a byte
                for k in range(0, n, 1 << 16):
                    part = values[k:k + (1 << 16)]
                    flat = np.packbits(((part[:, None] >> np.arange(low, dtype=np.uint64)) & _U(1)).astype(np.uint8).ravel(),
                                       bitorder="little")
                    packed[k * low // 8:k * low // 8 + len(flat)] = flat
        self._set({"head": np.array([n, low], np.int64), "words": words, "ones": ones, "low": packed})

    def _set(self, parts: Mapping[str, np.ndarray]) -> None:
        self.parts = dict(parts)
        self.n, self.low_bits = (int(x) for x in parts["head"])
        self.words, self.ones = parts["words"], parts["ones"]
        self.zeros = (64 * np.arange(len(self.ones)) - self.ones).astype(self.ones.dtype)
        low = parts["low"]
        self.low = np.ndarray((len(low) - 7,), "<u8", low.data, strides=(1,))
        self.mask = _U((1 << self.low_bits) - 1)

    @classmethod
    def over(cls, parts: Mapping[str, np.ndarray]) -> EliasFano:
        made = cls.__new__(cls)
        made._set(parts)
        return made

    def __len__(self) -> int:
        return self.n

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th one (or zero), from 0."""
        before = self.ones if ones else self.zeros
        at = np.searchsorted(before, k.astype(before.dtype), "right") - 1
        rest = (k - before[at]).astype(np.uint8)
        word = self.words[at] if ones else ~self.words[at]
        place = np.zeros(len(k), np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            lower = np.bitwise_count(word & _U((1 << half) - 1))
            up = rest >= lower
            rest -= lower * up
            step = up.astype(np.uint64) * _U(half)
            place += step
            word >>= step
        return at * 64 + place.astype(np.int64)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low_bits
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``. Low parts must have at most 57 bits."""
        high = self._select(i, True) - i
        return ((high.astype(np.uint64) << _U(self.low_bits)) | self._lows(i)).astype(np.int64)

    def index(self, x: np.ndarray) -> np.ndarray:
        """The place of each number, the first of equal ones; -1 where there is none."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        distinct, which = np.unique(x.astype(np.uint64), return_inverse=True)
        return self._index(distinct)[which]

    def _index(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        high = (x >> _U(self.low_bits)).astype(np.int64)
        inside = np.flatnonzero(high < self.zeros[-1] - 1)
        x, high = x[inside], high[inside]
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        stop = self._select(high, False) - high
        start = np.where(high > 0, start, 0)
        want, end = x & self.mask, stop.copy()
        open_ = np.flatnonzero(start < stop)
        while len(open_):  # a binary search in every run of equal high bits
            middle = (start[open_] + stop[open_]) >> 1
            less = self._lows(middle) < want[open_]
            start[open_] = np.where(less, middle + 1, start[open_])
            stop[open_] = np.where(less, stop[open_], middle)
            open_ = open_[start[open_] < stop[open_]]
        here = np.flatnonzero(start < end)
        here = here[self._lows(start[here]) == want[here]]
        out[inside[here]] = start[here]
        return out
