"""A wavelet matrix over a sequence of small symbols, in numpy."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with the number of ones before every 64th, for rank queries."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words), dtype=np.int64)
        np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64, out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits are set."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Counts how often symbols occur before a position, for many positions at once.

    One level per bit of a symbol, the highest first. A level keeps that bit of every symbol
    in the order of the level above, and then puts zeros before ones, each kept in order.
    It takes a quarter of a byte per symbol and level.
    """

    def __init__(self, symbols: np.ndarray, width: int) -> None:
        self.width, self.levels = width, []
        for bit in range(width - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            zeros = len(symbols) - int(np.count_nonzero(ones))
            self.levels.append((Bits(ones), zeros))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, prefix: int, at: np.ndarray, bits: int | None = None) -> np.ndarray:
        """How many of the first ``at`` symbols begin with the ``bits`` bits of ``prefix``."""
        bits = self.width if bits is None else bits
        low, high = np.zeros_like(at), at
        for level in range(bits):
            ones, zeros = self.levels[level]
            if prefix >> (bits - 1 - level) & 1:
                low, high = zeros + ones.ones(low), zeros + ones.ones(high)
            else:
                low, high = low - ones.ones(low), high - ones.ones(high)
        return high - low
