"""Words of whole Arrow columns, found and hashed with numpy.

A word is a run of bytes other than white space (0x20, 0x09-0x0D). All of these are single
bytes in UTF-8, so words are found on bytes. A column is walked in slices of about
``SLICE_BYTES``, which bounds the memory of a task; a longer text is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Everything between runs of letters; bytes of non-ASCII characters count as letters.
NOT_LETTERS = np.ones(256, dtype=bool)
NOT_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: The lower 0 to 8 bytes of a 64-bit value, and longer words that are hashed one by one.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
LONG_WORD = 256
_SEEDS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for every span, by prefix sums of a polynomial.

    Spans of any length cost the same, but unequal ones can be found that have equal hashes
    (a Thue-Morse sequence and its complement). It is for finding candidates only; what
    decides that two things are equal is hashed by ``run_hash``.
    """
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((values + np.uint64(1)) * powers(_BASE, n), out=sums[1:], dtype=np.uint64)
    raw = (sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hash(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of ``values[start : start + length]`` for every run, value after value.

    All bits are mixed after every value, so no algebra relates the hashes of two runs. Two
    seeds give two independent hashes, 128 bits together.
    """
    lengths = np.broadcast_to(np.asarray(lengths, dtype=np.int64), starts.shape)
    found = mix(lengths.astype(np.uint64) * np.uint64(_SEEDS[seed]) + np.uint64(seed + 1))
    longest, shortest = int(lengths.max(initial=0)), int(lengths.min(initial=0)) if len(lengths) else 0
    for k in range(longest):
        if k < shortest:
            found = mix(found ^ values[starts + k])
        else:
            more = np.flatnonzero(lengths > k)
            found[more] = mix(found[more] ^ values[starts[more] + k])
    return found


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of every word, eight bytes at a time; long words by BLAKE2."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    lengths = ends - starts
    found = mix(lengths.astype(np.uint64) * np.uint64(_SEEDS[seed]) + np.uint64(seed + 1))
    short = np.flatnonzero(lengths <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        short = short[lengths[short] > k]
        if not len(short):
            break
        part = eight[starts[short] + k] & _LOW[np.minimum(lengths[short] - k, 8)]
        found[short] = mix(found[short] ^ part)
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=bytes([seed])).digest()
        found[i] = int.from_bytes(digest, "little")
    return found


@dataclass
class Slice:
    """Some consecutive texts of a column.

    ``starts`` and ``ends`` are byte positions of the words in ``data``; ``first`` gives the
    number of each text's first word, with one more entry at the end; ``row`` is the
    position of the slice's first text in the column. A null text is an empty one.
    """

    row: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of each word; two seeds give independent ones."""
        return word_hashes(self.data, self.starts, self.ends, seed)

    def words(self, lo: int, hi: int) -> bytes:
        """Words ``lo .. hi - 1`` of the slice joined by single spaces."""
        data = self.data.tobytes() if not hasattr(self, "_bytes") else self._bytes
        self._bytes = data
        return b" ".join([data[s:e] for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist())])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)
    bounds = bounds[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, bounds.astype(np.int64)


def find_words(
    data: np.ndarray, bounds: np.ndarray, row: int = 0, lower: bool = False, between: np.ndarray = _SPACE
) -> Slice:
    """Words of the texts ``data[bounds[i]:bounds[i + 1]]``; ``bounds[0]`` is 0.

    ``between`` tells which bytes are not part of a word.
    """
    n = len(data)
    body = _LOWER[data] if lower else data
    inside = np.ones(n + 2, dtype=bool)
    inside[0] = inside[n + 1] = False
    inside[1 : n + 1] = ~between[data]
    opens, closes = inside[1 : n + 1] & ~inside[:n], inside[1 : n + 1] & ~inside[2 : n + 2]
    edges = bounds[(bounds > 0) & (bounds < n)]
    opens[edges] |= inside[1 : n + 1][edges]
    closes[edges - 1] |= inside[1 : n + 1][edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Slice(row, body, bounds, starts, ends, np.searchsorted(starts, bounds))


def slices(
    column: pa.Array, lower: bool = False, between: np.ndarray = _SPACE, slice_bytes: int = SLICE_BYTES
) -> Iterator[Slice]:
    """Walk a string column in slices of at most ``slice_bytes``, or one text if it is longer."""
    data, bounds = text_buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + slice_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield find_words(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], lo, lower, between)
        lo = hi
