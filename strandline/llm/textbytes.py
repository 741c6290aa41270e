"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Texts come as Arrow string columns. Bytes are folded by a table of 256 entries (0: not part of a word), words get
64-bit hashes, and everything else works on those. A word's hash is its polynomial modulo the prime 2**61 - 1 at a base
that was drawn at random, so equal words have equal hashes, and two different words of up to n bytes share one for at most n
of the 2**61 bases. The base is the same in every run, for results that can be repeated; who knows it can construct
words that share a hash, but words that collide at any base, as there are modulo 2**64, don't exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of at most so many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
PRIME = (1 << 61) - 1
_PRIME, _BASE = np.uint64(PRIME), 1_530_927_461_850_397_271
#: Sums of differences stay exact over so many bytes.
_EXACT = 1 << 23
_powers = {b: np.ones(1, np.uint64) for b in (_BASE, pow(_BASE, -1, PRIME), pow(_BASE, -(1 << 16), PRIME))}


def folding(word_bytes) -> np.ndarray:
    """Table that lower-cases A-Z and maps bytes for which word_bytes(lower-cased byte) is false to 0."""
    out = np.zeros(256, np.uint8)
    for b in range(1, 256):
        low = b + 32 if 65 <= b <= 90 else b
        out[b] = low if word_bytes(low) else 0
    return out


#: Words `[^\x20\x09-\x0D]+`; a NUL byte is mapped to 255, which UTF-8 never has.
SPACED = folding(lambda b: b != 32 and not 9 <= b <= 13)
SPACED[0] = 255
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, letters a-z and all beyond ASCII.
ALNUM = folding(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed)) | np.uint64(1)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any x."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it: 2**61 is 1, so what is shifted out comes in again at the other end."""
    low31, low30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low31, b >> np.uint64(31), b & low31
    middle = a0 * b1 + a1 * b0
    return reduced((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & low30) << np.uint64(31)) + a0 * b0)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first n powers of the base or of another one in _powers, modulo the prime."""
    while len(x := _powers[base]) < n:
        _powers[base] = np.concatenate([x, times(x, np.full(1, pow(base, len(x), PRIME), np.uint64))])
    return x[:n]


def divided(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x / base ** at modulo the prime, by powers of the inverse for either half of `at`."""
    low, high = at & 0xFFFF, at >> 16
    x = times(x, powers(1 << 16, pow(_BASE, -1, PRIME))[low])
    return times(x, powers(int(high.max(initial=0)) + 1, pow(_BASE, -(1 << 16), PRIME))[high]) if high.any() else x


class Prefixes:
    """Sums of values[k] * base ** k up to each place, from which hashes of all ranges follow.

    Either half of a product is summed on its own, modulo 2**64: the difference of two sums is exact while there is no
    overflow within the range. Values are below 2**8, or below the prime and then multiplied first (whole)."""

    def __init__(self, values: np.ndarray, whole: bool):
        x = powers(len(values))
        low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
        if whole:
            x = times(values, x)
            low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
        else:
            low, high = low * values, high * values
        self._low, self._high = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)
        np.cumsum(low, out=self._low[1:])
        np.cumsum(high, out=self._high[1:])

    def _between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high = reduced(self._high[ends] - self._high[starts])
        # times 2**32
        return reduced(reduced(self._low[ends] - self._low[starts]) + (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)))

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomials of ranges, modulo the prime."""
        x = self._between(starts, np.minimum(ends, starts + _EXACT))
        begin = starts + _EXACT
        while (long := np.flatnonzero(begin < ends)).size:
            x[long] = reduced(x[long] + self._between(begin[long], np.minimum(ends[long], begin[long] + _EXACT)))
            begin = begin + _EXACT
        return divided(x, starts)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most that many bytes together, or one text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a run of texts: starts and ends in data, hashes, and of[k]:of[k+1] for text k."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray):
        self.folded = f = table[data]
        self.off = off
        n = len(f)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes, self.of = np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
            return
        inside = f != 0
        first = np.zeros(n + 1, bool)
        first[off] = True  # texts begin here
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before &= ~first[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after &= ~first[1:]
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.of = np.searchsorted(self.starts, off)
        self._prefixes = Prefixes(f, False)
        self.hashes = self.hash(self.starts, self.ends)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of folded byte ranges."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        return mix(self._prefixes.hash(starts, ends) ^ ((ends - starts).astype(np.uint64) * _ODD))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their offsets; a shorter text with words is one shingle."""
    h, of, factors = words.hashes, words.of, constants(11, width)
    rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width if len(rolled) else 0):
        rolled += h[k : k + len(rolled)] * factors[k]
    rolled = mix(rolled)
    out, at = [], np.zeros(len(of), np.int64)
    for k in range(len(of) - 1):
        a, b = int(of[k]), int(of[k + 1])
        if b - a >= width:
            u = np.sort(rolled[a : b - width + 1])
            if len(u) > 1:
                u = u[np.concatenate(([True], u[1:] != u[:-1]))]
        elif b > a:
            with np.errstate(over="ignore"):
                u = mix(np.array([(h[a:b] * factors[: b - a]).sum() ^ np.uint64(b - a)], np.uint64))
        else:
            u = np.zeros(0, np.uint64)
        out.append(u)
        at[k + 1] = at[k] + len(u)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), at
