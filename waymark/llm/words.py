"""Words and hashes of whole Arrow batches of text, as NumPy passes over their bytes.

Texts come in pieces of a few MB, so memory does not follow the batch; one long
text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: A word's hash is its bytes' polynomial modulo two primes, each with a base of its own.
PRIMES = ((2147483647, 911382323), (2147483629, 972663749))
#: From so many bytes on, terms are reduced before they are added up, so that sums stay within 64 bits.
_LONG = 1 << 24
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE_SPLIT = np.ones(256, bool)
SPACE_SPLIT[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _power(prime: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo a prime, for i up to n."""
    if prime not in _powers or len(_powers[prime][0]) <= n:
        both = []
        for b in (base, pow(base, -1, prime)):
            steps = np.ones(1, U)
            while len(steps) <= max(1 << 16, n):
                steps = np.r_[steps, steps * U(pow(b, len(steps), prime)) % U(prime)]
            both.append(steps)
        _powers[prime] = tuple(both)
    return _powers[prime]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Piece:
    """Some rows of a batch: their bytes, and where each row's text and words lie."""

    rows: range
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first word of each row, and the end of the last

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, U)
        bytes_, out = self.data.astype(U) + U(1), np.zeros(len(self.starts), U)
        for prime, base in PRIMES:
            power, inverse = _power(prime, base, n)
            terms = bytes_ * power[:n]
            sums = np.zeros(n + 1, U)
            np.cumsum(terms if n < _LONG else terms % U(prime), out=sums[1:])
            out = (out << U(32)) | ((sums[self.ends] - sums[self.starts]) % U(prime) * inverse[self.starts] % U(prime))
        return mix(out)

    def within(self, k: int) -> np.ndarray:
        """By first word: whether k words in a row lie within one row."""
        doc = self.doc
        return doc[: max(0, len(doc) - k + 1)] == doc[k - 1 :]

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k words in a row, by first word; and which of them lie within one row."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, bool)
        size, own = 1, hashes
        while 2 * size <= k:
            own, size = after(own[:-size], own[size:]), 2 * size
        if size < k:
            own = after(own[:n], own[k - size :])
        return own, self.within(k)


def after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of what a and then b stand for."""
    return mix(a * U(0x9E3779B97F4A7C15) + b)


def pieces(column: pa.Array, word: np.ndarray, size: int = 1 << 19, lower: bool = False) -> Iterator[Piece]:
    """The texts of a string column (null: empty) in pieces of about size bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        own = data[offsets[at] : offsets[to]]
        yield _piece(range(at, to), LOWER[own] if lower else own, offsets[at : to + 1] - offsets[at], word)
        at = to


def _piece(rows: range, data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> Piece:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = word[data]
    before, after = inside[:-2].copy(), inside[2:].copy()
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside[1:-1] & ~before)
    ends = np.flatnonzero(inside[1:-1] & ~after) + 1
    return Piece(rows, data, offsets, starts, ends, np.searchsorted(starts, offsets))
