"""Texts of a batch as one byte array, with words, lines and hashes found by array operations.

Words are ``[^\\x20\\x09-\\x0D]+``; in UTF-8 these bytes are never part of another character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Two prime moduli below 2**31 with a base each: products of residues stay below 2**64.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_013)
_residues = [[np.ones(1, np.uint32), np.ones(1, np.uint32)] for _ in PRIMES]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2**64; kept between batches."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64), dtype=np.uint64)])
    return _powers[0][:n], _powers[1][:n]


def residues(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse modulo its prime; kept between batches."""
    prime, base = PRIMES[which], BASES[which]
    for k, step in enumerate((base, pow(base, -1, prime))):
        known = _residues[which][k]
        while len(known) < n:
            more = known[:n - len(known)] * np.uint64(pow(step, len(known), prime)) % np.uint64(prime)
            known = np.concatenate([known, more.astype(np.uint32)])
        _residues[which][k] = known
    return _residues[which][0][:n], _residues[which][1][:n]


class Rolling:
    """Hashes of any ranges of a sequence of numbers, as polynomials modulo two primes.

    Sums modulo a power of two would not do: there, whatever the base, some strings of a
    thousand symbols (Thue and Morse's and its complement) always meet.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.parts = []
        for k, prime in enumerate(map(np.uint64, PRIMES)):
            up, down = residues(len(values) + 1, k)
            terms = (values % prime if values.dtype.itemsize > 4 else values.astype(np.uint64) + np.uint64(1)) * up[:-1]
            if values.dtype.itemsize > 1 or len(values) >= 1 << 25:  # else sums of the products stay below 2**64 as they are
                terms %= prime
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])  # below 2**64 for 2**33 terms
            self.parts.append((prime, sums, down))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the ranges; equal ranges get equal hashes."""
        (p, a, x), (q, b, y) = self.parts
        first = (a[end] - a[start]) % p * x[start] % p
        second = (b[end] - b[start]) % q * y[start] % q
        return mixed((first << np.uint64(32) | second) ^ (end - start).astype(np.uint64) * np.uint64(_ODD))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread so that sums of the results show no pattern."""
    out = x >> np.uint64(30)
    out ^= x
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def chunks(texts: list, most: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """UTF-8 of consecutive texts, ``most`` bytes or one text at a time, with the number of the first."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if held and total + len(raw) > most:
            yield first, held
            first, held, total = i, [], 0
        held.append(raw)
        total += len(raw) + 1
    if held:
        yield first, held


class Words:
    """The words of some texts, each text followed by a line feed."""

    def __init__(self, raws: list[bytes]) -> None:
        self.sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        self.bytes = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]).astype(np.int64)  # byte each text starts at
        self._sums = self._rolling = None

    # words are looked for when they are asked for: work on bytes does without
    @cached_property
    def blank(self) -> np.ndarray:
        return SPACE[self.bytes]

    @cached_property
    def _edge(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.blank, prepend=True))

    @property
    def start(self) -> np.ndarray:
        return self._edge[0::2]

    @property
    def end(self) -> np.ndarray:
        return self._edge[1::2]

    @cached_property
    def bound(self) -> np.ndarray:
        """Words of text i: bound[i]:bound[i + 1]."""
        return np.searchsorted(self.start, np.append(self.first, len(self.bytes)))

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.bound)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal ranges get equal hashes."""
        if self._rolling is None:
            self._rolling = Rolling(self.bytes)
        return self._rolling(start, end)

    def marks(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Quicker numbers for byte ranges, equal for equal ranges, that may meet for others: to choose by, not to compare by."""
        sums, down = self._summed()
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def marks_along(self, width: int) -> np.ndarray:
        """The same for all ranges of ``width`` bytes, from the first byte on."""
        sums, down = self._summed()
        out = sums[width:] - sums[:-width]
        out *= down[:len(out)]
        out += np.uint64(width)
        return mixed(out)

    def _summed(self) -> tuple[np.ndarray, np.ndarray]:
        up, down = powers(len(self.bytes) + 1)
        if self._sums is None:
            terms = self.bytes.astype(np.uint64)
            terms += np.uint64(1)
            terms *= up[:-1]
            self._sums = np.zeros(len(terms) + 1, np.uint64)
            np.cumsum(terms, out=self._sums[1:])
        return self._sums, down

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.counts)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a byte-wise array over each text."""
        return np.add.reduceat(flags, self.first, dtype=np.int64)
