"""Vectorised hashing of words and of runs of words, for the Arrow workers.

A chunk of texts is laid out as one byte buffer. Words are the runs of bytes other than space and
0x09-0x0D, which in UTF-8 never cut a character. A word's hash is a polynomial over random 64-bit
values of its bytes, taken relative to the word's start by means of inverse powers (the base is odd,
so it has an inverse modulo 2**64), then mixed; the hash of a run of words is made the same way from
the words' hashes. Equal words and runs always have equal hashes; that two different ones collide has
a chance of about 2**-50 for a pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Texts are hashed in chunks of about so many bytes, which bounds the memory that a worker needs.
CHUNK_BYTES = 1 << 17

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    values[list(SEPARATORS)] = 0
    folded = values.copy()
    folded[65:91] = values[97:123]
    return values, folded


_PLAIN, _FOLDED = _tables(20240229)
# a second family of hashes, for tests of what the first one calls equal
_CHECK, _ = _tables(20250331)
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; the table of a worker grows by doubling."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(16, (n - 1).bit_length())
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(table, out=table)
        _powers[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class Words:
    """The words of a chunk of texts: hashes, byte positions, and where each text's words begin."""

    def __init__(self, texts: list[str | None], fold: bool = False, check: bool = False):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.buffer = b"\n".join(parts) + b"\n" if parts else b""
        raw = np.frombuffer(self.buffer, np.uint8)
        blank = _IS_SEPARATOR[raw]
        first = ~blank
        if len(first):
            first[1:] &= blank[:-1]
        self.starts = np.flatnonzero(first)
        last = blank.copy()
        if len(last):
            last[0] = False
            last[1:] &= ~blank[:-1]
        self.ends = np.flatnonzero(last)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        self.offsets = np.searchsorted(self.starts, begin)
        if len(self.starts):
            n = len(raw)
            with np.errstate(over="ignore"):
                sums = np.add.reduceat((_CHECK if check else _FOLDED if fold else _PLAIN)[raw] * _power(_BASE, n), self.starts)
                self.hashes = mix(sums * _power(_INVERSE, n)[self.starts])
        else:
            self.hashes = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def runs(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on; what crosses a text's end is meaningless."""
        return runs(self.hashes, k)

    def bounds(self, i: int) -> tuple[int, int]:
        return int(self.offsets[i]), int(self.offsets[i + 1])


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _power(_BASE, n), out=total[1:])
        return mix((total[k:] - total[:-k]) * _power(_INVERSE, n)[: n - k + 1] + _U(k))


def whole(hashes: np.ndarray) -> int:
    """The hash of all these words as one run."""
    return int(runs(hashes, len(hashes))[0])


def digest(values: np.ndarray) -> bytes:
    """128 bits of an array."""
    import hashlib

    return hashlib.blake2b(np.ascontiguousarray(values).tobytes(), digest_size=16).digest()


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of the texts with about as many characters as the limit, at least one text each."""
    begin, held, i = 0, 0, -1
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n + 1
    if i >= begin:
        yield begin, i + 1
