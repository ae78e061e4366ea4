"""Vectorised text helpers on Arrow buffers, shared by the operators that run numpy inside Spark tasks.

A text column is used as one byte buffer with row offsets.  Words, word hashes and window
fingerprints are computed over the whole buffer, so no Python object is made per word.  All
functions work on blocks of bounded size; ``blocks`` cuts a batch at row borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20           # text handled at once inside a task (one longer row is its own block)
_HASH_BYTES = 1 << 18           # word hashing works through a block in pieces of this size

#: Separators of the whitespace words ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32              # A-Z only

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_P = 0x9E3779B97F4A7C15         # odd bases: invertible modulo 2**64
_Q = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_MASK = (1 << 64) - 1


class _Powers:
    """Cached powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, U64)

    @staticmethod
    def _grown(p: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(p) < n:       # doubling: p[i + m] = p[i] * base**m
            p = np.concatenate([p, p * U64(pow(base, len(p), 1 << 64))])
        return p

    def up(self, n: int) -> np.ndarray:
        self._up = self._grown(self._up, self.base, n)
        return self._up[:n]

    def down(self, n: int) -> np.ndarray:
        self._down = self._grown(self._down, self.inv, n)
        return self._down[:n]


_BYTE_POWERS = _Powers(_P)
_WORD_POWERS = tuple(_Powers(q) for q in _Q)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection), so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def as_long(x: np.ndarray) -> pa.Array:
    """uint64 values as Spark longs (same bits)."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; a NULL is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    dt = np.int64 if wide else np.int32
    n = len(col)
    off = np.frombuffer(offs, dt, n + 1, col.offset * np.dtype(dt).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    buf = np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0]))
    return buf, off - off[0]


def blocks(off: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``size`` bytes."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in ``data`` (words never cross rows) and per-row word offsets."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = ~sep[data]
    edge = np.empty(n, bool)                      # a word begins: a word byte after a separator or a row border
    edge[0] = True
    np.logical_not(w[:-1], out=edge[1:])
    rows = off[:-1][np.diff(off) > 0]
    edge[rows] = True
    starts = np.flatnonzero(w & edge)
    edge[-1] = True                               # a word ends: a word byte before one
    np.logical_not(w[1:], out=edge[:-1])
    edge[rows[1:] - 1] = True
    ends = np.flatnonzero(w & edge) + 1
    return starts, ends, np.searchsorted(starts, off)


_PRIME = (1 << 31) - 1
_BASES = (1103515243, 1812433249)           # of the word hashes modulo the prime
_PRIME_BYTE = tuple(_rng.integers(1, _PRIME, 256, dtype=np.int64).astype(U64) for _ in _BASES)


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, up to a small multiple of it, in place."""
    high = x >> U64(31)
    x &= U64(_PRIME)
    x += high
    return x


class _PrimePowers:
    """Cached powers of a base and of its inverse modulo 2**31 - 1."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, _PRIME))
        self.tables = [np.ones(1, U64), np.ones(1, U64)]

    def get(self, n: int, down: bool) -> np.ndarray:
        p, base = self.tables[down], self.bases[down]
        while len(p) < n:
            p = np.concatenate([p, p * U64(pow(base, len(p), _PRIME)) % U64(_PRIME)])
        self.tables[down] = p
        return p[:n]


_PRIME_POWERS = tuple(_PrimePowers(b) for b in _BASES)


def _prime_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """62-bit word hash: two polynomials modulo 2**31 - 1, which has no structure in powers of two."""
    out = np.zeros(len(s), U64)
    for byte, powers in zip(_PRIME_BYTE, _PRIME_POWERS):
        cum = np.empty(len(data) + 1, U64)
        cum[0] = 0
        np.cumsum(_folded(byte[data] * powers.get(len(data), False)), out=cum[1:])       # terms below 2**32
        part = (cum[e] - cum[s]) % U64(_PRIME) * powers.get(len(data), True)[s] % U64(_PRIME)
        out = (out << U64(31)) | part
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, both: bool = False):
    """64-bit hash of each word's bytes; with ``both`` also a second one, of another family.

    A polynomial modulo 2**64 alone gives equal values to some long words that can be written down
    (Thue-Morse words of 1,024 letters); the polynomials modulo a prime do not, and enter both hashes.
    Together the two hashes hold 126 independent bits."""
    out, second = np.empty(len(starts), U64), np.empty(len(starts), U64)
    i, n = 0, len(starts)
    while i < n:
        j = max(int(np.searchsorted(ends, starts[i] + _HASH_BYTES, side="right")), i + 1)
        lo, hi = int(starts[i]), int(ends[j - 1])
        cum = np.empty(hi - lo + 1, U64)
        cum[0] = 0
        np.cumsum(_BYTE[data[lo:hi]] * _BYTE_POWERS.up(hi - lo), out=cum[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (cum[e] - cum[s]) * _BYTE_POWERS.down(hi - lo)[s] + (e - s).astype(U64)
        second[i:j] = _prime_hash(data[lo:hi], s, e)
        i = j
    first = mix(out + mix(second))
    return (first, second) if both else first


def window_prints(h: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Fingerprint of each run of ``size`` consecutive hashes (len(h) - size + 1 of them).

    Windows that cross a row border are meaningless; callers mask them.  ``second`` gives a fingerprint
    with another base, for the second word hash; both together are 126 bits."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    p = _WORD_POWERS[int(second)]
    cum = np.empty(len(h) + 1, U64)
    cum[0] = 0
    np.cumsum(h * p.up(len(h)), out=cum[1:])
    return mix((cum[size:] - cum[:n]) * p.down(n))


def span_prints(h: np.ndarray, g: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of the word runs [start, end), one on each of the two word hashes."""
    out = []
    for x, p in zip((h, g), _WORD_POWERS):
        cum = np.empty(len(x) + 1, U64)
        cum[0] = 0
        np.cumsum(x * p.up(len(x)), out=cum[1:])
        out.append(mix((cum[end] - cum[start]) * p.down(len(x) + 1)[start] + (end - start).astype(U64)))
    return out[0], out[1]


def window_mask(word_off: np.ndarray, size: int) -> np.ndarray:
    """True for each window start whose ``size`` words lie in one row."""
    total = int(word_off[-1])
    n = max(total - size + 1, 0)
    if not n:
        return np.zeros(0, bool)
    mark = np.zeros(n + 1, np.int32)
    count = np.diff(word_off)
    long = count >= size
    np.add.at(mark, word_off[:-1][long], 1)
    np.add.at(mark, word_off[1:][long] - size + 1, -1)
    return np.cumsum(mark)[:n] > 0


def covered(starts: np.ndarray, size, n: int) -> np.ndarray:
    """Boolean cover of [0, n) by the runs [start, start + size); sizes may differ."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + size, -1)
    return np.cumsum(mark)[:n] > 0


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the row ranges given by ``off`` (empty ranges give 0)."""
    cum = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return cum[off[1:]] - cum[off[:-1]]
