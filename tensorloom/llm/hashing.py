"""Rolling hashes of byte strings in numpy: polynomials modulo the prime 2^61 - 1, by prefix sums.

A polynomial modulo 2^64 has strings that collide whatever its base (Thue-Morse words and their
complements); modulo a prime two different strings of n bytes collide for at most n of all bases.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

PRIME = (1 << 61) - 1
P = np.uint64(PRIME)
BASE = 0x9E3779B97F4A7C15 % PRIME
INVERSE = pow(BASE, -1, PRIME)
#: Positions whose powers stand in a table; powers beyond are products of two.
TABLE = 1 << 20
STEP = 1 << 13
LOW29, LOW30, LOW31, LOW32 = (np.uint64((1 << k) - 1) for k in (29, 30, 31, 32))
S29, S30, S31, S32, S61 = (np.uint64(k) for k in (29, 30, 31, 32, 61))
ONE = np.uint64(1)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & P) + (x >> S61)
    return np.minimum(x, x - P)  # the difference wraps around where x is the less


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers a below 2^62 and b below the prime."""
    a1, a0, b1, b0 = a >> S31, a & LOW31, b >> S31, b & LOW31
    middle = a1 * b0
    middle += a0 * b1
    a1 *= b1
    a1 <<= ONE
    a0 *= b0
    a1 += a0
    a1 += middle >> S30
    middle &= LOW30
    middle <<= S31
    a1 += middle
    return reduced(a1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Powers:
    """Powers of a base modulo the prime: a table of TABLE of them and one of its multiples."""

    def __init__(self, base: int):
        self.base = base
        self.low, self.high = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def grown(self, table: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(table) < n:
            table = np.concatenate([table, times(table, np.uint64(pow(base, len(table), PRIME)))])
        return table

    def reach(self, n: int) -> None:
        """Make powers below n ready."""
        self.low = self.grown(self.low, self.base, min(n, TABLE))
        self.high = self.grown(self.high, pow(self.base, TABLE, PRIME), -(-n // TABLE))

    def at(self, i: np.ndarray) -> np.ndarray:
        if len(self.high) == 1:
            return self.low[i]
        return times(self.low[i % TABLE], self.high[i // TABLE])

    def stretch(self, a: int, b: int) -> np.ndarray:
        """Powers a to b - 1, all below or all above each multiple of TABLE."""
        out = self.low[a % TABLE : a % TABLE + b - a]
        return out if a < TABLE else times(out, self.high[a // TABLE])


UP, DOWN = Powers(BASE), Powers(INVERSE)


class Rolling:
    """Hashes of substrings of one buffer."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        UP.reach(n + 1)
        DOWN.reach(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        before = np.uint64(0)
        for a in range(0, n, STEP):
            b = min(n, a + STEP)
            up, c = UP.stretch(a, b), buf[a:b].astype(np.uint64) + ONE
            low, high = np.cumsum(c * (up & LOW32)), np.cumsum(c * (up >> S32))
            low += high >> S29
            high &= LOW29
            high <<= S32
            low += high
            low += before
            self.sums[a + 1 : b + 1] = reduced(low)
            before = self.sums[b]

    def of(self, start, end) -> np.ndarray:
        """Hashes of [start, end), arrays of positions."""
        start, end = np.asarray(start), np.asarray(end)
        h = times(self.sums[end] + (P - self.sums[start]), DOWN.at(start))
        return mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all substrings of k bytes."""
        n = max(0, len(self.sums) - k)
        out = np.empty(n, dtype=np.uint64)
        for a in range(0, n, STEP):
            b = min(n, a + STEP)
            out[a:b] = mixed(times(self.sums[a + k : b + k] + (P - self.sums[a:b]), DOWN.stretch(a, b)))
        return out


#: Words of up to so many bytes are hashed eight bytes at a time, longer ones as substrings of one buffer.
SHORT = 64
FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of many short stretches [start, end) of a buffer; equal bytes have equal hashes in any buffer.

    Each step mixes a word's next eight bytes in by a bijection, so words of one length that differ in eight
    bytes of one place alone never collide.
    """
    size = end - start
    h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F)
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    some = np.flatnonzero(size <= SHORT)
    at, left = start[some], size[some]
    while len(some):
        h[some] = mixed(h[some] ^ (eight[at] & FIRST[np.minimum(left, 8)]))
        on = left > 8
        some, at, left = some[on], at[on] + 8, left[on] - 8
    long = np.flatnonzero(size > SHORT)
    if len(long):
        ends = np.cumsum(size[long])
        h[long] = Rolling(np.concatenate([buf[a:b] for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])).of(ends - size[long], ends)
    return h


@functools.cache
def c_library():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library keeps its own counsel
        return None


def trim() -> None:
    """Give freed memory back to the system: a worker lives on, and the next one's peak adds to it."""
    if c_library() is not None and hasattr(c_library(), "malloc_trim"):
        c_library().malloc_trim(0)
    pa.default_memory_pool().release_unused()


def text_groups(batches, name: str = "text", most: int = 1 << 20, rows: int = 4096):
    """Slices of the batches whose texts sum to about `most` bytes: (slice, buffer, offsets).

    The buffer holds the texts' bytes one after the other; null counts as empty. A longer text is
    a group of its own.
    """
    passed = 0
    for batch in batches:
        column = batch.column(name)
        if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            kind = np.int64
        else:
            kind = np.int32
        if column.null_count:
            column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        n = len(column)
        if not n:
            continue
        offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        i = 0
        while i < n:
            j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
            j = min(max(j, i + 1), n, i + rows)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        del batch, column, data, offsets
        passed += n
        if passed >= 10_000:
            passed = 0
            trim()
