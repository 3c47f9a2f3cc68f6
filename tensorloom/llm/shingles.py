"""Sets of word shingles as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .hashing import mixed, text_groups, words

WORDS = 5
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd factors for the words of a shingle by place.
FACTORS = np.random.default_rng(5).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_spans(buf: np.ndarray, offsets: np.ndarray):
    """Where the words of all texts start and end."""
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[offsets] = True
    word = ~SEPARATOR[buf]
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    return np.flatnonzero(word & (~before | first[:-1])), np.flatnonzero(word & (~after | first[1:])) + 1


def word_hashes(buf: np.ndarray, offsets: np.ndarray):
    """Hashes of the words of all texts, and for each text where its words begin among them."""
    start, end = word_spans(buf, offsets)
    return words(LOWER[buf], start, end), np.searchsorted(start, offsets)


def sets(buf: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted; fewer words than size make one shingle."""
    h, at = word_hashes(buf, offsets)
    n = max(0, len(h) - size + 1)
    s = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        s += h[j : j + n] * FACTORS[j]
    s = mixed(s)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(s[a : b - size + 1]))
        elif b > a:
            out.append(mixed((h[a:b] * FACTORS[size : size + b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def identity(s: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def text_sets(batches, size: int = WORDS):
    """(slice, sets) for slices of the batches."""
    for part, buf, offsets in text_groups(batches):
        yield part, sets(buf, offsets, size)
