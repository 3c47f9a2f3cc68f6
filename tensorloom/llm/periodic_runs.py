"""Periodic runs of words in each text, by a suffix automaton with merged end-position sets.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, TIMES * q)
words that no neighbouring word extends keeping period q. The automaton of the words is built online; its
states, from the longest to the shortest, merge their children's ordered end-position sets, small
into large. Two end positions that become neighbours at distance d in the set of a state whose
longest string has at least d words end two occurrences that overlap or touch: a square of period d,
which begins where the longest string of the first one does. For each period and beginning the last
such end is kept and extended to the right; of runs with the same words the least period stays. Every
run is found so: the prefixes that end at its last word and one period before share a suffix that
reaches back to its beginning, and meet in the state of that suffix.

A word of a run occurs three times or more and eight words in a row twice or more within the run, so
the automaton is built for the stretches between words that can't lie in a run; ordinary prose has none.
It takes about 400 bytes for each word of such a stretch; a text is handled whole, in one task.

Defined results: null and blank texts have no words and no runs; words are compared as bytes; repeated
rows each get a row; extra columns are dropped unless they are named in `keep`; empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: A run has at least LEAST words, and TIMES periods.
LEAST = 24
TIMES = 3
#: Words in a row that occur twice in every run: max(LEAST, TIMES * q) - 2 * q + 1 is at least 9 for every q.
GRAM = 8
BLOCK = 512


class Ends:
    """An ordered set of numbers in blocks, so that no insertion moves more than 2 * BLOCK of them."""

    __slots__ = ("blocks", "first", "size")

    def __init__(self, x: int):
        self.blocks, self.first, self.size = [[x]], [x], 1

    def __iter__(self):
        for b in self.blocks:
            yield from b

    def add(self, x: int) -> tuple[int, int]:
        """The neighbours of x, which is new: the number below and above, or -1."""
        first, blocks = self.first, self.blocks
        i = bisect_left(first, x) - 1 if len(first) > 1 else 0
        i = max(i, 0)
        b = blocks[i]
        at = bisect_left(b, x)
        below = b[at - 1] if at else (blocks[i - 1][-1] if i else -1)
        above = b[at] if at < len(b) else (first[i + 1] if i + 1 < len(first) else -1)
        b.insert(at, x)
        if at == 0:
            first[i] = x
        if len(b) > 2 * BLOCK:
            blocks[i : i + 1] = [b[:BLOCK], b[BLOCK:]]
            first[i : i + 1] = [b[0], b[BLOCK]]
        self.size += 1
        return below, above


class Automaton:
    """The suffix automaton of a sequence of word numbers.

    A state's transitions: the first one in two arrays, more in a dictionary of its own.
    """

    def __init__(self, words):
        self.length, self.link = array("q", [0]), array("q", [-1])
        self.word, self.to = array("q", [-1]), array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}
        #: The end position of the prefix that a state stands for, -1 for clones.
        self.end = array("q", [-1])
        last = 0
        for i, w in enumerate(words):
            last = self.extend(last, w, i)

    def state(self, length: int, link: int, end: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(-1)
        self.to.append(-1)
        self.end.append(end)
        return len(self.length) - 1

    def extend(self, last: int, w: int, i: int) -> int:
        word, to, more, length, link = self.word, self.to, self.more, self.length, self.link
        new = self.state(length[last] + 1, 0, i)
        p, q = last, -1
        while p >= 0:
            if word[p] == w:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = w, new
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {w: new}
                elif w in others:
                    q = others[w]
                    break
                else:
                    others[w] = new
            p = link[p]
        if p < 0:
            return new
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        clone = self.state(length[p] + 1, link[q], -1)
        word[clone], to[clone] = word[q], to[q]
        if q in more:
            more[clone] = more[q].copy()
        link[q] = link[new] = clone
        while p >= 0:
            if word[p] == w:
                if to[p] != q:
                    break
                to[p] = clone
            else:
                others = more.get(p)
                if others is None or others.get(w) != q:
                    break
                others[w] = clone
            p = link[p]
        return new


def squares(words) -> dict[tuple[int, int], int]:
    """(beginning, period) to the last end of a square found."""
    a = Automaton(words)
    length, link, end = a.length, a.link, a.end
    del a
    found: dict[tuple[int, int], int] = {}
    sets: dict[int, Ends] = {}
    order = np.argsort(-np.frombuffer(length, dtype=np.int64), kind="stable").tolist()
    for v in order:
        if end[v] >= 0:
            merge(sets, v, Ends(end[v]), length[v], found)
        up = link[v]
        if up > 0:  # strings of no words have no squares
            merge(sets, up, sets.pop(v), length[up], found)
        else:
            sets.pop(v, None)
    return found


def merge(sets: dict[int, Ends], v: int, new: Ends, most: int, found: dict) -> None:
    """Add end positions to those of state v, whose longest string has `most` words."""
    old = sets.get(v)
    if old is None:
        sets[v] = new
        return
    if old.size < new.size:
        old, new = new, old
    before = -1
    for x in new:
        below, above = old.add(x)
        # two of the small set have met in a longer state
        if below >= 0 and below != before and x - below <= most:
            key = below - most + 1, x - below
            if found.get(key, -1) < x:
                found[key] = x
        if above >= 0 and above - x <= most:
            key = x - most + 1, above - x
            if found.get(key, -1) < above:
                found[key] = above
        before = x
    sets[v] = old


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, ordered."""
    best: dict[tuple[int, int], int] = {}
    n = len(words)
    for (start, q), last in squares(words).items():
        while last + 1 < n and words[last + 1] == words[last + 1 - q]:
            last += 1
        if q < best.get((start, last), n + 1):
            best[start, last] = q
    return sorted((s, e - s + 1, q) for (s, e), q in best.items() if e - s + 1 >= max(LEAST, TIMES * q))


def spans(marked: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[start, end) of the stretches of at least `least` true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.view(np.int8), [0]])))
    return [(a, b) for a, b in edge.reshape(-1, 2).tolist() if b - a >= least]


def stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the stretches of words outside of which no run can be, found again and again until none is cut."""
    todo, done = [(0, len(x))], []
    while todo:
        a, b = todo.pop()
        part = np.unique(x[a:b], return_inverse=True)[1] if b - a >= LEAST else x[:0]
        some = spans(np.bincount(part)[part] >= TIMES, LEAST) if len(part) else []
        if some == [(0, b - a)]:
            g, k = part, 1
            while k < GRAM:  # numbers of the stretches of 2, 4 and 8 words
                g = np.unique(g[:-k] * (len(g) + 1) + g[k:], return_inverse=True)[1]
                k *= 2
            some = [(s, e + GRAM - 1) for s, e in spans(np.bincount(g)[g] >= 2, LEAST - GRAM + 1)]
        if some == [(0, b - a)]:
            done.append((a, b))
        else:
            todo += [(a + s, a + e) for s, e in some]
    return sorted(done)


def find(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, ordered by start, then period."""
    if len(words) < LEAST:
        return []
    number: dict[bytes, int] = {}
    x = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    del number
    out = []
    for a, b in stretches(x):
        out += [(a + s, n, q) for s, n, q in runs_of(x[a:b].tolist())]
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]):
    """The run with the greatest length / period; ties: smallest start, then period."""
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q or (n * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = s, n, q
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period, joined by one space."""
    if runs:
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, q in runs:
            gone[s + q] += 1
            gone[s + n] -= 1
        words = [w for w, k in zip(words, (np.cumsum(gone) == 0).tolist(), strict=False) if k]
    return b" ".join(words)


FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), kept_text: bool = False) -> DataFrame:
    """The columns `keep` of docs with n_words, runs (all of them), the strongest run, digests, and the collapsed text if kept_text.

    Words are the maximal runs of other bytes than space and U+0009 to U+000D.
    """
    ship(docs.sparkSession)
    d = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("t"))
    schema = ", ".join([*(f"k{i} {d.schema[i].dataType.simpleString()}" for i in range(len(keep))), FOUND + (", collapsed string" if kept_text else "")])

    def one(t) -> tuple:
        words = b"".split() if t is None else t.as_buffer().to_pybytes().split()
        runs = find(words)
        best = strongest(runs)
        rest = collapsed(words, runs)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        found = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        row = (len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], *found, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())
        return (*row, rest.decode()) if kept_text else row

    long, string = pa.int64(), pa.string()
    types = [long, pa.list_(pa.struct([("start", long), ("length", long), ("period", long)])), long, long, long, long, string, string, string]
    names = ["n_words", "runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"]

    def run(batches):
        for batch in batches:
            t = batch.column(len(keep))
            rows = [one(x if x.is_valid else None) for x in t]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(9 if kept_text else 8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, k) for c, k in zip(columns, types, strict=False))], [*batch.schema.names[: len(keep)], *names[: len(columns)]])

    found = d.mapInArrow(run, schema)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names[: 9 if kept_text else 8])
