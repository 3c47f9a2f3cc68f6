"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and one end. A token's class is the upper BITS bits of its hash; the
bits of the class are predicted one by one, each from the bits before it and a context: none, the last
very frequent word (which tells the language), the word before. A context's predictor for a bit are
the counts of zeros and ones that followed there in the learning documents. The predictions are
stretched and summed with weights that are chosen by bit position and by how often the two contexts
were seen there; weights are refined online, by gradient steps on coding cost over the learning documents. The result is refined by a map from quantised prediction and bit position to the rate found
there, averaged with the prediction. Within its class a
known token has the share c / (C + V + 1), c its count, C and V tokens and distinct tokens of the
class; unknown tokens share the rest, (V + 1) / (C + V + 1), in which a word has the probability of its
spelling: bytes and a separator, bit by bit, from the byte before, with counts from all words of
learning documents but the COMMON most frequent ones (an end is spelt as no bytes). So a text's
probability is a product over its
tokens, and over all tokens the probabilities in one place sum to one. Each learning document is scored
by the counts of all others: its own are taken off, but for the predictor without a context.

Weights and map are fitted once, on all learning texts. One task begins, with texts in order of a hash that fit
into SAMPLE_BYTES, among the first SAMPLE_TEXTS different ones. From its weights each unit goes on with its own learning texts,
each once; the units' weights are averaged, by their tokens, and all counts of the map are added up. Pairs after
no hub (below) are counted within a unit for that, all else in all learning documents; a gate tells how often
contexts were seen, so weights hold for larger counts too. A text's unit follows from a hash of its row, so
no score depends on how rows are dealt to tasks.

Counters are exact and grow with the input; those of words and of the word before are in no one
place. Texts are dealt by hash to units of about UNIT_BYTES, which keep their tokens as numbers and their different words once. A unit's distinct (context, class) pairs with counts are
sent to parts by the context's hash, PART_BYTES of input to a part; a part adds up all units' counts for
the bits on each pair's path and returns them to each unit. Pairs after one of the HUBS most frequent
words, or at a text's beginning, go another way, so that no part gathers many units' pairs of one context: tasks count them in a
table of (HUBS + 1) 2^BITS numbers, and these tables are added up in two steps and sent to all tasks. Any other
word comes less than once in HUBS tokens, so its pairs are at most a thousandth of a unit's tokens. A
unit and a part make one row, so with very much input both sizes are best raised together. Words, known
by 64 bits of their hash, go the same way, for their counts; contexts are known by 44 bits. Sent to all tasks: counts by class and by very frequent word and class, and of
spellings: (GUIDES + HUBS + 3) 2^BITS and 2^17 numbers; the COMMON most frequent words; weights and map.

Defined results: null text is empty and has one token, the end; without learning documents every
count is 0, and weights stay as they begin; repeated rows each get a row; null ids are kept; an empty table gives an
empty result; a long text is scored as a whole, one of more than UNIT_BYTES in a unit of its own, in one
task, which holds some hundreds of bytes for each of its tokens (by the sizes of its arrays; not measured).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, ship, stage
from .hashing import mixed, text_groups, trim
from .hashing import words as word_hashes
from .shingles import LOWER, word_spans

BITS = 10
CLASSES = 1 << BITS
PREDICTORS = 3
#: Very frequent words that may serve as a context.
GUIDES = 256
#: Frequent words whose pairs are counted in a table.
HUBS = 1024
#: The most frequent words, whose spellings aren't counted.
COMMON = 4096
UNIT_BYTES = 4 << 20
PART_BYTES = 4 << 20
#: Bounds of the texts that the fit of weights and map begins with.
SAMPLE_BYTES = 4 << 20
SAMPLE_TEXTS = 8192
#: Bytes that are handled at once.
SLICE = 1 << 20
#: Bytes of texts to a task where they are dealt to units.
DEALT_BYTES = 16 << 20
#: Weights and the map's counts are added up as whole numbers of these parts, so sums don't depend on their order.
WEIGHT_UNIT = 1 << 20
HIT_UNIT = 1 << 16
STEP = 0.02
BATCH = 2048
#: Tokens whose predictions are made at once.
STRETCH = 1 << 15
#: Counts on a path stand in a row of so many numbers, in fours: numpy picks four about as fast as one.
LINE = -(-(BITS + 1) // 4) * 4
#: The mixer takes the bits of a class in rows of so many.
SHARES = tuple(1 << k for k in (3, 2, 1, 0) if BITS % 16 >> k & 1)
LEVELS = 4
BINS = 33
#: Lowest bits of a context's hash that aren't used.
CUT = 20
#: Added to both counts of a bit.
PRIOR = 0.1
END = np.uint64(0x5851F42D4C957F2D)
#: Bits that the counts of a spelling's bit without the byte before weigh as, in one with it.
TRUST = 4.0
SPELLING = 2 << 16
ROW = "uid long, p int, blob binary"


# ---- arrays as bytes


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    import zstandard

    head = struct.pack("<i", len(arrays)) + b"".join(struct.pack("<2sq", x.dtype.str[1:].encode(), len(x)) for x in arrays)
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def unpack(blob) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<i", raw)
    heads = [struct.unpack_from("<2sq", raw, 4 + 10 * i) for i in range(n)]
    out, at = [], 4 + 10 * n
    for kind, size in heads:
        out.append(np.frombuffer(raw, dtype=np.dtype(kind.decode()), count=size, offset=at))
        at += out[-1].nbytes
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def in_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What sorts numbers, none negative, equal ones by place; the numbers sorted."""
    bits = len(x).bit_length()
    if int(x.max(initial=0)).bit_length() + bits > 63:
        order = np.argsort(x, kind="stable")
        return order, x[order]
    both = np.sort((x << bits) | np.arange(len(x)))  # one sort of numbers with their places is faster
    return both & ((1 << bits) - 1), both >> bits


def pick(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x[at] for places within x, which numpy does faster where it needn't tell."""
    return x.take(at, axis=0, mode="clip")


def pick_lines(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of LINE numbers."""
    return pick(x.reshape(-1, 4), places(at, LINE // 4, 0, LINE // 4)).reshape(-1, LINE)


def places(at: np.ndarray, size: int, begin: int, n: int) -> np.ndarray:
    """In rows of `size`, those from `begin` to `begin` + n of each row."""
    out = np.empty((len(at), n), dtype=np.int64)
    for i in range(n):
        out[:, i] = at * size + (begin + i)
    return out.reshape(-1)


def starts(x: np.ndarray) -> np.ndarray:
    """Where among sorted numbers each different one begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, dtype=np.int64)


def lengths(first: np.ndarray, end: int) -> np.ndarray:
    """Lengths of stretches that begin at `first`, the last one's end given."""
    return np.diff(np.append(first, end))


# ---- units of texts


class Unit:
    """Texts of a unit: row ids, whether to learn from them, sizes, bytes; or as tokens by number, with the different words."""

    def __init__(self, rid, learns, sizes, buf):
        self.rid, self.learns, self.buf = rid, learns.astype(bool), buf
        self.offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def tokens(self, spans: bool = True) -> None:
        """Sets t, hashes of all tokens; begin, where each text's tokens begin; if spans, start and end of words in the buffer (0 for an end)."""
        hashes, found, words = [], [], []
        i, n = 0, len(self.rid)
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + SLICE, side="right")) - 1))
            part, offsets = self.buf[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i]
            start, end = word_spans(part, offsets)
            hashes.append(word_hashes(LOWER[part], start, end))
            found.append(np.stack([start, end]) + self.offsets[i])
            words.append(np.diff(np.searchsorted(start, offsets)))
            i = j
        h, words = np.concatenate(hashes), np.concatenate(words)
        self.begin = np.concatenate([[0], np.cumsum(words + 1)])
        place = np.arange(len(h)) + np.repeat(np.arange(n), words)
        self.t = np.full(self.begin[-1], END, dtype=np.uint64)
        self.t[place] = h
        if spans:
            self.start, self.end = np.zeros((2, len(self.t)), dtype=np.int64)
            self.start[place], self.end[place] = np.concatenate(found, axis=1)
        self.doc = np.repeat(np.arange(n), np.diff(self.begin))

    @classmethod
    def of_words(cls, rid, learns, n_tokens, number, sizes, buf) -> Unit:
        """From what as_words gives."""
        end = np.cumsum(sizes, dtype=np.int64)
        start = end - sizes
        distinct = word_hashes(LOWER[buf], start, end)
        distinct[sizes == 0] = END
        return cls.numbered(rid, learns, n_tokens, number.reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64), distinct, buf, start, end)

    @classmethod
    def numbered(cls, rid, learns, n_tokens, number, distinct, buf, start, end) -> Unit:
        u = cls.__new__(cls)
        u.rid, u.learns, u.buf = rid, learns.astype(bool), buf
        u.begin = np.concatenate([[0], np.cumsum(n_tokens, dtype=np.int64)])
        u.doc = np.repeat(np.arange(len(rid)), n_tokens)
        u.by_word, u.spans = (distinct, number), (start, end)
        u.t = distinct[number]
        return u

    def as_words(self) -> list[np.ndarray]:
        """Row ids, whether to learn from them, tokens of each, tokens as numbers in bytes by significance, sizes and bytes of the different words (an end is empty)."""
        distinct, number = self.by_word
        some = np.empty(len(distinct), dtype=np.int64)
        some[number] = np.arange(len(number))  # one token of each
        start, size = self.start[some], self.end[some] - self.start[some]
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return [self.rid, self.learns.astype(np.uint8), narrow(np.diff(self.begin)), number.astype("<u4").view(np.uint8).reshape(-1, 4).T.reshape(-1), narrow(size), self.buf[at]]

    def only(self, keep: np.ndarray) -> Unit:
        """Some of the texts."""
        distinct, number = self.by_word
        return self.numbered(self.rid[keep], self.learns[keep], np.diff(self.begin)[keep], number[keep[self.doc]], distinct, self.buf, *self.spans)

    @cached_property
    def by_word(self) -> tuple[np.ndarray, np.ndarray]:
        """The different tokens and each token's place among them."""
        return np.unique(self.t, return_inverse=True)

    def before(self) -> np.ndarray:
        """For each token the place of the one before among the different ones; their number at beginnings."""
        distinct, number = self.by_word
        one = np.concatenate([number[:1], number[:-1]])
        one[self.begin[:-1]] = len(distinct)
        return one

    def contexts(self) -> np.ndarray:
        """The different tokens as contexts, and that of a beginning."""
        return context_of(np.append(self.by_word[0], np.uint64(1)))

    def pairs(self, hubs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, as the hash of the word before with the token's class in the lowest bits; each token's place among them; how often learning texts have each; the number of the hub that the word before is (-1: none)."""
        contexts, rank = np.unique(self.contexts(), return_inverse=True)
        hub = np.where(is_one(contexts, hubs), np.searchsorted(hubs, contexts), -1)
        order, code = in_order((pick(rank, self.before()) << BITS) | classes(self.t).astype(np.int64))
        first = starts(code)
        at = np.empty(len(code), dtype=np.int64)
        at[order] = np.repeat(np.arange(len(first)), lengths(first, len(code)))
        code = code[first]
        key = (pick(contexts, code >> BITS) << np.uint64(CUT)) | (code & (CLASSES - 1)).astype(np.uint64)
        return key, at, np.bincount(at, weights=self.learns[self.doc], minlength=len(key)).astype(np.int64), pick(hub, code >> BITS)

    def guided(self, guides: np.ndarray) -> np.ndarray:
        """For each token the number of the last guide before it in its text, from 1 (0: none), with the class in its lowest bits."""
        distinct, number = self.by_word
        guide = np.where(is_one(distinct, guides), np.searchsorted(guides, distinct) + 1, 0)[number]
        last = np.where(guide > 0, np.arange(1, len(self.t) + 1), 0)
        last = np.concatenate([[0], np.maximum.accumulate(last)[:-1]])
        found = np.where(last > self.begin[self.doc], guide[np.maximum(last - 1, 0)], 0)
        return (found.astype(np.uint64) << np.uint64(BITS)) | classes(self.t)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens, each token's place among them, and how often learning texts have each."""
        distinct, at = self.by_word
        return distinct, at, np.bincount(at, weights=self.learns[self.doc], minlength=len(distinct)).astype(np.int64)


def context_of(t: np.ndarray) -> np.ndarray:
    """The hash of a word, or of 1 for none, as a context."""
    return mixed(t + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(CUT)


def classes(t: np.ndarray) -> np.ndarray:
    return t >> np.uint64(64 - BITS)


def make_units(unit_bytes: int):
    """For mapInArrow over rows sorted by group: (group, rid, learns, text) to units as rows, of texts of one group."""

    def run(batches):
        held: list[tuple] = []
        size = made = 0

        def flush():
            nonlocal size, made
            arrays = [np.concatenate([h[k] for h in held]) for k in range(4)]
            held.clear()
            size, made = 0, made + 1
            u = Unit(*arrays)
            u.tokens()
            return row(TaskContext.get().partitionId() << 32 | made, 0, pack(*u.as_words(), level=3))

        def by_group():
            for batch in batches:
                group = batch.column("group").to_numpy()
                cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
                yield from (batch.slice(a, b - a) for a, b in zip(cut[:-1], cut[1:], strict=True))

        last = None
        for part, buf, offsets in text_groups(by_group()):
            group = part.column("group")[0].as_py()
            if held and (group != last or size + len(buf) > 2 * unit_bytes):
                yield flush()
            last = group
            held.append((part.column("rid").to_numpy(), part.column("learns").to_numpy(zero_copy_only=False).astype(np.uint8), np.diff(offsets), buf.copy()))
            size += len(buf)
        if held:
            yield flush()

    return run


def row(uid: int, p: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.array([p], pa.int32()), pa.array([blob], pa.binary())], ["uid", "p", "blob"])


def units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Unit]]:
    for batch in batches:
        for uid, blob in zip(batch.column("uid").to_pylist(), batch.column("blob"), strict=True):
            u = Unit.of_words(*unpack(blob.as_buffer()))
            yield uid, u
            del u
            trim()


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the keys of each part begin among sorted keys; a part is a range of the upper 32 bits."""
    bounds = np.array([-(-(p << 32) // parts) << 32 for p in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


# ---- words and their counts


def spelled(buf: np.ndarray, start: np.ndarray, end: np.ndarray):
    """For words [start, end): the bytes of their spellings, separators included, the bytes before, where each word begins."""
    size = end - start + 1
    begin = np.cumsum(size) - size
    at = np.repeat(start - begin, size) + np.arange(int(size.sum()))
    buf = buf if len(buf) else np.zeros(1, dtype=np.uint8)
    out = LOWER[buf[np.minimum(at, len(buf) - 1)]]  # separators lie beyond the last word
    out[begin + size - 1] = 0x20
    before = np.concatenate([[0x20], out[:-1]]).astype(np.int64) if len(out) else out.astype(np.int64)
    return out.astype(np.int64), before, begin


def spelling_bits(byte: np.ndarray, before: np.ndarray):
    """For each bit of the bytes: its place among 2^16 (byte before and bits before), the bit."""
    for j in range(8):
        yield (before << 8) | (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1


#: All bytes after all bytes.
BEFORE, BYTE = np.divmod(np.arange(1 << 16), 256)


def byte_counts(buf: np.ndarray, start: np.ndarray, end: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Counts of bytes after bytes in words, each counting once or so many times."""
    n = np.zeros(1 << 16, dtype=np.int64)
    for i, j in slices(np.append(0, np.cumsum(end - start + 1)), SLICE):
        byte, before, _ = spelled(buf, start[i:j], end[i:j])
        weights = None if times is None else np.repeat(times[i:j], end[i:j] - start[i:j] + 1)
        n += np.bincount((before << 8) | byte, weights=weights, minlength=len(n)).astype(np.int64)
    return n


def bit_counts(n: np.ndarray) -> np.ndarray:
    """Counts of the bits of bytes, from counts of bytes after bytes."""
    out = np.zeros(SPELLING, dtype=np.int64)
    for place, bit in spelling_bits(BYTE, BEFORE):
        np.add.at(out, place * 2 + bit, n)
    return out


def spell_counts(buf: np.ndarray, start: np.ndarray, end: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Counts of the bits of words, each counting once or so many times."""
    return bit_counts(byte_counts(buf, start, end, times))


class Spelling:
    """Probabilities of words by their bytes."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(256, 256, 2).astype(np.float64)
        every = n.sum(axis=0) + 0.4
        each = n + TRUST * every / every.sum(axis=1, keepdims=True)
        self.log = np.log10(each / each.sum(axis=2, keepdims=True)).reshape(-1, 2)
        self.byte = sum(self.log[place, bit] for place, bit in spelling_bits(BYTE, BEFORE))

    def cost(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log10 probability of each word."""
        byte, before, begin = spelled(buf, start, end)
        total = self.byte[(before << 8) | byte]
        return np.add.reduceat(total, begin) if len(begin) else total


def send_words(parts: int):
    """For mapInArrow: units to their distinct words by part, hashes and counts."""

    def run(batches):
        for uid, u in units_of(batches):
            t, _, n = u.counted()
            at = cuts(t, parts)
            for p in np.flatnonzero(np.diff(at)):
                s = slice(at[p], at[p + 1])
                yield row(uid, int(p), pack(steps(t[s]), narrow(n[s])))

    return run


def steps(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as their steps, in bytes by significance, of which the upper ones are mostly 0."""
    return np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.reshape(-1)


def sums(steps_: np.ndarray) -> np.ndarray:
    """The numbers again."""
    return np.cumsum(np.ascontiguousarray(steps_.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def count_words(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For applyInArrow: a part's words to all units' counts of them for each unit.

    Beside these, as units below 0: counts by class (-1), the most frequent words (-2).
    """
    p, uids, found = key[0].as_py(), [], []
    for batch in batches:
        uids += batch.column("uid").to_pylist()
        found += [unpack(b.as_buffer()) for b in batch.column("blob")]
    t, n = np.concatenate([sums(f[0]) for f in found]), np.concatenate([f[1] for f in found])
    distinct, at = np.unique(t, return_inverse=True)
    total = np.bincount(at, weights=n, minlength=len(distinct)).astype(np.int64)
    known, of = total > 0, classes(distinct).astype(np.int64)
    yield row(-1, p, pack(np.bincount(of, weights=total, minlength=CLASSES).astype(np.int64), np.bincount(of[known], minlength=CLASSES)))
    yield row(-2, p, pack(*most_frequent(distinct[known], total[known])))
    place = 0
    for uid, f in zip(uids, found, strict=True):
        yield row(uid, p, pack(narrow(total[at[place : place + len(f[1])]])))
        place += len(f[1])


def most_frequent(t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = np.lexsort((t, -n))[:COMMON]
    return t[some], n[some]


def added(blobs) -> bytes:
    """The sum of arrays."""
    total = None
    for b in blobs:
        x = [z.astype(np.int64) for z in unpack(b.as_buffer())]
        total = x if total is None else [y + z for y, z in zip(total, x, strict=True)]
    return pack(*total)


def add_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For applyInArrow: rows to their sum."""
    yield row(0, key[0].as_py(), added(b for batch in batches for b in batch.column("blob")))


def join_frequent(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For applyInArrow: lists of words and counts to the most frequent ones."""
    t, n = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    for batch in batches:
        for b in batch.column("blob"):
            x = unpack(b.as_buffer())
            t, n = most_frequent(np.concatenate([t, x[0]]), np.concatenate([n, x[1]]))
    yield row(0, key[0].as_py(), pack(t, n))


def gathered(rows: DataFrame, how=add_up, groups: int = 4) -> list[list[np.ndarray]]:
    """Rows brought together by `how` in a few tasks, whose results come to the driver."""
    d = rows.withColumn("p", F.pmod("p", F.lit(groups)).cast("int")).groupBy("p").applyInArrow(how, ROW)
    return [unpack(r["blob"]) for r in d.collect()]


def total_of(rows: DataFrame, *sizes: int) -> list[np.ndarray]:
    """The sums of rows, first of those of each of 64 groups."""
    out = [np.zeros(n, dtype=np.int64) for n in sizes]
    for x in gathered(rows.withColumn("p", F.pmod("p", F.lit(64)).cast("int")).groupBy("p").applyInArrow(add_up, ROW)):
        out = [a + b for a, b in zip(out, x, strict=True)]
    return out


def is_one(t: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each word is one of some sorted ones."""
    return of[np.minimum(np.searchsorted(of, t), len(of) - 1)] == t if len(of) else np.zeros(len(t), dtype=bool)


def count_guided(guides, hubs, common):
    """For mapInArrow: units to the task's counts by guide and class, by hub and class, and of spellings of words that aren't common."""

    def run(batches):
        total, after = (np.zeros((n + 1) * CLASSES, dtype=np.int64) for n in (GUIDES + 1, len(hubs)))  # other tokens' last
        spelling = np.zeros(1 << 16, dtype=np.int64)
        for _, u in units_of(batches):
            learns = u.learns[u.doc]
            total += np.bincount(np.where(learns, u.guided(guides).astype(np.int64), len(total) - 1), minlength=len(total))
            context = u.contexts()
            hub = np.where(is_one(context, hubs), np.searchsorted(hubs, context), len(hubs)) << BITS
            after += np.bincount(np.where(learns, pick(hub, u.before()) | classes(u.t).astype(np.int64), len(after) - 1), minlength=len(after))
            distinct, _, n = u.counted()
            some = np.flatnonzero((n > 0) & (distinct != END) & ~is_one(distinct, common))
            spelling += byte_counts(u.buf, u.spans[0][some], u.spans[1][some], n[some])
        yield row(0, TaskContext.get().partitionId(), pack(narrow(total[:-CLASSES]), narrow(after[:-CLASSES]), narrow(bit_counts(spelling))))

    return run


# ---- counts of the bits on the paths of pairs


#: Of each number below CLASSES the bits up to its first one.
DEPTH = np.array([x.bit_length() for x in range(CLASSES)], dtype=np.uint8)


def path_totals(key: np.ndarray, fresh: np.ndarray, counts: np.ndarray, kind=np.int64) -> np.ndarray:
    """(n, BITS + 1): at level j the summed counts of neighbours whose keys agree but for their last BITS - j bits.

    fresh tells places that don't belong with the one before; kind is a type that holds the sums. A level's numbers lie side by side.
    """
    counts = counts.astype(kind)
    out = np.empty((BITS + 1, len(key)), dtype=kind)
    if not len(key):
        return out.T
    change = np.append(np.uint64(CLASSES), key[1:] ^ key[:-1])
    # bits from the last one that changes against the place before
    depth = np.where(change >= CLASSES, BITS + 1, pick(DEPTH, (change & np.uint64(CLASSES - 1)).astype(np.int64))).astype(np.uint8)
    depth[fresh] = BITS + 1
    some, sums = None, np.append(np.zeros(1, dtype=kind), np.cumsum(counts, dtype=kind))
    for j in range(BITS + 1):
        begins = depth > BITS - j
        i = np.flatnonzero(begins)
        group = np.cumsum(begins) - 1
        total = pick(lengths(pick(sums, i), sums[-1]), group)
        if some is None:
            out[j] = total
        else:
            out[j, some] = total
        alone = lengths(i, len(depth)) == 1  # these stand alone from here on
        if 2 * np.count_nonzero(alone) > len(depth):
            on = np.flatnonzero(~pick(alone, group))
            if some is None:
                out[j + 1 :] = counts
            some = on if some is None else pick(some, on)
            if not len(some):
                break
            depth, counts = pick(depth, on), pick(counts, on)
            sums = np.append(np.zeros(1, dtype=kind), np.cumsum(counts, dtype=kind))
    return out.T


def send_pairs(parts: int, hubs: np.ndarray):
    """For mapInArrow: units to their distinct pairs after no hub, by part: contexts, pairs of each, classes, counts."""

    def run(batches):
        for uid, u in units_of(batches):
            key, _, n, hub = u.pairs(hubs)
            key, n = key[hub < 0], n[hub < 0]
            at = cuts(key, parts)
            for p in np.flatnonzero(np.diff(at)):
                s = slice(at[p], at[p + 1])
                context = key[s] >> np.uint64(CUT)
                i = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                yield row(uid, int(p), pack(steps(context[i]), narrow(np.diff(np.append(i, len(context)))), (key[s] & np.uint64(CLASSES - 1)).astype(np.uint16), narrow(n[s])))

    return run


def count_pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For applyInArrow: a part's pairs to all units' counts on the paths of each unit's pairs.

    A bit for each pair whose context others have too, and for those the counts at level 0 and the
    differences from level to level.
    """
    p, uids, found = key[0].as_py(), [], []
    for batch in batches:
        uids += batch.column("uid").to_pylist()
        found += [unpack(b.as_buffer()) for b in batch.column("blob")]
    every = np.concatenate([(np.repeat(sums(c), n) << np.uint64(BITS)) | of for c, n, of, _ in found])
    unit = np.repeat(np.arange(len(uids)), [len(f[3]) for f in found])
    order = np.argsort(every)
    ordered = every[order]
    n = path_totals(ordered, np.empty(0, dtype=np.int64), np.concatenate([f[3] for f in found]).astype(np.int64)[order])
    first = np.flatnonzero(np.append(True, ordered[1:] >> np.uint64(BITS) != ordered[:-1] >> np.uint64(BITS)))
    least, most = (f.reduceat(unit[order], first) for f in (np.minimum, np.maximum))
    shared = np.empty(len(every), dtype=bool)
    shared[order] = np.repeat(least != most, np.diff(np.append(first, len(every))))
    back = np.empty(len(every), dtype=np.int64)
    back[order] = np.arange(len(every))
    n = n.T
    n[1:] = n[:-1] - n[1:]
    place = 0
    for uid, f in zip(uids, found, strict=True):
        some = shared[place : place + len(f[3])]
        yield row(uid, p, pack(np.packbits(some), narrow(np.take(n, back[place : place + len(f[3])][some], axis=1).reshape(-1)), level=3))
        place += len(f[3])


def add_shared(n: np.ndarray, at: np.ndarray, blobs: dict[int, list[np.ndarray]]) -> np.ndarray:
    """A unit's own counts, by level, on the paths of its pairs, with all units' in place of those whose contexts others have; parts begin at `at`."""
    for p in np.flatnonzero(np.diff(at)):
        bits, found = blobs[int(p)]
        some = at[p] + np.flatnonzero(np.unpackbits(bits, count=at[p + 1] - at[p]))
        found = found.reshape(BITS + 1, -1).astype(n.dtype)
        found[1:] = found[:1] - np.cumsum(found[1:], axis=0, dtype=n.dtype)
        for level, z in zip(n, found, strict=True):
            level[some] = z
    return n


# ---- mixing


class Mixer:
    """Gated weights and the refinement map.

    Inputs are turned so that they speak for the bit that came; a prediction x for it is one of -x
    for the other bit, so each bit counts in the map at x as a hit and at -x as a miss.
    """

    def __init__(self, weights: np.ndarray | None = None, hits: np.ndarray | None = None):
        shape = PREDICTORS, BITS * LEVELS * LEVELS
        self.weights = np.full(shape, 0.4, dtype=np.float32) if weights is None else weights.reshape(shape)
        self.hits = np.zeros((BITS, BINS), dtype=np.float32) if hits is None else hits.reshape(BITS, BINS)
        self.row = np.repeat(np.arange(BITS) * BINS, LEVELS * LEVELS)
        self.finish()

    def mix(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        out = pick(self.weights[0], gate)
        out *= x[0]
        for w, z in zip(self.weights[1:], x[1:], strict=True):
            out += pick(w, gate) * z
        return np.clip(out, -12, 12, out=out)

    def bins(self, logit: np.ndarray):
        place = logit + np.float32(8)
        place *= np.float32((BINS - 1) / 16)
        np.clip(place, 0, np.float32(BINS - 1 - 1e-4), out=place)
        low = place.astype(np.int64)
        place -= np.floor(place)
        return low, place

    def learn(self, x: list[np.ndarray], gate: np.ndarray) -> None:
        """One gradient step; the map counts predictions before it."""
        logit = self.mix(x, gate)
        low, part = self.bins(logit)
        n = self.weights.shape[1]
        low += gate * BINS
        seen = np.bincount(low, minlength=n * BINS).reshape(n, BINS)
        upper = np.bincount(low, weights=part, minlength=n * BINS).reshape(BITS, -1, BINS).sum(axis=1).reshape(-1)
        here = seen.reshape(BITS, -1, BINS).sum(axis=1).reshape(-1) - upper
        here[1:] += upper[:-1]
        self.hits += here.reshape(BITS, BINS)
        error = 1 / (1 + np.exp(logit))
        used = np.sqrt(np.maximum(seen.sum(axis=1), 1))
        for w, z in zip(self.weights, x, strict=True):
            w += (STEP * np.bincount(gate, weights=error * z, minlength=n) / used).astype(np.float32)

    def finish(self) -> None:
        """Rates of the map from its counts; an unseen place keeps the prediction."""
        seen = self.hits + self.hits[:, ::-1]
        self.refined = ((self.hits + 20 / (1 + np.exp(-np.linspace(-8, 8, BINS)))) / (seen + 20)).astype(np.float32)

    def probability(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Probabilities of the bits that came."""
        logit = self.mix(x, gate)
        low, part = self.bins(logit)
        at = pick(self.row, gate) + low
        refined = self.refined.reshape(-1)
        below = pick(refined, at)
        found = below + (pick(refined, at + 1) - below) * part
        return (1 / (1 + np.exp(-logit)) + found) / 2

    def cost(self, x: list[np.ndarray], gate: np.ndarray, n: int | None = None) -> np.ndarray:
        """log10 probability of the bits that came, by class of BITS of them; if n is given, those of n tokens by SHARES."""
        p = self.probability(x, gate)
        return np.log10(np.prod(p.reshape(-1, BITS), axis=1, dtype=np.float64) if n is None else products(p.astype(np.float64), n))


def products(p: np.ndarray, n: int) -> np.ndarray:
    """Products of the bits of each of n tokens by SHARES."""
    out = np.ones(n)
    for width in SHARES:
        some, p = p[: n * width], p[n * width :]
        while len(some) > n:
            some = some[::2] * some[1::2]
        out *= some
    return out


def joined(shares: list[np.ndarray], s: slice = slice(None)) -> np.ndarray:
    """Bits of some tokens by SHARES, one after the other."""
    return np.concatenate([x[s].reshape(-1) for x in shares])


def confidence(n: np.ndarray) -> np.ndarray:
    """How often a bit's context was seen, in LEVELS classes."""
    return (n >= 5).view(np.uint8) + (n >= 31).view(np.uint8) + (n >= 181).view(np.uint8)


def stretched(n: np.ndarray) -> np.ndarray:
    """Counts on paths (m, BITS + 1) to stretched predictions of their bits (m, BITS)."""
    return stretch(n[:, :-1].astype(np.float32), n[:, 1:].astype(np.float32))


def stretch(every: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Stretched predictions of bits, of `every` bit seen `same` being the one that came."""
    return np.log((same + np.float32(PRIOR)) / (every - same + np.float32(PRIOR)))


def stretched_lines(n: np.ndarray) -> np.ndarray:
    """The same in rows of LINE numbers, of which the first BITS are meant."""
    n = n.astype(np.float32)
    every, same, out = n.reshape(-1)[:-1], n.reshape(-1)[1:], np.zeros_like(n)
    with np.errstate(invalid="ignore", divide="ignore"):  # from row to row
        out.reshape(-1)[:-1] = stretch(every, same)
    return out


class Totals:
    """What all tasks know of all learning documents: counts by class, by guide and class and by hub and class, on paths; distinct words by class; spellings."""

    def __init__(self, by_class: np.ndarray, words: np.ndarray, spelling: np.ndarray, guides: np.ndarray, guided: np.ndarray, hubs: np.ndarray, after: np.ndarray):
        self.kind = np.int32 if by_class.sum() < 2**31 else np.int64
        self.words, self.spelling, self.guides = words, Spelling(spelling), guides
        self.by_class = by_class
        paths = np.stack([np.repeat(by_class.reshape(1 << j, -1).sum(axis=1), CLASSES >> j) for j in range(BITS + 1)], axis=1)
        self.plain = stretched(paths)  # predictions without a context
        self.plain_shares = [np.ascontiguousarray(x) for x in np.split(self.plain, np.cumsum(SHARES)[:-1], axis=1)]
        self.hubs = hubs
        self.nodes, self.hub_nodes = self.nodes_of(guided), self.nodes_of(after)

    def nodes_of(self, table: np.ndarray) -> np.ndarray:
        """For each context of a table by context and class: node 2^j + the first j bits of a class."""
        n = len(table) // CLASSES
        nodes = np.zeros((n, 2 * CLASSES), dtype=self.kind)
        for j in range(BITS + 1):
            nodes[:, 1 << j : 2 << j] = table.reshape(n, 1 << j, CLASSES >> j).sum(axis=2)
        return nodes.reshape(-1)

    def level(self, nodes: np.ndarray, place: np.ndarray, j: int) -> np.ndarray:
        """Counts at level j for places in a table by context and class."""
        of = place & (CLASSES - 1)
        return pick(nodes, ((place - of) << 1) + ((of + CLASSES) >> (BITS - j)))

    def guided(self, key: np.ndarray) -> np.ndarray:
        """(n, BITS + 1) for guides with classes."""
        return np.stack([self.level(self.nodes, key.astype(np.int64), j) for j in range(BITS + 1)], axis=1)

    @cached_property
    def guided_lines(self) -> np.ndarray:
        """A row of LINE numbers for each guide and class; made where it is used, not sent."""
        out = np.zeros((len(self.nodes) // 2, LINE), dtype=self.kind)
        place = np.arange(len(out))
        for j in range(BITS + 1):
            out[:, j] = self.level(self.nodes, place, j)
        return out


def slices(begin: np.ndarray, most: int = 1 << 17):
    """Ranges of texts with about `most` tokens."""
    i = 0
    while i + 1 < len(begin):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + most, side="right")) - 1)
        yield i, j
        i = j


class Inputs:
    """What the mixer is given for a unit's tokens; shared, if given, turns the unit's own counts, by level, on the paths of pairs after no hub to those to go by."""

    def __init__(self, u: Unit, totals: Totals, shared: Callable | None = None):
        self.u, self.totals = u, totals
        self.guided, self.guided_key = u.guided(totals.guides).astype(np.int64), np.arange(len(totals.nodes) // 2, dtype=np.uint64)
        self.key, self.pair, n, hub = u.pairs(totals.hubs)
        some, others = np.flatnonzero(hub >= 0), np.flatnonzero(hub < 0)
        rest = path_totals(self.key[others], np.empty(0, dtype=np.int64), n[others], totals.kind).T
        if shared is not None:
            rest = shared(self.key[others], rest)
        place = (hub[some] << BITS) | (self.key[some] & np.uint64(CLASSES - 1)).astype(np.int64)
        levels = np.empty((BITS + 1, len(self.key)), dtype=totals.kind)
        for j in range(BITS + 1):
            levels[j, some], levels[j, others] = totals.level(totals.hub_nodes, place, j), rest[j]
        self.pairs = np.zeros((len(self.key), LINE), dtype=totals.kind)
        for a in range(0, len(self.key), 4096):
            self.pairs[a : a + 4096, : BITS + 1] = levels[:, a : a + 4096].T

    def ordered(self, z: np.ndarray, s: slice, n: int):
        """A slice's tokens, from 0, in order of text and something else, below n; what is in order."""
        doc = self.u.doc[s]
        return in_order(((doc - doc[0]) << n.bit_length()) | z[s])

    def of(self, s: slice) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
        """Predictions and gates of the bits of a slice that holds whole texts, by SHARES."""
        x = [[np.empty((s.stop - s.start, width), dtype=np.float32) for width in SHARES] for _ in range(PREDICTORS - 1)]
        gate = [np.empty((s.stop - s.start, width), dtype=np.uint8) for width in SHARES]
        begin = self.u.begin[np.searchsorted(self.u.begin, s.start) : np.searchsorted(self.u.begin, s.stop) + 1]
        for i, j in slices(begin, STRETCH):
            some = slice(int(begin[i]), int(begin[j]))
            here = slice(some.start - s.start, some.stop - s.start)
            for k, (z, key, lines) in enumerate(((self.guided, self.guided_key, self.totals.guided_lines), (self.pair, self.key, self.pairs))):
                token, both = self.ordered(z, some, len(key))
                first = starts(both)  # the different ones of each text
                at = np.empty(len(token), dtype=np.int64)
                at[token] = np.repeat(np.arange(len(first)), lengths(first, len(token)))
                one = some.start + pick(token, first)
                place = pick(z, one)
                n = pick_lines(lines, place)
                doc = self.u.doc[one]
                own = path_totals(pick(key, place), starts(doc), lengths(first, len(token)) * self.u.learns[doc], n.dtype).T
                for j, level in enumerate(own):
                    n[:, j] -= level
                level = confidence(n)
                if k == 0:
                    level = level * np.uint8(LEVELS) + np.tile(np.arange(LINE, dtype=np.uint8) * np.uint8(LEVELS * LEVELS), (len(level), 1))
                found, begin_share = stretched_lines(n), 0
                for share, width in enumerate(SHARES):
                    unit = min(width, 4)
                    picked = places(at, LINE // unit, begin_share // unit, width // unit)
                    x[k][share][here] = pick(found.reshape(-1, unit), picked).reshape(-1, width)
                    gates = pick(level.reshape(-1, unit), picked).reshape(-1, width)
                    gate[share][here] = gate[share][here] + gates if k else gates
                    begin_share += width
        return x, gate

    def bits(self, s: slice, x: list[list[np.ndarray]], gate: list[np.ndarray], step: int):
        """Of some tokens of a slice at a time: what the mixer takes, bits by SHARES."""
        of = classes(self.u.t[s]).astype(np.int64)
        for a in range(0, len(of), step):
            at = slice(a, a + step)
            yield at, [joined([pick(z, of[at]) for z in self.totals.plain_shares]), *(joined(z, at) for z in x)], joined(gate, at).astype(np.int64)


def fit(totals):
    """For mapInArrow: all texts (rid, learns, text) of the sample, in one task, to weights and counts of the map."""

    def run(batches):
        groups = [(part.column("rid").to_numpy(), np.diff(offsets), buf.copy()) for part, buf, offsets in text_groups(batches)]
        mixer = Mixer()
        if groups:
            rid, sizes, buf = (np.concatenate([g[k] for g in groups]) for k in range(3))
            u = Unit(rid, np.ones(len(rid)), sizes, buf)
            u.tokens(spans=False)
            inputs = Inputs(u, totals.value)
            for i, j in slices(u.begin):
                s = slice(int(u.begin[i]), int(u.begin[j]))
                for _, x, gate in inputs.bits(s, *inputs.of(s), BATCH):
                    mixer.learn(x, gate)
        yield row(0, 0, pack(mixer.weights.reshape(-1), mixer.hits.reshape(-1)))

    return run


def fit_units(totals, start, chosen):
    """For mapInArrow: units to what their learning texts make of the weights at the start and of the map, chosen ones left out: weights times tokens, map, tokens, as whole numbers."""

    def run(batches):
        weights, hits = start.value
        left_out = chosen.value
        for uid, u in units_of(batches):
            u = u.only(u.learns & (np.diff(u.rid, prepend=~u.rid[:1]) != 0) & ~is_one(u.rid, left_out))
            if not len(u.rid):
                continue
            mixer = Mixer(weights.copy(), np.zeros_like(hits))
            inputs = Inputs(u, totals.value)
            for i, j in slices(u.begin):
                s = slice(int(u.begin[i]), int(u.begin[j]))
                for _, x, gate in inputs.bits(s, *inputs.of(s), BATCH):
                    mixer.learn(x, gate)
            parts = mixer.weights.reshape(-1) * float(len(u.t)) * WEIGHT_UNIT, mixer.hits.reshape(-1) * HIT_UNIT, [len(u.t)]
            yield row(0, uid % 64, pack(*(np.rint(x).astype(np.int64) for x in parts)))

    return run


def score_unit(u: Unit, totals: Totals, mixer: Mixer, counts: np.ndarray, shared: Callable) -> dict[str, np.ndarray]:
    """Sums for each text of a unit, given all learning documents' counts of its distinct words and what turns its own counts on the paths of pairs after no hub to all units'."""
    _, word, _ = u.counted()
    inputs = Inputs(u, totals, shared)
    cost = np.empty(len(u.t))
    for i, j in slices(u.begin):
        s = slice(int(u.begin[i]), int(u.begin[j]))
        token, both = inputs.ordered(word, s, len(counts))  # classes are in order too
        first = starts(both)  # different words of each text
        size = lengths(first, len(token))
        one = s.start + token[first]
        own, of, of_doc = u.learns[u.doc[one]], classes(u.t[one]).astype(np.int64), u.doc[one]
        left = counts[word[one]] - size * own
        group = np.cumsum(np.append(False, (of[1:] != of[:-1]) | (of_doc[1:] != of_doc[:-1])))
        # words that no other learning text has don't count as distinct words of their class
        distinct = totals.words[of] - np.bincount(group, weights=own & (left == 0))[group]
        tokens = totals.by_class[of] - np.bincount(group, weights=size)[group] * own
        share = np.log10(np.where(left > 0, left, distinct + 1) / (tokens + distinct + 1))
        unknown = np.flatnonzero(left == 0)
        if len(unknown):
            w, back = np.unique(word[one[unknown]], return_inverse=True)
            share[unknown] += totals.spelling.cost(u.buf, u.spans[0][w], u.spans[1][w])[back]
        cost[s][token] = np.repeat(share, size)
        for at, x, gate in inputs.bits(s, *inputs.of(s), 1 << 12):
            cost[s][at] += mixer.cost(x, gate, len(cost[s][at]))
    of_words = counts > 0, np.log10(counts + 1.0), u.spans[1] - u.spans[0] + 1
    known, logs, size, score = (np.add.reduceat(x, u.begin[:-1]) for x in (*(pick(x.astype(np.float64), word) for x in of_words), cost))
    return {"rid": u.rid, "n_tokens": np.diff(u.begin), "n_known": np.rint(known).astype(np.int64), "logs": logs, "score": score, "size": np.rint(size).astype(np.int64)}


def score_units(parts: int, totals, mixer):
    """For applyInArrow: a unit with its counts to sums for each text; kind is 0 for texts, 1 for words, 2 for pairs."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, words, found = None, {}, {}
        for batch in batches:
            for kind, p, blob in zip(batch.column("kind").to_pylist(), batch.column("p").to_pylist(), batch.column("blob"), strict=True):
                x = unpack(blob.as_buffer())
                if kind == 0:
                    unit = Unit.of_words(*x)
                elif kind == 1:
                    words[p] = x[0]
                else:
                    found[p] = x
        counts = np.concatenate([words[p] for p in sorted(words)]).astype(np.int64)
        out = score_unit(unit, totals.value, mixer.value, counts, lambda keys, n: add_shared(n, cuts(keys, parts), found))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out.values()], list(out))
        trim()

    return run


def first_texts(d: DataFrame) -> list[int]:
    """Row ids of the learning texts of d (rid, learns, text) that the fit begins with."""
    learning = d.where("learns")
    first = learning.select("rid", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).where(F.col("size") <= SAMPLE_BYTES)
    first = first.groupBy("rid").agg(F.max("size").alias("size")).orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE_TEXTS).collect()
    chosen, room = [], SAMPLE_BYTES
    for r in first:
        if r["size"] <= room:
            chosen.append(r["rid"])
            room -= r["size"]
    return chosen


def fitted(d: DataFrame, totals, chosen: list[int] | None = None) -> Mixer:
    """The mixer after the learning texts of d (rid, learns, text) that the fit begins with."""
    learning = d.where("learns")
    chosen = first_texts(d) if chosen is None else chosen
    if not chosen:
        return Mixer()
    chosen = d.sparkSession.createDataFrame([(x,) for x in chosen], "rid long")
    some = learning.join(F.broadcast(chosen), "rid", "left_semi").dropDuplicates(["rid"]).repartition(1).sortWithinPartitions("rid")
    return Mixer(*unpack(some.mapInArrow(fit(totals), ROW).collect()[0]["blob"]))


def fitted_on_all(d: DataFrame, units: DataFrame, totals) -> Mixer:
    """The mixer after all learning texts: the first ones' weights, from which each unit goes on by itself, averaged by tokens; the map's counts of all."""
    spark = d.sparkSession
    chosen = first_texts(d)
    mixer = fitted(d, totals, chosen)
    start = spark.sparkContext.broadcast((mixer.weights, mixer.hits))
    rows = units.mapInArrow(fit_units(totals, start, spark.sparkContext.broadcast(np.sort(np.array(chosen, dtype=np.int64)))), ROW)
    weights, hits, n = total_of(rows, mixer.weights.size, mixer.hits.size, 1)
    if not n[0]:
        return mixer
    return Mixer((weights / (float(n[0]) * WEIGHT_UNIT)).astype(np.float32), mixer.hits.reshape(-1) + hits / HIT_UNIT)


def score(docs: DataFrame, learns: Column, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), unit_bytes: int = UNIT_BYTES, part_bytes: int = PART_BYTES, hubs: int = HUBS) -> DataFrame:
    """(key, *keep, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of docs.

    learns tells which rows the model may learn from. bits_per_byte is over the bytes that are
    coded: those of the words and one after each.
    """
    spark = docs.sparkSession
    ship(spark)
    rid = F.xxhash64(F.col(key), F.col(text))
    d = docs.select(rid.alias("rid"), F.coalesce(learns, F.lit(False)).alias("learns"), F.col(text).alias("text"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).collect()[0][0]
    group = F.when(F.octet_length("text") > unit_bytes, F.col("rid")).otherwise(F.pmod(F.xxhash64("rid"), F.lit(1 + n_bytes // unit_bytes)))
    grouped = d.select(group.alias("group"), "*").repartition(int(1 + n_bytes // DEALT_BYTES), "group").sortWithinPartitions("group", "rid")
    units = stage(grouped.mapInArrow(make_units(unit_bytes), ROW), "units")
    n_units = units.count()
    parts = 1 + n_bytes // part_bytes

    words = units.mapInArrow(send_words(parts), ROW).repartition(parts, "p").groupBy("p")
    words = stage(words.applyInArrow(count_words, ROW), "words")
    by_class, distinct = total_of(words.where("uid = -1"), CLASSES, CLASSES)
    n_tokens, n_words = int(by_class.sum()), int(distinct.sum())
    frequent = gathered(words.where("uid = -2"), join_frequent)
    common = most_frequent(*(np.concatenate([f[k] for f in frequent] or [np.empty(0, dtype=np.uint64)]) for k in range(2)))[0]
    guides, hubs, common = np.sort(common[:GUIDES]), np.unique(context_of(np.append(common[:hubs], np.uint64(1)))), np.sort(common)
    guided, after, spelling = total_of(units.mapInArrow(count_guided(guides, hubs, common), ROW), (GUIDES + 1) * CLASSES, len(hubs) * CLASSES, SPELLING)
    totals = spark.sparkContext.broadcast(Totals(by_class, distinct, spelling, guides, guided, hubs, after))
    mixer = spark.sparkContext.broadcast(fitted_on_all(d, units, totals))

    pairs = units.mapInArrow(send_pairs(parts, hubs), ROW).repartition(parts, "p").groupBy("p").applyInArrow(count_pairs, ROW)
    kinds = [x.withColumn("kind", F.lit(i)) for i, x in enumerate((units, words.where("uid >= 0"), pairs))]
    together = kinds[0].unionAll(kinds[1]).unionAll(kinds[2]).repartition(max(1, 2 * n_units), "uid").groupBy("uid")
    sums = together.applyInArrow(score_units(parts, totals, mixer), "rid long, n_tokens long, n_known long, logs double, score double, size long")
    # rows repeated in full share a rid and have equal sums
    sums = stage(sums.groupBy("rid").agg(*[F.avg(c).alias(f"__lm_{c}") for c in ("n_tokens", "n_known", "logs", "score", "size")]), "scores")
    drop_staged(spark, units, words)

    out = docs.select(F.col(key), *[F.col(k) for k in keep], rid.alias("__lm_rid")).join(sums, F.col("__lm_rid") == F.col("rid"))
    whole = lambda c: F.round(F.col(f"__lm_{c}")).cast("long")
    base = F.col("__lm_logs") - F.col("__lm_n_tokens") * F.lit(math.log10(n_tokens + n_words + 1))
    return out.select(
        key, *keep, whole("n_tokens").alias("n_tokens"), whole("n_known").alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), F.col("__lm_score").alias("score"), (-F.col("__lm_score") * math.log2(10) / F.col("__lm_size")).alias("bits_per_byte"),
    )
