"""Removal of every byte that a repeated string of `length` bytes covers.

Windows of `length` bytes are dealt out by the smallest hash among their `GRAM`-byte substrings
(the first of equal ones), which equal windows share wherever they stand. Runs of neighbouring
windows with one smallest substring form pieces; pieces whose substring occurs elsewhere are
candidates. A substring in very many different pieces is hot: its pieces are cut by the distance
from window to substring, eight distances to a part, and dealt by substring, distance and the
bytes that all windows of the part share, so that parts with the same surroundings collapse to one
text with a count. Text of each different piece is then cut once. From how many pieces a substring
is hot doesn't depend on the input; up to SENT hot ones are sent to all tasks, more are joined to
the rows that hold them.

In a shard the texts are joined and sorted by suffix to a depth of at least `length`: by 8 bytes, then ties
at three times the depth in each step (two in shards of 2 MB or more). On the Burrows-Wheeler transform
intervals of patterns are extended to the left breadth-first, from the patterns of up to 8 bytes that the first sort shows: all
patterns of length l give the boundaries whose common prefix is l, so common prefixes are found by
increasing value, and the search stops at `length`. Boundaries that are still unset separate
suffixes that share `length` bytes or more. A window is repeated if its group has two
occurrences, counting copies of equal pieces.

Windows never cross texts, and every row counts by itself: equal rows repeat each other. 64-bit
hashes stand for substrings when windows are dealt out and when equal pieces are counted.

Defined results: null text is empty; texts shorter than `length` are kept whole; repeated rows and
null ids are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, ship, stage
from .hashing import Rolling, mixed, text_groups

LENGTH = 200
GRAM = 32
PART = 8
#: A substring in more different pieces is hot; more hot ones than SENT are dealt out by a join, each to SALTS places.
HOT = 512
SENT = 1 << 16
SALTS = 32
SHARD_BYTES = 1 << 20
#: Places, and intervals of suffixes, that are handled at once.
STEP = 1 << 13
EXPANDED = 1 << 22


def runs(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Pieces of the texts: (row, first window, last window, position of the substring, its hash, rolling hashes)."""
    rolling = Rolling(buf)
    h = rolling.grams(gram)
    none = np.empty(0, dtype=np.int64)
    if len(buf) < length:
        return none, none, none, none, np.empty(0, dtype=np.uint64), rolling
    w, m = length - gram + 1, len(h)
    # the hash's upper half with the position below: the minimum is the first of the smallest
    least = np.empty(m - w + 1, dtype=np.uint64)
    for a in range(0, len(least), STEP):
        b = min(len(least), a + STEP)
        x = (h[a : b + w - 1] & np.uint64(0xFFFFFFFF00000000)) | np.arange(a, b + w - 1, dtype=np.uint64)
        least[a:b] = sliding_min(x, w)
    # windows that lie in one text, and those where a piece begins and ends
    sizes = np.diff(offsets)
    inside = np.maximum(sizes - length + 1, 0)
    within = np.repeat(np.tile([True, False], len(sizes)), np.stack([inside, sizes - inside], axis=1).ravel())[: len(least)]
    same = (least[1:] == least[:-1]) & within[1:] & within[:-1]
    i = np.flatnonzero(within & ~np.append(False, same))
    last = np.flatnonzero(within & ~np.append(same, False))
    p = (least[i] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return np.searchsorted(offsets, i, side="right") - 1, i, last, p, h[p], rolling


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from those of 1, 2, 4, ... of them."""
    n, size = len(x) - w + 1, 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def content(rolling: Rolling, first, last, p, length: int):
    """Hash of a piece's text and of where the substring stands in it."""
    return mixed(rolling.of(first, last + length) + (p - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def count_pieces(length: int):
    """For mapInArrow: text to (h, c, n), pieces of a group of texts counted."""

    def run(batches):
        for _, buf, offsets in text_groups(batches):
            _, first, last, p, h, rolling = runs(buf, offsets, length)
            both = np.stack([h, content(rolling, first, last, p, length)], axis=1) if len(h) else np.empty((0, 2), dtype=np.uint64)
            order = np.lexsort((both[:, 1], both[:, 0]))
            both = both[order]
            new = np.ones(len(both), dtype=bool)
            new[1:] = (both[1:] != both[:-1]).any(axis=1)
            i = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([signed(both[i, 0]), signed(both[i, 1]), pa.array(np.diff(np.concatenate([i, [len(both)]])), pa.int64())], ["h", "c", "n"])

    return run


def list_pieces(length: int, hot=None):
    """For mapInArrow: (rid, text) to (rid, first, last, h, key, c); pieces of hot substrings in parts.

    hot is sent, or each row has its own hot substrings in a column `hot`.
    """

    def run(batches):
        sent = None if hot is None else np.sort(np.array(hot.value, dtype=np.int64).view(np.uint64))
        for part, buf, offsets in text_groups(batches):
            row, first, last, p, h, rolling = runs(buf, offsets, length)
            if not len(h):
                continue
            known = np.unique(part.column("hot").flatten().to_numpy(zero_copy_only=False).view(np.uint64)) if sent is None else sent
            key = h
            if len(known):
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                is_hot = known[i] == h
                if is_hot.any():
                    row, first, last, p, h, key = cut(row, first, last, p, h, is_hot, rolling, length)
            rid = part.column("rid").to_numpy(zero_copy_only=False)
            base = offsets[row]
            c = content(rolling, first, last, p, length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[row], pa.int64()), pa.array(first - base, pa.int64()), pa.array(last - base, pa.int64()), signed(h), signed(key), signed(c)],
                ["rid", "first", "last", "h", "key", "c"],
            )

    return run


def list_held(length: int):
    """For mapInArrow: (rid, text) to (rid, h), the different substrings that deal out a row's pieces."""

    def run(batches):
        for part, buf, offsets in text_groups(batches):
            row, _, _, _, h, _ = runs(buf, offsets, length)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            rid = part.column("rid").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(rid[row[new]], pa.int64()), signed(h[new])], ["rid", "h"])

    return run


def cut(row, first, last, p, h, is_hot, rolling, length):
    """Replace hot pieces by their parts, with keys of their own."""
    i = np.flatnonzero(is_hot)
    g_most, g_least = (p[i] - first[i]) // PART, (p[i] - last[i]) // PART
    n = g_most - g_least + 1
    j = np.repeat(i, n)
    g = np.repeat(g_most, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    a = np.maximum(first[j], p[j] - PART * g - PART + 1)
    b = np.minimum(last[j], p[j] - PART * g)
    shared = rolling.of(p[j] - PART * g, p[j] - PART * g - PART + 1 + length)
    keys = mixed(h[j] * np.uint64(0xE7037ED1A0B428DB) + shared + g.astype(np.uint64))
    rest = np.flatnonzero(~is_hot)
    join = lambda x, y: np.concatenate([x[rest], y])
    return join(row, row[j]), join(first, a), join(last, b), join(p, p[j]), join(h, h[j]), join(h, keys)


def cut_text(length: int):
    """For mapInArrow: (text, at) to (key, c, m, piece)."""

    def run(batches):
        for part, buf, offsets in text_groups(batches):
            raw, row, (first, last, key, c, m) = buf.tobytes(), *listed_rows(part.column("at"))
            first, last = (x.to_numpy() + offsets[row] for x in (first, last))
            pieces = [raw[a:b] for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([key, c, m, pa.array(pieces, pa.binary())], ["key", "c", "m", "piece"])

    return run


def listed_rows(lists: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Of a column of lists of structs the row of each struct and the structs' fields."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), lists.flatten().flatten()


def leading(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number, zeros beyond the end."""
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(buf),), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)


def suffix_order(buf: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first bytes, at least depth of them; only ties are sorted again, at two or three times the depth."""
    n = len(buf)
    key = leading(buf)
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # ranks from 1, 0 beyond the end; three of up to 21 bits go into one key
    rank = np.zeros(n + 1, dtype=np.int32 if n < (1 << 31) - 1 else np.int64)
    rank[order] = start + 1
    done, bits = 8, 21 if n < (1 << 21) - 1 else 32
    while done < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        s = order[slots]
        key = rank[s].astype(np.int64) << bits | rank[np.minimum(s + done, n)]
        if bits == 21:
            key = key << bits | rank[np.minimum(s + 2 * done, n)]
        by = np.argsort(key)
        s, key = s[by], key[by]
        order[slots] = s
        fresh = np.ones(len(s), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        new[slots] |= fresh
        rank[s] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))] + 1
        done *= 3 if bits == 21 else 2
    return order


def expand(lb: np.ndarray, rb: np.ndarray):
    """All rows of the intervals, and for each the interval it belongs to."""
    n = rb - lb
    which = np.repeat(np.arange(len(lb)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lb[which], which


def boundaries(bwt: np.ndarray, length: int, first: np.ndarray | None = None) -> np.ndarray:
    """Whether each suffix shares less than length bytes with the one before it.

    bwt holds the byte before each suffix in sorted order. The children of an interval [lb, rb)
    are, for each byte in it, the suffixes that byte precedes: from the rank of its first to that
    of its last occurrence. An interval is followed up only if its right end is a new boundary.
    With the suffixes' first 8 bytes, in order, the search begins with the patterns of up to 8 bytes.
    """
    n = len(bwt)
    listed = np.argsort(bwt, kind="stable")  # occurrences by byte; the place in this list is the row that an extension leads to
    to = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    to[listed] = np.arange(n)
    starts = np.append(0, np.cumsum(np.bincount(bwt, minlength=256)))
    seen = np.zeros(n + 1, dtype=bool)
    seen[0] = seen[n] = True
    lb, rb = np.array([0]), np.array([n])
    done = 0
    if first is not None:
        done = min(8, length)
        change = (first[1:] ^ first[:-1]) >> np.uint64(64 - 8 * done)
        edges = np.flatnonzero(change) + 1
        seen[edges] = True
        # the patterns of this length that agree with the next one but for the last byte
        some = change[edges - 1] < 256
        lb, rb = np.append(0, edges[:-1])[some], edges[some]
    for _ in range(done, length):
        size = rb - lb
        wide = size > 256
        firsts, lasts = [], []
        if wide.any() and size[wide].sum() > 50_000:
            wl, wr = lb[wide], rb[wide]
            for byte in np.flatnonzero(np.diff(starts)):
                block = listed[starts[byte] : starts[byte + 1]]
                a, b = np.searchsorted(block, wl), np.searchsorted(block, wr)
                firsts.append(a[b > a] + starts[byte])
                lasts.append(b[b > a] + starts[byte] - 1)
            lb, rb = lb[~wide], rb[~wide]
            size = size[~wide]
        one = size == 1
        single = to[lb[one]]
        firsts.append(single)
        lasts.append(single)
        lb, rb = lb[~one], rb[~one]
        for a in range(0, len(lb), EXPANDED):
            q, which = expand(lb[a : a + EXPANDED], rb[a : a + EXPANDED])
            key = np.sort((which << 8 | bwt[q]) << 32 | to[q])
            at = np.flatnonzero(np.append(True, key[1:] >> 32 != key[:-1] >> 32))
            firsts.append((key[at] & 0xFFFFFFFF).astype(to.dtype))
            lasts.append((key[np.append(at[1:], len(key)) - 1] & 0xFFFFFFFF).astype(to.dtype))
        # intervals of patterns of one length don't overlap, so both ends sort alike
        lb, rb = np.sort(np.concatenate(firsts)), np.sort(np.concatenate(lasts)) + 1
        new = ~seen[rb]
        lb, rb = lb[new], rb[new]
        if not len(rb):
            break
        seen[rb] = True
    return seen[:n]


def hits(pieces: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each window occurs twice or more, a piece counting counts times, in one array with gaps; where each piece's begin, how many they are."""
    sizes = np.array([len(x) for x in pieces], dtype=np.int64)
    # no UTF-8 text holds the byte 0xFF
    buf = np.frombuffer(b"\xff".join(pieces) + b"\xff", dtype=np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_order(buf, length)
    group = np.flatnonzero(boundaries(buf[order - 1], length, leading(buf)[order]))
    windows = sizes - length + 1
    weight = np.repeat(np.stack([counts, np.zeros_like(counts)], axis=1).ravel(), np.stack([windows, np.full_like(windows, length)], axis=1).ravel())
    total = np.add.reduceat(weight[order], group)
    hit = np.empty(len(buf), dtype=bool)
    hit[order] = np.repeat(total >= 2, np.diff(np.append(group, len(buf))))
    return hit & (weight > 0), begin, windows


def repeated(pieces: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each piece whether each of its windows occurs twice or more, a piece counting counts times."""
    hit, begin, windows = hits(pieces, counts, length)
    return [hit[a : a + n] for a, n in zip(begin, windows, strict=True)]


def spans(hit: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Pieces with repeated windows, and for each the first and last window of each run of them, one after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
    which = np.searchsorted(begin, edge[:, 0], side="right") - 1
    runs_ = (edge - begin[which, None] - [0, 1]).astype(np.int32)
    i = np.flatnonzero(np.diff(which, prepend=-1))
    at = np.append(i, len(which)).astype(np.int32) * np.int32(8)
    return which[i], pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(at), pa.py_buffer(runs_)])


def search_shards(length: int):
    """For mapInArrow over rows sorted by key: (key, c, m, piece) to (key, c, spans) of repeated windows."""

    def result(held):
        key, c, m = (np.concatenate([h[k] for h in held]) for k in range(3))
        hit, begin, _ = hits(list(chain.from_iterable(h[3] for h in held)), m, length)
        keep, found = spans(hit, begin)
        return pa.RecordBatch.from_arrays([pa.array(key[keep], pa.int64()), pa.array(c[keep], pa.int64()), found], ["key", "c", "spans"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            c, m = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("c", "m"))
            piece = batch.column("piece").to_pylist()
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if size >= SHARD_BYTES and keys[a] != last:
                    yield result(held)
                    held, size = [], 0
                held.append((keys[a:b], c[a:b], m[a:b], piece[a:b]))
                size += sum(map(len, piece[a:b]))
                last = keys[a]
        if held:
            yield result(held)

    return run


def cover(marks: pa.Array, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal covered byte ranges of texts in one buffer, from lists of (first window of a piece, spans in it): row, begin, end."""
    row, (first, found) = listed_rows(marks)
    ends = np.frombuffer(b"".join(found.to_pylist()), dtype=np.int32).astype(np.int64).reshape(-1, 2)
    n = pc.binary_length(found).to_numpy(zero_copy_only=False) // 8
    # one byte between the texts keeps their ranges apart
    apart = offsets + np.arange(len(offsets))
    ends += np.repeat(first.to_numpy() + apart[row], n)[:, None]
    ends = ends[np.argsort(ends[:, 0], kind="stable")]
    a, b = ends[:, 0], np.maximum.accumulate(ends[:, 1] + length)
    i = np.flatnonzero(np.append(True, a[1:] > b[:-1])[: len(a)])
    a, b = a[i], b[np.append(i[1:], len(a))[: len(i)] - 1]
    row = np.searchsorted(apart, a, side="right") - 1
    return row, a - row, b - row


def remove(names: list[str], length: int, kept_text: bool):
    """For mapInArrow: the input's columns, text and marks to the columns and counts (and the remaining text)."""

    def run(batches):
        for part, buf, offsets in text_groups(batches, "__sd_text"):
            row, a, b = cover(part.column("__sd_marks"), offsets, length)
            n_spans = np.bincount(row, minlength=part.num_rows)
            ranges = np.concatenate([[0], np.cumsum(n_spans)])
            gone = np.concatenate([[0], np.cumsum(b - a)])[ranges]
            edge = np.zeros(len(buf) + 1, dtype=np.int8)
            edge[a] += 1
            edge[b] -= 1
            left = buf[np.cumsum(edge[:-1], dtype=np.int8) == 0]
            if kept_text:
                # a window may start or end within a character, of which the rest goes from the text; halves of two don't make one
                kept, raw = [], buf.tobytes()
                for i in range(part.num_rows):
                    s = slice(ranges[i], ranges[i + 1])
                    kept.append("".join(raw[x:y].decode("utf-8", "ignore") for x, y in zip([offsets[i], *b[s]], [*a[s], offsets[i + 1]], strict=True)))
            else:
                at = (offsets - gone).tolist()
                kept = [hashlib.sha256(left[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(len(names))), *(pa.array(x, pa.int64()) for x in (np.diff(offsets), np.diff(gone), n_spans)), pa.array(kept, pa.string())],
                [*names, "__sd_n_bytes", "__sd_n_removed", "__sd_n_spans", "__sd_kept"],
            )

    return run


def with_hot(d: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """(rid, text, hot) for the rows of d: the substrings of hot that deal out pieces of the row."""
    salt = F.pmod("rid", F.lit(SALTS))
    held = d.mapInArrow(list_held(length), "rid long, h long").withColumn("salt", salt)
    dealt = hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    own = held.join(dealt, ["h", "salt"]).groupBy("rid").agg(F.collect_set("h").alias("hot"))
    return d.join(own.hint("shuffle_hash"), "rid", "left").select("rid", "text", "hot")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, kept_text: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs, __sd_n_bytes, __sd_n_removed, __sd_n_spans and __sd_kept.

    __sd_kept is the remaining text without characters cut in two, or, if kept_text is false, the
    SHA-256 in hex of all remaining bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    names = docs.columns if keep is None else keep
    rid = F.xxhash64(F.col(key), F.col(text))
    d = docs.select(rid.alias("rid"), F.col(text).alias("text")).where(F.octet_length("text") >= length)

    counted = d.select("text").mapInArrow(count_pieces(length), "h long, c long, n long").groupBy("h", "c").agg(F.sum("n").alias("n"))
    repeats = stage(counted.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("pieces")).where("n >= 2").select("h", "pieces"), "repeats")
    hot = repeats.where(F.col("pieces") > HOT).select("h")
    any_hot = hot.count()
    schema = "rid long, first long, last long, h long, key long, c long"
    if any_hot <= SENT:
        listed = d.mapInArrow(list_pieces(length, spark.sparkContext.broadcast([r["h"] for r in hot.collect()])), schema)
    else:
        listed = with_hot(d, hot, length).mapInArrow(list_pieces(length), schema)
    listed = stage(listed.join(repeats.select("h"), "h").select("rid", "first", "last", "key", "c"), "pieces")
    different = listed.groupBy("key", "c").agg(F.count("*").alias("m"), F.min(F.struct("rid", "first", "last")).alias("at"))
    if any_hot:
        keys = listed.groupBy("key").agg(F.count("*").alias("n")).where("n >= 2").select("key")
        different = different.join(keys, "key")
    wanted = different.groupBy(F.col("at.rid").alias("rid")).agg(F.collect_list(F.struct(F.col("at.first").alias("first"), F.col("at.last").alias("last"), "key", "c", "m")).alias("at"))
    # of rows repeated in full each would cut the same pieces
    texts = d.join(wanted.hint("shuffle_hash"), "rid").select("text", "at")
    cuts = texts.mapInArrow(cut_text(length), "key long, c long, m long, piece binary")
    found = cuts.repartition("key").sortWithinPartitions("key", "c").mapInArrow(search_shards(length), "key long, c long, spans binary")
    found = stage(found.dropDuplicates(["key", "c"]), "spans")
    drop_staged(spark, repeats)

    marks = listed.join(found, ["key", "c"]).groupBy("rid").agg(F.collect_list(F.struct("first", "spans")).alias("__sd_marks"))
    all_docs = docs.select(*[F.col(c) for c in names], F.col(text).alias("__sd_text"), rid.alias("__sd_rid"))
    all_docs = all_docs.join(marks.withColumnRenamed("rid", "__sd_rid").hint("shuffle_hash"), "__sd_rid", "left").select(*names, "__sd_text", "__sd_marks")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in all_docs.schema.fields[: len(names)])
    return all_docs.mapInArrow(remove(names, length, kept_text), f"{schema}, __sd_n_bytes long, __sd_n_removed long, __sd_n_spans long, __sd_kept string")
