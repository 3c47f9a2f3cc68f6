import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tensorloom.llm import suffix_dedup as S


def windows(texts, length):
    """Whether each window occurs twice or more in all texts."""
    c = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [np.array([c[t[i : i + length]] > 1 for i in range(len(t) - length + 1)], dtype=bool) for t in texts]


def removed(texts, length):
    out = []
    for t, hit in zip(texts, windows(texts, length), strict=True):
        cover = np.zeros(len(t), dtype=bool)
        for i in np.flatnonzero(hit):
            cover[i : i + length] = True
        n = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((len(t), int(cover.sum()), n, hashlib.sha256(bytes(np.frombuffer(t, dtype=np.uint8)[~cover])).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_shard_against_enumeration(seed):
    rng = random.Random(seed)
    length = rng.choice([1, 3, 5, 8, 20])
    bases = [bytes(rng.choices(rng.choice([b"ab", b"abcdefgh ", b"\x00a"]), k=rng.randint(length, 60))) for _ in range(3)]
    texts = []
    for _ in range(rng.randint(1, 12)):
        b = bytearray(rng.choice(bases))
        if rng.random() < 0.5:
            b[rng.randrange(len(b))] = 120
        texts.append(bytes(b))
    different = list(dict.fromkeys(texts))
    got = S.repeated(different, np.array([texts.count(x) for x in different]), length)
    want = windows(texts, length)
    for x, hit in zip(different, got, strict=True):
        assert hit.tolist() == want[texts.index(x)].tolist()


def test_wide_intervals():
    rng = random.Random(0)
    texts = [bytes(rng.choices(b"abc", k=400)) for _ in range(300)]
    assert all((a == b).all() for a, b in zip(S.repeated(texts, np.ones(300, dtype=int), 12), windows(texts, 12), strict=True))


def test_common_prefixes_by_enumeration():
    rng = random.Random(7)
    buf = np.frombuffer(bytes(rng.choices(b"ab", k=200)) + b"\xff", dtype=np.uint8)
    order = S.suffix_order(buf, 30)
    text = buf.tobytes()
    cut = lambda i: text[i : i + 30]
    assert [cut(i) for i in order] == sorted(cut(i) for i in range(len(text)))
    new = S.boundaries(buf[order - 1], 7)
    assert new.tolist() == [True] + [text[a : a + 7] != text[b : b + 7] for a, b in zip(order[:-1], order[1:], strict=True)]


def test_every_window_is_in_one_piece():
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"ab", k=n)) for n in (0, 10, 39, 40, 41, 500, 3)] + [b"a" * 300, b"xyz" * 100]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    row, first, last, p, h, _ = S.runs(buf, offsets, 40, 8)
    found = Counter(int(s) for a, b in zip(first, last, strict=True) for s in range(a, b + 1))
    want = {int(o) + i for o, t in zip(offsets, texts, strict=False) for i in range(len(t) - 39)}
    assert set(found) == want and set(found.values()) <= {1}
    assert ((p >= last) & (p + 8 <= first + 40)).all()  # the substring lies in all windows of the piece
    keys = {}
    for a, b, k in zip(first, last, h, strict=True):
        for s in range(a, b + 1):
            assert keys.setdefault(buf[s : s + 40].tobytes(), k) == k  # equal windows are dealt alike


def check(spark, texts, length=200, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").selectExpr("*", "1 AS rid", "2 AS key", "'x' AS spans").repartition(3)
    got = S.remove_repeats(d, length=length, kept_text=False).collect()
    want = removed([(t or "").encode() for t in texts], length)
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r["__sd_n_bytes"], r["__sd_n_removed"], r["__sd_n_spans"], r["__sd_kept"]) for r in got), key=key) == sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=key)


@pytest.mark.parametrize("hot,sent", [(512, 1 << 16), (1, 1 << 16), (1, 0)])
def test_rows(spark, monkeypatch, hot, sent):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SENT", sent)
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choices("abcdeéß", k=rng.randint(1, 8))) for _ in range(n))
    passage, line = prose(60), prose(12) + "\n"
    texts = [None, "", "short", prose(400), passage, "x" * 1000, line * 12, prose(30) + " " + prose(50)]
    texts += [prose(rng.randint(5, 80)) + " " + passage + " " + prose(rng.randint(5, 80)) for _ in range(12)]
    texts += [texts[8], texts[3][:700] + "Z" + texts[3][700:], passage[:201], prose(20_000)]
    check(spark, texts)
    check(spark, [*texts[:6], texts[3], texts[3], texts[4]], ids=[*range(6), 3, 7, None])


def test_empty(spark):
    check(spark, [])
    check(spark, ["a", None])


def test_texts_without_broken_characters(spark):
    texts = ["é" * 150 + "tail one", "x" + "é" * 150 + "tail two"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r["__sd_kept"] for r in S.remove_repeats(d).collect()}
    want = [t for t in removed([t.encode() for t in texts], 200)]
    assert all(w[1] > 0 for w in want) and "�" not in "".join(got.values())
    assert got[1].startswith("x") or got[1] == ""


def test_query(spark):
    from tensorloom.llm.queries import queries, table

    d = "/root/testdata/sf0.001"
    rows = table(spark, d, "documents").collect()
    got = sorted(tuple(r) for r in queries()["op6_suffix_array"](spark, d).collect())
    assert got == sorted((r.doc_id, *w) for r, w in zip(rows, removed([(r.text or "").encode() for r in rows], 200), strict=True))


def test_halves_of_characters_make_none(spark):
    """A passage that begins and ends within characters takes them whole, though their outer halves would make a letter."""
    passage = "".join(f"{i:04d} " for i in range(60))
    texts = [f"a é{passage}é z", f"b ĩ{passage}è y"]  # the bytes A9 before and C3 after the passage are shared
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r["__sd_kept"], r["__sd_n_bytes"], r["__sd_n_removed"]) for r in S.remove_repeats(d).collect()}
    assert got == {0: ("a  z", 308, 302), 1: ("b  y", 308, 302)}


def test_few_sorts_of_ties(monkeypatch):
    """Suffixes that agree throughout are sorted to 216 bytes by four sorts, not by one for each doubling."""
    calls, argsort = [], np.argsort
    monkeypatch.setattr(S.np, "argsort", lambda x, **k: calls.append(len(x)) or argsort(x, **k))
    text = bytes(random.Random(3).choices(b"abcd", k=400))
    buf = np.frombuffer((text + b"\xff") * 20, dtype=np.uint8)
    order = S.suffix_order(buf, 200)
    assert len(calls) <= 4
    raw = buf.tobytes()
    assert [raw[i : i + 200] for i in order] == sorted(raw[i : i + 200] for i in range(len(raw)))


def test_large_shards():
    """Ranks of more than 21 bits: the depth is doubled instead."""
    rng = np.random.default_rng(5)
    buf = np.append(np.tile(rng.integers(97, 101, 300_000).astype(np.uint8), 8), np.uint8(255))
    order, raw = S.suffix_order(buf, 40), buf.tobytes()
    assert len(buf) > 1 << 21 and (np.sort(order) == np.arange(len(buf))).all()
    assert all(raw[a : a + 40] <= raw[b : b + 40] for a, b in zip(order[:-1:37].tolist(), order[1::37].tolist(), strict=False))


@pytest.mark.parametrize("length", [1, 4, 8, 9, 30])
def test_search_from_leading_bytes(monkeypatch, length):
    """Begun at the patterns of up to 8 bytes, and by few intervals at a time, the search finds the same boundaries."""
    rng = random.Random(length)
    parts = [bytes(rng.choices(b"ab\x00", k=rng.randint(length, 60))) for _ in range(30)]
    buf = np.frombuffer(b"\xff".join([*parts, *parts[:9]]) + b"\xff", dtype=np.uint8)
    order = S.suffix_order(buf, length)
    want = S.boundaries(buf[order - 1], length)
    monkeypatch.setattr(S, "EXPANDED", 3)
    got = S.boundaries(buf[order - 1], length, S.leading(buf)[order])
    ends = np.concatenate([np.flatnonzero(buf == 255), [len(buf)]])
    whole = ends[np.searchsorted(ends, order)] - order >= length  # others hold a separator
    assert (np.cumsum(want)[whole][1:] != np.cumsum(want)[whole][:-1]).tolist() == (np.cumsum(got)[whole][1:] != np.cumsum(got)[whole][:-1]).tolist()
