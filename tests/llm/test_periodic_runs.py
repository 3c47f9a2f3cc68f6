import hashlib
import random
import zlib

import numpy as np
import pytest

from tensorloom.llm import periodic_runs as P


def brute(w):
    """All runs by comparing the words with themselves at each distance."""
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            s = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            if i - s >= max(24, 3 * q):
                found.setdefault((s, i), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng):
    """Words with stretches of short periods, some of periods of periods."""
    letters = rng.choice([1, 2, 3, 5, 20])
    w = []
    while len(w) < rng.randint(10, 250):
        part = [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.3:
            part = part * 3 + [letters]
        w += (part * rng.randint(1, 12))[: rng.randint(5, 90)] if rng.random() < 0.6 else [rng.randrange(letters * 3) for _ in range(rng.randint(0, 30))]
    return [b"w%d" % x for x in w]


@pytest.mark.parametrize("seed", range(8))
def test_against_comparison_at_each_distance(seed):
    rng = random.Random(seed)
    runs = 0
    for _ in range(150):
        w = periodic(rng)
        want = brute(w)
        runs += len(want)
        assert P.find(w) == want
        number = {x: i for i, x in enumerate(dict.fromkeys(w))}
        assert sorted(P.runs_of([number[x] for x in w]), key=lambda r: (r[0], r[2])) == want  # without cutting
    assert runs > 50


def test_long_and_self_similar_sequences():
    n = 20_000
    for w, want in (([0] * n, (0, n, 1)), ([i % 7 for i in range(n)], (0, n, 7)), ([*range(n // 4)] * 4, (0, n, n // 4))):
        assert P.runs_of(w) == [want]
    assert P.runs_of([bin(i).count("1") % 2 for i in range(4096)]) == []  # Thue-Morse: no word three times in a row


def test_states_of_the_automaton():
    """Every substring leads to a state, and no other does."""
    rng = random.Random(1)
    w = [rng.randrange(3) for _ in range(60)]
    a = P.Automaton(w)
    step = lambda v, x: a.to[v] if a.word[v] == x else a.more.get(v, {}).get(x)
    subs = {tuple(w[i:j]) for i in range(len(w)) for j in range(i, len(w) + 1)}
    reached, todo = {(): 0}, [()]
    while todo:
        s = todo.pop()
        for x in range(3):
            if step(reached[s], x) is not None:
                reached[*s, x] = step(reached[s], x)
                todo.append((*s, x))
    assert set(reached) == subs
    longest = {}
    for s, v in reached.items():
        longest[v] = max(longest.get(v, 0), len(s))
    assert all(a.length[v] == k for v, k in longest.items())


def test_ordered_sets(monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    rng = random.Random(2)
    values = rng.sample(range(1000), 300)
    e, have = P.Ends(values[0]), [values[0]]
    for x in values[1:]:
        below, above = max((y for y in have if y < x), default=-1), min((y for y in have if y > x), default=-1)
        assert e.add(x) == (below, above)
        have.append(x)
    assert list(e) == sorted(have) and max(map(len, e.blocks)) <= 8


def row(text, runs=None):
    w = (text or "").encode().split()
    runs = brute(w) if runs is None else runs
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    found = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *found, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "a " * 23, "a " * 24, "a\nb\tc " * 8, "a b c " * 8 + "a b", "A a " * 12, "\x85 x y " * 20, "é ß " * 30, "x y z " * 5000]
    texts += [b" ".join(periodic(rng)).decode() for _ in range(40)] + ["a " * 24, "a " * 24]
    ids = [*range(len(texts) - 2), 3, None]
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS runs", "'x' AS t", "'y' AS k0").repartition(3)
    out = P.periodic_runs(d, keep=("doc_id", "start", "t"), kept_text=True)
    assert out.columns[:3] == ["doc_id", "start", "t"]
    got = out.toDF("doc_id", "own", "t", *out.columns[3:]).collect()
    key = lambda r: tuple(map(str, r))
    rows = [(r.doc_id, len(r.runs), r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got]
    assert sorted(rows, key=key) == sorted(((i, *row(t)) for i, t in zip(ids, texts, strict=True)), key=key)
    assert all(hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 and r.own == 1 and r.t == "x" for r in got)
    assert [r.collapsed for r in got if r.doc_id == 7] == ["a b c"]


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert P.periodic_runs(d).collect() == []


def plant(doc_id, text):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    w, g = (text or "").encode().split(), h // 10
    if h % 10 == 0 and w:
        n = len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return b" ".join(w).decode()


def test_planted_texts(spark):
    from tensorloom.llm.queries import planted

    texts = [None, "", "a", "a b", " ".join(map(str, range(100))), "x\ty\nz\x0bv  w"]
    rows = [(i, texts[i % len(texts)]) for i in range(300)] + [(None, texts[4])]
    found = planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = [(str(r.doc_id), r.text or "") for r in found]
    norm = lambda t: b" ".join(t.encode().split()).decode()
    assert sorted((a, norm(b)) for a, b in got) == sorted((str(i), plant(i, t)) for i, t in rows)


def test_query(spark):
    from tensorloom.llm.queries import queries, table

    d = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries()["op11_suffix_automaton"](spark, d).collect())
    want = sorted((r.doc_id, *row(plant(r.doc_id, r.text))) for r in table(spark, d, "documents").collect())
    assert got == want and sum(r[1] > 0 for r in want) > 10


def test_stretches_hold_every_run():
    rng = random.Random(4)
    for _ in range(200):
        w = periodic(rng)
        x = np.unique(np.array(w), return_inverse=True)[1]
        cut = P.stretches(x)
        assert all(any(a <= s and s + n <= b for a, b in cut) for s, n, _ in brute(w))
