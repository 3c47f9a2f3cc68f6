import zlib

import numpy as np
import pytest

from tensorloom.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string"


def brute(text):
    """Counts of n-grams, by strings."""
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    counts = {}
    for w in words:
        p = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                g = p[i : i + n]
                if g != " " and not (n == 3 and g[1] == " "):
                    counts[g] = counts.get(g, 0) + 1
    return counts


@pytest.mark.parametrize("text", ["", "a", "The the THE", "l'été 42 fois", "ß ẞ 𝔘 x", "a\n\tb", "123 !?"])
def test_grams_against_strings(text):
    counts = {}
    for g in L.grams(text).tolist():
        counts[g] = counts.get(g, 0) + 1
    want = brute(text)
    # between words one blank serves both, and no gram has it in the middle
    assert sorted(counts.values()) == sorted(want.values())


def test_profile_order():
    codes = np.array([5, 5, 7, 7, 1, 9], dtype=np.int64)
    assert L.profile(codes, 3).tolist() == [5, 7, 1]


def test_out_of_place_distance():
    p = L.Profiles({"x": L.profile(L.grams("aa ab")).tolist(), "y": L.profile(L.grams("zz zy")).tolist()})
    assert p.predict("aa ab") == ("x", 1.0)
    assert p.predict("zz")[0] == "y"
    assert p.predict(None) == p.predict("12 !") == (L.UNKNOWN, 0.0)
    assert p.predict("qq")[0] == "x"  # both lack everything but the blank: the first language
    assert L.Profiles({}).predict("a") == (L.UNKNOWN, 0.0)


def test_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "the dog", None), (4, None, "en"), (5, "", "fr"), (5, "", "fr"), (None, "le chien", None), (6, "le chat " * 20000, "fr")]
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS gram", "2 AS lang_pred", "3 AS score")
    learned = L.learn(d)
    assert list(learned) == ["en", "fr"]
    got = sorted(((r.doc_id, r.lang_pred) for r in L.predict(d, learned).collect()), key=str)
    assert got == sorted([(1, "en"), (2, "fr"), (3, "en"), (4, "und"), (5, "und"), (5, "und"), (None, "fr"), (6, "fr")], key=str)
    empty = d.where("false")
    assert L.learn(empty) == {} and L.predict(empty, {}).count() == 0


def test_learning_counts_all_rows(spark):
    rows = [(i, f"{'ab' if i % 3 else 'ba'} x{'y' * (i % 5)}", "q") for i in range(200)]
    learned = L.learn(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert learned["q"] == L.profile(np.concatenate([L.grams(t) for _, t, _ in rows])).tolist()


def test_held_out_accuracy(spark):
    from tensorloom.llm.queries import queries, table

    d = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in table(spark, d, "documents").collect()}
    got = queries()["op1_rank_order"](spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def ranked(counts):
    """The 300 most frequent n-grams; ties: pairs, letters, triples, each by code points with the blank first."""
    order = lambda g: (-counts[g], (2, 1, 3).index(len(g)), [0 if c == " " else ord(c) for c in g])
    return {g: i for i, g in enumerate(sorted(counts, key=order)[:300])}


def test_query_against_strings(spark):
    """The query's predictions and scores over the whole small table, by ranks of strings."""
    from tensorloom.llm.queries import queries, table

    d = "/root/testdata/sf0.001"
    rows = table(spark, d, "documents").collect()
    learned = {}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            total = learned.setdefault(r.lang, {})
            for g, n in brute(r.text).items():
                total[g] = total.get(g, 0) + n
    profiles = {lang: ranked(learned[lang]) for lang in sorted(learned)}
    want = {}
    for r in rows:
        own = ranked(brute(r.text or ""))
        away = {lang: sum(abs(i - p[g]) if g in p else 300 for g, i in own.items()) for lang, p in profiles.items()}
        best = min(away, key=away.get) if own else "und"
        want[r.doc_id] = (best, 1 - away[best] / (300 * len(own)) if own else 0.0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries()["op1_rank_order"](spark, d).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(abs(got[i][1] - s) < 1e-12 for i, (_, s) in want.items())
