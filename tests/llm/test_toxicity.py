import random

import numpy as np
import pytest

from tensorloom.llm import toxicity as T


def corpus(rng, n, noise=0.02):
    """Texts of a few hundred common words; toxic ones hold one of five words or a word with one of two beginnings."""
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(20, 80))
        toxic = rng.random() < 0.3
        if toxic:
            bad = rng.choice(["zilch", "zounds", "zany", "zest", "zinc", "vex" + rng.choice(words), "quarx" + rng.choice(words)])
            w[rng.randrange(len(w))] = rng.choice([bad, bad.upper(), bad.title() + ","])
        rows.append((i, " ".join(w), int(toxic), int(toxic ^ (rng.random() < noise))))
    return rows


def test_planted_texts_on_held_out_rows(spark):
    rows = corpus(random.Random(1), 1500)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows if i % 3], "doc_id long, toxic int")
    model = T.learn(docs.where("doc_id % 3 <> 0"), labels)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    held = [(got[i].predicted, true) for i, _, true, _ in rows if i % 3 == 0]
    assert sum(p == y for p, y in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert {"=zilch", "=zany"} <= set(model.lexicon) and any(e.startswith("^vex") for e in model.lexicon) and any(e.startswith("^qua") for e in model.lexicon)
    assert all(model.voters[e][0] > model.voters[e][1] for e in model.voters if e[0] in "=^")


def test_rates_and_correlations_are_estimated():
    """Six voters of known rates, one of them five times; a fifth of the given labels are absent from the evidence."""
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    rates = np.array([[0.8, 0.05], [0.6, 0.1], [0.7, 0.02], [0.3, 0.2], [0.5, 0.01]])
    one = np.stack([rng.random(len(y)) < np.where(y, a, b) for a, b in rates], axis=1)
    votes = np.concatenate([one, np.repeat(one[:, :1], 4, axis=1)], axis=1).astype(float)
    given = (y ^ (rng.random(len(y)) < 0.03)).astype(int)
    p, toxic, clean, own = T.label_model(votes, given, np.ones(len(y)))
    assert np.abs(toxic[:5] - rates[:, 0]).max() < 0.05 and np.abs(clean[:5] - rates[:, 1]).max() < 0.05
    assert own[0] == pytest.approx(0.2, abs=0.02) and own[1:5] == pytest.approx(1.0, abs=0.05)
    assert ((p >= 0.5) == y).mean() > max(0.985, (given == y).mean())


def test_logistic_regression_is_at_its_minimum():
    rng = np.random.default_rng(3)
    x, w = (rng.random((200, 6)) < 0.3).astype(float), rng.random(200) + 0.5
    p = rng.random(200)
    b = T.logistic(x, p, w, penalty=0.5)
    q = 1 / (1 + np.exp(-(x @ b[:-1] + b[-1])))
    assert np.abs(x.T @ (w * (q - p)) + 0.5 * b[:-1]).max() < 1e-4 and abs(w @ (q - p)) < 1e-4


def test_entries_are_mined_by_the_likelihood_ratio(spark, monkeypatch):
    monkeypatch.setattr(T, "GATHERED", 20)
    texts = [("bad dog", 1)] * 12 + [("good dog", 0)] * 12 + [("bade dog", 1)] * 3
    d = spark.createDataFrame(texts, "text string, z int").repartition(3)
    assert T.mine(d, 15, 12) == ["^bad", "=bad"]


def plain(model, text):
    """A score by definition: words by splitting off other characters, entries by testing each."""
    import math
    import re

    text = text or ""
    w = [x for x in re.split(r"[\W\d_]+", text.lower()) if x]
    fires = lambda e: any(x == e[1:] if e[0] == "=" else x.startswith(e[1:]) for x in w)
    letters = max(1, sum(c.isascii() and c.isalpha() for c in text) + sum(len(c.encode()) for c in text if not c.isascii()))
    shows = [
        sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) > 0.3 * letters, text.count("!") > 0.02 * letters, sum(c in "#*$%&|<>@" for c in text) > 0.05 * letters,
        re.search(r"[A-Za-z][*@#$%]+[A-Za-z]", text) is not None, len(w) >= 20 and len(set(w)) < 0.3 * len(w), len(w) < 20,
    ]
    z = model.bias + sum(x for e, x in model.lexicon.items() if fires(e)) + sum(x for x, s in zip(model.patterns, shows, strict=True) if s)
    return 1 / (1 + math.exp(-z))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 5)
    model = T.Model(-1.0, {"=bad": 2.0, "^wor": 0.5, "=é": 1.0}, (0.1, 0.2, 0.4, 0.8, 1.6, 3.2))
    texts = [None, "", " \n", "BAD!", "worse words", "b*d É 123_bad", "word " * 30, "x" * 300_000 + " bad", "Bad bad bad", "<|>#%$ & @"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "BAD!"), (None, "bad")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS t", "3 AS k0").repartition(3)
    out = T.score(d, model, keep=("t", "k0"))
    assert out.columns == ["doc_id", "t", "k0", "score", "predicted"]
    got = sorted(((r.doc_id, r.score) for r in out.collect()), key=str)
    want = sorted(((i, plain(model, t)) for i, t in rows), key=str)
    assert [x for x, _ in got] == [x for x, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])


def test_labels_that_are_missing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (None, "e")], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    scores = lambda rows: [r.score for r in T.score(docs, T.learn(docs, labels(rows))).collect()]
    assert scores([]) == pytest.approx([0.0] * 3) and scores([(1, None), (None, 1)]) == pytest.approx([0.0] * 3)
    assert scores([(1, 0), (2, 0)]) == pytest.approx([0.0] * 3) and scores([(1, 1)]) == pytest.approx([1.0] * 3)
    assert T.score(docs.limit(0), T.learn(docs.limit(0), labels([]))).collect() == []
    model = T.learn(docs, labels([(1, 1), (1, 0), (2, 0), (2, 0)]))  # one half counts as toxic
    assert all(0 < r.score < 1 for r in T.score(docs, model).collect())


def test_sample_is_bounded_and_repeated_rows_count_once(spark):
    rows = corpus(random.Random(4), 400, noise=0.0)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [rows[0][:2]] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    a, b = (T.learn(d.repartition(4), labels, sample=60) for d in (docs, docs.distinct()))
    assert a.lexicon == pytest.approx(b.lexicon) and a.bias == pytest.approx(b.bias) and a.lexicon


def test_query(spark):
    from tensorloom.llm.queries import queries, remainder, table

    d = "/root/testdata/sf0.01"
    got = queries()["op12_label_model"](spark, d)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(table(spark, d, "labels"), "doc_id", "left").withColumn("h", remainder(5) == 0).collect()
    assert len(rows) == table(spark, d, "documents").count() and all(r.held_out == r.h for r in rows)
    labelled = [r for r in rows if r.toxic is not None and r.held_out]
    assert sum(r.predicted == r.toxic for r in labelled) >= 0.95 * len(labelled)
    assert not any(r.predicted for r in labelled if not r.toxic)
