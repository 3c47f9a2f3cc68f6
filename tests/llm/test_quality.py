import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tensorloom.llm import quality as Q

SCHEMA = "doc_id long, text string"


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def random_text(rng):
    words = ["a", "b", "the", "x#", "|", "ünï", "👍", "A."]
    return "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b", " ", " ", "\n\n"]) for _ in range(rng.randint(0, 60)))


def test_base_counts(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "a b c", "a a a a", "x\nx\n\nx \n x", "a b c\n" * 400, "w" * 10_000] + [random_text(rng) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), SCHEMA).selectExpr("*", "1 AS n_words", "2 AS w")
    f = F.col("__q_f")
    got = {r.doc_id: tuple(r)[1:] for r in Q.features(d).select("doc_id", *[f[c] for c in Q.BASE], Q.base_failed(f)).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i][:5] == want, (t, got[i], want)
        assert got[i][5] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_estimation_finds_accuracies():
    rng = np.random.default_rng(1)
    n, rates = 20_000, [0.95, 0.9, 0.85, 0.9, 0.8]
    good = rng.random(n) < 0.8
    counts = {}
    for g in good:
        code = 0
        for a in rates:
            v = 1 if rng.random() < 0.2 else (2 if g == (rng.random() < a) else 0)
            code = code * 3 + v
        counts[code] = counts.get(code, 0) + 1
    m = Q.estimate(sorted(counts.items()), 5)
    assert abs(m["share"] - 0.8) < 0.02
    for j, a in enumerate(rates):
        assert abs(m["rates"][1][j][2] - a) < 0.03 and abs(m["rates"][0][j][0] - a) < 0.05


def brute_posterior(m, votes):
    odds = math.log(m["share"] / (1 - m["share"]))
    for j, v in enumerate(votes):
        if v:
            k = 2 if v > 0 else 0
            odds += math.log(m["rates"][1][j][k] / m["rates"][0][j][k])
    return 1 / (1 + math.exp(-odds))


def test_posterior_and_verdict(spark):
    from tensorloom.llm.queries import table

    d = Q.features(table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text"))
    m = Q.fit(d)
    f = F.col("__q_f")
    rows = Q.judge(d, m).select(F.array(*Q.rules(f)).alias("votes"), Q.base_failed(f).alias("failed"), "__q_p", "__q_kept").collect()
    assert rows
    for r in rows:
        p = brute_posterior(m, r.votes)
        assert abs(p - r["__q_p"]) < 1e-9 and r["__q_kept"] == (not r.failed and p >= 0.5)


def test_verdicts_agree_with_labels(spark):
    from tensorloom.llm.queries import queries, table

    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries()["op5_weak_supervision"](spark, d).collect()}
    labels = [r for r in table(spark, d, "labels").collect() if not got[r.doc_id].base_failed]
    good, bad = ([got[r.doc_id].kept for r in labels if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_filter_keeps_columns_and_edge_cases(spark):
    rest = lambda i: " ".join(f"word{i}x{j}" for j in range(60))
    texts = [f"The people of town {i} went to the market. They bought bread and apples, then came home again. {rest(i)}." for i in range(40)]
    texts += [None, "", "short", *(" ".join(f"{w}***" for w in t.split()) for t in texts[:12])]
    d = spark.createDataFrame(list(enumerate(texts)), SCHEMA).selectExpr("*", "0 AS __extra", "'k' AS kept", "1.5D AS quality")
    out = Q.quality_filter(d)
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(40))
    assert Q.quality_filter(d.union(d)).count() == 80
    assert Q.quality_filter(d.where("false")).count() == 0


def test_no_python_in_the_plan(spark):
    from tensorloom.llm.queries import queries

    plan = queries()["op5_weak_supervision"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_row_by_row(spark):
    """The query's counts by regular expressions and its verdict by rules and estimation in plain Python, for every row of the table."""
    from test_pipeline import plain_quality

    from tensorloom.llm.queries import queries, table

    d = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in table(spark, d, "documents").collect()]
    kept = {r["doc_id"] for r in plain_quality(rows)}
    got = {r.doc_id: r for r in queries()["op5_weak_supervision"](spark, d).collect()}
    assert len(got) == len(rows) and 0 < len(kept) < len(rows)
    for r in rows:
        want, x = brute(r["text"]), got[r["doc_id"]]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and x.kept == (r["doc_id"] in kept)
