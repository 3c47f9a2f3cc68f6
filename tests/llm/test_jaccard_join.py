import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import components as C
from tensorloom.llm import jaccard_join as J
from tensorloom.llm.components import components

SCHEMA = "doc_id long, text string"


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in at[x] if j < i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS ent", "2 AS sig", "3 AS n_shingles", "4 AS root").repartition(3)
    return sorted((tuple(r) for r in J.classes(d).collect()), key=str)


def near_copies(rng, n):
    words = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 12, 40, 120]))]
        passage = [rng.choice(words) for _ in range(20)]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.1:
                w += passage
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("frequent", [8, 1])
def test_against_enumeration(spark, monkeypatch, frequent):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    rng = random.Random(frequent)
    rows = near_copies(rng, 25)
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "One two"), (1004, "one  TWO"), (1005, "one two three"), (1004, "one  TWO"), (1006, "x " * 30_000), (None, rows[0][1])]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("sent", [500_000, 0])
def test_texts_by_ids_or_by_shuffle(spark, monkeypatch, sent):
    monkeypatch.setattr(J, "SENT_IDS", sent)
    rows = near_copies(random.Random(5), 8)
    assert run(spark, rows) == brute(rows)


def test_exact_threshold(spark):
    w = [f"t{i}" for i in range(40)]
    rows = [(i + 1, " ".join(w[:n])) for i, n in enumerate((13, 12, 11, 14, 24, 29, 30))]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(3, None)]) == [(3, 0, 3)]


@pytest.mark.parametrize("seed", range(30))
def test_similar_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    universe = np.sort(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    frequent = rng.random(4000) < rng.choice([0.0, 0.3, 0.9, 1.0])
    for _ in range(60):
        n = int(rng.choice([5, 6, 9, 10, 31, 32, 40, 63, 64, 130, 500]))
        x = rng.choice(4000, n, replace=False)
        lost = rng.integers(0, n // 5 + 1)
        y = np.concatenate([x[lost:], rng.choice(4000, rng.integers(0, n // 5 + 1), replace=False)])
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both) and len(x) + len(y) > 2 * both:
            a, b = (set(np.concatenate(J.signatures(universe[z], frequent[z])).tolist()) for z in (x, y))
            assert a & b
            h = [J.histogram(universe[z]) for z in (x, y)]
            m = min(map(len, h))
            assert np.minimum(*(z.astype(int).reshape(-1, m).sum(axis=0) for z in h)).sum() >= both


@pytest.mark.parametrize("few", [200_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW", few)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each(spark):
    rows = near_copies(random.Random(3), 10)
    alone = [f"{x} alone among all of the others here" for x in "abcdefg"]
    extra = [rows[0], (None, alone[0]), (1000, alone[1]), (1000, alone[2]), (None, alone[3]), (None, alone[3]), (1001, alone[4]), (None, alone[4]), (None, ""), (1002, "")]
    d = spark.createDataFrame([*rows, *extra], SCHEMA).selectExpr("*", "7 AS component_id", "8 AS rid", "9 AS class")
    kept = J.one_of_each(d)
    assert kept.columns == d.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    least = {c for _, _, c in brute(rows)}
    assert sorted(i for i, _ in got if i is not None and i < 1000) == sorted(least)
    rest = sorted(((i, t) for i, t in got if i is None or i >= 1000), key=str)
    # unrelated texts of one id stay both, copies without ids become one, an id goes before none
    assert rest == sorted([(None, alone[0]), (1000, alone[1]), (1000, alone[2]), (None, alone[3]), (1001, alone[4]), (None, ""), (1002, "")], key=str)


def test_texts_without_ids_are_no_cross_product(spark):
    """Null and repeated ids cost what own ids do: each row's text is fetched by the row, not by the id."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(30)) for _ in range(400)]
    d = spark.createDataFrame([(None, t) for t in texts] + [(5, t + " k") for t in texts], SCHEMA)
    docs = d.select(F.col("doc_id").alias("id"), J.row_id("doc_id", "text").alias("rid"), "text")
    wanted = docs.select("rid").distinct().withColumn("ent", F.lit(1))
    assert J.texts_of(docs, wanted).count() == len(set(texts)) * 2
    assert J.one_of_each(d).count() == J.classes_by_row(d).select("class").distinct().count()


def test_too_few_rounds_are_an_error(spark, monkeypatch):
    from tensorloom.llm import components as M

    monkeypatch.setattr(M, "FEW", 0)
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    with pytest.raises(RuntimeError):
        M.components(path, most=1)


def test_clusters_in_many_blocks(spark, monkeypatch):
    """Texts of lines from one pool chain to clusters by the lines they share; sizes differ by more than a tier."""
    for name, value in (("FREQUENT", 2), ("GROUP", 2), ("BLOCK", 3), ("HELD", 200)):
        monkeypatch.setattr(J, name, value)
    met = []
    compare = J.compare_clusters
    monkeypatch.setattr(J, "compare_clusters", lambda members, *rest: met.append(members.count()) or compare(members, *rest))
    rng = random.Random(11)
    pool = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(12)]
    rows = []
    for n in (2, 3, 4, 5, 6, 9, 12) * 6:
        lines = rng.sample(pool, n)
        rows.append((len(rows), " ".join(lines)))
        if rng.random() < 0.5:
            rows.append((len(rows), " ".join([*lines[:-1], lines[-1][:-4]])))
    want = brute(rows)
    assert run(spark, rows) == want and met[0] > 10
    assert 10 < len({c for _, _, c in want}) < len(rows)


def test_query_against_enumeration(spark):
    """The query over the whole small table against all pairs."""
    from tensorloom.llm.queries import queries, table

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]
    got = queries()["op9_token_combinations"](spark, d).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("listed", [1 << 19, 1])
def test_copies_add_no_signatures(spark, monkeypatch, listed):
    """Signatures go with the sets, not with the rows that have them; copies beyond the list change no result."""
    monkeypatch.setattr(J, "COPIED", listed)
    signed, staged = [], J.stage

    def counting(df, name):
        out = staged(df, name)
        if name == "signatures":
            signed.append(out.count())
        return out

    monkeypatch.setattr(J, "stage", counting)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) for _ in range(80)) for _ in range(6)]
    texts += [t.rsplit(" ", 3)[0] for t in texts[:3]]
    for copies in (1, 20):
        rows = [(1000 * c + i, t) for c in range(copies) for i, t in enumerate(texts)]
        got = {r[0]: r[2] for r in J.classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
        assert got == {1000 * c + i: i % 6 for c in range(copies) for i in range(len(texts))}
    assert signed[1] == signed[0] if listed > 1 else signed[1] >= signed[0]


def test_many_texts_by_ids_in_several_passes(spark, monkeypatch):
    """More ids than are sent at once take more passes over the texts, which aren't shuffled."""
    monkeypatch.setattr(J, "SENT_IDS", 100)
    rows = spark.range(1000).selectExpr("id rid", "concat('text ', id) text")
    wanted = spark.range(0, 1000, 2).selectExpr("id rid", "-id ent")
    found = J.texts_of(rows, wanted)
    assert sorted(map(tuple, found.collect())) == sorted((-i, f"text {i}") for i in range(0, 1000, 2))
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_equal_signatures_are_paired_once(spark):
    """A passage in the same few texts makes many signatures; only sets of members that differ are paired."""
    sets = [(sig, (4, 5, 6)) for sig in range(40)] + [(90, (4, 5)), (91, (5, 4)), (92, (4, 5, 6, 7)), (93, (8,))]
    d = spark.createDataFrame([(sig, ent, 100 + ent) for sig, ents in sets for ent in ents], "sig long, ent long, n long").repartition(3)
    got = sorted(tuple(r) for r in J.one_of_equal(d).collect())
    assert got == sorted((sig, ent, 100 + ent) for sig, ents in ((0, (4, 5, 6)), (90, (4, 5)), (92, (4, 5, 6, 7)), (93, (8,))) for ent in ents)


def test_more_input_does_not_make_shingles_rare(spark, monkeypatch):
    counts = spark.createDataFrame([(s, 7 + s % 5) for s in range(50)], "s long, n long")  # ten each of 7 to 11
    assert sorted(J.listed(counts, 8, 1 << 40)) == [s for s in range(50) if s % 5]
    monkeypatch.setattr(J, "PART", 5)
    assert sorted(J.listed(counts, 8, 1 << 20)) == [s for s in range(50) if s % 5 > 1]
    monkeypatch.setattr(J, "PART", 3)
    assert len(J.listed(counts, 8, 1 << 20)) == 0
    assert len(J.listed(counts.where("n < 0"), 8, 0)) == 0


def test_list_of_frequent_shingles_leaves_results_alone(spark, monkeypatch):
    rng = random.Random(5)
    passage = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(40)) for _ in range(20)) for _ in range(6)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(passage) for _ in range(3)) + f" w{i % 17} x{i % 5}") for i in range(90)], "doc_id long, text string")
    want = sorted(map(tuple, J.classes(docs).collect()))
    for part in (0, 3):
        monkeypatch.setattr(J, "PART", part)
        assert sorted(map(tuple, J.classes(docs).collect())) == want
