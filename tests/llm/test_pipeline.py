import hashlib
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import corpus_pipeline as P
from tensorloom.llm import jaccard_join, mixing, packing, quality, suffix_dedup


def test_stages_one_by_one(spark):
    """Each stage against its operator on what its predecessor kept."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "length_packing"]
    key = lambda df: sorted(map(str, df.collect()))
    step = [f for _, f in P.STAGES]

    a = step[0](spark, docs, d).cache()
    features = quality.features(docs)
    assert a.columns == docs.columns and key(a) == key(quality.judge(features, quality.fit(features)).where("__q_kept").select(docs.columns))

    b = step[1](spark, a, d).cache()
    least = {r.component_id for r in jaccard_join.classes(a).collect()}
    assert b.columns == docs.columns and sorted(r.doc_id for r in b.collect()) == sorted(least)

    c = step[2](spark, b, d).cache()
    counts = {r.doc_id: (r["__sd_n_bytes"], r["__sd_n_removed"]) for r in suffix_dedup.remove_repeats(b).collect()}
    assert c.columns == docs.columns
    for r in c.collect():
        n, removed = counts[r.doc_id]
        assert len(r.text.encode()) <= n - removed and len(r.text.encode()) >= n - removed - 6 * (removed > 0)
        assert r.n_chars == len(r.text) or removed == 0
    assert all(n == gone or i in {r.doc_id for r in c.collect()} or n - gone < 10 for i, (n, gone) in counts.items())

    e = step[3](spark, c, d).cache()
    assert e.columns == docs.columns and e.count() == sum(r["__mix_copies"] for r in mixing.plan(c).collect())
    f = step[4](spark, e, d)
    assert f.count() == e.count() and set(packing.COLUMNS) < set(f.columns)


def test_run(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(map(str, P.run(spark, d).collect()))
    assert got and got == sorted(map(str, P.run(spark, d).collect()))
    assert P.ORACLE_SQL is None


def test_empty_and_extra_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "1 AS length", "2 AS component_id", "'x' AS target")
    for rows in (docs.where("false"), docs.limit(0), docs.where("doc_id < 40")):
        out = rows
        for _, f in P.STAGES[:4]:
            out = f(spark, out, d)
            assert out.columns == docs.columns
        assert P.STAGES[4][1](spark, out, d).count() == out.count()


def test_nulls(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for _, f in P.STAGES:
        out = f(spark, out, "")
    assert out.count() == 0
    for _, f in P.STAGES[1:]:
        f(spark, docs, "").collect()


VOTES = (  # (good, bad) of each rule, by the features of a text
    (lambda f: f["symbols"] <= 0.1, lambda f: f["symbols"] > 0.3),
    (lambda f: f["marked"] <= 0.02, lambda f: f["marked"] > 0.08),
    (lambda f: f["repeats"] <= 0.2, lambda f: f["repeats"] > 0.5),
    (lambda f: f["doubled"] <= 0.3, lambda f: f["doubled"] > 0.6),
    (lambda f: f["upper"] <= 0.15, lambda f: f["upper"] > 0.4),
    (lambda f: f["shouts"] <= 0.1, lambda f: f["shouts"] > 0.3),
    (lambda f: 0.02 <= f["stops"] <= 0.5, lambda f: f["n"] >= 40 and f["stops"] < 0.005),
    (lambda f: 3 <= f["mean"] <= 9, lambda f: f["mean"] < 1.5 or f["mean"] > 16),
    (lambda f: f["fresh"] >= 3, lambda f: f["n"] >= 40 and f["fresh"] < 1.5),
)


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def plain_quality(rows):
    """Rows that pass, by votes and expectation-maximisation written out for each document."""
    votes, base = [], []
    for r in rows:
        text = r["text"] or ""
        w = words_of(text)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        repeated = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        n, chars = max(1, len(w)), max(1, sum(map(len, w)))
        marks = len(re.findall(r"[#*$%&|<>]", text))
        f = {
            "n": len(w),
            "symbols": marks / n,
            "marked": marks / chars,
            "repeats": len(repeated) / n,
            "doubled": (len(lines) - len(set(lines))) / max(1, len(lines)),
            "upper": sum(unicodedata.category(c) == "Lu" for c in text) / chars,
            "shouts": text.count("!") / n,
            "stops": (text.count(".") + text.count("?")) / n,
            "mean": sum(map(len, w)) / n,
            "fresh": len(set(w)) / n**0.5,
        }
        votes.append([0 if not w else -1 if bad(f) else 1 if good(f) else 0 for good, bad in VOTES])
        base.append(len(w) >= 50 and 100 * len(repeated) <= 50 * len(w))
    good = [(0.95, 0.5)[v.count(-1)] if v.count(-1) < 2 else 0.02 for v in votes]
    for _ in range(200):
        share = (1 + sum(good)) / (2 + len(good))
        yes = []  # for each rule the share of good votes among its votes, in good and in bad documents
        for j in range(len(VOTES)):
            sums = [[1 + sum(p for v, p in zip(votes, of, strict=True) if v[j] == x) for x in (1, -1)] for of in (good, [1 - p for p in good])]
            yes.append([a / (a + b) for a, b in sums])
        good = []
        for v in votes:
            a, b = share, 1 - share
            for x, (g, h) in zip(v, yes, strict=True):
                a, b = (a * g, b * h) if x == 1 else (a * (1 - g), b * (1 - h)) if x == -1 else (a, b)
            good.append(a / (a + b))
    return [r for r, p, ok in zip(rows, good, base, strict=True) if ok and p >= 0.5]


def plain_duplicates(rows):
    """Of each class of linked texts the one with the smallest id, by all pairs."""
    rows = sorted(rows, key=lambda r: r["doc_id"])
    sets = []
    for r in rows:
        w = r["text"].encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [r for i, r in enumerate(rows) if label[i] == i]


def plain_passages(rows):
    """Texts without the characters that a 200-byte string standing anywhere else too has a byte of."""
    seen = Counter(t[i : i + 200] for t in (r["text"].encode() for r in rows) for i in range(len(t) - 199))
    out = []
    for r in rows:
        t = r["text"].encode()
        gone = set()
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        left, at = [], 0
        for c in r["text"]:
            n = len(c.encode())
            if not gone.intersection(range(at, at + n)):
                left.append(c)
            at += n
        left = "".join(left)
        if not gone:
            out.append(r)
        elif words_of(left):
            out.append({**r, "text": left, "n_chars": len(left)})
    return out


def plain_mix(rows):
    """Each row as often as its steps cross an integer; targets by sharing again and again."""
    size = Counter()
    for r in rows:
        size[r["source"]] += len(words_of(r["text"]))
    names = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / total >= 2 * size[s]}
        if not over:
            target.update({s: weight[s] * left / total for s in open_})
            break
        target.update({s: 2 * size[s] for s in over})
        left, open_ = left - sum(2 * size[s] for s in over), open_ - over
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    out = []
    for s in names:
        u, rate = int(md5("mix:" + s)[:4], 16) / 65536, target[s] / size[s]
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: (len(words_of(r["text"])), md5(str(r["doc_id"]))))
        for i, r in enumerate(mine):
            out += [r] * (math.floor((i + 1) * rate + u) - math.floor(i * rate + u))
    return out


def least_padding(lengths, buckets=16):
    tops = sorted(set(lengths))
    n = Counter(lengths)
    best = [0] + [math.inf] * len(tops)
    for _ in range(min(buckets, len(tops))):
        new = list(best)
        for j in range(1, len(tops) + 1):
            pad = 0
            for i in range(j - 1, -1, -1):
                pad += (tops[j - 1] - tops[i]) * n[tops[i]]
                new[j] = min(new[j], best[i] + pad)
        best = new
    return best[-1]


def test_run_against_plain_python(spark, tmp_path):
    """All five stages written out in plain Python, over the small table with cases planted in it."""
    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    vocabulary = [w for w in {w for r in rows for w in words_of(r["text"])} if w.isalpha()]
    vocabulary.sort()
    text = lambda n: " ".join(rng.choice(vocabulary) + ("." if i % 9 == 8 else "") for i in range(n))
    passage = text(60) + " Überlänge Größe"
    planted = [text(rng.randint(60, 200)) for _ in range(12)]
    planted += [planted[0], planted[0], planted[1].replace(" ", "  "), planted[2] + " one two"]
    planted += [f"{text(80)} ü{passage}ß {text(40)}" for _ in range(5)] + [f"{text(20)}ñ{passage}ö", passage]
    planted += ["#### " * 90, "BUY NOW! " * 40, "same line here\n" * 60, "x", "", None, " \n\t"]
    start = max(r["doc_id"] for r in rows) + 1
    rows += [{**rows[i], "doc_id": start + i, "text": t, "n_chars": len(t or "")} for i, t in enumerate(planted)]
    spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema).write.parquet(f"{tmp_path}/documents.parquet")

    key = lambda r: (r["doc_id"], r["text"], r["source"], r["n_chars"])
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [len(rows)]
    for (_, stage), plain in zip(P.STAGES[:4], (plain_quality, plain_duplicates, plain_passages, plain_mix), strict=True):
        kept, rows = stage(spark, kept, str(tmp_path)).cache(), plain(rows)
        assert sorted(key(r) for r in kept.collect()) == sorted(key(r) for r in rows), plain.__name__
        counts.append(len(rows))
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] != counts[3]

    packed = P.run(spark, str(tmp_path)).collect()
    lengths = sorted((r["doc_id"], len(words_of(r["text"]))) for r in rows)
    assert sorted((r.doc_id, r.length) for r in packed) == lengths
    tops = sorted({r.bucket_length for r in packed})
    assert len(tops) <= 16 and sum(r.padding for r in packed) == least_padding([n for _, n in lengths])
    assert all(r.bucket_length == min(t for t in tops if t >= r.length) == r.length + r.padding and tops[r.bucket] == r.bucket_length for r in packed)
    for b, top in enumerate(tops):
        full, batches = max(1, 65_536 // max(1, top)), Counter(r.batch for r in packed if r.bucket == b)
        assert sorted(batches) == list(range(len(batches))) and all(batches[i] == full for i in range(len(batches) - 1)) and batches[len(batches) - 1] <= full
