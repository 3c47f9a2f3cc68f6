"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters see a text only. Lexicon voters fire where a text has a certain word or a word with a certain
beginning; the words and beginnings are those that mark toxic texts most surely (by the likelihood
ratio) in a sample of labelled rows, which is bounded: SAMPLE rows of each label, those with the smallest
hashes of id and text. Pattern voters fire by shares of capitals, exclamation marks, symbols, masked
letters, repeated words.

The label model takes the true label of a sampled row as hidden. A given label is one more voter, right
with probability GOLD. Expectation-maximisation estimates how often each voter fires on toxic and on
clean texts, and the correlations of the voters among texts of one class; a voter's log-odds are
divided by the sum of its correlations, so that voters that say the same count as one. The posteriors
are the soft labels on which a logistic regression over all lexicon entries and patterns is trained;
that classifier scores every text, whole.

Labels of one key are averaged (one half counts as toxic); rows repeated in id and text are sampled once.

Defined results: null and empty texts have no voter that fires and get the score of such texts; rows
without a label, or with a null id, are not learned from; if labels of one kind are missing the score is the
share of toxic labels (0 without labels) for all; repeated rows each get a row; empty tables give empty
results; other columns of any name are ignored unless named in `keep`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, ship, stage

#: Labelled rows of each label that lexicon, label model and classifier are fitted on.
SAMPLE = 3000
#: Entries of the lexicon, and lexicon voters of the label model.
ENTRIES = 1024
VOTERS = 160
#: Least number of toxic texts with an entry, and least likelihood ratio statistic.
SUPPORT = 3
LEAST = 15.0
PREFIXES = (3, 4, 5, 6)
#: Probability that a given label is right.
GOLD = 0.97
ROUNDS = 60
#: Correlations of less than that count as none.
NOISE = 0.1
PENALTY = 1.0
#: Partial counts that a task holds before it sends them, words that a worker remembers.
GATHERED = 1_000_000
REMEMBERED = 500_000

WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("capitals", "exclamations", "symbols", "masked", "repeats", "short")
MASKED = re.compile(rb"[A-Za-z][*@#$%]+[A-Za-z]")
#: Classes of bytes: 1 capitals, 2 small letters (all other bytes of letters beyond ASCII too), 3 exclamation marks, 4 symbols.
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[128:], CLASS[33] = 1, 2, 2, 3
CLASS[[ord(c) for c in "#*$%&|<>@"]] = 4


def entries(word: str) -> list[str]:
    """A word's lexicon entries: itself and its beginnings."""
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def patterns(raw: bytes, n_words: int, n_distinct: int) -> list[bool]:
    """Which of PATTERNS a text shows."""
    n = np.bincount(CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=5)
    letters = max(1, int(n[1] + n[2]))
    return [
        n[1] > 0.3 * letters,
        n[3] > 0.02 * letters,
        n[4] > 0.05 * letters,
        MASKED.search(raw) is not None,
        n_words >= 20 and n_distinct < 0.3 * n_words,
        n_words < 20,
    ]


@dataclass
class Model:
    """Weights of lexicon entries and patterns; what the label model found, for inspection."""

    bias: float
    lexicon: dict[str, float] = field(default_factory=dict)
    patterns: tuple[float, ...] = (0.0,) * len(PATTERNS)
    #: Voter: (rate on toxic texts, rate on clean texts, share of its evidence that is its own).
    voters: dict[str, tuple[float, float, float]] = field(default_factory=dict)


class Reader:
    """Finds lexicon entries in texts; remembers the words it has met."""

    def __init__(self, lexicon: list[str]):
        self.number = {e: i for i, e in enumerate(lexicon)}
        self.known: dict[str, tuple[int, ...]] = {}

    def read(self, raw: bytes) -> tuple[set[int], list[bool]]:
        found = WORD.findall(raw.decode("utf-8", "replace").lower())
        distinct = set(found)
        out: set[int] = set()
        known, number = self.known, self.number
        for w in distinct:
            of = known.get(w)
            if of is None:
                of = tuple(number[e] for e in entries(w) if e in number)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[w] = of
            if of:
                out.update(of)
        return out, patterns(raw, len(found), len(distinct))


def count_entries(batches):
    """For mapInArrow: (text, z) to (entry, n1, n0), texts of either label with each entry, in parts."""
    counts: dict[str, list[int]] = {}

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["entry", "n1", "n0"])

    for batch in batches:
        for text, z in zip(batch.column("text"), batch.column("z").to_pylist(), strict=True):
            found = {e for w in set(WORD.findall((text.as_py() or "").lower())) for e in entries(w)}
            for e in found:
                counts.setdefault(e, [0, 0])[z] += 1
            if len(counts) > GATHERED:
                yield flush()
                counts.clear()
    yield flush()


def mine(sample: DataFrame, n1: int, n0: int, most: int = ENTRIES) -> list[str]:
    """The entries with the greatest likelihood ratio statistic among those that are commoner in toxic texts."""
    d = sample.select("text", "z").mapInArrow(count_entries, "entry string, n1 long, n0 long").groupBy("entry").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    a, b = F.col("n1"), F.col("n0")
    d = d.where((a >= SUPPORT) & (a * n0 > b * n1))
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    of, rest, total = a + b, (n1 + n0) - (a + b), n1 + n0
    g = 2 * (part(a, of * n1 / total) + part(b, of * n0 / total) + part(n1 - a, rest * n1 / total) + part(n0 - b, rest * n0 / total))
    d = d.withColumn("g", F.round(g, 6)).where(F.col("g") >= LEAST)
    return [r["entry"] for r in d.orderBy(F.desc("g"), F.length("entry"), "entry").limit(most).collect()]


def read_sample(sample: DataFrame, lexicon: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(fired, label) of the sampled rows: lexicon entries, then patterns. At most 2 SAMPLE rows come to the driver, as bits."""

    def run(batches):
        reader = Reader(lexicon)
        for batch in batches:
            bits = []
            for text in batch.column("text"):
                fired = np.zeros(len(lexicon) + len(PATTERNS), dtype=bool)
                found, shown = reader.read(text.as_buffer().to_pybytes() if text.is_valid else b"")
                fired[list(found)] = True
                fired[len(lexicon) :] = shown
                bits.append(np.packbits(fired).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("z"), pa.array(bits, pa.binary())], ["h", "z", "bits"])

    rows = sorted(sample.select("h", "z", "text").mapInArrow(run, "h long, z int, bits binary").collect(), key=lambda r: r["h"])
    n = len(lexicon) + len(PATTERNS)
    fired = np.array([np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8))[:n] for r in rows], dtype=np.float64).reshape(-1, n)
    return fired, np.array([r["z"] for r in rows], dtype=np.int64)


def label_model(votes: np.ndarray, given: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS):
    """(posterior of toxic, rates of toxic and clean texts by voter, own share of each voter's evidence).

    votes: texts by voters, 1 where a voter fires; given: labels; weight: of each text.
    """
    gold = np.log(GOLD / (1 - GOLD))
    p = np.where(given == 1, GOLD, 1 - GOLD)
    pooled = (weight @ votes + 0.5) / (weight.sum() + 1)
    for _ in range(rounds):
        rates, spread = [], []
        for q in (p, 1 - p):
            n = weight * q
            r = (n @ votes + 2 * pooled) / (n.sum() + 2)
            away = votes - r
            cov = (away * n[:, None]).T @ away / n.sum()
            rates.append(r)
            spread.append(cov)
        share = (weight @ p + 1) / (weight.sum() + 2)
        cov = share * spread[0] + (1 - share) * spread[1]
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = cov / np.outer(scale, scale)
        corr[corr < NOISE] = 0
        np.fill_diagonal(corr, 1)
        own = 1 / corr.sum(axis=1)
        yes, no = np.log(rates[0] / rates[1]), np.log((1 - rates[0]) / (1 - rates[1]))
        odds = np.log(share / (1 - share)) + np.where(given == 1, gold, -gold) + votes @ (own * yes) + (1 - votes) @ (own * no)
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done, p = np.abs(new - p).max(initial=0) < 1e-9, new
        if done:
            break
    return p, rates[0], rates[1], own


def logistic(x: np.ndarray, p: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression on soft labels p, the bias last and free of the penalty; Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    b = np.zeros(x.shape[1])

    def loss(b):
        z = x @ b
        return weight @ (np.logaddexp(0, z) - p * z) + 0.5 * ridge @ b**2

    now = loss(b)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (q - p)) + ridge * b)
        size = 1.0
        while loss(b - size * step) > now and size > 1e-6:
            size /= 2
        b = b - size * step
        was, now = now, loss(b)
        if was - now < 1e-9 * max(1.0, abs(was)):
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model from rows of docs whose key has a label."""
    spark = docs.sparkSession
    ship(spark)
    gold = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("z"))
    h = F.xxhash64(F.col(key), F.col(text)).alias("h")
    # narrow rows meet the labels; texts of the sample alone are moved
    known = stage(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), h).distinct().join(gold, "k").select("h", "z"), "labelled")
    n = {r["z"]: r["n"] for r in known.groupBy("z").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        drop_staged(spark, known)
        share = float(next(iter(n), 0))
        return Model(bias=np.inf if share else -np.inf)
    chosen = [known.where(F.col("z") == z).orderBy("h").limit(sample) for z in (0, 1)]
    chosen = F.broadcast(chosen[0].unionAll(chosen[1]))  # at most 2 * sample rows
    rows = docs.select(h, F.col(text).cast("string").alias("text")).join(chosen, "h").dropDuplicates(["h"])
    rows = stage(rows, "sample")
    size = {z: min(sample, n[z]) for z in (0, 1)}
    lexicon = mine(rows, size[1], size[0])
    fired, given = read_sample(rows, lexicon)
    drop_staged(spark, known, rows)
    # each label weighs as in all labelled rows, relative to toxic ones
    weight = np.where(given == 1, 1.0, (n[0] / n[1]) * (size[1] / size[0]))
    # of entries that fire on the same texts the first one votes
    voters = list(dict.fromkeys(np.unique(fired[:, : len(lexicon)], axis=1, return_index=True)[1].tolist())) if lexicon else []
    voters = [*sorted(voters)[:VOTERS], *range(len(lexicon), fired.shape[1])]
    p, toxic, clean, own = label_model(fired[:, voters], given, weight)
    b = logistic(fired, p, weight)
    names = [*lexicon, *PATTERNS]
    found = {names[j]: (float(toxic[i]), float(clean[i]), float(own[i])) for i, j in enumerate(voters)}
    return Model(float(b[-1]), dict(zip(lexicon, map(float, b), strict=False)), tuple(map(float, b[len(lexicon) : -1])), found)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, score, predicted) for every row; the model, of bounded size, is sent to all tasks."""
    spark = docs.sparkSession
    ship(spark)
    names = [key, *keep]
    d = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col(text).cast("string").alias("t"))
    schema = ", ".join([*(f"k{i} {d.schema[i].dataType.simpleString()}" for i in range(len(names))), "score double, predicted int"])
    lexicon, weights = list(model.lexicon), np.array([*model.lexicon.values(), *model.patterns])
    bias = model.bias

    def run(batches):
        reader = Reader(lexicon)
        for batch in batches:
            out = np.full(batch.num_rows, bias)
            for i, t in enumerate(batch.column(len(names))):
                found, shown = reader.read(t.as_buffer().to_pybytes() if t.is_valid else b"")
                out[i] += sum(weights[j] for j in sorted(found)) + weights[len(lexicon) :] @ np.array(shown, dtype=float)
            s = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], [*batch.schema.names[: len(names)], "score", "predicted"])

    found = d.mapInArrow(run, schema)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "score", "predicted")
