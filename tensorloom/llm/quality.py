"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule votes good (1), bad (-1) or abstains (0) from a document's features. Documents are
counted by their pattern of votes (at most 3^rules rows), expectation-maximisation over those
counts estimates each rule's accuracy in good and in bad documents, among those it votes on, and
the share of good ones; a document is kept when its posterior probability of being good is at least one half.
Nothing is sampled: the counts are of all documents.

Words are maximal runs of other characters than space and U+0009 to U+000D. Repeated three-word
windows are found by 64-bit hashes of the words inside one text.

Defined results: null or blank text has no words and fails the base rule; ties of the posterior
at one half are kept; repeated rows each get a row; an empty table gives an empty result. Other
columns are carried by judge(), which uses names with the prefix __q_ for itself.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, stage

LEAST_WORDS = 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BLANKS = " \t\n\x0b\x0c\r"
ROUNDS = 200


def bound(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def occurrences(text: Column, pattern: str) -> Column:
    return (F.size(F.split(text, pattern, -1)) - 1).cast("long")


def repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in words."""

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            n = F.size(s)
            hit = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(F.filter(s, hit), lambda x: x["i"]))

        def summed(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1), x + 3) - x).cast("long"))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return bound(bound(by_hash, positions), summed)

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))
    return bound(words, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(bound(windows(w), count)))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __q_f, a struct of all counts that the rules read."""
    t = F.coalesce(F.col(text), F.lit(""))

    def counts(w: Column, t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            occurrences(t, "[#*$%&|<>]").alias("n_symbols"),
            bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            bound(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            occurrences(t, r"\p{Lu}").alias("n_upper"),
            occurrences(t, "!").alias("n_shouts"),
            occurrences(t, "[.?]").alias("n_stops"),
        )

    words = F.filter(F.split(t, SEPARATORS), lambda w: w != "")
    both = F.struct(words.alias("w"), t.alias("t"))
    return docs.withColumn("__q_f", bound(both, lambda x: counts(x["w"], x["t"])))


def rules(f: Column) -> list[Column]:
    """Votes of the rules: 1 good, -1 bad, 0 abstains."""
    n = F.greatest(f["n_words"], F.lit(1))
    vote = lambda good, bad: F.when(f["n_words"] == 0, 0).when(bad, -1).when(good, 1).otherwise(0)
    symbols = f["n_symbols"] / n
    marked = f["n_symbols"] / F.greatest(f["word_chars"], F.lit(1))
    repeats = f["n_repeat_words"] / n
    doubled = f["n_dup_lines"] / F.greatest(f["n_lines"], F.lit(1))
    upper = f["n_upper"] / F.greatest(f["word_chars"], F.lit(1))
    shouts = f["n_shouts"] / n
    stops = f["n_stops"] / n
    mean = f["word_chars"] / n
    fresh = f["n_distinct"] / F.sqrt(n)
    return [
        vote(symbols <= 0.1, symbols > 0.3),
        vote(marked <= 0.02, marked > 0.08),
        vote(repeats <= 0.2, repeats > 0.5),
        vote(doubled <= 0.3, doubled > 0.6),
        vote(upper <= 0.15, upper > 0.4),
        vote(shouts <= 0.1, shouts > 0.3),
        vote((stops >= 0.02) & (stops <= 0.5), (n >= 40) & (stops < 0.005)),
        vote((mean >= 3) & (mean <= 9), (mean < 1.5) | (mean > 16)),
        vote(fresh >= 3, (n >= 40) & (fresh < 1.5)),
    ]


def pattern(f: Column) -> Column:
    """The votes as one number in base three."""
    out = F.lit(0)
    for v in rules(f):
        out = out * 3 + (v + 1)
    return out.cast("int")


def estimate(patterns: list[tuple[int, int]], n_rules: int, rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over (pattern, count): the share of good documents and each rule's rates.

    Starts from votes counted plainly (no bad vote: probably good, one: open, more: probably bad),
    which fixes which of the two classes is the good one; counts are smoothed by one document for
    each outcome. Failure modes are disjoint, so each is seen by two rules or more, whose agreement
    is what the estimate rests on.
    """
    codes = np.array([p for p, _ in patterns], dtype=np.int64)
    n = np.array([c for _, c in patterns], dtype=np.float64)
    votes = np.stack([(codes // 3 ** (n_rules - 1 - j)) % 3 for j in range(n_rules)]) if len(codes) else np.zeros((n_rules, 0), dtype=np.int64)
    rates = np.full((2, n_rules, 3), 1 / 3)
    share = 0.5
    good = np.array([0.95, 0.5, 0.02])[np.minimum((votes == 0).sum(axis=0), 2)]
    for _ in range(rounds if len(codes) else 0):
        new = (1 + (n * good).sum()) / (2 + n.sum())
        for k, p in ((1, n * good), (0, n * (1 - good))):
            for j in range(n_rules):
                rates[k, j] = 1 + np.bincount(votes[j], weights=p, minlength=3)
            rates[k] /= (rates[k, :, 0] + rates[k, :, 2])[:, None]  # among those that vote
            rates[k, :, 1] = 1  # an abstention tells nothing
        done, share = abs(new - share) < 1e-12, new
        good = posterior(votes, share, rates)
        if done:
            break
    return {"share": float(share), "rates": rates.tolist()}


def posterior(votes: np.ndarray, share: float, rates: np.ndarray) -> np.ndarray:
    odds = np.full(votes.shape[1], math.log(share / (1 - share)))
    for j, v in enumerate(votes):
        odds += np.log(rates[1, j][v]) - np.log(rates[0, j][v])
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(with_features: DataFrame) -> dict:
    """The model from counts of all documents by pattern; a bounded number of rows comes to the driver."""
    found = with_features.groupBy(pattern(F.col("__q_f")).alias("p")).agg(F.count("*").alias("n")).collect()
    return estimate(sorted((r["p"], r["n"]) for r in found), len(rules(F.col("__q_f"))))


def quality(f: Column, model: dict) -> Column:
    """Posterior probability that a document is good."""
    odds = F.lit(math.log(model["share"] / (1 - model["share"])))
    for v, good, bad in zip(rules(f), model["rates"][1], model["rates"][0], strict=True):
        g = [math.log(a) - math.log(b) for a, b in zip(good, bad, strict=True)]
        odds = odds + F.when(v < 0, g[0]).when(v > 0, g[2]).otherwise(g[1])
    return 1 / (1 + F.exp(-odds))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < LEAST_WORDS) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def judge(with_features: DataFrame, model: dict) -> DataFrame:
    """Adds __q_p (posterior) and __q_kept."""
    f = F.col("__q_f")
    d = with_features.withColumn("__q_p", quality(f, model))
    return d.withColumn("__q_kept", ~base_failed(f) & (F.col("__q_p") >= 0.5))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns of docs.

    Features are found once and written to the shared folder with the rows that the base rule passes;
    the others count for the model by their votes alone.
    """
    d = features(docs, text)
    d = stage(d.select(*[F.when(~base_failed(F.col("__q_f")), F.col(c)).alias(c) for c in docs.columns], "__q_f"), "features")
    return judge(d, fit(d)).where("__q_kept").select(*docs.columns)
