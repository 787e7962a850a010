"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule says good, bad or nothing of a document. The votes of all documents, counted by pattern, give each
rule's accuracies on good and on bad documents and the share of good ones by expectation-maximisation; a
document's posterior probability of being good then decides, in place of a demand that every rule pass. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_WORDS, MAX_REPEAT = 50, 50
ROUNDS, PRIOR = 25, 0.7
#: chance of a bad vote where a rule votes, on good and on bad documents: where the estimation starts, least, most
IF_GOOD, IF_BAD = (0.01, 0.001, 0.03), (0.3, 0.15, 0.5)
#: (rule, numerator, denominator, good range, bad outside of): shares per word, line or character
RULES = (
    ("long_enough", "n_words", None, (100, None), (50, None)),
    ("word_length", "word_chars", "n_words", (3, 10), (2, 15)),
    ("few_symbols", "n_symbols", "n_words", (None, 0.05), (None, 0.2)),
    ("mostly_letters", "n_symbols", "word_chars", (None, 0.02), (None, 0.1)),
    ("few_shouts", "n_shouts", "n_words", (None, 0.05), (None, 0.2)),
    ("few_capitals", "n_capitals", "word_chars", (None, 0.15), (None, 0.4)),
    ("new_lines", "n_dup_lines", "n_lines", (None, 0.1), (None, 0.5)),
    ("new_phrases", "n_repeat_words", "n_words", (None, 0.1), (None, 0.3)),
    ("few_bars", "n_bars", "n_words", (None, 0.02), (None, 0.15)),
)
NAMES = tuple(r[0] for r in RULES)


def _count(pattern: str) -> Column:
    """Characters of a class, given the pattern of the others."""
    return F.length(F.regexp_replace("text", pattern, "")).cast("long")


def features(docs: DataFrame, first: str = "doc_id") -> DataFrame:
    """Counts of each whole text, after the column ``first``; a null text is an empty one."""
    split = docs.select(first, F.coalesce("text", F.lit("")).alias("text"))
    cut = split.withColumns(
        {
            "w": F.filter(F.split("text", r"[ \t-\r]+"), lambda x: x != ""),
            "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
            "n_symbols": _count(r"[^#*$%&|<>]+"),
            "n_shouts": _count(r"[^!]+"),
            "n_capitals": _count(r"[^A-ZÀ-ÖØ-Þ]+"),
            "n_bars": _count(r"[^|]+"),
        }
    ).drop("text")
    triples = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    counted = cut.select(
        first, "n_symbols", "n_shouts", "n_capitals", "n_bars", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), triples.alias("h"),
    )
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    sorted_ = counted.withColumn("s", pairs).drop("h")
    again = F.filter("s", lambda x, j: x["h"].eqNullSafe(F.get("s", j - 1)["h"]) | x["h"].eqNullSafe(F.get("s", j + 1)["h"]))
    placed = sorted_.withColumn("p", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("s")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("p", start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("p")


def vote(low_high: tuple, bad: tuple, value: Column) -> Column:
    """1 inside the good range, -1 outside the other, 0 between them or without a value."""
    inside = lambda r: F.lit(True) if r == (None, None) else (F.lit(True) if r[0] is None else value >= r[0]) & (F.lit(True) if r[1] is None else value <= r[1])
    return F.when(value.isNull(), 0).when(inside(low_high), 1).when(~inside(bad), -1).otherwise(0)


def votes(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.col(a).cast("double") if b is None else F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counts.withColumns({name: vote(good, bad, share(a, b)) for name, a, b, good, bad in RULES})


def clip(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """(share of good documents, chances of a bad vote on good and on bad ones for each rule) by expectation-maximisation.

    A rule's two accuracies are 1 less the first and the second itself. Their bounds say what rules are for: a
    bad vote is seldom wrong, and each rule knows one kind of bad document, so a good vote says little. No rule
    can flip, and one that never votes keeps its starting values.
    """
    m = len(patterns[0][0]) if patterns else len(RULES)
    prior, chances = PRIOR, [(IF_GOOD[0], IF_BAD[0])] * m
    for _ in range(rounds):
        total = good = 0.0
        sums = [[0.0] * 4 for _ in range(m)]  # bad votes and votes on good documents, then on bad ones
        weights = [weight(c) for c in chances]
        for row, n in patterns:
            q = 1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(w[v] for v, w in zip(row, weights, strict=True))))
            total += n
            good += n * q
            for v, s in zip(row, sums, strict=True):
                if v:
                    s[0] += n * q * (v < 0)
                    s[1] += n * q
                    s[2] += n * (1 - q) * (v < 0)
                    s[3] += n * (1 - q)
        prior = clip(good / total, 0.01, 0.99) if total else prior
        chances = [(clip(s[0] / s[1], *IF_GOOD[1:]) if s[1] > 0 else c[0], clip(s[2] / s[3], *IF_BAD[1:]) if s[3] > 0 else c[1]) for s, c in zip(sums, chances, strict=True)]
    return prior, chances


def weight(chances: tuple[float, float]) -> dict[int, float]:
    """What a vote adds to the log odds of a good document."""
    a, b = chances
    return {-1: math.log(a / b), 0: 0.0, 1: math.log((1 - a) / (1 - b))}


def judged(docs: DataFrame, first: str = "doc_id") -> DataFrame:
    """Counts, votes, posterior, base_failed and kept for each row of ``docs(doc_id, text)``.

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEAT percent of the words in repeated three-word
    windows; such documents go whatever the votes. kept: otherwise, whether the posterior is at least one half.
    Vote patterns are counted by Spark; at most 3 ** rules counts reach the driver. Null, empty and wordless texts
    have no words and fail. Repeated rows are judged alike; an empty table gives an empty table; other columns are
    ignored.
    """
    voted = stored(votes(features(docs, first)))
    rows = voted.groupBy(*NAMES).count().orderBy(*NAMES).collect()
    prior, chances = estimate([(tuple(r)[:-1], r[-1]) for r in rows])
    weights = [weight(c) for c in chances]
    odds = sum((F.when(F.col(name) < 0, w[-1]).when(F.col(name) > 0, w[1]).otherwise(0.0) for name, w in zip(NAMES, weights, strict=True)), F.lit(math.log(prior / (1 - prior))))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    return voted.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that `judged` keeps, with all their columns; each row is judged by its own text, without a join."""
    return judged(docs.select(F.struct("*").alias("row"), "text"), "row").where("kept").select("row.*")
