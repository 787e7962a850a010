"""Rule ensemble: extraction of paths, agreement of compiled and plain scores, held-out accuracy, awkward tables."""

import math
import random
import re

import pytest
from fixtures import docs, prose
from pyspark.sql import functions as F

from marketgrid.llm import rulefit
from marketgrid.llm.rulefit import Model, Rule

PRINTED = """RandomForestClassificationModel: uid=x, numTrees=2, numClasses=2, numFeatures=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 0 <= -0.25)
      Predict: 0.0
     Else (feature 0 > -0.25)
      Predict: 1.0
    Else (feature 0 > 1.5)
     Predict: 0.0
  Tree 1 (weight 1.0):
    If (feature 1 <= 1.0E-4)
     Predict: 0.0
    Else (feature 1 > 1.0E-4)
     If (feature 0 <= 1.5)
      Predict: 0.0
     Else (feature 0 > 1.5)
      Predict: 1.0
"""
INF = math.inf


def test_paths_become_rules_with_narrowed_bounds():
    got = rulefit.paths(PRINTED, ["a", "b"])
    assert got == [
        Rule((("a", -INF, 1.5),)), Rule((("a", -INF, -0.25),)), Rule((("a", -0.25, 1.5),)), Rule((("a", 1.5, INF),)),
        Rule((("b", -INF, 1e-4),)), Rule((("b", 1e-4, INF),)), Rule((("a", -INF, 1.5), ("b", 1e-4, INF))), Rule((("a", 1.5, INF), ("b", 1e-4, INF))),
    ]


def test_compiled_score_is_the_logistic_of_the_rules_that_hold(spark):
    model = Model(-1.0, ((Rule((("a", 0.0, 2.0),)), 1.5), (Rule((("a", -INF, 1.0), ("b", 3.0, INF))), -2.0)))
    rows = spark.createDataFrame([(a, b) for a in (-1.0, 0.0, 0.5, 1.0, 2.0, 2.5) for b in (2.0, 3.0, 4.0)], "a double, b double")
    for r in rows.select("a", "b", model.score().alias("s")).collect():
        z = -1.0 + (1.5 if 0 < r.a <= 2 else 0) - (2.0 if r.a <= 1 and r.b > 3 else 0)
        assert r.s == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-15)


def plain_statistics(text):
    t = text or ""
    ws = " \t\n\x0b\x0c\r"
    words = [w for w in re.split(f"[{ws}]+", t) if w]
    n = len(words)
    share = lambda x: x / n if n else 0.0
    lines = [x for x in t.split("\n") if x]
    return {
        "words": n, "chars": share(len(t)), "symbols": share(sum(c in "#*$%&|<>{}[]\\^~=_@" for c in t)), "bangs": share(sum(c in "!?" for c in t)),
        "commas": share(sum(c in ",;:" for c in t)), "echoes": share(sum(a == b for a, b in zip(words, words[1:]))), "digits": share(sum(c.isnumeric() for c in t)),
        "upper": share(sum(c.isupper() for c in t)), "lines": share(t.count("\n")), "distinct": share(len(set(words))), "bare": share(sum(not any(c.isalnum() for c in w) for w in words)),
        "sentences": share(sum(w[-1] in ".!?" for w in words)), "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "tails": share(sum(len(w) - len(re.sub(r"[^A-Za-zÀ-ÿ0-9]+$", "", w)) >= 2 for w in words)),
        "caps": share(sum(len(x) for x in [re.findall(r"^[A-ZÄÖÜÉ]{2,}(?![A-Za-zÀ-ÿ])", w) for w in words])),
    }


def test_statistics_equal_plain_ones(spark):
    texts = [None, "", "  \n\t ", "one", "a a a b", "Xy XY, XYZ! AB12 Ab ÄÖ", "x | y | z.", "w### v$$$ end.\nend.\nend.", "no!! yes?! 12 3,4", "é é É", prose(1, 5000) + ".\n" + prose(1, 50), "a\x0bb\x0cc\rd", "a b a b", "..", "ha" * 30000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = rulefit.with_statistics(df, "text", ["i"], "s_").collect()
    for r in got:
        want = plain_statistics(texts[r.i])
        assert set(want) == {c[2:] for c in r.asDict() if c.startswith("s_")}
        for name, value in want.items():
            assert r["s_" + name] == pytest.approx(value), (texts[r.i], name)


def corpus(n):
    out = []
    for i in range(n):
        r = random.Random(i)
        text, good = prose(i, r.randint(20, 200)).capitalize() + ".", 1
        if i % 4 == 0:
            words = text.split()
            text, good = [" | ".join(words), " ".join(w for w in words[:10] for _ in range(9)), text.upper().replace(" ", "!! ")][i // 4 % 3], 0
        out.append((i, text, good))
    return out


def test_held_out_rows_are_judged_right_and_the_ensemble_is_sparse(spark):
    rows = corpus(900)
    df = docs(spark, [(i, t) for i, t, _ in rows] + [(None, "x"), (5000, None), (5001, "")])
    labels = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in rulefit.split_classify(spark, df, labels).collect()}
    assert got[None].held_out is False and len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[i].predicted, g) for i, _, g in rows if got[i].held_out]
    assert len(held) > 120 and sum(a == b for a, b in held) / len(held) > 0.97
    model = rulefit.fit(df, labels)
    assert 0 < len(model.rules) < 100
    again = rulefit.classify(df.select("doc_id", "text", F.lit(1).alias("S_x"), F.lit(2).alias("score")), model)
    assert again.columns == ["doc_id", "S_x", "score", "predicted"] and again.count() == 903


def test_labels_that_say_nothing(spark):
    df = docs(spark, [(i, "some text here") for i in range(20)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in rulefit.classify(df.select("doc_id", "text"), rulefit.fit(df, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 0), (3, None), (4, 7), (12, 0), (12, 1), (99, 0)], "doc_id long, quality int")
    assert {round(r.score, 9) for r in rulefit.classify(df.select("doc_id", "text"), rulefit.fit(df, ones)).collect()} == {round(10 / 11, 9)}
    same = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")  # nothing to split on
    assert {round(r.score, 9) for r in rulefit.classify(df.select("doc_id", "text"), rulefit.fit(df, same)).collect()} == {0.5}
    assert rulefit.classify(df.limit(0).select("doc_id", "text"), Model(0.0, ())).collect() == []
