"""Language identification by held-out accuracy; quality rules against plain counts and a plain estimation."""

import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import docs, fields, prose  # noqa: E402

from marketgrid.llm import langid, quality  # noqa: E402

STEMS = {"aa": ["tion", "the", "ing", "and", "ough"], "bb": ["ß", "sch", "ung", "der", "ein"], "cc": ["ñ", "ción", "los", "que", "rr"]}


def words(lang, seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def language_rows(spark):
    r = random.Random(7)
    rows = [(i, words(c := r.choice("abc") * 2, i, r.choice((1, 3, 20, 200))), c) for i in range(600)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 -- !!", "bb"), (1003, words("aa", 1, 40000), None), (None, words("bb", 2, 30), "bb"), (1004, words("cc", 3, 30), "cc"), (1004, words("cc", 3, 30), "cc")]
    return spark.createDataFrame([(*x, "s", 0.5, "x") for x in rows], "doc_id long, text string, lang string, source string, score double, lang_pred string")


def test_held_out_documents_are_told_apart(spark):
    table = language_rows(spark)
    got = langid.split_identify(spark, table)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == table.count()
    truth = {r.doc_id: r for r in table.collect()}
    right = held = 0
    for r in got.collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.held_out and truth[r.doc_id].lang:
            held += 1
            right += r.lang_pred == truth[r.doc_id].lang
    assert held > 100 and right / held > 0.93  # single short words are ambiguous


def test_predictions_use_the_text_only(spark):
    table = language_rows(spark)
    model = langid.fit(spark, table.where("lang is not null").selectExpr("cast(doc_id as string) as key", "text", "lang"))
    a = fields(langid.identify(spark, table, model), "lang_pred", "score")
    b = fields(langid.identify(spark, table.selectExpr("doc_id + 5 as doc_id", "text", "'zz' as lang", "'other' as source"), model), "lang_pred", "score")
    assert a == b and (model.w == 0).mean() > 0.5  # the L1 penalty leaves most weights at zero


def test_nothing_to_learn_from(spark):
    table = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert fields(langid.split_identify(spark, table), "doc_id", "lang_pred", "score") == [(1, "und", 0.0), (2, "und", 0.0)]
    assert langid.split_identify(spark, table.limit(0)).count() == 0


def test_leader_formula_and_temperature():
    z, n = np.zeros((langid.DIM + 1, 2)), np.zeros((langid.DIM + 1, 2))
    langid.follow(z, n, [(0, np.array([3]), np.array([1.0]))])
    assert np.allclose(z[3], [-0.5, 0.5]) and np.allclose(n[3], [0.25, 0.25])
    w = langid.weights(z, n)
    assert np.allclose(w[3], [(0.5 - langid.L1) / ((1 + 0.5) / langid.ALPHA + langid.L2), -(0.5 - langid.L1) / ((1 + 0.5) / langid.ALPHA + langid.L2)]) and (w[5] == 0).all()
    r = np.random.default_rng(1)
    logits = r.normal(size=(4000, 3))
    labels = np.array([r.choice(3, p=p) for p in langid.softmax(logits)])
    assert abs(langid.temperature(labels, logits * 4) - 4) < 0.4


def test_grams_fold_case_and_symbols():
    same = lambda a, b: sorted(langid.grams(a.encode())) == sorted(langid.grams(b.encode()))
    assert same("Où ÉTÉ", "où  été!") and not same("ab", "ba") and not len(langid.grams("1 2".encode())) and len(langid.grams("𝒜𐐀".encode()))


def plain_counts(text):
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def quality_texts():
    r, texts = random.Random(3), [(0, None), (1, ""), (2, " \n\t"), (3, "a b a b a b a"), (4, "é ü x\x1cy"), (5, "a b c\n\na b c\n  \na b c"), (None, prose(1, 80)), (6, prose(1, 80)), (6, prose(1, 80)), (7, prose(9, 30000)), (8, "same three words " * 4000)]
    for i in range(10, 150):
        t = prose(i, r.randint(20, 300))
        if i % 7 == 0:
            t = t.replace(" ", "*** ")
        if i % 11 == 0:
            t = t.upper().replace(" ", "!! ")
        if i % 13 == 0:
            t = "\n".join([t[:200]] * 6 + [t])
        if i % 17 == 0:
            t = t.replace(" ", " | ")
        texts.append((i, t))
    return texts


def test_counts_and_verdicts_equal_the_plain_version(spark):
    texts = quality_texts()
    got = quality.judged(docs(spark, texts)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=repr) == sorted(((i, *plain_counts(t)) for i, t in texts), key=repr)
    counted = {}
    for r in got:
        row = tuple(r[n] for n in quality.NAMES)
        counted[row] = counted.get(row, 0) + 1
    votes = np.array(list(counted), float)
    n = np.array(list(counted.values()), float)[:, None]
    prior, good, bad = quality.PRIOR, np.full(votes.shape[1], quality.IF_GOOD[0]), np.full(votes.shape[1], quality.IF_BAD[0])
    score = lambda v: math.log(prior / (1 - prior)) + (v < 0) @ np.log(good / bad) + (v > 0) @ np.log((1 - good) / (1 - bad))
    for _ in range(quality.ROUNDS):
        q = 1 / (1 + np.exp(-score(votes)))[:, None]
        cast = [(n * s * (votes != 0)).sum(0) for s in (q, 1 - q)]
        hit = [(n * s * (votes < 0)).sum(0) for s in (q, 1 - q)]
        prior = min(max(float((n * q).sum() / n.sum()), 0.01), 0.99)
        good = np.where(cast[0] > 0, np.clip(hit[0] / np.maximum(cast[0], 1e-300), *quality.IF_GOOD[1:]), good)
        bad = np.where(cast[1] > 0, np.clip(hit[1] / np.maximum(cast[1], 1e-300), *quality.IF_BAD[1:]), bad)
    for r in got:
        p = 1 / (1 + math.exp(-score(np.array([r[n] for n in quality.NAMES], float))))
        assert abs(p - r.posterior) < 1e-9
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed and p >= 0.5)
    assert 60 < sum(r.kept for r in got) < 140


def test_good_rows_stay_whole(spark):
    table = docs(spark, quality_texts())
    left = quality.keep_good(table)
    assert left.columns == table.columns
    kept = sorted((r.doc_id for r in quality.judged(table).where("kept").collect()), key=repr)
    assert sorted((r.doc_id for r in left.collect()), key=repr) == kept and None in kept


def test_no_documents_to_judge(spark):
    assert quality.judged(docs(spark, [])).count() == 0 and quality.keep_good(docs(spark, [])).count() == 0
    assert quality.estimate([])[0] == quality.PRIOR
