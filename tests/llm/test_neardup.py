"""Near-duplicate groups against all pairs, and the parts they are made of."""

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import WORDS, docs, fields, prose  # noqa: E402

from marketgrid.llm import neardup  # noqa: E402
from marketgrid.llm.components import components  # noqa: E402


def plain_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_groups(texts):
    sets, group = [plain_set(t) for _, t in texts], list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                group[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(texts):
        if doc_id is not None:
            low[find(i)] = min(doc_id, low.get(find(i), doc_id))
    ids = [low.get(find(i)) if sets[i] else texts[i][0] for i in range(len(texts))]
    return sorted(((d, len(s), c, d is not None and d == c) for (d, _), s, c in zip(texts, sets, ids, strict=True)), key=repr)


def edited(text, edits, r):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


def case():
    r, texts, n = random.Random(9), [], 0
    for family in range(12):
        base = prose(family, r.choice((40, 120, 400)))
        for _ in range(r.randint(1, 14)):
            texts.append((n := n + 1, edited(base, r.randint(0, 12), r)))
    hot = prose(99, 150)
    texts += [(n := n + 1, edited(hot, r.randint(0, 14), r)) for _ in range(150)]  # one large group and many that don't quite belong
    texts += [(n := n + 1, hot) for _ in range(60)]
    texts += [(500, "a b"), (499, "A  b"), (501, "a b c d e"), (502, ""), (503, None), (504, " \t\n "), (505, "b a"), (None, hot), (None, "only null"), (506, prose(50, 20000)), (507, prose(50, 20000) + " more"), (507, prose(50, 20000) + " more")]
    return texts


def test_groups_equal_all_pairs(spark):
    texts = case()
    got = fields(neardup.near_duplicates(docs(spark, texts)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == plain_groups(texts)


def test_one_row_of_each_group_stays(spark):
    texts = case()
    table = docs(spark, texts)
    left = neardup.drop_near_duplicates(table)
    assert left.columns == table.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({d for d, _, _, k in plain_groups(texts) if k})


def test_no_rows_and_no_links(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    assert fields(neardup.near_duplicates(docs(spark, [(1, "a"), (2, "b"), (3, None)])), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 3)]


def test_signature_estimates_similarity_and_stops_early():
    r = np.random.default_rng(2)
    gaps = []
    for share in (0.2, 0.5, 0.75, 0.9):
        for _ in range(20):
            both = r.integers(0, 2**63, 400, dtype=np.uint64)
            k = int(400 * share)
            a, b = both, np.concatenate([both[:k], r.integers(0, 2**63, 400 - k, dtype=np.uint64)])
            true = k / (800 - k)
            gaps.append((neardup.superminhash(a, 256) == neardup.superminhash(b, 256)).mean() - true)
    assert abs(np.mean(gaps)) < 0.01 and np.std(gaps) < 0.035
    few = neardup.superminhash(np.arange(3, dtype=np.uint64), 120)
    assert (few < np.iinfo(np.uint64).max).all()  # every register is filled, however few elements


def test_chunks_of_words_make_the_same_set(monkeypatch):
    text = prose(3, 500).encode()
    whole = neardup.shingle_set(text)
    monkeypatch.setattr(neardup, "_STEP", 37)
    assert (neardup.shingle_set(text) == whole).all() and len(whole) == len(plain_set(text.decode()))


def test_parity_sketches_never_overstate_a_difference():
    r = np.random.default_rng(4)
    for _ in range(200):
        a, b = (r.choice(3000, r.integers(1, 2000), replace=False).astype(np.uint64) for _ in range(2))
        apart = np.unpackbits((neardup.odd_sketch(neardup.mix(a)) ^ neardup.odd_sketch(neardup.mix(b))).view(np.uint8)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7), (None, 3), (300, 299), (300, 299)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in range(200, 209)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
