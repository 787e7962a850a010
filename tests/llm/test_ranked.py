"""Ranked search against direct scoring of every document, and the treap against a plain grid."""

import math
import re
from collections import Counter

import numpy as np
from fixtures import docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from marketgrid.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, k=20):
    """Sorted (item, rank, key, score), every document scored."""
    held = [(i, Counter(words(t)), len(words(t))) for i, t in rows]
    held = [h for h in held if h[2]]
    total, length = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, count, n in held:
            m = 75 + (25 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * count[t]) // (1000 * count[t] + 12 * m)) for t in words(text) if t in count)
            if s > 0:
                scored.append((key, s))
        scored.sort(key=lambda x: (-x[1], x[0] is not None, x[0] or 0))
        out += [(item, r + 1, key, s) for r, (key, s) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found(df, item="item_id", key="doc_id"):
    return sorted(((r[item], r["rank"], r[key], r["score"]) for r in df.collect()), key=repr)


def test_results_are_those_of_scoring_every_document(spark):
    rows = [(i, prose(i % 300, 5 + i * 7 % 400)) for i in range(700)]  # copies: many equal scores
    rows += [(i, t) for i, t in zip(range(1000, 1012), [None, "", "--", "rare", "RARE rare", "straße ÑANDÚ 12ab", "ñandú", "a\x00b", "𝄞 x", prose(1, 30000), "a-b a_b", "A B"], strict=True)]
    rows += [(None, prose(3, 30)), (5, prose(3, 30)), (5, prose(3, 30))]
    items = [(j, prose(j, 20 + j)) for j in range(25)] + [(100, "rare"), (100, "Rare, RARE rare"), (None, "straße"), (101, None), (102, ""), (103, "nowhere-at-all zzzq"), (104, prose(1, 3000)), (105, "ÑANDÚ ñandú ab12 12ab"), (106, "a b")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = ranked.index(docs(spark, rows).repartition(5), postings=9000)
    assert got.shards.count() > 5
    want = plain(rows, items)
    assert found(ranked.search(spark, got, queries)) == want
    assert found(ranked.search(spark, got, queries, block_bytes=9000)) == want  # several blocks, the same answers
    assert found(ranked.search(spark, got, queries, k=3)) == plain(rows, items, 3)


def test_one_very_common_term_and_ties_go_by_key(spark):
    rows = [(i, "same words here") for i in range(3000, 0, -1)] + [(0, "other text")]
    items = [(1, "same"), (2, "here other")]
    got = ranked.search(spark, ranked.index(docs(spark, rows).repartition(7), postings=2000), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == plain(rows, items)


def test_empty_tables_other_keys_and_names(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ranked.search(spark, ranked.index(docs(spark, [(1, "a b")])), none).collect() == []
    some = spark.createDataFrame([("q", "b")], "Name string, body string")
    assert found(ranked.search(spark, ranked.index(docs(spark, []).select("doc_id", "text")), some, "Name", "body"), "Name") == []
    pages = spark.createDataFrame([("u1", "b c", 1), ("u2", "d", 2)], "`page.key` string, body string, score int")
    got = ranked.search(spark, ranked.index(pages, "page.key", "body"), some, "Name", "body", key="where")
    assert got.columns == ["Name", "rank", "where", "score"] and found(got, "Name", "where") == plain([("u1", "b c"), ("u2", "d")], [("q", "b")])


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 40), st.integers(1, 200), st.floats(0.01, 0.6), st.integers(1, 12), st.sampled_from([8, 64, 1 << 20]))
def test_treap_search_equals_the_grid(seed, n_rows, n_cols, fill, k, cells):
    r = np.random.default_rng(seed)
    grid = np.where(r.random((n_rows, n_cols)) < fill, r.integers(0, 50, (n_rows, n_cols)), -1)
    grid[0, 0] = 7
    row, col = np.nonzero(grid >= 0)
    treap = ranked.Treap(*ranked.grow(row, col, grid[row, col]))
    asked = r.choice(np.unique(row), min(len(np.unique(row)), 1 + seed % 6), replace=False)
    weights = r.integers(1, 9, len(asked))
    score = weights @ np.where(grid[asked] >= 0, grid[asked], 0)
    floor = 1 + int(r.integers(0, 20))
    cols, scores = treap.best(asked, weights, k, floor, cells)
    bar = max(floor, np.sort(score)[::-1][k - 1] if len(score) >= k else 0)
    want = [(c, s) for c, s in enumerate(score.tolist()) if s >= bar]
    assert sorted(zip(cols.tolist(), scores.tolist(), strict=True)) == want


def test_search_opens_few_cells_for_a_rare_term():
    """Best first: with one document far ahead, most of the grid stays closed."""
    r = np.random.default_rng(1)
    row, col = np.divmod(r.choice(64 * 4096, 60000, replace=False), 4096)
    value = r.integers(1, 10, len(row))
    value[np.flatnonzero(row == 63)[0]] = 10_000
    treap = ranked.Treap(*ranked.grow(row, col, value))
    opened, maps = [], treap.maps

    class Counting:
        def __getitem__(self, at):
            opened.append(np.size(at))
            return maps[at]

    treap.maps = Counting()
    cols, scores = treap.best(np.array([63]), np.array([3]), 1)
    assert scores.tolist() == [30_000] and sum(opened) < 1500


def test_a_stored_index_is_smaller_than_four_times_its_texts():
    rows = [(i, prose(i, 300)) for i in range(400)]
    vocab, ids, tfs, sizes, lengths = {}, [], [], [], []
    for _, t in rows:
        c = Counter(ranked.terms(t.encode()))
        ids += [vocab.setdefault(x, len(vocab)) for x in c]
        tfs += c.values()
        sizes.append(len(c))
        lengths.append(300)
    shard = ranked._shard(vocab, [i for i, _ in rows], ids, tfs, sizes, lengths, 400, 400 * 300)
    assert sum(len(x) for x in shard if isinstance(x, bytes)) < sum(len(t) for _, t in rows)
