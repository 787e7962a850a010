"""Rules and eigenvalues of matrices that stay in blocks or pairs, against whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import random_wide
from marketgrid.functions import solvers as S
from marketgrid.operators import blocks as K
from marketgrid.operators import covariance as V
from marketgrid.operators import hierarchy as H
from marketgrid.operators import weights as W

SCHEMA = "u string, d int, i string, j string, s double"


def matrices():
    out = {}
    for n, (u, d) in zip((1, 6, 25), [("a", 1), ("a", 2), ("b", 1)]):
        x = random_wide(90, n, seed=n).to_numpy()
        out[u, d] = np.atleast_2d(np.cov(x, rowvar=False)) * np.outer(np.arange(1, n + 1), np.arange(1, n + 1))
    return out


def frame(spark, mats):
    rows = [(u, d, f"n{i:03d}", f"n{j:03d}", float(m[i, j])) for (u, d), m in mats.items() for i in range(len(m)) for j in range(i, len(m))]
    return spark.createDataFrame(rows, SCHEMA)


def gathered(df, value="w"):
    out = {}
    for r in df.collect():
        out.setdefault((r.u, r.d), {})[r.asset] = r[value]
    return {k: np.array([v[a] for a in sorted(v)]) for k, v in out.items()}


@pytest.mark.parametrize("rule", ["hrp", "erc", "min_variance", "max_diversification", "inverse_vol", "equal"])
def test_rules_on_blocks_equal_whole_matrices(spark, rule, monkeypatch):
    monkeypatch.setattr(K, "SIDE", 8)
    mats = matrices()
    got = gathered(W.cov_rule(frame(spark, mats), ["u", "d"], rule, dense=0))
    assert set(got) == set(mats)
    for k, m in mats.items():
        assert got[k] == pytest.approx(S.RULES[rule](m), abs=1e-8), k


def test_large_and_small_matrices_share_a_call(spark):
    mats = matrices()
    got = W.cov_rules(frame(spark, mats), ["u", "d"], ["inverse_vol", "hrp"], dense=10)
    for rule in ("inverse_vol", "hrp"):
        by = gathered(got.filter(F.col("rule") == rule))
        for k, m in mats.items():
            assert by[k] == pytest.approx(S.RULES[rule](m), abs=1e-8)


def test_mean_variance_on_blocks(spark):
    mats = matrices()
    rng = np.random.default_rng(1)
    mu = {k: rng.normal(size=len(m)) * 1e-4 for k, m in mats.items()}
    rows = [(u, d, f"n{i:03d}", float(x)) for (u, d), v in mu.items() for i, x in enumerate(v)]
    got = gathered(W.mean_variance(frame(spark, mats), spark.createDataFrame(rows, "u string, d int, asset string, mu double"), ["u", "d"], dense=5))
    for k, m in mats.items():
        assert got[k] == pytest.approx(S.mean_variance_gross(m, mu[k]), rel=1e-6, abs=1e-9)


def test_equal_distances_keep_index_order(spark):
    rng = np.random.default_rng(4)
    m = np.round(np.corrcoef(rng.normal(size=(17, 40))), 1)
    np.fill_diagonal(m, 1.0)
    got = gathered(H.hrp(frame(spark, {("a", 1): m}), ["u", "d"]))
    assert got["a", 1] == pytest.approx(S.hrp(m), abs=1e-10)


def test_spanning_tree_is_kruskals(spark):
    rng = np.random.default_rng(2)
    n, w = 30, rng.integers(0, 40, (30, 30))
    pairs = [("k", f"n{i:02d}", f"n{j:02d}", float(w[i, j])) for i in range(n) for j in range(i + 1, n)]
    home, want = {f"n{i:02d}": i for i in range(n)}, set()
    for _, i, j, x in sorted(pairs, key=lambda p: (p[3], p[1], p[2])):
        if home[i] != home[j]:
            want.add((x, i, j))
            old = home[j]
            home = {k: home[i] if v == old else v for k, v in home.items()}
    got = H.spanning_tree(spark.createDataFrame(pairs, "k string, i string, j string, w double"), ["k"]).collect()
    assert {(r.w, r.i, r.j) for r in got} == want and len(got) == n - 1


def test_bisection_paths():
    starts, beside, codes = H.bisection(5)
    assert starts == [[0, 0, 0], [0, 0, 1], [0, 2, 2], [0, 2, 3, 3], [0, 2, 3, 4]]
    assert beside == [[2, 1], [2, 0], [0, 3], [0, 2, 4], [0, 2, 3]]
    assert codes == sorted(codes) and H.bisection(1) == ([[0]], [[]], [0])


def test_leading_eigenvalues(spark):
    x = random_wide(120, 60, seed=5).to_numpy() * np.arange(1, 61)
    rho = np.corrcoef(x, rowvar=False)
    rows = [("u", f"n{i:03d}", f"n{j:03d}", float(rho[i, j])) for i in range(60) for j in range(i, 60)]
    df = spark.createDataFrame(rows, "universe string, i string, j string, rho double")
    got = V.corr_eigen(df, ["universe"], dense=10, leading=12).orderBy("rank").collect()
    want = np.linalg.eigvalsh(rho)[::-1]
    assert [r.eigenvalue for r in got] == pytest.approx(list(want[:12]), abs=1e-9)
    assert got[-1].cumulative == pytest.approx(want[:12].sum() / 60)
    whole = V.corr_eigen(df, ["universe"]).orderBy("rank").collect()
    assert [r.eigenvalue for r in whole] == pytest.approx(list(want), abs=1e-9)


def test_hierarchical_parity_of_five_thousand_assets(spark):
    """One factor and 5,000 assets: 12.5 million pairs, no matrix. Loads repeat, so the tree is known by its weights' laws."""
    n = 5000
    load = lambda c: 0.2 + (F.col(c) % 7) / 10.0
    pairs = spark.range(n).select(F.col("id").alias("a")).withColumn("b", F.explode(F.sequence("a", F.lit(n - 1))))
    s = F.when(F.col("a") == F.col("b"), load("a") * load("a") + 0.5).otherwise(load("a") * load("b"))
    cov = pairs.select(F.lit("u").alias("u"), F.format_string("n%05d", "a").alias("i"), F.format_string("n%05d", "b").alias("j"), s.alias("s"))
    w = {r.asset: r.w for r in H.hrp(cov, ["u"]).collect()}
    m = np.array([0.2 + (i % 7) / 10 for i in range(n)])
    whole = np.outer(m, m) + np.diag(np.full(n, 0.5))
    assert len(w) == n and sum(w.values()) == pytest.approx(1.0)
    assert np.array([w[f"n{i:05d}"] for i in range(n)]) == pytest.approx(S.hrp(whole), rel=1e-6)
