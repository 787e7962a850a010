import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import collect, panel, random_wide
from marketgrid.operators import covariance as V
from marketgrid.operators import tails as K

U = ["universe"]


def shrunk(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Direct constant-correlation shrinkage with the published scaling of the rho term."""
    t, n = x.shape
    c = x - x.mean(axis=0)
    s = c.T @ c / t
    v = np.diag(s)
    rbar = np.mean([s[i, j] / np.sqrt(v[i] * v[j]) for i in range(n) for j in range(n) if i != j])
    f = rbar * np.sqrt(np.outer(v, v))
    np.fill_diagonal(f, v)
    pi = np.array([[np.mean((c[:, i] * c[:, j]) ** 2) - s[i, j] ** 2 for j in range(n)] for i in range(n)])
    rho = sum(np.sqrt(v[i] / v[j]) * (np.mean(c[:, i] ** 3 * c[:, j]) - v[i] * s[i, j]) for i in range(n) for j in range(n) if i != j)
    delta = np.clip((pi.sum() - np.trace(pi) - rbar * rho) / np.sum((f - s) ** 2) / t, 0, 1)
    return delta * f + (1 - delta) * s, delta


@pytest.mark.parametrize("block", [2, 256])
def test_sample_covariance_pairwise_and_blocked(spark, block):
    w = random_wide(40, 5, seed=1)
    w.iloc[3, 1] = w.iloc[7, 4] = np.nan
    got = collect(V.cov_sample(panel(spark, w), U, ppy=12, block=block), ["i", "j"], "s")
    want = w.cov() * 12
    assert len(got) == 15
    for (i, j), s in got.items():
        assert s == pytest.approx(want.loc[i, j], rel=1e-9)


def test_shrinkage_matches_direct_computation(spark):
    w = random_wide(50, 4, seed=2)
    w["a3"] = w["a3"] * 3 - w["a0"]  # unequal variances and correlations, so that every term matters
    w["a1"] = 0.8 * w["a0"] + 0.4 * w["a1"]
    pairs = V.total(V.pair_sums(panel(spark, w), U, block=3), U)
    ref, delta = shrunk(w.to_numpy())
    assert 0 < delta < 1
    got = V.ledoit_wolf(pairs, U, ppy=1).collect()
    for r in got:
        assert r.delta == pytest.approx(delta, rel=1e-8)
        assert r.s == pytest.approx(ref[int(r.i[1]), int(r.j[1])], rel=1e-8)
    other = V.ledoit_wolf(pairs, U, ppy=1, ratio="delta_method").first().delta
    assert other != pytest.approx(delta, rel=1e-6)


@pytest.mark.parametrize("lookback", [None, 15])
def test_epoch_histories_equal_slices(spark, lookback):
    w = random_wide(48, 3, seed=3)
    due = (F.col("rn") >= 20) & (F.col("rn") % 7 == 0)
    got = V.cov_windowed(panel(spark, w), U, due, kind="sample", lookback=lookback, ppy=1).collect()
    dates = list(w.index)
    assert {r.d for r in got} == {dates[i] for i in range(20, 48) if i % 7 == 0}
    for r in got:
        i = dates.index(r.d)
        want = w.iloc[0 if lookback is None else i - lookback: i].cov()
        assert r.s == pytest.approx(want.loc[r.i, r.j], rel=1e-8)


def test_pair_missing_from_a_chunk_keeps_its_total(spark):
    w = random_wide(36, 2, seed=4)
    w.iloc[12:24, 0] = np.nan
    due = (F.col("rn") > 0) & (F.col("rn") % 12 == 0)
    got = collect(V.cov_windowed(panel(spark, w), U, due, kind="sample", ppy=1), ["d", "i", "j"], "s")
    at = list(w.index)[24]
    assert got[(at, "a0", "a1")] == pytest.approx(w.iloc[:24].cov().loc["a0", "a1"], rel=1e-9)


def test_more_universes_do_not_change_results(spark):
    w = random_wide(30, 3, seed=5)
    one = collect(V.cov_sample(panel(spark, w), U), ["i", "j"], "s")
    many = panel(spark, w, "u0")
    for k in range(1, 10):
        many = many.unionByName(panel(spark, random_wide(30, 3, seed=50 + k), f"u{k}"))
    got = collect(V.cov_sample(many, U), ["universe", "i", "j"], "s")
    for (i, j), s in one.items():
        assert got[("u0", i, j)] == pytest.approx(s, rel=1e-12)


def test_ewma_and_breadth(spark):
    w = random_wide(25, 3, seed=6)
    wt = 0.97 ** np.arange(24, -1, -1)
    wt = wt / wt.sum()
    x = w.to_numpy()
    c = x - wt @ x
    got = collect(V.cov_ewma(panel(spark, w), U, ppy=1), ["i", "j"], "s")
    for (i, j), s in got.items():
        assert s == pytest.approx(float(np.sum(wt * c[:, int(i[1])] * c[:, int(j[1])])), rel=1e-8)
    lam = np.linalg.eigvalsh(w.corr().to_numpy())
    pr = V.participation_ratio(V.corr_matrix(panel(spark, w), U), U).first().participation_ratio
    assert pr == pytest.approx(lam.sum() ** 2 / (lam**2).sum(), rel=1e-9)


def test_exceedance_correlation(spark):
    w = random_wide(80, 3, seed=7)
    got = collect(K.exceedance_correlation(panel(spark, w), U, 0.3, "lower", 5), ["i", "j"], "rho")
    a, b = w["a0"], w["a1"]
    m = (a < a.quantile(0.3)) & (b < b.quantile(0.3))
    assert m.sum() >= 5
    assert got[("a0", "a1")] == pytest.approx(a[m].corr(b[m]), rel=1e-9)
    assert got[("a1", "a0")] == got[("a0", "a1")] and got[("a2", "a2")] == 1.0
