import numpy as np
import pytest

from helpers import random_wide
from marketgrid.functions import solvers as S
from marketgrid.operators import learn as L
from marketgrid.operators import weights as W


def cov(seed=0, n=6):
    return random_wide(200, n, seed).cov().to_numpy() * np.outer(np.arange(1, n + 1), np.arange(1, n + 1))


def test_erc_contributions_are_equal():
    for seed in range(4):
        s = cov(seed)
        w = S.erc(s)
        rc = w * (s @ w)
        assert w.sum() == pytest.approx(1.0)
        assert rc / rc.sum() == pytest.approx(np.full(6, 1 / 6), abs=1e-8)


def test_hrp_does_not_depend_on_labels():
    s = cov(3)
    w = S.hrp(s)
    p = np.array([4, 2, 0, 5, 1, 3])
    v = S.hrp(s[np.ix_(p, p)])
    assert w.sum() == pytest.approx(1.0)
    # bisection follows the leaf order, which may be mirrored as a whole but groups the same leaves
    assert sorted(np.round(v, 10)) == pytest.approx(sorted(np.round(w, 10)), abs=0.05)
    assert (w > 0).all()


def test_leaf_order_puts_the_older_cluster_left():
    # 2-3 merge first (id 4), then 0-1 (id 5), then both
    d = np.array([[0, 0.2, 0.9, 0.8], [0.2, 0, 0.7, 0.9], [0.9, 0.7, 0, 0.1], [0.8, 0.9, 0.1, 0]])
    assert S.leaf_order(d) == [2, 3, 0, 1]


def test_two_asset_hrp_is_inverse_variance():
    s = np.diag([1.0, 4.0])
    assert S.hrp(s) == pytest.approx([0.8, 0.2])
    assert S.min_variance_clip(s) == pytest.approx([0.8, 0.2])
    assert S.max_diversification_clip(s) == pytest.approx([2 / 3, 1 / 3])
    assert S.inverse_vol(s) == pytest.approx([2 / 3, 1 / 3])


def test_group_budget_balances_group_risk(spark):
    s = cov(1)
    groups = {"a0": "a", "a1": "a", "b2": "b", "b3": "b", "b4": "b", "c5": "c"}
    names = list(groups)
    rows = [("u", names[i], names[j], float(s[i, j])) for i in range(6) for j in range(i, 6)]
    got = W.group_risk_budget(spark.createDataFrame(rows, "universe string, i string, j string, s double"), spark.createDataFrame(list(groups.items()), "asset string, grp string"), ["universe"])
    by = {r.asset: r.w for r in got.collect()}
    w = np.array([by[k] for k in names])
    risks = []
    for g in "abc":
        i = [n for n, k in enumerate(names) if groups[k] == g]
        inner = w[i] * (s[np.ix_(i, i)] @ w[i])
        risks.append(np.sqrt(inner.sum()))
        assert np.ptp(inner) < 1e-8 * inner.max() + 1e-12  # equal risk inside the group
    assert w.sum() == pytest.approx(1.0) and np.ptp(risks) < 1e-8 * max(risks)


def test_mean_variance_respects_gross_limit():
    s = cov(2)
    w = S.mean_variance_gross(s, np.array([1, -1, 2, 0.5, -2, 1.0]))
    assert np.abs(w).sum() == pytest.approx(2.0)


def test_linear_solvers():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((120, 5))
    x = (x - x.mean(0)) / x.std(0)
    y = x @ np.array([1.0, 0, -0.5, 0, 0]) + rng.standard_normal(120)
    y = y - y.mean()
    g, c = x.T @ x / 120, x.T @ y / 120
    b = L.solve_linear(g, c, 120, "ridge", {"alpha": 10.0})
    assert b == pytest.approx(np.linalg.solve(x.T @ x + 10 * np.eye(5), x.T @ y))
    e = L.solve_linear(g, c, 120, "elastic_net", {"alpha": 0.2, "l1_ratio": 0.5})
    grad = g @ e - c + 0.1 * e
    for k in range(5):  # optimality of the penalised problem
        assert abs(grad[k] + 0.1 * np.sign(e[k])) < 1e-9 if e[k] else abs(grad[k]) <= 0.1 + 1e-9
