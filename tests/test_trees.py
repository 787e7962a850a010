"""Trees of all refits at once against plain recursion on the same bins and draws."""

import datetime as dt

import numpy as np
import pytest

from marketgrid.operators import trees as T
from marketgrid.operators import walk as K

D0 = dt.date(2000, 1, 1)


def frame(spark, n=70, assets=("a", "b", "c"), seed=0, event=False):
    rng = np.random.default_rng(seed)
    rows = []
    x = rng.normal(size=(n, 2)).round(1)
    for k, a in enumerate(assets):
        y = (1 - k) * np.sign(x[:, 0]) + 0.5 * x[:, 1] + 0.3 * rng.normal(size=n)
        if event:
            y = (y > 0.4).astype(float)
        for i in range(n):
            rows.append((a, D0 + dt.timedelta(days=i), None if (i + k) % 17 == 3 else float(y[i]), None if (i * 7 + k) % 31 == 5 else float(x[i, 0]), float(x[i, 1])))
    return spark.createDataFrame(rows, "asset string, d date, y double, x1 double, x2 double").repartition(3), rows


def plain_tree(codes, own, assets, n, w, g, h, depth, leaf):
    """Nested splits by looking at every candidate."""
    def value(s):
        return (w * g)[s].sum() / (w * h)[s].sum()

    def node(s, left):
        best = (1e-12, None)
        if left:
            for f in range(codes.shape[1]):
                for a in range(-1, assets if assets > 1 else 0):
                    for b in range(T.BINS):
                        go = s & (codes[:, f] <= b) & ((a < 0) | (own == a))
                        rest = s & ~go
                        if go.sum() < leaf or rest.sum() < leaf:
                            continue
                        gain = round((w * g)[go].sum() ** 2 / w[go].sum() + (w * g)[rest].sum() ** 2 / w[rest].sum() - (w * g)[s].sum() ** 2 / w[s].sum(), 12)
                        if gain > best[0]:
                            best = (gain, (f, a, b))
        if best[1] is None:
            return lambda c, o, v=value(s): np.full(len(c), v)
        f, a, b = best[1]
        rule = lambda c, o: (c[:, f] <= b) & ((a < 0) | (o == a))
        yes, no = node(s & rule(codes, own), left - 1), node(s & ~rule(codes, own), left - 1)
        return lambda c, o: np.where(rule(c, o), yes(c, o), no(c, o))

    return node(n, depth)


def plain(spark, wide, rows, spec, span, numbered, event=False):
    """{(asset, d): value} by refit after refit."""
    ready, assets = T._rows(wide, K.calendar(wide), ["x1", "x2"], "d", numbered)
    era, edges = T._eras(ready, span, 2)
    r = sorted(ready.collect(), key=lambda q: (q.asset, q.d))
    x, pos, own = np.array([q.x for q in r]), np.array([q.pos for q in r]), np.array([q.a for q in r])
    y, key = np.array([q.y for q in r]), np.array([q.key for q in r], np.int64)
    out = {}
    for e in range(len(span.at)):
        codes = T._coded(x, edges[era[e]])
        train = (pos >= span.lo[e]) & (pos < span.hi[e]) & ~np.isnan(y)
        use = (pos >= span.at[e]) & (pos < span.until[e])
        t = np.nan_to_num(y)
        if event and len(set(t[train])) < 2:
            f = np.full(len(r), t[train].mean())
        elif spec.boost:
            f = np.full(len(r), np.log(t[train].mean() / (1 - t[train].mean())) if event else t[train].mean())
            for turn in range(spec.trees):
                p = 1 / (1 + np.exp(-f)) if event else f
                s = train & (T.noise(key, np.array([T.SEED + turn]))[0] < (spec.sample or 2))
                f = f + spec.rate * plain_tree(codes, own, assets, s, np.ones(len(r)), t - p, p * (1 - p) if event else np.ones(len(r)), spec.depth, spec.leaf)(codes, own)
            f = 1 / (1 + np.exp(-f)) if event else f
        else:
            f = np.zeros(len(r))
            for tree in range(spec.trees):
                w = np.searchsorted(T._POISSON, T.noise(key, np.array([T.SEED + tree]))[0], side="right").astype(float) if spec.trees > 1 else np.ones(len(r))
                f += plain_tree(codes, own, assets, train & (w > 0), w, t, np.ones(len(r)), spec.depth, spec.leaf)(codes, own) / spec.trees
        out |= {(r[i].asset, r[i].d): f[i] for i in np.flatnonzero(use)}
    return out


@pytest.mark.parametrize("local", [0, T.LOCAL])
@pytest.mark.parametrize("spec", [T.Spec(1, 3, 6), T.Spec(4, 2, 3), T.Spec(5, 2, 1, True, 0.3, 0.7)])
def test_regressions_equal_plain_recursion(spark, spec, local, monkeypatch):
    monkeypatch.setattr(T, "RENEW", 2)
    monkeypatch.setattr(T, "LOCAL", local)
    monkeypatch.setattr(T, "regressor", lambda name, prm: spec)
    wide, rows = frame(spark)
    got = {(r.asset, r.d): r.forecast for r in T.walk_forward_trees(wide, ["x1", "x2"], [("m", "any", None)], min_train=20, refit_every=12, horizon=1, embargo=3).collect()}
    assert len(got) == 3 * (70 - 24)
    want = plain(spark, wide, rows, spec, K.refits(70, 24, 12, 4), True)
    assert {k for k, v in got.items() if v is not None} == set(want) and len(want) < len(got)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


@pytest.mark.parametrize("local", [0, T.LOCAL])
@pytest.mark.parametrize("spec,window", [(T.Spec(3, 2, 4, event=True), 30), (T.Spec(4, 2, 1, True, 0.2, event=True), None)])
def test_event_chances_equal_plain_recursion_at_every_row(spark, spec, window, local, monkeypatch):
    monkeypatch.setattr(T, "RENEW", 3)
    monkeypatch.setattr(T, "LOCAL", local)
    monkeypatch.setattr(T, "classifier", lambda name: spec)
    wide, rows = frame(spark, n=44, event=True)
    got = {(r.asset, r.d): r.p for r in T.walk_forward_events(wide, ["x1", "x2"], "any", min_train=36, window=window).collect()}
    want = plain(spark, wide, rows, spec, K.refits(44, 36, 1, 0, window), False, True)
    assert len(got) == 24 and {k for k, v in got.items() if v is not None} == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_thin_and_one_class_training_sets(spark):
    wide, _ = frame(spark, n=30, event=True)
    flat = wide.selectExpr("asset", "d", "0.0 as y", "x1", "x2")
    assert {r.p for r in T.walk_forward_events(flat, ["x1", "x2"], "random_forest", min_train=25).collect()} - {None} == {0.0}
    none = wide.selectExpr("asset", "d", "cast(null as double) as y", "x1", "x2")
    assert {r.p for r in T.walk_forward_events(none, ["x1", "x2"], "gradient_boosting", min_train=25).collect()} == {None}
    assert T.walk_forward_trees(wide, ["x1"], [("t", "shallow_tree", None)], min_train=40).count() == 0


def test_forests_draw_signals_at_each_node():
    draw = [T.noise(np.arange(4 * 9, dtype=np.uint64), np.array([t * 64]))[0].reshape(4, 9).argsort(1).argsort(1) < 3 for t in range(40)]
    assert {int(d.sum()) for d in draw} == {12}
    assert np.mean(draw, axis=(0, 1)) == pytest.approx(np.full(9, 1 / 3), abs=0.12)


def test_noise_is_uniform_and_draws_have_mean_one():
    u = T.noise(np.arange(20000, dtype=np.int64), np.array([3, 4]))
    assert u.mean(1) == pytest.approx([0.5, 0.5], abs=0.01) and abs(np.corrcoef(u)[0, 1]) < 0.03
    assert np.searchsorted(T._POISSON, u, side="right").mean() == pytest.approx(1.0, abs=0.02)
