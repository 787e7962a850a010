"""Walk-forward trees and classifiers on small frames."""

import datetime as dt

import numpy as np
import pytest

from marketgrid.operators import learn as L


def frame(spark, n=80, assets=("a", "b"), seed=0, hole=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    rows = []
    for k, a in enumerate(assets):
        y = (1 - 2 * k) * np.sign(x[:, 0]) + 0.1 * rng.normal(size=n)
        for i in range(n):
            rows.append((a, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(y[i]), None if hole == i else float(x[i, 0]), float(x[i, 1])))
    return spark.createDataFrame(rows, "asset string, d date, y double, x1 double, x2 double")


def test_pooled_trees_tell_assets_apart_and_keep_every_row(spark):
    wide = frame(spark, hole=70)
    got = L.walk_forward_trees(wide, ["x1", "x2"], [("tree", "shallow_tree", {"max_depth": 3})], min_train=50, refit_every=20, horizon=1, embargo=0).collect()
    assert len(got) == 2 * (80 - 51)
    by = {(r.asset, r.d): r.forecast for r in got}
    days = sorted({d for _, d in by})
    assert by[("a", dt.date(2000, 1, 1) + dt.timedelta(days=70))] is None
    assert np.mean([by[("a", d)] * by[("b", d)] < 0 for d in days if by[("a", d)] is not None]) > 0.9


@pytest.mark.parametrize("model,penalty", [("logit", 1.0), ("logit_l1", 0.1)])
def test_penalty_follows_the_rows(spark, model, penalty):
    wide = frame(spark, assets=("a",), seed=3)
    events = wide.selectExpr("asset", "d", "cast(y > 0 as double) as y", "x1", "x2")
    got = {r.d: r.p for r in L.walk_forward_classifier(events, ["x1", "x2"], model, min_train=60, refit_every=40).collect()}
    rows = sorted((r.d, r.y, r.x1, r.x2) for r in events.collect())
    x = np.array([r[2:] for r in rows[:60]])
    y = np.array([r[1] for r in rows[:60]])
    sd = x.std(0, ddof=1)
    z, z1 = x / sd, np.array([r[2:] for r in rows[60:]]) / sd
    w, b = np.zeros(2), 0.0
    for _ in range(60000):  # proximal gradient on the penalised mean loss
        p = 1 / (1 + np.exp(-(z @ w + b)))
        g, gb = z.T @ (p - y) / 60, (p - y).mean()
        b -= 0.5 * gb
        w = w - 0.5 * g
        w = w / (1 + 0.5 / (penalty * 60)) if model == "logit" else np.sign(w) * np.maximum(np.abs(w) - 0.5 / (penalty * 60), 0)
    want = 1 / (1 + np.exp(-(z1 @ w + b)))
    assert [got[r[0]] for r in rows[60:]] == pytest.approx(list(want), abs=2e-3)


def test_one_class_predicts_its_rate(spark):
    wide = frame(spark, assets=("a",)).selectExpr("asset", "d", "0.0 as y", "x1", "x2")
    assert {r.p for r in L.walk_forward_classifier(wide, ["x1"], "logit", min_train=40, refit_every=30).collect()} == {0.0}
    assert L.walk_forward_classifier(wide.limit(5), ["x1"], "logit", min_train=40).count() == 0
