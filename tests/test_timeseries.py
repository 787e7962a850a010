import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import collect, months, panel, random_wide, series
from marketgrid.functions.expr import roll_mean, win
from marketgrid.operators import crosssection as X
from marketgrid.operators import forecast as FC
from marketgrid.operators import timeseries as T

W = lambda: win(["asset"])


def values(df, col):
    return [r[col] for r in df.orderBy("d").collect()]


def test_gap_needs_full_window(spark):
    s = series(spark, [1, 2, 3, 4, None, 6, 7, 8, 9, 10])
    got = values(s.withColumn("m", roll_mean("x", W(), 3)).withColumn("k", roll_mean("x", W(), 3, 2)), "m")
    assert got == [None, None, 2.0, 3.0, None, None, None, 7.0, 8.0, 9.0]
    two = values(s.withColumn("k", roll_mean("x", W(), 3, 2)), "k")
    assert two == [None, 1.5, 2.0, 3.0, 3.5, 5.0, 6.5, 7.0, 8.0, 9.0]


def test_constant_column_has_no_score(spark):
    s = series(spark, [5] * 20)
    assert set(values(s.withColumn("z", T.zscore("x", W(), 12)), "z")) == {None}
    d = s.select(F.lit("u").alias("u"), "x")
    assert {r.z for r in d.withColumn("z", X.xs_z("x", ["u"])).collect()} == {None}
    assert {r.z for r in d.withColumn("z", X.xs_z("x", ["u"], fill=True)).collect()} == {0.0}


def test_rank_of_ties(spark):
    d = spark.createDataFrame([("u", float(v)) for v in (1, 1, 1, 1, 2)], "u string, x double")
    assert sorted(r.k for r in d.withColumn("k", X.avg_rank("x", ["u"])).collect()) == [2.5] * 4 + [5.0]


def test_wide_rank_is_exact_on_a_hot_value(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([np.full(500, 0.25), rng.random(1000)])
    d = spark.createDataFrame([("g", int(i), float(x)) for i, x in enumerate(v)], "g string, id long, x double")
    got = {r.id: r["rank"] for r in X.with_wide_rank(d, ["g"], "x", buckets=8).collect()}
    want = pd.Series(v).rank()
    assert all(got[i] == want[i] for i in range(len(v)))


def test_rank_pct_counts_missing_priors(spark):
    x = [1, None, 3, 2, None]
    got = values(series(spark, x).withColumn("k", T.rank_pct("x", W(), 4, 1)), "k")
    want = pd.Series(x, dtype=float).rolling(4, min_periods=1).apply(lambda a: (a[-1] > a[:-1]).mean() if len(a) > 1 else np.nan, raw=True)
    assert [None if np.isnan(v) else v for v in want] == got


def test_quadratic_gap_equals_refit(spark):
    rng = np.random.default_rng(2)
    y = 8.0 + 0.01 * np.arange(40) + rng.standard_normal(40).cumsum() * 0.02
    got = values(T.quadratic_gap(series(spark, y, col="y"), ["asset"], "y", min_obs=10), "gap")
    for i in range(40):
        if i < 9:
            assert got[i] is None
        else:
            t = np.arange(i + 1.0)
            b = np.polyfit(t, y[: i + 1], 2)
            assert got[i] == pytest.approx(y[i] - np.polyval(b, i), abs=1e-9)


def test_forecast_uses_only_the_past(spark):
    w = random_wide(40, 2, seed=8)
    rows = [("a", "s", d, float(a), float(b)) for d, a, b in zip(w.index, w["a0"], w["a1"])]
    sch = "asset string, signal string, d date, x double, y double"
    base = values(FC.univariate_forecasts(spark.createDataFrame(rows, sch), ["asset", "signal"], min_obs=12), "forecast")
    rows[-1] = (*rows[-1][:3], rows[-1][3], 99.0)
    moved = values(FC.univariate_forecasts(spark.createDataFrame(rows, sch), ["asset", "signal"], min_obs=12), "forecast")
    assert base == moved
    x, y = w["a0"].to_numpy(), w["a1"].to_numpy()
    b, a = np.polyfit(x[:30], y[:30], 1)
    assert base[30] == pytest.approx(a + b * x[30], abs=1e-12)
    assert base[11] is None and base[12] is not None


def test_clark_west_and_hac_against_numpy(spark):
    rng = np.random.default_rng(4)
    n = 60
    y, f, b = rng.standard_normal((3, n))
    d = months(n)
    df = spark.createDataFrame([("k", x, *map(float, v)) for x, *v in zip(d, y, f, b)], "k string, d date, y double, forecast double, bench double")
    h = (y - b) ** 2 - (y - f) ** 2 + (b - f) ** 2
    e = h - h.mean()
    lag = int(np.floor(4 * (n / 100) ** (2 / 9)))
    var = (e**2).mean() + sum(2 * (1 - k / (lag + 1)) * (e[k:] * e[:-k]).mean() for k in range(1, lag + 1))
    assert FC.clark_west(df, ["k"]).first().stat == pytest.approx(h.mean() / np.sqrt(var / n), rel=1e-9)
    x = np.column_stack([np.ones(n), f])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    u = x * (y - x @ beta)[:, None]
    s = u.T @ u
    for k in range(1, lag + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lag + 1)) * (g + g.T)
    inv = np.linalg.inv(x.T @ x)
    se = np.sqrt(np.diag(inv @ s @ inv))
    r = FC.nw_ols(df.withColumnRenamed("forecast", "x"), ["k"]).first()
    assert (r.alpha, r.beta) == pytest.approx(tuple(beta), rel=1e-8)
    assert (r.t_alpha, r.t_beta) == pytest.approx(tuple(beta / se), rel=1e-8)


def test_tilt_bounds_hold(spark):
    w = random_wide(10, 5, seed=9)
    p = panel(spark, w).withColumn("b", F.lit(0.2))
    got = X.apply_tilt(p, "b", "x", ["universe", "d"], strength=3.0, max_total=0.4)
    for r in got.groupBy("d").agg(F.sum("w").alias("s"), F.sum(F.abs(F.col("w") - 0.2)).alias("x"), F.min("w").alias("m")).collect():
        assert r.s <= 1 + 1e-12 and r.x <= 0.4 + 1e-9 and r.m >= 0


def test_panel_helper_round_trip(spark):
    w = random_wide(4, 2)
    assert len(collect(panel(spark, w), ["asset", "d"], "x")) == 8
