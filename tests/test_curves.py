import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import months
from marketgrid.operators import components as CO
from marketgrid.operators import curves as C


@pytest.fixture(scope="module")
def quotes(spark):
    rng = np.random.default_rng(0)
    ten = [0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0]
    rows = [("c", d, t, float(3 + 0.6 * np.log1p(t) + 0.1 * rng.standard_normal() + 0.5 * np.sin(k / 3))) for k, d in enumerate(months(40)) for t in ten]
    return spark.createDataFrame(rows, "curve string, d date, tenor double, par double")


def test_bootstrap_equals_the_recursion(spark, quotes):
    rows = C.bootstrap_curve(C.par_on_grid(quotes)).filter(F.col("d") == months(1)[0]).orderBy("tenor").collect()
    assert len(rows) == 62
    run = 0.0
    for r in rows:
        if r.tenor < 0.5:
            want = 1 / (1 + r.par * r.tenor)
        else:
            want = (1 - r.par / 2 * run) / (1 + r.par / 2)
            run += want
        assert r.discount == pytest.approx(want, abs=1e-12)


def test_grid_hits_the_quotes(spark, quotes):
    j = C.par_on_grid(quotes).withColumnRenamed("par", "p").join(quotes, ["curve", "d", "tenor"])
    assert j.filter(F.abs(F.col("p") * 100 - F.col("par")) > 1e-9).count() == 0
    assert j.count() == 40 * 7


def test_par_bond_prices_at_par_and_attribution_adds_up(spark, quotes):
    z = C.curve_table(quotes)
    p = C.pack(z, F.ln("discount"), "lnd").withColumn("m", F.lit(10.0))
    px = p.select(C.price_bond(C.par_yield_on_schedule(F.col("m")), F.col("m")).alias("px")).collect()
    assert all(r.px == pytest.approx(100.0, abs=1e-9) for r in px)
    r = C.constant_maturity_returns(z, [2.0, 10.0], max_gap=0.09)
    parts = F.col("carry") + F.col("rolldown") + F.col("duration") + F.col("convexity") + F.col("residual")
    assert r.count() == 78 and r.filter(F.abs(F.col("total") - parts) > 1e-12).count() == 0


def test_too_few_quotes_drop_the_date(spark, quotes):
    d0 = months(1)[0]
    few = quotes.filter((F.col("d") != d0) | (F.col("tenor") > 2))
    assert C.curve_table(few).filter(F.col("d") == d0).count() == 0


def test_svensson_fit_recovers_a_synthetic_curve(spark):
    ten = [0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 20.0, 30.0]
    p = spark.createDataFrame([("c", d, 4.0, -1.5, 1.0, 0.8, 1.8, 9.0) for d in months(3)], "curve string, d date, beta0 double, beta1 double, beta2 double, beta3 double, tau1 double, tau2 double")
    z = p.withColumn("tenor", F.explode(F.array(*map(F.lit, ten)))).withColumn("zero", C.svensson_eval("tenor"))
    for r in CO.svensson_fit_grid(z.select("curve", "d", "tenor", "zero")).collect():
        assert r.rmse < 5e-3 and r.beta0 == pytest.approx(4.0, abs=0.3)


def test_forward_factor_matches_least_squares(spark, quotes):
    z = C.curve_table(quotes).cache()
    f = {r.d: {} for r in z.select("d").distinct().collect()}
    for r in C.forward_rates(z).collect():
        f[r.d][r.n] = r.f
    rx = {}
    for r in C.bond_excess_returns(z).collect():
        rx.setdefault(r.d, []).append(r.rx)
    dates = sorted(f)
    x = np.array([[1.0, *[f[d][n] for n in range(1, 6)]] for d in dates])
    y = np.array([np.nan if rx[d][0] is None else np.mean(rx[d]) for d in dates])
    ok = np.isfinite(y)
    want = x @ np.linalg.lstsq(x[ok], y[ok], rcond=None)[0]
    got, _ = CO.cp_factor(z)
    assert [r.factor for r in got.orderBy("d").collect()] == pytest.approx(list(want), abs=1e-7)
    late = {r.d: r.factor for r in CO.cp_factor_expanding(z, min_obs=12).collect()}
    i = 38
    g = np.linalg.lstsq(x[: i - 12], y[: i - 12], rcond=None)[0]
    assert late[dates[i]] == pytest.approx(float(x[i] @ g), abs=1e-6)


def test_curve_components(spark, quotes):
    z = C.curve_table(quotes)
    load, scores = CO.curve_pca(z, 2)
    wide = z.groupBy("d").pivot("tenor").agg(F.first("zero")).orderBy("d").toPandas().set_index("d").diff().dropna()
    x = wide.to_numpy() - wide.to_numpy().mean(axis=0)
    sv = np.linalg.svd(x, compute_uv=False) ** 2
    share = {r.pc: r.share for r in load.select("pc", "share").distinct().collect()}
    assert share[1] == pytest.approx(sv[0] / sv.sum(), rel=1e-6)
    sd = scores.filter("pc = 1").agg(F.stddev_samp("score")).first()[0]
    assert sd == pytest.approx(np.sqrt(sv[0] / (len(x) - 1)), rel=1e-6)
