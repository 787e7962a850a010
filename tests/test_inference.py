import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import months
from marketgrid.functions.normal import norm_cdf, norm_ppf, t_ppf, t_sf
from marketgrid.operators import inference as I


def chain(n: int, rep: int, seed: int = I.SEED, block: float = 12.0) -> list[int]:
    """The index path stepped one row at a time from the same hashes."""
    out = []
    for t in range(n):
        h = hashlib.md5(f"{seed}:{rep}:{t}".encode()).hexdigest()
        u, v = int(h[:13], 16) / 2**52, int(h[13:26], 16) / 2**52
        out.append(int(v * n) if t == 0 or u < 1 / block else (out[-1] + 1) % n)
    return out


def test_index_closed_form_equals_the_chain(spark):
    n = spark.createDataFrame([(40,)], "n int")
    got = {}
    for r in I.bootstrap_index(n, 5).orderBy("rep", "t").collect():
        got.setdefault(r.rep, []).append(r.idx)
    assert got == {k: chain(40, k) for k in range(5)}


def test_sharpe_difference_against_resampled_paths(spark):
    rng = np.random.default_rng(1)
    n, reps = 50, 60
    s, b = rng.normal(0.01, 0.03, n), rng.normal(0.005, 0.04, n)
    df = spark.createDataFrame([("k", d, float(x), float(y), 0.001) for d, x, y in zip(months(n), s, b)], "strategy string, d date, r double, b double, rf double")
    sh = lambda v: v.mean() / v.std(ddof=1) * np.sqrt(12)
    xs, xb = s - 0.001, b - 0.001
    draws = np.array([sh(xs[chain(n, k)]) - sh(xb[chain(n, k)]) for k in range(reps)])
    r = I.sharpe_difference(df, ["strategy"], reps=reps, blocks=7).first()
    obs = sh(xs) - sh(xb)
    assert r.difference == pytest.approx(obs)
    assert r.se == pytest.approx(draws.std(ddof=1), rel=1e-8)
    assert r.ci_lo == pytest.approx(np.percentile(draws, 2.5), rel=1e-8)
    assert r.p_one_sided == pytest.approx((draws - draws.mean() >= abs(obs)).mean())


def test_reality_check_counts(spark):
    rng = np.random.default_rng(2)
    n, reps = 40, 50
    x = rng.normal([0.01, 0.0, -0.05], 0.03, (n, 3))
    rows = [("f", f"s{k}", d, float(x[i, k])) for i, d in enumerate(months(n)) for k in range(3)]
    r = I.reality_check(spark.createDataFrame(rows, "family string, strategy string, d date, x double"), ["family"], reps=reps).first()
    boot = np.array([x[chain(n, k)].mean(axis=0) for k in range(reps)])
    om = boot.std(axis=0, ddof=1) * np.sqrt(n)
    t = np.sqrt(n) * x.mean(axis=0) / om
    top = max(0.0, t.max())
    keep = t >= -np.sqrt(2 * np.log(np.log(n)))
    w = np.maximum((np.sqrt(n) * (boot - x.mean(axis=0)) / om).max(axis=1), 0)
    h = np.maximum((np.sqrt(n) * (boot - np.where(keep, x.mean(axis=0), 0)) / om).max(axis=1), 0)
    assert (r.n_strategies, r.n_in_null, r.best) == (3, int(keep.sum()), f"s{t.argmax()}")
    assert r.p_reality_check == pytest.approx((w >= top).mean()) and r.p_spa == pytest.approx((h >= top).mean())


def test_distribution_functions(spark):
    d = spark.createDataFrame([(0.975, 1.96, 10.0)], "p double, z double, k double")
    r = d.select(norm_ppf("p").alias("q"), norm_cdf("z").alias("c"), t_sf("z", "k").alias("s"), t_ppf("p", "k").alias("t")).first()
    assert r.q == pytest.approx(1.959964, abs=1e-6) and r.c == pytest.approx(0.9750021, abs=1e-6)
    assert r.s == pytest.approx(0.0392, abs=2e-4) and r.t == pytest.approx(2.228139, abs=1e-5)


def test_parametric_z_is_antisymmetric(spark):
    rng = np.random.default_rng(3)
    rows = [("k", float(a), float(b)) for a, b in rng.normal(0.01, 0.05, (40, 2))]
    df = spark.createDataFrame(rows, "k string, xs double, xb double")
    z1 = I.jobson_korkie(df, ["k"]).first().z
    z2 = I.jobson_korkie(df.select("k", F.col("xs").alias("xb"), F.col("xb").alias("xs")), ["k"]).first().z
    assert z1 == pytest.approx(-z2)
