import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import months, panel, random_wide
from marketgrid.operators import backtest as B
from marketgrid.operators import metrics as M


def loop(r: np.ndarray, targets: dict[int, np.ndarray], rate: float) -> pd.DataFrame:
    """Plain sequential drift with cash, for comparison."""
    held, rows = None, []
    for i in range(min(targets), len(r)):
        cost = moved = 0.0
        if i in targets:
            pre = np.zeros(r.shape[1]) if held is None else held
            moved = np.abs(targets[i] - pre).sum()
            cost = moved * rate
            held = targets[i]
        gross = held @ r[i]
        rows.append((i, gross, cost, moved, 1 - held.sum()))
        held = held * (1 + r[i]) / ((held * (1 + r[i])).sum() + 1 - held.sum())
    return pd.DataFrame(rows, columns=["i", "gross", "cost", "turnover", "cash"])


def frames(spark, w, targets):
    r = panel(spark, w, value="r")
    rows = [("u", "s", a, w.index[i], float(t[k])) for i, t in targets.items() for k, a in enumerate(w.columns)]
    tg = spark.createDataFrame(rows, "universe string, strategy string, asset string, d date, target double")
    rates = spark.createDataFrame([(a, 0.002) for a in w.columns], "asset string, rate double")
    return r, tg, rates


def test_closed_form_equals_the_loop(spark):
    w = random_wide(50, 4, seed=11, scale=0.08)
    rng = np.random.default_rng(3)
    targets = {i: rng.dirichlet(np.ones(4)) * 0.8 for i in (5, 6, 17, 40)}
    r, tg, rates = frames(spark, w, targets)
    got = B.backtest(r, tg, rates).orderBy("d").toPandas()
    want = loop(w.to_numpy(), targets, 0.002)
    assert len(got) == len(want)
    for k in ("gross", "cost", "turnover", "cash"):
        assert got[k].to_numpy() == pytest.approx(want[k].to_numpy(), abs=1e-12)
    assert got["net"].to_numpy() == pytest.approx((got["gross"] - got["cost"]).to_numpy())
    assert ((got["turnover"] > 0) == (got["cost"] > 0)).all()


def test_missing_return_counts_as_zero_and_bad_target_falls_back(spark):
    w = random_wide(12, 2, seed=12)
    w.iloc[6, 0] = np.nan
    targets = {2: np.array([0.5, 0.5]), 8: np.array([np.nan, 1.0])}
    r, tg, rates = frames(spark, w, targets)
    got = B.backtest(r, tg, rates, turnover="one_way", renormalise=True).orderBy("d").toPandas()
    want = loop(w.fillna(0).to_numpy(), {2: targets[2], 8: np.array([0.5, 0.5])}, 0.002)
    assert got["gross"].to_numpy() == pytest.approx(want["gross"].to_numpy(), abs=1e-12)
    assert got["turnover"].to_numpy()[0] == 0.0
    assert got["turnover"].to_numpy()[6] == pytest.approx(want["turnover"].to_numpy()[6] / 2)


def test_trade_counts_of_the_published_schedule(spark):
    cal = spark.range(10944).select(F.col("id").alias("rn"))
    for n, trades in ((1, 9684), (5, 1937), (63, 154), (252, 39)):
        assert cal.filter(B.every_n(F.col("rn"), n, 1260)).count() == trades


def test_band_trades_exactly_when_crossed(spark):
    # asset 0 gains until it has drifted past the band once, then both stay flat
    w = pd.DataFrame({"a0": [0, 0.2, 0.0, 0.0, 0.0, 0.0], "a1": [0.0] * 6}, index=months(6))
    r, tg, _ = frames(spark, w, {i: np.array([0.5, 0.5]) for i in range(6)})
    for kind, band in (("l1", 0.05), ("max", 0.04)):
        got = sorted(x.d for x in B.band_trades(r, tg, band, kind).collect())
        assert got == [w.index[0], w.index[2]]


def test_metrics_on_edge_cases(spark):
    rows = [("down", d, -0.01, 0.0) for d in months(8)] + [("up", d, 0.01 + 0.001 * i, 0.0) for i, d in enumerate(months(8))] + [("one", months(1)[0], 0.02, 0.0)]
    p = {x.strategy: x for x in M.performance(spark.createDataFrame(rows, "strategy string, d date, r double, rf double"), ["strategy"]).collect()}
    assert p["down"].time_under_water == 7  # the running peak starts at the first value
    assert p["down"].sharpe is None  # zero variance
    assert p["up"].sortino == float("inf") and p["up"].calmar is None and p["up"].time_under_water == 0
    assert p["one"].vol is None and p["one"].sharpe is None and p["one"].periods == 1


def test_breakeven_spread_meets_the_benchmark(spark):
    rng = np.random.default_rng(5)
    d = months(60)
    rows = [("b", x, float(v), 0.001) for x, v in zip(d, rng.normal(0.004, 0.05, 60))] + [("s", x, float(v), 0.001) for x, v in zip(d, rng.normal(0.005, 0.02, 60))]
    df = spark.createDataFrame(rows, "strategy string, d date, r double, rf double")
    be = M.breakeven_spread(df, "b").first()
    assert be.breakeven_bp > 600  # no ceiling
    lev = df.filter("strategy = 's'").withColumn("r", M.lever_series("r", "rf", F.lit(be.leverage), F.lit(be.breakeven_bp)))
    a = M.performance(lev, ["strategy"]).first().sharpe
    b = M.performance(df.filter("strategy = 'b'"), ["strategy"]).first().sharpe
    assert a == pytest.approx(b, abs=1e-9)


def fold(r, goals, band, kind, min_gap):
    """Trade positions by stepping through the dates."""
    held = last = None
    at, out = 0, []
    for i in range(len(r)):
        off = held is None or (np.abs(goals[i] - held).sum() >= band if kind == "l1" else np.abs(held - last).max() > band)
        if held is None or (i - at >= min_gap and off):
            held, last, at = goals[i], goals[i], i
            out.append(i)
        whole = (held * (1 + r[i])).sum() + 1 - held.sum()
        held = held * (1 + r[i]) / whole
    return out


@pytest.mark.parametrize("kind,band,min_gap,chunk", [("l1", 0.12, 1, 256), ("l1", 0.2, 4, 7), ("max", 0.05, 1, 16)])
def test_band_trades_equal_the_fold(spark, monkeypatch, kind, band, min_gap, chunk):
    monkeypatch.setattr(B, "CHUNK", chunk)
    rows, rets, want = [], [], set()
    for u, n in (("u", 90), ("v", 1), ("w", 33)):
        rng = np.random.default_rng(n)
        names, day = ["a", "b", "c"], months(n)
        r = rng.normal(0, 0.06, (n, 3))
        r[rng.random((n, 3)) < 0.05] = 0.0
        if n > 50:
            r[20, 1] = -1.0  # one asset is lost, also for trades after it
        rets += [(u, a, day[i], float(r[i, k])) for i in range(n) for k, a in enumerate(names) if r[i, k] or i % 2]
        for s in ("x", "y"):
            goals = rng.dirichlet(np.ones(3), n) * (0.9 if s == "x" else 1.0) if s == "x" else np.tile([0.5, 0.3, 0.2], (n, 1))
            rows += [(u, s, a, day[i], float(goals[i, k])) for i in range(n) for k, a in enumerate(names)]
            want |= {(u, s, day[i]) for i in fold(r, goals, band, kind, min_gap)}
    path = spark.createDataFrame(rows, "universe string, strategy string, asset string, d date, target double")
    got = B.band_trades(spark.createDataFrame(rets, "universe string, asset string, d date, r double"), path, band, kind, min_gap).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_band_search_never_holds_a_path(spark, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 8)
    day = months(100)
    path = spark.createDataFrame([("u", "s", "a", x, 0.5) for x in day], "universe string, strategy string, asset string, d date, target double")
    rets = spark.createDataFrame([("u", "a", x, 0.01) for x in day], "universe string, asset string, d date, r double")
    sizes = []
    plain = B._first_hits

    def watched(*args):
        run = plain(*args)

        def counted(key, pdf):
            assert len(pdf) <= 16
            return run(key, pdf)

        return counted

    monkeypatch.setattr(B, "_first_hits", watched)
    assert B.band_trades(rets, path, 9.0).count() == 1 and not sizes  # never trades again: every date waits to the end
    assert B.band_trades(rets.limit(0), path.limit(0), 0.1).count() == 0


def test_trades_with_a_missing_target_keep_the_last_ones(spark):
    rows = [("u", "s", a, months(3)[i], t) for i, (x, y) in enumerate([(0.5, 0.5), (None, 1.0), (0.2, 0.8)]) for a, t in (("a", x), ("b", y))]
    got = B.hold_last_valid(spark.createDataFrame(rows, "universe string, strategy string, asset string, d date, target double")).collect()
    assert {r.d for r in got} == {months(3)[0], months(3)[2]}
