"""Inputs past limits that must not exist."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketgrid import session
from marketgrid.operators import backtest as B
from marketgrid.operators import components as CO
from marketgrid.operators import forecast as FC
from marketgrid.operators import signals as S
from marketgrid.operators import weights as W
from marketgrid.sources import files

D0 = dt.date(2000, 1, 1)


def test_lags_beyond_any_fixed_frame(spark):
    rows = [("a", D0 + dt.timedelta(days=i), float(i % 7), 150) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, d date, e double, lag int")
    got = FC._with_lags(df, ["k"], ["e"], "lag", "d").groupBy("_lagk").agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("_pe")).alias("s")).collect()
    e = np.array([r[2] for r in rows])
    assert {r._lagk: (r.n, r.s) for r in got} == {k: (400 - k, float((e[k:] * e[:-k]).sum())) for k in range(1, 151)}


def test_absent_series_keep_their_signals(spark):
    levels = spark.createDataFrame([("all", D0 + dt.timedelta(days=31 * i), float(i)) for i in range(30)], "u string, d date, UNRATE double")
    got = S.monthly_macro_block(levels).groupBy("signal").agg(F.count("x").alias("n")).collect()
    by = {r.signal: r.n for r in got}
    assert by["unrate"] == 30 and by["cpi_yoy"] == 0 and len(by) == 8 * 2 + 7 * 3 + 1 + 2


def test_only_a_missing_path_is_an_empty_table(spark, tmp_path):
    assert files.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="not a Parquet file"):
        files.read_optional(spark, str(tmp_path / "bad"), "a int").count()


def test_a_large_matrix_is_not_refused(spark):
    n = 5200
    cov = spark.range(n).select(F.lit("u").alias("universe"), F.format_string("a%05d", "id").alias("i"), F.format_string("a%05d", "id").alias("j"), (F.col("id") + 1.0).alias("s"))
    w = {r.asset: r.w for r in W.cov_rule(cov, ["universe"], "inverse_vol").collect()}
    iv = 1 / np.sqrt(np.arange(1, n + 1))
    assert len(w) == n and w["a00000"] == pytest.approx(iv[0] / iv.sum())


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "local-cluster[2,1,1024]"}.get(key, default)

    class Cluster:
        conf = Conf()

    with pytest.raises(RuntimeError):
        session.scratch_path(Cluster(), "x")


def loop_scores(wide, min_obs, coverage):
    """First-component scores by plain recomputation at every date."""
    out = {}
    for i in range(min_obs, len(wide)):
        seen = wide.iloc[: i + 1]
        seen = seen.loc[:, seen.notna().sum() / (i + 1) >= coverage].dropna()
        seen = seen.loc[:, seen.std() > 0]
        if len(seen) < min_obs or seen.shape[1] < 2:
            continue
        z = ((seen - seen.mean()) / seen.std()).to_numpy()
        u, s, vt = np.linalg.svd(z, full_matrices=False)
        pc = u[:, 0] * s[0] * (1 if vt[0].sum() >= 0 else -1)
        out[wide.index[i]] = pc[-1] / pc.std()
    return out


def test_recursive_component_equals_recomputation(spark):
    rng = np.random.default_rng(2)
    common = rng.normal(size=90).cumsum()
    wide = pd.DataFrame({k: common * w + rng.normal(size=90) for k, w in (("a", 1), ("b", 0.8), ("c", 0.5), ("late", 0.7), ("flat", 0))}, index=[D0 + dt.timedelta(days=i) for i in range(90)])
    wide["flat"] = 3.0
    wide.loc[wide.index[:40], "late"] = np.nan
    wide.loc[wide.index[[5, 50, 89]], "b"] = np.nan
    rows = [("u", k, d, None if np.isnan(v) else float(v)) for k in wide for d, v in wide[k].items()]
    got = {r.d: r.score for r in CO.recursive_pc1(spark.createDataFrame(rows, "universe string, series string, d date, x double"), ["universe"], min_obs=30, coverage=0.6).collect()}
    want = loop_scores(wide, 30, 0.6)
    assert set(got) == set(want) and len(got) > 40
    assert [got[d] for d in want] == pytest.approx(list(want.values()), abs=1e-6)


def plain_band(goal, ret, band, kind, gap):
    held, last, at, out = None, None, 0, []
    for i, g in enumerate(goal):
        if held is None or (i - at >= gap and ((np.abs(g - held).sum() >= band) if kind == "l1" else np.abs(held - last).max() > band)):
            held, last, at = g, g, i
            out.append(i)
        grown = held * (1 + ret[i])
        held = grown / (grown.sum() + 1 - held.sum())
    return out


def test_bands_equal_a_plain_walk_on_many_strategies(spark):
    rng = np.random.default_rng(4)
    rows, path, want = [], [], {}
    for u in ("x", "y"):
        ret = rng.normal(0, 0.08, (60, 3))
        rows += [(u, f"a{k}", D0 + dt.timedelta(days=i), float(ret[i, k])) for i in range(60) for k in range(3)]
        for s in ("p", "q"):
            goal = rng.dirichlet(np.ones(3) * 30, 60) * (1.0 if s == "p" else 0.9)
            path += [(u, s, f"a{k}", D0 + dt.timedelta(days=i), float(goal[i, k])) for i in range(60) for k in range(3)]
            want[(u, s)] = (goal, ret)
    r = spark.createDataFrame(rows, "universe string, asset string, d date, r double")
    p = spark.createDataFrame(path, "universe string, strategy string, asset string, d date, target double")
    for kind, band, gap in (("l1", 0.3, 2), ("max", 0.08, 1)):
        got = {}
        for row in B.band_trades(r, p, band, kind, gap).collect():
            got.setdefault((row.universe, row.strategy), set()).add((row.d - D0).days)
        assert {k: sorted(v) for k, v in got.items()} == {k: plain_band(*v, band, kind, gap) for k, v in want.items()}
        assert max(map(len, got.values())) > 5


def test_sliding_ranks_equal_the_window_expression(spark):
    from marketgrid.functions.expr import win
    from marketgrid.operators import timeseries as T

    rng = np.random.default_rng(6)
    rows = [(k, D0 + dt.timedelta(days=i), None if rng.random() < 0.1 else float(rng.integers(0, 6))) for k, n in (("a", 130), ("b", 7), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, d date, x double")
    for window, need in ((5, 1), (24, None), (200, 3)):
        both = T.with_rank_pct(df, ["k"], "x", "got", window, need).withColumn("want", T.rank_pct("x", win(["k"]), window, need)).collect()
        assert len(both) == len(rows) and all(r.got == pytest.approx(r.want) if r.want is not None else r.got is None for r in both)


def plain_choice(x, r, burn, step, window, horizon, need):
    """Candidate with the best trailing rank correlation at each choice."""
    n, out, now = len(r), {}, None
    fwd = np.array([r[i + 1 : i + 1 + horizon].sum() if i + horizon < n else np.nan for i in range(n)])
    for t in range(burn, n):
        if (t - burn) % step == 0:
            best = []
            for pos, name in enumerate(sorted(x)):
                lo, hi = max(t - window, 0), t - horizon
                a, b = x[name][lo:hi], fwd[lo:hi]
                ok = ~np.isnan(a) & ~np.isnan(b)
                a, b = pd.Series(a[ok]).rank(), pd.Series(b[ok]).rank()
                ic = a.corr(b) if ok.sum() >= need and a.std() > 0 and b.std() > 0 else -np.inf
                best.append((-round(ic, 12) if np.isfinite(ic) else np.inf, pos, name))
            now = min(best)[2]
        out[t] = now
    return out


@pytest.mark.parametrize("burn,step,window,horizon", [(20, 3, 15, 1), (10, 7, 40, 2), (30, 5, 9, 1)])
def test_window_choice_moves_each_row_twice(spark, burn, step, window, horizon):
    rng = np.random.default_rng(7)
    ret, cand, want = [], [], {}
    for k in ("p", "q"):
        r = rng.normal(size=80).round(1)
        x = {c: np.where(rng.random(80) < 0.1, np.nan, rng.integers(0, 9, 80)) for c in ("c0", "c1", "c2")}
        ret += [("u", k, D0 + dt.timedelta(days=i), float(r[i])) for i in range(80)]
        cand += [("u", k, D0 + dt.timedelta(days=i), p, c, None if np.isnan(x[c][i]) else float(x[c][i])) for p, c in enumerate(sorted(x)) for i in range(80)]
        want |= {(k, D0 + dt.timedelta(days=t)): c for t, c in plain_choice(x, r, burn, step, window, horizon, 5).items()}
    c = spark.createDataFrame(cand, "universe string, asset string, d date, pos int, candidate string, x double")
    got = CO.adaptive_choice(c, spark.createDataFrame(ret, "universe string, asset string, d date, r double"), ["universe"], burn, step, window, horizon, 5).collect()
    assert {(r.asset, r.d): r.candidate for r in got} == want


@pytest.mark.parametrize("lookback", [None, 12])
def test_training_windows_share_their_rows(spark, lookback):
    rng = np.random.default_rng(8)
    rows = [(u, f"a{k}", D0 + dt.timedelta(days=i), float(rng.normal()), 0.01 * i) for u, n in (("u", 60), ("v", 20)) for i in range(n) for k in range(3) if not (k == 2 and i < 30)]
    panel = spark.createDataFrame(rows, "universe string, asset string, d date, r double, rf double")
    epochs = spark.createDataFrame([(u, D0 + dt.timedelta(days=i)) for u, n in (("u", 60), ("v", 20)) for i in range(0, n, 4)], "universe string, epoch date")
    fn = lambda train, rf: train.sum() + rf.iloc[-1] + len(train)
    got = {(r.universe, r.epoch, r.asset): r.w for r in W.train_rule_windows(panel, epochs, ["universe"], fn, lookback, parts=3).collect()}
    want = {}
    for u, n in (("u", 60), ("v", 20)):
        for e in range(0, n, 4):
            mine = [x for x in rows if x[0] == u and (x[2] - D0).days < e and (lookback is None or (x[2] - D0).days >= e - lookback)]
            for k in {x[1] for x in mine}:
                want[u, D0 + dt.timedelta(days=e), k] = sum(x[3] for x in mine if x[1] == k) + max(x[4] for x in mine) + len({x[2] for x in mine})
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_resample_counts_do_not_grow_with_strategies(spark, monkeypatch):
    from marketgrid.operators import inference as I

    rng = np.random.default_rng(9)
    days = [D0 + dt.timedelta(days=i) for i in range(30)]
    rows = [(f"s{k:02d}", days[i], float(rng.normal()), float(rng.normal())) for k in range(9) for i in range(30 - (k % 2) * 5)]
    df = spark.createDataFrame(rows, "strategy string, d date, r double, b double")
    one = {r.strategy: r for r in I.sharpe_difference(df, ["strategy"], reps=40, blocks=3, rf=None).collect()}
    monkeypatch.setattr(I, "STRATEGIES", 2)
    two = {r.strategy: r for r in I.sharpe_difference(df, ["strategy"], reps=40, blocks=5, rf=None).collect()}
    assert len(one) == 9 and all(one[k].se == pytest.approx(two[k].se) and one[k].p_upper == two[k].p_upper for k in one)
