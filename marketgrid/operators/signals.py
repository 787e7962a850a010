"""Signal blocks: named predictors as long (signal, d, x) panels.

Each block computes its columns in one window pass over a wide frame of one entity (one row per date), or per
asset, and unpivots them. `u` names the universe of the single-entity frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import div, ffill, finite, roll_mean, rolling, win
from . import timeseries as T
from .align import asof, dedupe_signals
from .curves import curve_factors, daily_curve_signals, forward_rates, forward_spreads
from .dates import resample_last, resample_sum

# fixed values: calendar days from the period described to the release
PUBLICATION_DAYS = {"CPIAUCSL": 45, "CPILFESL": 45, "PCEPI": 60, "INDPRO": 45, "PAYEMS": 35, "UNRATE": 35, "HOUST": 50, "PERMIT": 50,
                    "UMCSENT": 20, "M2SL": 45, "AWHMAN": 35, "TCU": 45, "ICSA": 5, "NFCI": 8, "ANFCI": 8}
# fixed values: publication lag in months
PUBLICATION_MONTHS = {"CPIAUCSL": 1, "CPILFESL": 1, "PCEPILFE": 1, "INDPRO": 1, "UNRATE": 1, "PAYEMS": 1, "UMCSENT": 1, "HOUST": 1, "PERMIT": 1,
                      "AWHMAN": 1, "NEWORDER": 1, "M2SL": 1, "ISRATIO": 2, "BAA": 1, "AAA": 1}
# fixed values: stale assets, windows, roles and the macro series of each signal
STALE_ASSETS = ("hy", "ig")
MOM_WINDOWS, REV_WINDOWS = (5, 21, 63, 126, 252), (1, 5)
MA_PAIRS = ((5, 21), (10, 50), (21, 126), (50, 200))
RULE_PAIRS, RULE_LAGS = ((1, 9), (1, 12), (2, 9), (2, 12), (3, 9), (3, 12)), (9, 12)
ROLES = {"equity": "sp500", "bond": "ust10y", "gold": "gold", "risky": "hy", "safe": "ig"}
MACRO_YOY = (("CPIAUCSL", "cpi"), ("CPILFESL", "core_cpi"), ("PCEPILFE", "core_pce"), ("INDPRO", "indpro"), ("PAYEMS", "payems"), ("M2SL", "m2"),
             ("HOUST", "houst"), ("PERMIT", "permit"))
MACRO_LEVEL = (("UNRATE", "unrate"), ("UMCSENT", "sentiment"), ("AWHMAN", "hours"), ("NFCI", "nfci"), ("ANFCI", "anfci"), ("ICSA", "claims"), ("T10Y3M", "term_spread_3m"))

U = ["u"]


def long(df: DataFrame, cols: list[str], asset: str | None = None) -> DataFrame:
    """Wide columns to (signal, d, x); per-asset names end in the asset."""
    ids = ["d", *([asset] if asset else [])]
    s = df.select(*ids, *[finite(k).alias(k) for k in cols]).unpivot(ids, cols, "signal", "x")
    return s.select((F.concat_ws("_", "signal", asset) if asset else F.col("signal")).alias("signal"), "d", "x")


def step_levels(series: DataFrame, days: DataFrame, ids: list[str], release: bool = False, lags: dict[str, int] | None = None, default_days: int = 30) -> DataFrame:
    """Wide step functions on a calendar, one column per id.

    Plain: values on calendar dates, filled forward. With `release`, every value counts from its stamp plus the
    series' lag in days, on or off the calendar.
    """
    keyed = days.select("d", F.explode(F.array(*[F.lit(i) for i in ids])).alias("series"))
    rows = series.filter(F.col("series").isin(*ids)).select("series", "d", "x")
    if release:
        lag = F.coalesce(*[F.when(F.col("series") == k, F.lit(v)) for k, v in (lags or PUBLICATION_DAYS).items()], F.lit(default_days))
        filled = asof(keyed, rows.withColumn("d", F.date_add("d", lag)), ["series"], "x")
    else:
        filled = keyed.join(rows, ["series", "d"], "left").withColumn("x", ffill("x", win(["series"])))
    wide = filled.groupBy("d").pivot("series", ids).agg(F.first("x"))
    return wide.withColumn("u", F.lit("all"))


def month_levels(series: DataFrame, ids: list[str], lags: dict[str, int] | None = None) -> DataFrame:
    """Wide month-end levels, each id shifted by its publication lag in months."""
    m = resample_last(series.filter(F.col("series").isin(*ids)).select("series", "d", "x"), ["series"], "x")
    w = win(["series"])
    shifted = F.coalesce(*[F.when(F.col("series") == k, F.lag("x", (lags or {}).get(k, 0)).over(w) if (lags or {}).get(k, 0) else F.col("x")) for k in ids])
    return m.withColumn("x", shifted).groupBy("d").pivot("series", ids).agg(F.first("x")).withColumn("u", F.lit("all"))


def _z(k: str, w, window: int = 252, m: int = 120) -> Column:
    return T.zscore(k, w, window, m)


def _with_changes(df: DataFrame, names: list[str], lags: tuple[int, ...], window: int, m: int) -> tuple[DataFrame, list[str]]:
    w = win(U)
    extra = {}
    for k in names:
        extra |= {f"{k}_chg{n}": T.diff(k, w, n) for n in lags}
        extra[f"{k}_z"] = _z(k, w, window, m)
    return df.select("*", *[v.alias(k) for k, v in extra.items()]), [*names, *extra]


# ---- daily blocks ----


def daily_curve_block(quotes: DataFrame, days: DataFrame, window: int = 252, m: int = 120) -> DataFrame:
    """Slopes, level and curvature on every calendar date; `quotes` is (d, tenor, par)."""
    q = days.select("d").join(quotes.select("d", "tenor", "par"), "d", "left").withColumn("u", F.lit("all"))
    s = daily_curve_signals(q, U, window, m)
    return long(s, [k for k in s.columns if k.startswith("d_")])


def daily_credit_block(levels: DataFrame, window: int = 252, m: int = 120) -> DataFrame:
    """Baa over Aaa and over the ten-year, with 5- and 21-row changes and z; `levels` has DAAA, DBAA, DGS10 in percent."""
    s = levels.select("u", "d", ((F.col("DBAA") - F.col("DAAA")) / 100.0).alias("d_baa_aaa"), ((F.col("DBAA") - F.col("DGS10")) / 100.0).alias("d_baa_10y"))
    return long(*_with_changes(s, ["d_baa_aaa", "d_baa_10y"], (5, 21), window, m))


def daily_volatility_block(levels: DataFrame, returns: DataFrame, roles: dict = ROLES, window: int = 252, m: int = 120) -> DataFrame:
    """Implied volatility, its gap to realised and term ratio; 21- and 63-row realised volatility per asset with z."""
    wa = win(["asset"])
    eq = returns.filter(F.col("asset") == roles["equity"]).select("d", (T.realized_vol("r", wa, 21, 252, 15) * 100.0).alias("_rv"))
    j = levels.select("u", "d", F.col("VIXCLS").alias("d_vix"), div("VXVCLS", "VIXCLS").alias("d_vix_term")).join(eq, "d", "left").withColumn("d_vrp", F.col("d_vix") - F.col("_rv"))
    w = win(U)
    j = j.select("*", T.diff("d_vix", w, 5).alias("d_vix_chg5"), _z("d_vix", w, window, m).alias("d_vix_z"), _z("d_vrp", w, window, m).alias("d_vrp_z"))
    head = long(j, ["d_vix", "d_vix_chg5", "d_vix_z", "d_vrp", "d_vrp_z", "d_vix_term"])
    a = returns.select("asset", "d", *[T.realized_vol("r", wa, n, 252, n // 2).alias(f"d_rvol{n}") for n in (21, 63)])
    raw = long(a, ["d_rvol21", "d_rvol63"], "asset")
    zs = a.select("asset", "d", *[_z(f"d_rvol{n}", wa, window, m).alias(f"d_rvol{n}") for n in (21, 63)])
    return head.unionByName(raw).unionByName(long(zs, ["d_rvol21", "d_rvol63"], "asset").withColumn("signal", F.concat("signal", F.lit("_z"))))


def _filled_growth(returns: DataFrame) -> DataFrame:
    """Growth index with gaps: NULL on a missing return, and `gp`, the same carried over the gaps."""
    w = win(["asset"])
    g = returns.withColumn("g", T.growth("r", w))
    return g.withColumn("gp", ffill("g", w))


def _pct(g: str, w, k: int, skip: int = 0) -> Column:
    return div(F.lag(g, skip).over(w) if skip else g, F.lag(g, k + skip).over(w)) - 1.0


def daily_momentum_block(returns: DataFrame, windows=MOM_WINDOWS, pairs=MA_PAIRS) -> DataFrame:
    """Trend over five windows, the longer ones also as of five rows ago, and four moving-average ratios, per asset."""
    w = win(["asset"])
    g = _filled_growth(returns)
    cols = {}
    for n in windows:
        cols[f"d_mom{n}"] = _pct("gp", w, n)
        if n > 21:
            cols[f"d_mom{n}s5"] = _pct("gp", w, n - 5, 5)
    for s, l in pairs:
        cols[f"d_ma{s}_{l}"] = T.ma_ratio("g", w, s, l)
    return long(g.select("asset", "d", *[v.alias(k) for k, v in cols.items()]), list(cols), "asset")


def daily_reversal_block(returns: DataFrame, windows=REV_WINDOWS) -> DataFrame:
    w = win(["asset"])
    g = _filled_growth(returns)
    return long(g.select("asset", "d", *[(-_pct("gp", w, n)).alias(f"d_rev{n}") for n in windows]), [f"d_rev{n}" for n in windows], "asset")


def daily_macro_block(released: DataFrame, levels: DataFrame, year: int = 252, window: int = 252, m: int = 120) -> DataFrame:
    """Released macro steps: four year-on-year rates, four levels with 21-row changes, claims with z; oil trend and z."""
    w = win(U)
    j = released.join(levels.select("d", "DCOILWTICO"), "d")
    cols = {}
    for sid, k in (("CPIAUCSL", "d_cpi"), ("CPILFESL", "d_core_cpi"), ("INDPRO", "d_indpro"), ("PAYEMS", "d_payems")):
        cols[f"{k}_yoy"] = T.yoy(sid, w, year)
    for sid, k in (("UNRATE", "d_unrate"), ("UMCSENT", "d_sentiment"), ("NFCI", "d_nfci"), ("ANFCI", "d_anfci")):
        cols |= {k: F.col(sid), f"{k}_chg": T.diff(sid, w, 21)}
    cols |= {"d_claims": F.col("ICSA"), "d_claims_z": _z("ICSA", w, window, m), "d_oil_mom63": _pct("DCOILWTICO", w, 63), "d_oil_z": _z("DCOILWTICO", w, window, m)}
    return long(j.select("d", *[v.alias(k) for k, v in cols.items()]), list(cols))


def _two(returns: DataFrame, names: list[str]) -> DataFrame:
    """Returns of the named assets side by side by date."""
    wide = returns.groupBy("d").agg(*[F.max(F.when(F.col("asset") == k, F.col("r"))).alias(f"r_{n}") for n, k in enumerate(names)])
    return wide.withColumn("u", F.lit("all"))


def daily_cross_asset_block(returns: DataFrame, roles: dict = ROLES) -> DataFrame:
    """Stock-bond correlation over 126 rows and its 21-row change; compounded gaps of two pairs."""
    w = win(U)
    p = _two(returns, [roles[k] for k in ("equity", "bond", "gold", "risky", "safe")])
    p = p.withColumn("d_stock_bond_corr", T.rolling_corr("r_0", "r_1", w, 126, 60))
    s = p.select("d", "d_stock_bond_corr", T.diff("d_stock_bond_corr", w, 21).alias("d_stock_bond_corr_chg"),
                 (T.momentum("r_2", w, 126) - T.momentum("r_0", w, 126)).alias("d_gold_vs_eq"), (T.momentum("r_3", w, 63) - T.momentum("r_4", w, 63)).alias("d_hy_vs_ig"))
    return long(s, ["d_stock_bond_corr", "d_stock_bond_corr_chg", "d_gold_vs_eq", "d_hy_vs_ig"])


def assemble(blocks: list[DataFrame]) -> DataFrame:
    """Blocks in order; a name defined twice keeps its first block."""
    parts = [b.withColumn("block", F.lit(n)) for n, b in enumerate(blocks)]
    return dedupe_signals(reduce(DataFrame.unionByName, parts)).drop("block")


def daily_panel(blocks: list[DataFrame], lag: int = 1, stale: tuple[str, ...] = STALE_ASSETS) -> DataFrame:
    return T.lag_panel(assemble(blocks), ["signal"], lag=lag, stale=stale)


# ---- monthly blocks ----


def monthly_curve_block(curve: DataFrame, bond_returns: DataFrame | None = None, cp: DataFrame | None = None) -> DataFrame:
    """Curve shape, forwards, spreads, forward-rate factor, carry with roll and duration; change and z of four.

    `curve` holds month-end dates; `bond_returns` is the repricing output by maturity.
    """
    k = ["curve", "d"]
    a = curve_factors(curve, level_span=(2.0, 30.0), slope_short=0.5).withColumnRenamed("level", "curve_level").withColumnRenamed("slope", "curve_slope").withColumnRenamed("curvature", "curve_curvature")
    b = curve_factors(curve).select(*k, F.col("slope").alias("curve_slope_2s10s"))
    short = curve.groupBy(*k).agg(F.min_by("zero", F.abs(F.col("tenor") - 1 / 12)).alias("short_rate"))
    s = a.join(b, k).join(short, k).withColumn("d", F.last_day("d"))
    w = win(["curve"])
    four = ["curve_level", "curve_slope", "curve_curvature", "short_rate"]
    s = s.select("*", *[T.diff(n, w).alias(f"{n}_chg") for n in four], *[T.zscore(n, w).alias(f"{n}_z") for n in four])
    out = [long(s, [*four, "curve_slope_2s10s", *[f"{n}_chg" for n in four], *[f"{n}_z" for n in four]])]
    f = forward_rates(curve)
    out.append(f.select(F.concat(F.lit("fwd_f"), "n").alias("signal"), F.last_day("d").alias("d"), F.col("f").alias("x")))
    out.append(forward_spreads(f).select(F.concat(F.lit("fb"), "n").alias("signal"), F.last_day("d").alias("d"), F.col("fb").alias("x")))
    if cp is not None:
        out.append(cp.select(F.lit("cp_factor_oos").alias("signal"), F.last_day("d").alias("d"), F.col("factor").alias("x")))
    if bond_returns is not None:
        tag = F.concat(F.format_string("%.0f", "maturity"), F.lit("y"))
        r = bond_returns.withColumn("signal", tag).withColumn("_cr", F.col("carry") + F.col("rolldown"))
        cr = resample_sum(r.select("signal", "d", "_cr"), ["signal"], "_cr", scale=12.0)
        md = resample_last(r.select("signal", "d", "mod_dur"), ["signal"], "mod_dur")
        out.append(cr.select(F.concat(F.lit("carry_roll_"), "signal").alias("signal"), "d", F.col("_cr").alias("x")))
        out.append(md.select(F.concat(F.lit("mod_dur_"), "signal").alias("signal"), "d", F.col("mod_dur").alias("x")))
    return reduce(DataFrame.unionByName, out)


def bond_signal_panel(curve: DataFrame, bond_returns: DataFrame, factor: DataFrame | None = None, term_premium: DataFrame | None = None) -> DataFrame:
    """Every bond predictor at month ends: level, slope, curvature, forward spreads, carry with roll, factor, term premium."""
    s = curve_factors(curve, level_span=(1.5, 30.0), slope_short=0.5).withColumn("d", F.last_day("d"))
    out = [long(s, ["level", "slope", "curvature"])]
    out.append(forward_spreads(forward_rates(curve)).select(F.concat(F.lit("fb"), "n").alias("signal"), F.last_day("d").alias("d"), F.col("fb").alias("x")))
    r = bond_returns.select(F.concat(F.lit("carry_roll_"), F.format_string("%.0f", "maturity"), F.lit("y")).alias("signal"), "d", (F.col("carry") + F.col("rolldown")).alias("x"))
    out.append(resample_sum(r, ["signal"], "x", scale=12.0))
    if factor is not None:
        out.append(factor.select(F.lit("cp_factor").alias("signal"), F.last_day("d").alias("d"), F.col("factor").alias("x")))
    if term_premium is not None:
        out.append(resample_last(term_premium.select(F.lit("term_premium").alias("signal"), "d", "x"), ["signal"], "x").select("signal", "d", "x"))
    return reduce(DataFrame.unionByName, out)


def monthly_credit_block(levels: DataFrame, lag: int = 1) -> DataFrame:
    """Three spreads with one- and three-row change, z and rank, all shifted by the publication lag; `levels` has BAA, AAA, DGS10."""
    w = win(U)
    s = levels.select("u", "d", (F.col("BAA") - F.col("AAA")).alias("baa_aaa"), (F.col("BAA") - F.col("DGS10")).alias("baa_10y"), (F.col("AAA") - F.col("DGS10")).alias("aaa_10y"))
    cols = {}
    for k in ("baa_aaa", "baa_10y", "aaa_10y"):
        cols |= {k: F.col(k), f"{k}_chg": T.diff(k, w), f"{k}_chg3": T.diff(k, w, 3), f"{k}_z": T.zscore(k, w), f"{k}_rank": T.rank_pct(k, w)}
    s = s.select("u", "d", *[v.alias(k) for k, v in cols.items()])
    return T.lag_panel(long(s, list(cols)), ["signal"], lag=lag)


def monthly_volatility_block(levels: DataFrame, returns: DataFrame, roles: dict = ROLES) -> DataFrame:
    """Implied level, change, z, rank; 12-row realised volatility per asset with z; risk-premium proxy. `levels` has VIXCLS."""
    w, wa = win(U), win(["asset"])
    a = returns.select("asset", "d", T.realized_vol("r", wa, 12).alias("rvol"))
    eq = a.filter(F.col("asset") == roles["equity"]).select("d", F.col("rvol").alias("_rv"))
    s = levels.select("u", "d", F.col("VIXCLS").alias("vix")).join(eq, "d", "left")
    s = s.select("d", "vix", T.diff("vix", w).alias("vix_chg"), T.zscore("vix", w).alias("vix_z"), T.rank_pct("vix", w).alias("vix_rank"), (F.col("vix") / 100.0 - F.col("_rv")).alias("vrp_proxy"))
    zs = a.select("asset", "d", T.zscore("rvol", wa).alias("rvol"))
    return long(s, ["vix", "vix_chg", "vix_z", "vix_rank", "vrp_proxy"]).unionByName(long(a, ["rvol"], "asset")).unionByName(
        long(zs, ["rvol"], "asset").withColumn("signal", F.concat("signal", F.lit("_z"))))


def monthly_macro_block(levels: DataFrame) -> DataFrame:
    """Eight year-on-year rates with deviations, seven levels with change and z, the Sahm gap, oil; `levels` is publication-shifted.

    A series that `levels` lacks gives its signals without values.
    """
    w = win(U)
    absent = [sid for sid in (*(s for s, _ in (*MACRO_YOY, *MACRO_LEVEL)), "DCOILWTICO") if sid not in levels.columns]
    levels = levels.select("*", *[F.lit(None).cast("double").alias(sid) for sid in absent])
    first = {f"{k}_yoy": T.yoy(sid, w) for sid, k in MACRO_YOY}
    s = levels.select("*", *[v.alias(k) for k, v in first.items()], roll_mean("UNRATE", w, 3).alias("_u3"))
    cols = {k: F.col(k) for k in first}
    cols |= {f"{k}_dev": T.trend_deviation(k, w) for k in first}
    for sid, k in MACRO_LEVEL:
        cols |= {k: F.col(sid), f"{k}_chg": T.diff(sid, w), f"{k}_z": T.zscore(sid, w)}
    cols["sahm"] = F.col("_u3") - rolling(F.min, "_u3", w, 12)
    cols |= {"oil_yoy": T.yoy("DCOILWTICO", w), "oil_z": T.zscore("DCOILWTICO", w)}
    return long(s.select("d", *[v.alias(k) for k, v in cols.items()]), list(cols))


def monthly_momentum_block(returns: DataFrame, roles: dict = ROLES) -> DataFrame:
    """1-, 3-, 6-, 12-row and 12-less-1 momentum per asset; stock-bond correlation and its change; gold minus equity."""
    wa, w = win(["asset"]), win(U)
    a = returns.select("asset", "d", *[T.momentum("r", wa, n).alias(f"mom{n}") for n in (1, 3, 6, 12)], T.momentum("r", wa, 11, lag=1).alias("mom12_1"))
    p = _two(returns, [roles[k] for k in ("equity", "bond", "gold")]).withColumn("stock_bond_corr", T.rolling_corr("r_0", "r_1", w, 36))
    s = p.select("d", "stock_bond_corr", T.diff("stock_bond_corr", w, 3).alias("stock_bond_corr_chg"), (T.momentum("r_2", w, 12) - T.momentum("r_0", w, 12)).alias("gold_vs_equity_12m"))
    return long(a, ["mom1", "mom3", "mom6", "mom12", "mom12_1"], "asset").unionByName(long(s, ["stock_bond_corr", "stock_bond_corr_chg", "gold_vs_equity_12m"]))


def monthly_regime_block(regimes: DataFrame, crisis: DataFrame | None = None) -> DataFrame:
    """Regime dummies, deviations, crisis probability and its three-row change; `regimes` is (d, regime, growth_dev, inflation_dev)."""
    r = regimes.withColumn("u", F.lit("all"))
    out = T.regime_dummies(r, ["d"]).select("signal", "d", "x").unionByName(long(r, ["growth_dev", "inflation_dev"]))
    if crisis is not None:
        c = r.select("u", "d").join(crisis.select("d", F.col("p").alias("crisis_prob")), "d", "left")
        c = c.withColumn("crisis_prob_chg", T.diff("crisis_prob", win(U), 3))
        out = out.unionByName(long(c, ["crisis_prob", "crisis_prob_chg"]))
    return out


def monthly_term_premium_block(levels: DataFrame, column: str = "THREEFYTP10") -> DataFrame:
    w = win(U)
    s = levels.select("d", F.col(column).alias("term_premium"), T.diff(column, w).alias("term_premium_chg"), T.zscore(column, w).alias("term_premium_z"))
    return long(s, ["term_premium", "term_premium_chg", "term_premium_z"])


def monthly_panel(blocks: list[DataFrame], min_count: int = 120) -> DataFrame:
    """Blocks without duplicates, thin or constant signals dropped, one row lagged."""
    return T.lag_panel(T.prune_signals(assemble(blocks), min_count=min_count), ["signal"])


def technical_rule_block(index: DataFrame, pairs=RULE_PAIRS, lags=RULE_LAGS, lag: int = 1) -> DataFrame:
    """Moving-average, momentum and volume rules of one index (u, d, px, vol) and their mean vote, lagged."""
    w = win(U)
    v = index.withColumn("vol", F.when(F.col("vol") > 0, F.col("vol"))).withColumn("_r", div("px", F.lag("px").over(w)) - 1.0)
    o = T.on_balance_volume(v, U, "_r", "vol")
    cols = {f"tchi_ma{s}_{n}": T.ma_cross("px", w, s, n) for s, n in pairs}
    cols |= {f"tchi_mom{k}": T.mom_state("px", w, k) for k in lags}
    cols |= {f"tchi_vol{s}_{n}": T.ma_cross("obv", w, s, n) for s, n in pairs}
    rules = long(o.select("d", *[c.alias(k) for k, c in cols.items()]), list(cols))
    vote = T.rule_vote(rules, ["d"], out="x").select(F.lit("tchi_mean").alias("signal"), "d", "x")
    return T.lag_panel(rules.unionByName(vote), ["signal"], lag=lag)


def literature_panel(valuation: DataFrame, index: DataFrame, output: DataFrame, invest: DataFrame, daily: DataFrame, returns: DataFrame, long_bond: str, credit: str,
                     window: int = 120, min_periods: int = 60, min_obs: int = 120) -> DataFrame:
    """Valuation ratios, rules, output gap, investment ratio, realised variance and return spreads, each lagged one row.

    `valuation` (u, d, p, dv, e, cape, gs10), `index` (u, d, px, vol), `output` (u, d, x), `invest` (u, d, inv, gdp),
    `daily` (u, d, r) of the equity asset, `returns` (asset, d, r).
    """
    w = win(U)
    v = T.valuation_ratios(valuation, U, window=window, min_periods=min_periods)
    parts = [long(v, [k for k in v.columns if k.startswith("gw_")])]
    g = T.quadratic_gap(output.withColumn("y", F.ln("x")), U, "y", min_obs, "ogap")
    parts.append(long(g.select("d", "ogap", T.diff("ogap", w).alias("ogap_chg")), ["ogap", "ogap_chg"]))
    i = invest.withColumn("ik_proxy", div(ffill("inv", w), ffill("gdp", w)))
    parts.append(long(i.select("d", "ik_proxy", T.trend_deviation("ik_proxy", w, window, min_periods).alias("ik_proxy_dev")), ["ik_proxy", "ik_proxy_dev"]))
    sv = T.realised_variance(daily, U).select("d", F.col("svar").alias("gw_svar"), F.col("svar_log").alias("gw_svar_log"))
    parts.append(long(sv, ["gw_svar", "gw_svar_log"]))
    p = _two(returns, [long_bond, credit])
    parts.append(long(p.select("d", F.col("r_0").alias("gw_ltr"), (F.col("r_1") - F.col("r_0")).alias("gw_dfr")), ["gw_ltr", "gw_dfr"]))
    lagged = T.lag_panel(reduce(DataFrame.unionByName, parts), ["signal"])
    return lagged.unionByName(technical_rule_block(index))
