"""Row transforms of one entity, as column expressions over a shared entity window.

Every function takes the unframed entity window `w`; expressions that share `w` share one sort.
Functions that need two window levels take a DataFrame and its keys instead.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.expr import ColumnLike, c, clip, div, expanding, ffill, roll_growth, roll_mean, roll_std, rolling, safe_corr, trailing, win


def zscore(x: ColumnLike, w: WindowSpec, window: int = 60, min_periods: int | None = None) -> Column:
    m = max(12, window // 3) if min_periods is None else min_periods
    return div(c(x) - roll_mean(x, w, window, m), roll_std(x, w, window, m))


def trend_deviation(x: ColumnLike, w: WindowSpec, window: int = 36, min_periods: int | None = None) -> Column:
    m = max(6, window // 3) if min_periods is None else min_periods
    return c(x) - roll_mean(x, w, window, m)


def yoy(x: ColumnLike, w: WindowSpec, periods: int = 12) -> Column:
    return div(x, F.lag(c(x), periods).over(w)) - 1.0


def diff(x: ColumnLike, w: WindowSpec, k: int = 1) -> Column:
    return c(x) - F.lag(c(x), k).over(w)


def pct_change(df: DataFrame, by: list[str], x: str, k: int = 1, out: str = "chg", pad: bool = True, order: str = "d") -> DataFrame:
    """Relative change over k rows; with `pad`, gaps are filled forward first."""
    w = win(by, order)
    filled = df.withColumn("_p", ffill(x, w) if pad else F.col(x))
    return filled.withColumn(out, div("_p", F.lag("_p", k).over(w)) - 1.0).drop("_p")


def momentum(x: ColumnLike, w: WindowSpec, window: int, is_return: bool = True, lag: int = 0) -> Column:
    """Compounded return of the trailing window, full window required; or a price ratio."""
    if is_return:
        return roll_growth(x, w, window, lag=lag) - 1.0
    return div(x, F.lag(c(x), window).over(w)) - 1.0


def realized_vol(r: ColumnLike, w: WindowSpec, window: int = 12, ppy: int = 12, min_periods: int | None = None) -> Column:
    return roll_std(r, w, window, min_periods) * F.sqrt(F.lit(float(ppy)))


def rolling_corr(a: ColumnLike, b: ColumnLike, w: WindowSpec, window: int = 36, min_periods: int | None = None) -> Column:
    """Pearson correlation of the rows where both values exist; NULL on a flat window."""
    m = window // 2 if min_periods is None else min_periods
    f = trailing(w, window)
    pair = F.when(c(b).isNotNull(), c(a))
    return F.when(F.count(pair).over(f) >= m, safe_corr(a, b, f))


def rank_pct(x: ColumnLike, w: WindowSpec, window: int = 120, min_periods: int | None = None) -> Column:
    """Share of the earlier rows of the window strictly below the current value.

    Earlier nulls stay in the denominator and a null current value scores 0, as a NaN comparison does.
    """
    m = window // 4 if min_periods is None else min_periods
    prior = w.rowsBetween(-(window - 1), -1)
    below = F.size(F.filter(F.collect_list(c(x)).over(prior), lambda v: v < c(x)))
    n_prior = F.count(F.lit(1)).over(prior)
    score = F.when(c(x).isNull(), 0.0).otherwise(below) / F.nullif(n_prior, F.lit(0))
    return F.when(F.count(c(x)).over(trailing(w, window)) >= m, score)


def _below(window: int, need: int, by: list[str], d: str):
    """Trailing rank shares of a chunk's own rows; the rows before them are those of the chunk before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        at, value, own = pdf["_n"].to_numpy(), pdf["_x"].to_numpy(dtype=float), pdf["_own"].to_numpy()
        held: list[float] = []
        score, first = np.full(len(at), np.nan), 0
        for t in range(len(at)):
            while at[first] < at[t] - (window - 1):
                if not np.isnan(value[first]):
                    held.pop(bisect_left(held, value[first]))
                first += 1
            known = not np.isnan(value[t])
            if own[t] and t > first and len(held) + known >= need:
                score[t] = bisect_left(held, value[t]) / (t - first) if known else 0.0
            if known:
                insort(held, value[t])
        out = pdf.loc[own, [*by, d]].copy()
        out["_score"] = score[own]
        return out

    return run


def with_rank_pct(df: DataFrame, by: list[str], x: str, out: str, window: int = 120, min_periods: int | None = None, d: str = "d") -> DataFrame:
    """`rank_pct` for long windows: rows go to their chunk of `window` rows and the next one, and a sorted run slides over it.

    Each row moves twice whatever the window, a task holds two chunks of one entity, and a step costs a search in the
    run rather than a pass over the window.
    """
    need = window // 4 if min_periods is None else min_periods
    rows = df.select(*by, d, F.col(x).cast("double").alias("_x"), (F.row_number().over(win(by, d)).cast("long") - 1).alias("_n"))
    chunk = F.floor(F.col("_n") / window)
    copies = F.explode(F.array(F.struct(chunk.alias("_c"), F.lit(True).alias("_own")), F.struct((chunk + 1).alias("_c"), F.lit(False).alias("_own"))))
    schema = df.select(*by, d).schema.add("_score", "double")
    found = rows.select("*", copies.alias("_e")).select(*by, d, "_x", "_n", "_e.*").groupBy(*by, "_c").applyInPandas(_below(window, need, by, d), schema)
    score = F.when(~F.isnan("_score"), F.col("_score"))
    return df.join(found, [*by, d]).withColumn(out, score).drop("_score")


def winsorize(x: ColumnLike, w: WindowSpec, lower: float = 0.01, upper: float = 0.99, window: int = 120) -> Column:
    """Clip to the trailing linear-interpolated quantiles; unbounded until they exist."""
    m = window // 4
    lo = rolling(lambda v: F.percentile(v, F.lit(lower)), x, w, window, m)
    hi = rolling(lambda v: F.percentile(v, F.lit(upper)), x, w, window, m)
    return F.when(c(x).isNotNull(), F.least(F.greatest(c(x), F.coalesce(lo, c(x))), F.coalesce(hi, c(x))))


def ma_ratio(x: ColumnLike, w: WindowSpec, short: int, long: int) -> Column:
    return div(roll_mean(x, w, short), roll_mean(x, w, long)) - 1.0


def ma_cross(x: ColumnLike, w: WindowSpec, short: int, long: int) -> Column:
    """1.0 while the short average is at or above the long one, else 0.0; NULL until both exist."""
    s, g = roll_mean(x, w, short), roll_mean(x, w, long)
    return (s >= g).cast("double")


def mom_state(x: ColumnLike, w: WindowSpec, k: int) -> Column:
    """1.0 if at or above the value k rows ago; a missing current value scores 0.0."""
    past = F.lag(c(x), k).over(w)
    return F.when(past.isNotNull(), F.coalesce((c(x) >= past).cast("double"), F.lit(0.0)))


def growth(r: ColumnLike, w: WindowSpec, null_as_zero: bool = False) -> Column:
    """Cumulative product of 1 + r; a null row is NULL unless it counts as a zero return."""
    x = F.coalesce(c(r), F.lit(0.0)) if null_as_zero else c(r)
    g = F.product(F.lit(1.0) + x).over(expanding(w))
    return g if null_as_zero else F.when(c(r).isNotNull(), g)


def with_growth(df: DataFrame, by: list[str], r: str = "r", out: str = "g", order: str = "d", null_as_zero: bool = False) -> DataFrame:
    return df.withColumn(out, growth(r, win(by, order), null_as_zero))


def on_balance_volume(df: DataFrame, by: list[str], r: str, vol: str, out: str = "obv", order: str = "d") -> DataFrame:
    """Running sum of the return's sign times volume; the first, signless row adds zero."""
    signed = F.coalesce(F.signum(r), F.lit(0.0)) * F.col(vol)
    total = F.sum(signed).over(expanding(win(by, order)))
    return df.withColumn(out, F.when(F.col(vol).isNotNull(), total))


def rule_vote(df: DataFrame, by: list[str], x: str = "x", out: str = "vote") -> DataFrame:
    """Mean of the rule states that exist at a date."""
    return df.groupBy(*by).agg(F.avg(x).alias(out))


def reversal(g: ColumnLike, w: WindowSpec, k: int) -> Column:
    """Minus the k-row return of a growth index."""
    return F.lit(1.0) - div(g, F.lag(c(g), k).over(w))


def momentum_skip(g: ColumnLike, w: WindowSpec, window: int, skip: int) -> Column:
    """Return over window - skip rows of a growth index, ending `skip` rows ago."""
    return div(F.lag(c(g), skip).over(w), F.lag(c(g), window).over(w)) - 1.0


def momentum_mean(r: ColumnLike, w: WindowSpec, window: int, skip: int = 5) -> Column:
    """Trailing mean return times the window length, as of `skip` rows ago."""
    return roll_mean(r, w, window, lag=skip) * window


def momentum_sharpe(r: ColumnLike, w: WindowSpec, window: int, skip: int = 5) -> Column:
    """Trailing mean over trailing sd, as of `skip` rows ago."""
    return div(roll_mean(r, w, window, lag=skip), roll_std(r, w, window, lag=skip))


# fixed values: candidate windows of the adaptive momentum choice
CANDIDATE_WINDOWS = (21, 42, 63, 126, 189, 252, 378, 504)


def momentum_candidates(df: DataFrame, by: list[str], r: str = "r", windows=CANDIDATE_WINDOWS, skip: int = 5, order: str = "d") -> DataFrame:
    """Long (entity, date, candidate, x): two candidates per window, all from one sort."""
    w = win(by, order)
    parts = []
    for k, n in enumerate(windows):
        parts += [F.struct(F.lit(2 * k).alias("pos"), F.lit(f"mom{n}").alias("candidate"), momentum_mean(r, w, n, skip).alias("x")),
                  F.struct(F.lit(2 * k + 1).alias("pos"), F.lit(f"momsharpe{n}").alias("candidate"), momentum_sharpe(r, w, n, skip).alias("x"))]
    wide = df.withColumn("_c", F.array(*parts))
    return wide.select(*by, order, F.explode("_c").alias("_c")).select(*by, order, "_c.*")


def drawdown(df: DataFrame, by: list[str], r: str = "r", out: str = "dd", order: str = "d") -> DataFrame:
    """Growth over its running maximum, minus one. The maximum starts at the first growth value."""
    w = win(by, order)
    g = df.withColumn("_g", growth(r, w, null_as_zero=True))
    return g.withColumn(out, F.col("_g") / F.max("_g").over(expanding(w)) - 1.0).drop("_g")


def sahm_rule(df: DataFrame, by: list[str], x: str, out: str = "sahm", order: str = "d") -> DataFrame:
    w = win(by, order)
    three = df.withColumn("_u3", roll_mean(x, w, 3))
    return three.withColumn(out, F.col("_u3") - rolling(F.min, "_u3", w, 12)).drop("_u3")


def compound_gap(df: DataFrame, a: str, b: str, window: int, asset: str = "asset", r: str = "r", d: str = "d", by: list[str] | None = None) -> DataFrame:
    """Rolling compounded return of asset a minus that of asset b."""
    by = by or []
    w = win([*by, asset], d)
    m = df.filter(F.col(asset).isin(a, b)).select(*by, asset, d, momentum(r, w, window).alias("m"))
    pick = lambda k: F.max(F.when(F.col(asset) == k, F.col("m")))
    return m.groupBy(*by, d).agg((pick(a) - pick(b)).alias("gap"))


def valuation_ratios(df: DataFrame, by: list[str], p: str = "p", div_: str = "dv", e: str = "e", cape: str = "cape", gs10: str = "gs10",
                     window: int = 120, min_periods: int = 60, order: str = "d") -> DataFrame:
    """Log ratios of price, dividend and earnings; yield gap; deviation and z-score of three of them."""
    w = win(by, order)
    ln = lambda k: F.ln(F.col(k))
    base = df.select(
        *by, order, (ln(div_) - ln(p)).alias("gw_dp"), (ln(div_) - F.ln(F.lag(p).over(w))).alias("gw_dy"), (ln(e) - ln(p)).alias("gw_ep"),
        (ln(div_) - ln(e)).alias("gw_de"), F.col(cape).alias("gw_cape"), div(F.lit(1.0), cape).alias("gw_cape_inv"),
        (F.col(e) / F.col(p) - F.col(gs10) / 100.0).alias("gw_ygap"))
    extra = []
    for k in ("gw_dp", "gw_ep", "gw_cape"):
        extra += [trend_deviation(k, w, window, min_periods).alias(f"{k}_dev"), zscore(k, w, window, min_periods).alias(f"{k}_z")]
    return base.select("*", *extra)


def realised_variance(df: DataFrame, by: list[str], r: str = "r", d: str = "d") -> DataFrame:
    """Month sum of squared returns, and its log."""
    g = df.groupBy(*by, F.last_day(d).alias(d)).agg(F.coalesce(F.sum(F.col(r) * F.col(r)), F.lit(0.0)).alias("svar"))
    return g.withColumn("svar_log", F.ln(F.nullif("svar", F.lit(0.0))))


def return_spread(df: DataFrame, a: str, b: str, asset: str = "asset", r: str = "r", d: str = "d", lag: int = 1, by: list[str] | None = None) -> DataFrame:
    """Asset a minus asset b by date, lagged."""
    by = by or []
    pick = lambda k: F.max(F.when(F.col(asset) == k, F.col(r)))
    gap = df.filter(F.col(asset).isin(a, b)).groupBy(*by, d).agg((pick(a) - pick(b)).alias("spread"))
    return gap.withColumn("spread", F.lag("spread", lag).over(win(by, d))) if lag else gap


def quadratic_gap(df: DataFrame, by: list[str], y: str, min_obs: int = 120, out: str = "gap", order: str = "d") -> DataFrame:
    """Last residual of an expanding quadratic trend, without refitting.

    The sums of t^k and t^k*y over the rows so far solve the 3x3 normal equations in closed form. Time is
    centred at the middle of the rows so far, where odd power sums vanish and the system splits; y is
    taken relative to the entity's first value.
    """
    w = win(by, order)
    known = df.filter(F.col(y).isNotNull())
    f = expanding(w)
    z = F.col(y) - F.first(y).over(f)
    base = known.withColumn("_t", (F.row_number().over(w) - 1).cast("double")).withColumn("_z", z)
    s = base.withColumn("_n", F.col("_t") + 1.0).withColumn("_sz", F.sum("_z").over(f)) \
        .withColumn("_stz", F.sum(F.col("_t") * F.col("_z")).over(f)) \
        .withColumn("_sttz", F.sum(F.col("_t") * F.col("_t") * F.col("_z")).over(f))
    n, m = F.col("_n"), F.col("_t") / 2.0
    # centred sums with u = t - m
    su2 = n * (n * n - 1.0) / 12.0
    su4 = n * (n * n - 1.0) * (3.0 * n * n - 7.0) / 240.0
    suz = F.col("_stz") - m * F.col("_sz")
    su2z = F.col("_sttz") - 2.0 * m * F.col("_stz") + m * m * F.col("_sz")
    det = n * su4 - su2 * su2
    c2 = (n * su2z - su2 * F.col("_sz")) / F.nullif(det, F.lit(0.0))
    c0 = (F.col("_sz") - c2 * su2) / n
    c1 = suz / F.nullif(su2, F.lit(0.0))
    gap = F.col("_z") - (c0 + c1 * m + c2 * m * m)
    return s.withColumn(out, F.when(n >= min_obs, gap)).drop("_t", "_z", "_n", "_sz", "_stz", "_sttz")


REGIMES = ("Goldilocks", "Reflation", "Stagflation", "Deflation")


def regime_dummies(df: DataFrame, keys: list[str], regime: str = "regime", labels=REGIMES) -> DataFrame:
    """Long 0/1 dummies; a missing label is 0 in all of them."""
    rows = F.array(*[F.struct(F.lit(f"regime_{s.lower()}").alias("signal"),
                              F.coalesce((F.col(regime) == s).cast("double"), F.lit(0.0)).alias("x")) for s in labels])
    return df.select(*keys, F.explode(rows).alias("e")).select(*keys, "e.*")


def interactions(signals: DataFrame, dummies: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Product of each signal with each regime dummy, named ``signal x state``."""
    d = dummies.select(*keys, F.col("signal").alias("_state"), F.col("x").alias("_on"))
    return signals.join(d, keys).select(
        *[k for k in signals.columns if k not in ("signal", x)],
        F.concat("signal", F.lit(" x "), F.regexp_replace("_state", "^regime_", "")).alias("signal"), (F.col(x) * F.col("_on")).alias(x))


def lag_panel(df: DataFrame, by: list[str], x: str = "x", lag: int = 1, stale: tuple[str, ...] = (), order: str = "d") -> DataFrame:
    """Shift every signal; those whose name ends in a stale asset one row more."""
    w = win(by, order)
    one, two = F.lag(x, lag).over(w), F.lag(x, lag + 1).over(w)
    is_stale = F.lit(False)
    for a in stale:
        is_stale = is_stale | F.col("signal").endswith(f"_{a}")
    return df.withColumn(x, F.when(is_stale, two).otherwise(one))


def prune_signals(df: DataFrame, x: str = "x", min_count: int = 120, min_std: float = 1e-12) -> DataFrame:
    """Signals with enough values and some variation. The aggregate has one row per signal."""
    keep = df.groupBy("signal").agg(F.count(x).alias("_n"), F.stddev_samp(x).alias("_s")).filter(
        (F.col("_n") > min_count) & (F.col("_s") > min_std)).select("signal")
    return df.join(keep, "signal", "left_semi")


# fixed values: family by signal prefix, tested in this order
FAMILY_PREFIXES = (
    ("d_carry", "carry and rolldown"), ("d_roll", "carry and rolldown"),
    ("d_slope", "curve shape"), ("d_curv", "curve shape"), ("d_level", "curve shape"),
    ("d_fwd", "forward rates"), ("d_cp", "Cochrane-Piazzesi"),
    ("d_baa", "credit spreads"), ("d_aaa", "credit spreads"), ("d_hy", "credit spreads"),
    ("d_vix", "volatility"), ("d_rvol", "volatility"), ("d_mom", "momentum"),
    ("d_ma", "moving average"), ("d_rev", "short-term reversal"),
    ("carry_roll", "carry and rolldown"), ("mod_dur", "carry and rolldown"),
    ("curve_", "curve shape"), ("short_rate", "curve shape"), ("fwd_", "forward rates"),
    ("cp_factor", "Cochrane-Piazzesi"), ("baa", "credit spreads"), ("aaa", "credit spreads"),
    ("vix", "volatility"), ("rvol", "volatility"), ("vrp", "volatility"),
    ("mom", "momentum"), ("tchi", "moving average"), ("gw_", "valuation"),
    ("term_premium", "term premium"), ("stock_bond", "cross asset"), ("gold_vs", "cross asset"),
    ("regime_", "regime state"), ("crisis", "regime state"),
)

# fixed values: families of the monthly library
LIBRARY_FAMILIES = (
    ("curve", ("curve_", "fwd_", "fb", "cp_factor", "carry_roll", "mod_dur", "short_rate")),
    ("credit", ("baa", "aaa")),
    ("volatility", ("vix", "rvol", "vrp")),
    ("macro", ("cpi", "core_", "indpro", "payems", "m2_", "houst", "permit", "unrate", "sentiment", "hours",
               "nfci", "anfci", "claims", "term_spread", "sahm", "oil")),
    ("momentum", ("mom", "stock_bond", "gold_vs")),
    ("regime", ("regime_", "growth_dev", "inflation_dev", "crisis_prob")),
    ("term_premium", ("term_premium",)),
)


def family_of(name: ColumnLike, prefixes=FAMILY_PREFIXES) -> Column:
    """Family of the first matching prefix; a product of two names is an interaction."""
    hits = [F.when(c(name).startswith(p), F.lit(f)) for p, f in prefixes]
    return F.coalesce(*hits, F.when(c(name).contains(" x "), F.lit("regime interaction")), F.lit("macro and other"))


def library_family(name: ColumnLike) -> Column:
    hits = [F.when(c(name).startswith(p), F.lit(f)) for f, ps in LIBRARY_FAMILIES for p in ps]
    return F.coalesce(*hits, F.lit("other"))


def signal_catalog(df: DataFrame, x: str = "x", d: str = "d") -> DataFrame:
    """Coverage, span, mean, sd and lag-1 autocorrelation of each signal."""
    rows = df.withColumn("_prev", F.lag(x).over(win(["signal"], d)))
    known = F.when(F.col(x).isNotNull(), F.col(d))
    g = rows.groupBy("signal").agg(
        F.count(x).alias("n_obs"), (F.count(x) / F.count("*")).alias("coverage"), F.min(known).alias("first"), F.max(known).alias("last"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), safe_corr(x, "_prev").alias("autocorr_1"))
    return g.withColumn("family", library_family("signal"))
