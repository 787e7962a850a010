"""Out-of-sample forecasts from running sums, and their evaluation.

Panels are long in (asset, signal, d); partitions are (asset, signal) series of at most one row per date, so
a scan of thousands of signals on thousands of assets is one shuffle and no loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import c, div, expanding, ffill, safe_corr, win


def prevailing_mean(df: DataFrame, by: list[str], y: str = "y", min_obs: int = 60, out: str = "bench", order: str = "d") -> DataFrame:
    """Mean of all earlier values, NULL until `min_obs` of them exist."""
    past = expanding(win(by, order), lag=1)
    return df.withColumn(out, F.when(F.count(y).over(past) >= min_obs, F.avg(y).over(past)))


def univariate_forecasts(df: DataFrame, by: list[str], x: str = "x", y: str = "y", min_obs: int = 60, horizon: int = 1, order: str = "d") -> DataFrame:
    """Expanding least-squares forecast of y from x; adds `forecast`.

    Coefficients come from running sums over complete pairs, are shifted by `horizon` pair rows, carried
    forward over the full calendar and applied to the row's own x. Sums are taken about each series'
    first pair, so that a large level does not cancel.
    """
    w = win(by, order)
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    d = df.withColumn("_px", F.when(pair, F.col(x))).withColumn("_py", F.when(pair, F.col(y)))
    first = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_ux", F.col("_px") - F.first("_px", ignorenulls=True).over(first)).withColumn("_uy", F.col("_py") - F.first("_py", ignorenulls=True).over(first))
    f = expanding(w)
    n, sx, sy = F.count("_ux").over(f), F.sum("_ux").over(f), F.sum("_uy").over(f)
    sxx, sxy = F.sum(F.col("_ux") * F.col("_ux")).over(f), F.sum(F.col("_ux") * F.col("_uy")).over(f)
    var, cov = sxx - sx * sx / n, sxy - sx * sy / n
    beta = F.when(F.abs(var) > 1e-12, cov / F.nullif(var, F.lit(0.0))).otherwise(0.0)
    mean_x = sx / n + F.first("_px", ignorenulls=True).over(first)
    mean_y = sy / n + F.first("_py", ignorenulls=True).over(first)
    d = d.withColumn("_b", F.when(pair & (n >= min_obs), F.struct(beta.alias("b"), (mean_y - beta * mean_x).alias("a"))))
    # shift by pair rows: among pair rows only, lag the coefficients; NULL structs count as rows there
    wp = Window.partitionBy(*by, pair).orderBy(order)
    d = d.withColumn("_s", F.when(pair, F.lag("_b", horizon).over(wp)))
    total = F.count("_px").over(Window.partitionBy(*by))
    d = d.withColumn("_c", F.when(total >= min_obs + horizon, ffill("_s", w)))
    return d.withColumn("forecast", F.col("_c.a") + F.col("_c.b") * F.col(x)).drop("_px", "_py", "_ux", "_uy", "_b", "_s", "_c")


def combine(df: DataFrame, by: list[str], f: str = "forecast", method: str = "mean", trim: float = 0.10) -> DataFrame:
    """Pool the forecasts of all signals per date: mean, median, or mean of those inside the [trim, 1 - trim] quantiles."""
    if method == "mean":
        return df.groupBy(*by).agg(F.avg(f).alias("pooled"))
    if method == "median":
        return df.groupBy(*by).agg(F.percentile(f, F.lit(0.5)).alias("pooled"))
    if method == "trimmed":
        q = df.groupBy(*by).agg(F.percentile(f, F.array(F.lit(trim), F.lit(1.0 - trim))).alias("_q"))
        j = df.join(q, by)
        inside = (F.col(f) >= F.col("_q")[0]) & (F.col(f) <= F.col("_q")[1])
        return j.groupBy(*by).agg(F.avg(F.when(inside, F.col(f))).alias("pooled"))
    raise ValueError(f"unknown combination method: {method}")


def campbell_thompson(f: Column | str, bench: Column | str, floor: float | None = 0.0, max_deviation: float | None = None) -> Column:
    out = c(f)
    if max_deviation is not None:
        out = F.when(out.isNotNull(), F.least(F.greatest(out, c(bench) - max_deviation), c(bench) + max_deviation))
    if floor is not None:
        out = F.when(out.isNotNull(), F.greatest(out, F.lit(floor)))
    return out


def forecast_edges(returns: DataFrame, signals: DataFrame, min_obs: int = 120, horizon: int = 1, method: str = "mean") -> DataFrame:
    """Pooled walk-forward forecast per asset; `returns` is (asset, d, y), `signals` is (signal, d, x)."""
    return combine(univariate_forecasts(returns.join(signals, "d"), ["asset", "signal"], min_obs=min_obs, horizon=horizon), ["asset", "d"], method=method)


def select_features(df: DataFrame, by: list[str], k: int, x: str = "x", y: str = "y", fill: bool = False, min_known: int = 0) -> DataFrame:
    """Top-k signals by absolute correlation with the target; (by, signal, strength, rank). Ties go to the first name."""
    a, b = (F.coalesce(F.col(x), F.lit(0.0)), F.coalesce(F.col(y), F.lit(0.0))) if fill else (F.col(x), F.col(y))
    g = df.withColumn("_a", a).withColumn("_b", b).groupBy(*by, "signal").agg(F.abs(safe_corr("_a", "_b")).alias("strength"), F.count(x).alias("_n"))
    g = g.filter(F.col("strength").isNotNull() & (F.col("_n") > min_known)).drop("_n")
    w = Window.partitionBy(*by).orderBy(F.col("strength").desc(), "signal")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def purged_end(pos: Column, horizon: int = 1, embargo: int = 12, min_train: int = 180) -> Column:
    """End (exclusive) of the rows usable at position `pos`; NULL when too few remain."""
    end = pos - horizon - embargo
    return F.when(end >= min_train, end)


def forward_sum_target(df: DataFrame, by: list[str], y: str, h: int, out: str = "target", order: str = "d") -> DataFrame:
    f = win(by, order).rowsBetween(-(h - 1), 0)
    return df.withColumn(out, F.when(F.count(y).over(f) >= h, F.sum(y).over(f)))


def forward_event_target(df: DataFrame, by: list[str], label: str, h: int, out: str = "target", order: str = "d") -> DataFrame:
    """1 if the label is 1 in any of the next h rows; needs row t + h - 1 to exist."""
    w = win(by, order)
    inside = F.lead(F.lit(1), h - 1).over(w).isNotNull() if h > 1 else F.lit(True)
    return df.withColumn(out, F.when(inside, F.max(label).over(w.rowsBetween(1, h))))


def visible_target(df: DataFrame, by: list[str], label: str, h: int, lag: int = 12, out: str = "target", order: str = "d") -> DataFrame:
    d = forward_event_target(df, by, label, h, "_t", order)
    return d.withColumn(out, F.lag("_t", lag).over(win(by, order))).drop("_t")


# ---- evaluation ----


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def oos_r2(df: DataFrame, by: list[str], y: str = "y", f: str = "forecast", b: str = "bench", min_rows: int = 12) -> DataFrame:
    """1 - MSE of the forecast over MSE of the benchmark, on complete rows."""
    k = complete(df, [y, f, b])
    mf, mb = F.avg(F.pow(F.col(y) - F.col(f), 2)), F.avg(F.pow(F.col(y) - F.col(b), 2))
    return k.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= min_rows, 1.0 - mf / F.nullif(mb, F.lit(0.0))).alias("r2"))


def hac_lag(n: Column) -> Column:
    """floor(4 * (n / 100)^(2/9))."""
    return F.floor(4.0 * F.pow(n / 100.0, F.lit(2.0 / 9.0))).cast("int")


def _with_lags(df: DataFrame, by: list[str], values: list[str], lag: str, order: str) -> DataFrame:
    """Rows (by, lag, _lagk, values, values of the _lagk-th row before as _p_*) for _lagk = 1..lag of the row's series.

    The lag is the series' own, so each row asks for exactly the rows it needs, by their number; the join's key
    holds that number, which spreads a long series.
    """
    rows = df.select(*by, lag, *values, F.row_number().over(Window.partitionBy(*by).orderBy(order)).alias("_rn"))
    ask = rows.withColumn("_lagk", F.explode(F.sequence(F.lit(1), F.col(lag)))).withColumn("_rn", F.col("_rn") - F.col("_lagk")).filter("_rn > 0")
    return ask.join(rows.select(*by, "_rn", *[F.col(v).alias(f"_p{v}") for v in values]), [*by, "_rn"]).drop("_rn")


def clark_west(df: DataFrame, by: list[str], y: str = "y", f: str = "forecast", b: str = "bench", min_rows: int = 24, order: str = "d") -> DataFrame:
    """Statistic of the nested-forecast comparison with a Bartlett-weighted standard error; (by, n, mean, stat)."""
    k = complete(df, [y, f, b]).withColumn("_h", F.pow(F.col(y) - F.col(b), 2) - F.pow(F.col(y) - F.col(f), 2) + F.pow(F.col(b) - F.col(f), 2))
    whole = Window.partitionBy(*by)
    k = k.withColumn("_n", F.count(F.lit(1)).over(whole)).filter(F.col("_n") >= min_rows)
    k = k.withColumn("_m", F.avg("_h").over(whole)).withColumn("_e", F.col("_h") - F.col("_m")).withColumn("_l", hac_lag(F.col("_n")))
    k = k.withColumn("_lag", F.greatest("_l", F.lit(1)))
    base = k.groupBy(*by).agg(F.max("_n").alias("n"), F.max("_m").alias("mean"), F.avg(F.col("_e") * F.col("_e")).alias("_g0"), F.max("_l").alias("_l"))
    auto = _with_lags(k, by, ["_e"], "_lag", order).groupBy(*by, "_lagk").agg(F.avg(F.col("_e") * F.col("_p_e")).alias("_g"))
    weighted = auto.join(base.select(*by, "_l"), by).groupBy(*by).agg(F.sum(2.0 * (1.0 - F.col("_lagk") / (F.col("_l") + 1.0)) * F.col("_g")).alias("_gs"))
    j = base.join(weighted, by, "left")
    se = F.sqrt(F.greatest(F.col("_g0") + F.coalesce("_gs", F.lit(0.0)), F.lit(1e-18)) / F.col("n"))
    return j.select(*by, "n", "mean", (F.col("mean") / se).alias("stat"))


def nw_ols(df: DataFrame, by: list[str], y: str = "y", x: str = "x", order: str = "d") -> DataFrame:
    """One-regressor least squares with Bartlett-weighted standard errors; alpha, beta and their t-values.

    The 2x2 score sums are kept element by element: S = sum of u_t u_t' plus weighted lagged products, with
    u = (e, x e).
    """
    k = complete(df, [y, x])
    whole = Window.partitionBy(*by)
    sxx = F.var_pop(x).over(whole)
    k = k.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_mx", F.avg(x).over(whole)).withColumn("_my", F.avg(y).over(whole))
    k = k.withColumn("_vx", sxx).withColumn("_b", F.covar_pop(x, y).over(whole) / F.nullif(F.col("_vx"), F.lit(0.0)))
    k = k.withColumn("_a", F.col("_my") - F.col("_b") * F.col("_mx")).withColumn("_e", F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).withColumn("_xe", F.col(x) * F.col("_e"))
    lag = F.greatest(F.least(F.greatest(hac_lag(F.col("_n")), F.lit(1)), F.greatest(F.floor(F.col("_n") / 4).cast("int"), F.lit(1))), F.lit(1))
    k = k.withColumn("_lag", lag)
    base = k.groupBy(*by).agg(F.max("_n").alias("n"), F.max("_a").alias("alpha"), F.max("_b").alias("beta"), F.max("_mx").alias("_mx"), F.max("_vx").alias("_vx"),
                              F.max("_lag").alias("_lag"), F.sum(F.col("_e") * F.col("_e")).alias("_s00"), F.sum(F.col("_e") * F.col("_xe")).alias("_s01"), F.sum(F.col("_xe") * F.col("_xe")).alias("_s11"))
    past = _with_lags(k, by, ["_e", "_xe"], "_lag", order)
    wt = 1.0 - F.col("_lagk") / (F.col("_lag") + 1.0)
    cross = past.groupBy(*by).agg(F.sum(2.0 * wt * F.col("_e") * F.col("_p_e")).alias("_c00"), F.sum(wt * (F.col("_e") * F.col("_p_xe") + F.col("_xe") * F.col("_p_e"))).alias("_c01"),
                                  F.sum(2.0 * wt * F.col("_xe") * F.col("_p_xe")).alias("_c11"))
    j = base.join(cross, by)
    s00, s01, s11 = F.col("_s00") + F.col("_c00"), F.col("_s01") + F.col("_c01"), F.col("_s11") + F.col("_c11")
    n, mx, vx = F.col("n"), F.col("_mx"), F.col("_vx")
    # rows of (X'X)^-1 are [(vx + mx^2), -mx; -mx, 1] / (n vx)
    p, q = (vx + mx * mx) / (n * vx), -mx / (n * vx)
    r = 1.0 / (n * vx)
    var_a = p * p * s00 + 2 * p * q * s01 + q * q * s11
    var_b = q * q * s00 + 2 * q * r * s01 + r * r * s11
    low = lambda v: F.sqrt(F.greatest(v, F.lit(1e-18)))
    return j.select(*by, "n", "alpha", "beta", (F.col("alpha") / low(var_a)).alias("t_alpha"), (F.col("beta") / low(var_b)).alias("t_beta"))


def signal_scan(df: DataFrame, by: list[str] = ["asset", "signal"], min_rows: int = 252, order: str = "d") -> DataFrame:
    """R2 and Clark-West statistic of every (asset, signal) with enough scored rows."""
    r = oos_r2(df, by).filter(F.col("n") >= min_rows)
    s = clark_west(df, by, order=order).select(*by, "stat")
    return r.join(s, by, "left")


def signal_rank(scan: DataFrame, n_assets: int, crit: float = 1.645) -> DataFrame:
    """Per signal: means, significant and positive counts; signals scored on at least half the assets."""
    g = scan.groupBy("signal", "family").agg(F.avg("r2").alias("mean_r2"), F.avg("stat").alias("mean_t"), F.count_if(F.col("stat") > crit).alias("n_sig"),
                                             F.count_if(F.col("r2") > 0).alias("n_positive"), F.count("*").alias("n_assets"))
    return g.filter(F.col("n_assets") >= n_assets // 2)


def family_rank(ranked: DataFrame) -> DataFrame:
    g = ranked.groupBy("family").agg(F.count("*").alias("signals"), F.avg("mean_r2").alias("mean_r2"), F.max("mean_r2").alias("best_r2"), F.avg("mean_t").alias("mean_t"),
                                     F.sum("n_sig").alias("sig_pairs"), F.sum("n_assets").alias("pairs"))
    return g.withColumn("pct_sig", F.col("sig_pairs") / F.col("pairs"))


def multiplicity(ranked: DataFrame, level: float = 0.05) -> DataFrame:
    g = ranked.agg(F.sum("n_assets").alias("pairs"), F.sum("n_sig").alias("significant"))
    return g.withColumn("expected_by_chance", level * F.col("pairs")).withColumn("ratio", div("significant", "expected_by_chance"))


def top_k_per_asset(scan: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("asset").orderBy(F.col("r2").desc(), "signal")
    return scan.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recurring_signals(top: DataFrame, min_assets: int = 3) -> DataFrame:
    g = top.groupBy("signal", "family").agg(F.countDistinct("asset").alias("assets"), F.percentile("r2", F.lit(0.5)).alias("median_r2"),
                                            F.max("r2").alias("best_r2"), F.max_by("asset", "r2").alias("best_on"))
    return g.filter(F.col("assets") >= min_assets)


def skill_split(skill: DataFrame, stale: list[str], by: list[str] = ["family"]) -> DataFrame:
    """Mean R2 over all, stale and clean assets; one pair of columns per sampling in `sample`."""
    is_stale = F.col("asset").isin(*stale)
    return skill.groupBy(*by, "sample").agg(F.avg("r2").alias("all"), F.avg(F.when(is_stale, F.col("r2"))).alias("stale"), F.avg(F.when(~is_stale, F.col("r2"))).alias("clean"))


def auc(df: DataFrame, by: list[str], y: str = "y", s: str = "p", wide: bool = False) -> DataFrame:
    """Area under the ROC curve from average ranks; NULL with one class."""
    from .crosssection import avg_rank, with_wide_rank

    k = complete(df, [y, s])
    k = with_wide_rank(k, by, s, "_r") if wide else k.withColumn("_r", avg_rank(s, by))
    n1, n0 = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    hit = F.sum(F.when(F.col(y) == 1, F.col("_r")))
    return k.groupBy(*by).agg(((hit - n1 * (n1 + 1) / 2.0) / F.nullif(n1 * n0, F.lit(0))).alias("auc"))


def classification_report(df: DataFrame, by: list[str], y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    k = complete(df, [y, p])
    pred, pos = F.col(p) >= threshold, F.col(y) == 1
    tp, fp, fn, tn = F.count_if(pred & pos), F.count_if(pred & ~pos), F.count_if(~pred & pos), F.count_if(~pred & ~pos)
    g = k.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.count("*").alias("n_obs"), F.avg(y).alias("base_rate"),
                           F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))
    return g.withColumn("precision", div("tp", F.col("tp") + F.col("fp"))).withColumn("recall", div("tp", F.col("tp") + F.col("fn"))).withColumn("n_signals", F.col("tp") + F.col("fp"))


def brier(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    return complete(df, [y, p]).groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))
