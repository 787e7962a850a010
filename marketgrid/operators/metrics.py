"""Performance metrics and leverage arithmetic.

Inputs are long return paths (keys..., d, r, rf); every metric of every strategy and window comes from one
window sort and one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ColumnLike, c, clip, compound, div, expanding, roll_mean, roll_std, safe_corr, win
from .covariance import nw_variance_factor
from .dates import in_span
from .timeseries import drawdown


def with_windows(df: DataFrame, spans: dict[str, tuple[str, str] | None], d: str = "d") -> DataFrame:
    """Copy each row into the evaluation windows that hold its date; None is the full sample."""
    member = F.array_compact(F.array(*[F.when(in_span(*v, d) if v else F.lit(True), F.lit(k)) for k, v in spans.items()]))
    return df.withColumn("span", F.explode(member))


def with_underwater(df: DataFrame, by: list[str], dd: str = "dd", order: str = "d") -> DataFrame:
    """Length so far of the current underwater run, without island ids."""
    w = win(by, order)
    d = df.withColumn("_rn", F.row_number().over(w))
    dry = F.max(F.when(F.coalesce(F.col(dd), F.lit(0.0)) >= -1e-12, F.col("_rn"))).over(expanding(w))
    return d.withColumn("underwater", F.col("_rn") - F.coalesce(dry, F.lit(0))).drop("_rn")


def sortino_of(ex: Column, ppy: int) -> Column:
    """Mean over the root mean square of the negative excess returns alone; infinite without any."""
    down = F.sqrt(F.avg(F.when(ex < 0, ex * ex))) * F.sqrt(F.lit(float(ppy)))
    return F.when(F.count_if(ex < 0) == 0, F.when(F.count(ex) > 0, F.lit(float("inf")))).otherwise(F.avg(ex) * ppy / F.nullif(down, F.lit(0.0)))


def sharpe_of(ex: Column, ppy: int) -> Column:
    return F.avg(ex) * ppy / F.nullif(F.stddev_samp(ex) * F.sqrt(F.lit(float(ppy))), F.lit(0.0))


def performance(df: DataFrame, by: list[str], r: str = "r", rf: str | None = "rf", turnover: str | None = None, ppy: int = 12, order: str = "d") -> DataFrame:
    """The full metric set, one row per key."""
    known = df.filter(F.col(r).isNotNull())
    p = with_underwater(drawdown(known, by, r, "dd", order), by, "dd", order)
    x, root = F.col(r), F.sqrt(F.lit(float(ppy)))
    ex = x - F.col(rf) if rf else x
    n = F.count(x)
    cagr, mdd = F.pow(compound(x) + 1.0, ppy / n) - 1.0, F.min("dd")
    vol = F.stddev_samp(x) * root
    aggs = [cagr.alias("cagr"), (F.avg(x) * ppy).alias("ann_return"), vol.alias("vol"), mdd.alias("max_drawdown"),
            F.when(mdd < 0, cagr / F.abs(F.nullif(mdd, F.lit(0.0)))).alias("calmar"), sortino_of(ex, ppy).alias("sortino"),
            F.avg((x > 0).cast("double")).alias("hit_rate"), F.min(x).alias("worst_period"), F.max("underwater").alias("time_under_water"),
            n.alias("periods"), sharpe_of(ex, ppy).alias("sharpe"), (F.avg(ex) * ppy).alias("excess_return")]
    if turnover:
        t = F.coalesce(F.col(turnover), F.lit(0.0))
        aggs += [(F.avg(t) * ppy).alias("turnover_pa"), (F.avg((t > 1e-9).cast("double")) * ppy).alias("trades_pa")]
    return p.groupBy(*by).agg(*aggs)


def comparison_table(df: DataFrame, spans: dict, by: list[str] = ["strategy"], **kw) -> DataFrame:
    return performance(with_windows(df, spans), [*by, "span"], **kw)


def rolling_sharpe(df: DataFrame, by: list[str], window: int = 36, ppy: int = 12, r: str = "r", rf: str = "rf", order: str = "d") -> DataFrame:
    """Rolling mean of the excess return over the rolling sd of the total return."""
    w = win(by, order)
    s = roll_mean(F.col(r) - F.col(rf), w, window) * ppy / F.nullif(roll_std(r, w, window) * F.sqrt(F.lit(float(ppy))), F.lit(0.0))
    return df.withColumn("rolling_sharpe", s)


def edge_vs(table: DataFrame, benchmark: str, metric: str = "sharpe", by: list[str] | None = None, strategy: str = "strategy") -> DataFrame:
    """A metric minus the benchmark row's."""
    by = by or []
    b = table.filter(F.col(strategy) == benchmark).select(*by, F.col(metric).alias("_b"))
    joined = table.join(b, by) if by else table.withColumn("_b", b.scalar())
    return joined.withColumn(f"{metric}_edge", F.col(metric) - F.col("_b")).drop("_b")


def realized_stats(returns: DataFrame, weights: DataFrame, by: list[str], ppy: int = 12, asset: str = "asset", d: str = "d", r: str = "r", rf: str = "rf") -> DataFrame:
    """Compound a fixed mix; its Sharpe divides by the sd of total returns."""
    port = returns.join(weights, [*by, asset]).groupBy(*by, d).agg(F.sum(F.col(r) * F.col("w")).alias("_p"), F.first(rf).alias("_rf"))
    p = drawdown(port, by, "_p", "_dd", d)
    x = F.col("_p")
    vol = F.stddev_samp(x) * F.sqrt(F.lit(float(ppy)))
    return p.groupBy(*by).agg((F.pow(compound(x) + 1.0, ppy / F.count(x)) - 1.0).alias("geometric_return"), (F.avg(x) * ppy).alias("arithmetic_return"),
                              vol.alias("vol"), F.min("_dd").alias("max_drawdown"), F.count(x).alias("months"),
                              (F.avg(x - F.col("_rf")) * ppy / F.nullif(vol, F.lit(0.0))).alias("sharpe"))


def asset_stats(df: DataFrame, by: list[str] = ["asset"], ppy: int = 252, r: str = "r", rf: str = "rf", order: str = "d", min_obs: int = 100) -> DataFrame:
    known = df.filter(F.col(r).isNotNull()).withColumn("_l", F.lag(r).over(win(by, order)))
    g = known.groupBy(*by).agg((F.avg(r) * ppy).alias("ann_return"), (F.stddev_samp(r) * F.sqrt(F.lit(float(ppy)))).alias("ann_vol"),
                               sharpe_of(F.col(r) - F.col(rf), ppy).alias("sharpe"), safe_corr(r, "_l").alias("autocorr_1"), F.min(r).alias("worst_day"))
    nw = nw_variance_factor(df, by, r, min_obs=min_obs, d=order).withColumnRenamed("nw", "nw_factor")
    return g.join(nw, by).withColumn("vol_adjusted", F.col("ann_vol") * F.sqrt("nw_factor"))


# ---- leverage ----

# fixed values: financing spread over the risk-free rate, basis points a year
SPREADS_BP = {"institutional": 25, "typical": 50, "retail": 150}


def required_leverage(vol: ColumnLike, target: ColumnLike) -> Column:
    return F.when(c(vol) > 0, c(target) / F.nullif(c(vol), F.lit(0.0))).otherwise(F.lit(float("inf")))


def lever_series(r: ColumnLike, rf: ColumnLike, leverage: ColumnLike, spread_bp: ColumnLike, ppy: int = 12) -> Column:
    """Leverage times excess return plus rf, less financing on the borrowed part."""
    base = F.coalesce(c(rf), F.lit(0.0))
    cost = F.greatest((c(leverage) - 1.0) * (c(spread_bp) / 1e4) / ppy, F.lit(0.0))
    return c(leverage) * (c(r) - base) + base - cost


def levered_sharpe(sharpe: ColumnLike, vol: ColumnLike, leverage: ColumnLike, spread_bp: ColumnLike) -> Column:
    drag = c(spread_bp) / 1e4 * (c(leverage) - 1.0) / F.nullif(c(leverage) * c(vol), F.lit(0.0))
    return F.when((c(leverage) <= 1.0) | (c(vol) <= 0), c(sharpe)).otherwise(c(sharpe) - drag)


def leverage_comparison(df: DataFrame, by: list[str] = ["strategy"], target_vol: float = 0.095, spread_bp: float = 50.0,
                        max_leverage: float | None = None, ppy: int = 12) -> DataFrame:
    """Every strategy at one volatility, paying for the leverage used."""
    base = performance(df, by, ppy=ppy).select(*by, "vol", F.col("sharpe").alias("sharpe_unlevered"))
    base = base.withColumn("leverage_needed", required_leverage("vol", F.lit(target_vol)))
    base = base.withColumn("leverage_used", F.least("leverage_needed", F.lit(max_leverage)) if max_leverage else F.col("leverage_needed"))
    lev = df.filter("r is not null").join(base.select(*by, "leverage_used"), by).withColumn("r", lever_series("r", "rf", "leverage_used", F.lit(spread_bp), ppy))
    p = performance(lev, by, ppy=ppy).select(*by, F.col("vol").alias("vol_achieved"), F.col("cagr").alias("cagr_levered"),
                                             F.col("sharpe").alias("sharpe_levered"), F.col("max_drawdown").alias("max_drawdown_levered"))
    return base.join(p, by).withColumn("reaches_target", F.col("leverage_used") >= F.col("leverage_needed") - 1e-9).withColumn(
        "sharpe_cost", F.col("sharpe_unlevered") - F.col("sharpe_levered"))


def unlevered_comparison(df: DataFrame, by: list[str] = ["strategy"], ppy: int = 12) -> DataFrame:
    return performance(df, by, ppy=ppy).select(*by, "cagr", "vol", "sharpe", "max_drawdown", "calmar")


def spread_sensitivity(df: DataFrame, spreads: list[float], by: list[str] = ["strategy"], target_vol: float = 0.095, ppy: int = 12) -> DataFrame:
    """Levered Sharpe for each financing spread; long in `spread_bp`."""
    lev = df.filter("r is not null").groupBy(*by).agg((F.stddev_samp("r") * F.sqrt(F.lit(float(ppy)))).alias("_v")).select(
        *by, required_leverage("_v", F.lit(target_vol)).alias("leverage"))
    rows = df.filter("r is not null").join(lev, by).withColumn("spread_bp", F.explode(F.array(*[F.lit(float(s)) for s in spreads])))
    ex = lever_series("r", "rf", "leverage", "spread_bp", ppy) - F.col("rf")
    return rows.groupBy(*by, "leverage", "spread_bp").agg(sharpe_of(ex, ppy).alias("sharpe"))


def blended_financing(weights: DataFrame, rates: DataFrame, by: list[str], unleverable: list[str], asset: str = "asset") -> DataFrame:
    """Weight-average financing: all positions in proportion, or an overlay on the leverable sleeve only."""
    j = weights.join(rates, asset)
    free = ~F.col(asset).isin(*unleverable)
    return j.groupBy(*by).agg(F.sum(F.col("w") * F.col("bp")).alias("proportional_bp"),
                              div(F.sum(F.when(free, F.col("w") * F.col("bp"))), F.sum(F.when(free, F.col("w")))).alias("overlay_bp"))


def lever_to_benchmark(df: DataFrame, benchmark: str, spreads: DataFrame, by: list[str] | None = None, mode: str = "aligned", ppy: int = 12) -> DataFrame:
    """Scale every path to the benchmark's volatility per key.

    "aligned" keeps the benchmark itself at one and also de-levers; "overlay" changes nothing when the
    needed leverage is at most one. `spreads` is (strategy, spread_bp).
    """
    by = by or []
    keys = ["strategy", *by]
    v = df.filter("r is not null").groupBy(*keys).agg((F.stddev_samp("r") * F.sqrt(F.lit(float(ppy)))).alias("_v"))
    b = v.filter(F.col("strategy") == benchmark).select(*by, F.col("_v").alias("_b"))
    lev = (v.join(b, by) if by else v.withColumn("_b", b.scalar())).withColumn("leverage", required_leverage("_v", "_b"))
    if mode == "aligned":
        lev = lev.withColumn("leverage", F.when(F.col("strategy") == benchmark, 1.0).otherwise(F.col("leverage")))
    rows = df.filter("r is not null").join(lev.select(*keys, "leverage"), keys).join(spreads, "strategy")
    levered = lever_series("r", "rf", "leverage", "spread_bp", ppy)
    return rows.withColumn("levered", levered if mode == "aligned" else F.when(F.col("leverage") <= 1.0, F.col("r")).otherwise(levered))


def breakeven_spread(df: DataFrame, benchmark: str, ppy: int = 12) -> DataFrame:
    """Spread at which the levered Sharpe meets the benchmark's.

    A constant charge moves the mean only, so the levered Sharpe is linear in the spread and the break-even
    is a ratio; where even free financing falls short it is 0.
    """
    ex = F.col("r") - F.col("rf")
    root = F.sqrt(F.lit(float(ppy)))
    g = df.filter("r is not null").groupBy("strategy").agg((F.stddev_samp("r") * root).alias("_v"), (F.avg(ex) * ppy).alias("_m"), (F.stddev_samp(ex) * root).alias("_s"))
    b = g.filter(F.col("strategy") == benchmark)
    j = g.filter(F.col("strategy") != benchmark).withColumn("_bv", b.select("_v").scalar()).withColumn("_bs", b.select(F.col("_m") / F.col("_s")).scalar()).withColumn("leverage", required_leverage("_v", "_bv")).filter("leverage > 1")
    free = F.col("leverage") * (F.col("_m") - F.col("_bs") * F.col("_s"))
    return j.select("strategy", "leverage", clip(free / (F.col("leverage") - 1.0) * 1e4, 0.0).alias("breakeven_bp"))


def certainty_equivalent_of(ex: Column, gamma: float, ppy: int) -> Column:
    return F.avg(ex) * ppy - 0.5 * gamma * F.var_samp(ex) * ppy


def certainty_equivalent(df: DataFrame, by: list[str], gamma: float = 5.0, ppy: int = 12) -> DataFrame:
    return df.groupBy(*by).agg(certainty_equivalent_of(F.col("r") - F.col("rf"), gamma, ppy).alias("ce"))


def ce_gain(df: DataFrame, benchmark: DataFrame, by: list[str], gamma: float = 5.0, ppy: int = 12) -> DataFrame:
    """Difference of certainty equivalents on common dates; `benchmark` is (d, b)."""
    j = df.join(benchmark, "d")
    return j.groupBy(*by).agg((certainty_equivalent_of(F.col("r") - F.col("rf"), gamma, ppy) - certainty_equivalent_of(F.col("b") - F.col("rf"), gamma, ppy)).alias("ce_gain"))
