"""Queries: performance metrics and leverage."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import r6, win
from ..operators import metrics as M
from ..operators import timeseries as T
from .registry import query, view
from .series import out, sq

SPANS = {"dev": ("1995-01", "1998-12"), "oos": ("1999-01", "2001-12"), "full": None}


def perf_views(prefix: str, src: str, keys: str = "strategy") -> None:
    """SQL of the metric set on relation (keys, d, r, rf)."""
    view(f"{prefix}_g", f"SELECT *, product(1 + r) OVER (PARTITION BY {keys} ORDER BY d) AS g, row_number() OVER (PARTITION BY {keys} ORDER BY d) AS rn FROM {src} WHERE r IS NOT NULL")
    view(f"{prefix}_d", f"SELECT *, g/MAX(g) OVER (PARTITION BY {keys} ORDER BY d) - 1 AS dd FROM {prefix}_g")
    view(f"{prefix}_i", f"SELECT *, SUM(CASE WHEN dd < -1e-12 THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY d) AS island FROM {prefix}_d")
    view(f"{prefix}_u", f"SELECT {keys}, MAX(k) AS tuw FROM (SELECT {keys}, island, COUNT(*) FILTER (WHERE dd < -1e-12) AS k FROM {prefix}_i GROUP BY {keys}, island) GROUP BY {keys}")
    view(prefix, f"""SELECT p.*, tuw AS time_under_water, CASE WHEN max_drawdown < 0 THEN cagr/abs(max_drawdown) END AS calmar FROM (SELECT {keys}, POW(product(1 + r), 12.0/COUNT(r)) - 1 AS cagr, AVG(r)*12 AS ann_return,
      stddev_samp(r)*sqrt(12) AS vol, MIN(dd) AS max_drawdown, CASE WHEN COUNT(*) FILTER (WHERE r - rf < 0) = 0 THEN 'inf'::DOUBLE ELSE AVG(r - rf)*12/(sqrt(AVG(POW(r - rf, 2)) FILTER (WHERE r - rf < 0))*sqrt(12)) END AS sortino,
      AVG(CAST(r > 0 AS DOUBLE)) AS hit_rate, MIN(r) AS worst_period, COUNT(r) AS periods, AVG(r - rf)*12/(stddev_samp(r - rf)*sqrt(12)) AS sharpe, AVG(r - rf)*12 AS excess_return FROM {prefix}_d GROUP BY {keys}) p
      JOIN {prefix}_u u ON {' AND '.join(f'u.{k} = p.{k}' for k in keys.split(', '))}""")


PERF = ("cagr", "ann_return", "vol", "max_drawdown", "calmar", "sortino", "hit_rate", "worst_period", "sharpe", "excess_return")
PSQL = {k: k for k in PERF}
perf_views("pf", "strat_m")
view("span_m", "SELECT strategy, s.span, d, r, rf FROM strat_m JOIN (VALUES ('dev', DATE '1995-01-01', DATE '1998-12-31'), ('oos', DATE '1999-01-01', DATE '2001-12-31'), ('full', DATE '1900-01-01', DATE '2100-01-01')) s(span, a, b) ON d BETWEEN a AND b")
perf_views("pfs", "span_m", "strategy, span")


@query("performance", sq(PSQL, "pf", "strategy, periods, time_under_water"))
def _(t):
    return out(M.performance(t.strat_m, ["strategy"]), *PERF, keys=("strategy", "periods", "time_under_water"))


@query("max_drawdown", "SELECT strategy, round(max_drawdown, 6)+0.0 AS mdd FROM pf")
def _(t):
    return T.drawdown(t.strat_m, ["strategy"]).groupBy("strategy").agg(r6(F.min("dd")).alias("mdd"))


@query("time_under_water", "SELECT strategy, time_under_water AS tuw FROM pf")
def _(t):
    u = M.with_underwater(T.drawdown(t.strat_m, ["strategy"]), ["strategy"])
    return u.groupBy("strategy").agg(F.max("underwater").alias("tuw"))


@query("sortino", "SELECT strategy, round(sortino, 6)+0.0 AS sortino, round(AVG(r)*12/(sqrt(AVG(r*r) FILTER (WHERE r < 0))*sqrt(12)), 6)+0.0 AS plain FROM pf JOIN strat_m USING (strategy) GROUP BY 1, sortino")
def _(t):
    return t.strat_m.groupBy("strategy").agg(r6(M.sortino_of(F.col("r") - F.col("rf"), 12)).alias("sortino"), r6(M.sortino_of(F.col("r"), 12)).alias("plain"))


@query("rolling_sharpe", """SELECT strategy, d, round(CASE WHEN COUNT(r) OVER w >= 24 THEN AVG(r - rf) OVER w*12/(stddev_samp(r) OVER w*sqrt(12)) END, 6)+0.0 AS rolling_sharpe FROM strat_m
  WINDOW w AS (PARTITION BY strategy ORDER BY d ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def _(t):
    return out(M.rolling_sharpe(t.strat_m, ["strategy"], 24), "rolling_sharpe", keys=("strategy", "d"))


@query("comparison_table", sq(PSQL, "pfs", "strategy, span, periods, time_under_water"))
def _(t):
    return out(M.comparison_table(t.strat_m, SPANS), *PERF, keys=("strategy", "span", "periods", "time_under_water"))


@query("edge_vs", "SELECT a.strategy, a.span, round(a.sharpe - b.sharpe, 6)+0.0 AS sharpe_edge FROM pfs a JOIN pfs b ON a.span = b.span AND b.strategy = 'MEDIUM'")
def _(t):
    c = M.comparison_table(t.strat_m, SPANS)
    return out(M.edge_vs(c, "MEDIUM", by=["span"]), "sharpe_edge", keys=("strategy", "span"))


@query("realized_stats", """WITH p AS (SELECT d, SUM(r)/(SELECT COUNT(DISTINCT strategy) FROM strat_m) AS r, ANY_VALUE(rf) AS rf FROM strat_m GROUP BY 1), g AS (SELECT *, product(1 + r) OVER (ORDER BY d) AS g FROM p), x AS (SELECT *, g/MAX(g) OVER (ORDER BY d) - 1 AS dd FROM g)
  SELECT round(POW(product(1 + r), 12.0/COUNT(*)) - 1, 6)+0.0 AS geometric_return, round(AVG(r)*12, 6)+0.0 AS arithmetic_return, round(stddev_samp(r)*sqrt(12), 6)+0.0 AS vol, round(MIN(dd), 6)+0.0 AS max_drawdown, COUNT(*) AS months,
  round(AVG(r - rf)*12/(stddev_samp(r)*sqrt(12)), 6)+0.0 AS sharpe FROM x""")
def _(t):
    r = t.strat_m.select(F.lit("all").alias("universe"), F.col("strategy").alias("asset"), "d", "r", "rf")
    w = r.select("universe", "asset").distinct().withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("universe")))
    return out(M.realized_stats(r, w, ["universe"]), "geometric_return", "arithmetic_return", "vol", "max_drawdown", "sharpe", keys=("months",))


@query("asset_stats", """WITH l AS (SELECT *, LAG(r) OVER (PARTITION BY strategy ORDER BY d) AS l1, """ + ", ".join(f"LAG(r, {k}) OVER (PARTITION BY strategy ORDER BY d) AS m{k}" for k in range(1, 6)) + """ FROM strat_m),
  a AS (SELECT strategy AS asset, AVG(r)*12 AS ar, stddev_samp(r)*sqrt(12) AS av, AVG(r - rf)*12/(stddev_samp(r - rf)*sqrt(12)) AS sh, corr(r, l1) AS ac, MIN(r) AS worst, greatest(1 + """ +
       " + ".join(f"2*(1 - {k}/6.0)*corr(r, m{k})" for k in range(1, 6)) + """, 0.25) AS nw FROM l GROUP BY 1)
  SELECT asset, round(ar, 6)+0.0 AS ann_return, round(av, 6)+0.0 AS ann_vol, round(sh, 6)+0.0 AS sharpe, round(ac, 6)+0.0 AS autocorr_1, round(nw, 6)+0.0 AS nw_factor, round(worst, 6)+0.0 AS worst_day, round(av*sqrt(nw), 6)+0.0 AS vol_adjusted FROM a""")
def _(t):
    s = M.asset_stats(t.strat_m.withColumnRenamed("strategy", "asset"), ppy=12, min_obs=60)
    return out(s, "ann_return", "ann_vol", "sharpe", "autocorr_1", "nw_factor", "worst_day", "vol_adjusted", keys=("asset",))


@query("lever_series", sq({"up": "1.5*(r - rf) + rf - 0.5*0.005/12", "down": "0.5*(r - rf) + rf"}, "strat_m", "strategy, d"))
def _(t):
    return out(t.strat_m.withColumn("up", M.lever_series("r", "rf", F.lit(1.5), F.lit(50.0))).withColumn("down", M.lever_series("r", "rf", F.lit(0.5), F.lit(50.0))), "up", "down", keys=("strategy", "d"))


@query("levered_sharpe", "SELECT strategy, round(0.8/vol, 6)+0.0 AS leverage, round(CASE WHEN 0.8/vol <= 1 THEN sharpe ELSE sharpe - 0.005*(0.8/vol - 1)/(0.8/vol*vol) END, 6)+0.0 AS s FROM pf")
def _(t):
    p = M.performance(t.strat_m, ["strategy"]).withColumn("leverage", M.required_leverage("vol", F.lit(0.8)))
    return out(p.withColumn("s", M.levered_sharpe("sharpe", "vol", "leverage", F.lit(50.0))), "leverage", "s", keys=("strategy",))


view("lev_l", "SELECT strategy, vol, sharpe, 0.8/vol AS need, least(0.8/vol, 1.2) AS used FROM pf")
view("lev_m", "SELECT strategy, d, used*(r - rf) + rf - greatest((used - 1)*0.005/12, 0) AS r, rf FROM strat_m JOIN lev_l USING (strategy)")
perf_views("pfl", "lev_m")


@query("leverage_comparison", """SELECT l.strategy, round(l.vol, 6)+0.0 AS vol, round(l.sharpe, 6)+0.0 AS sharpe_unlevered, round(need, 6)+0.0 AS leverage_needed, round(used, 6)+0.0 AS leverage_used, used >= need - 1e-9 AS reaches_target,
  round(p.vol, 6)+0.0 AS vol_achieved, round(p.cagr, 6)+0.0 AS cagr_levered, round(p.sharpe, 6)+0.0 AS sharpe_levered, round(l.sharpe - p.sharpe, 6)+0.0 AS sharpe_cost, round(p.max_drawdown, 6)+0.0 AS max_drawdown_levered FROM lev_l l JOIN pfl p USING (strategy)""")
def _(t):
    c = M.leverage_comparison(t.strat_m, target_vol=0.8, max_leverage=1.2)
    return out(c, *[k for k in c.columns if k not in ("strategy", "reaches_target")], keys=("strategy", "reaches_target"))


@query("unlevered_comparison", sq({k: k for k in ("cagr", "vol", "sharpe", "max_drawdown", "calmar")}, "pf", "strategy"))
def _(t):
    return out(M.unlevered_comparison(t.strat_m), "cagr", "vol", "sharpe", "max_drawdown", "calmar", keys=("strategy",))


@query("spread_sensitivity", """WITH x AS (SELECT strategy, s.bp, 0.8/vol AS lev, 0.8/vol*(r - rf) - greatest((0.8/vol - 1)*s.bp/1e4/12, 0) AS e FROM strat_m JOIN pf USING (strategy), (SELECT unnest([0, 25, 50, 100, 150])::DOUBLE AS bp) s)
  SELECT strategy, bp AS spread_bp, round(lev, 6)+0.0 AS leverage, round(AVG(e)*12/(stddev_samp(e)*sqrt(12)), 6)+0.0 AS sharpe FROM x GROUP BY 1, 2, lev""")
def _(t):
    return out(M.spread_sensitivity(t.strat_m, [0, 25, 50, 100, 150], target_vol=0.8), "leverage", "sharpe", keys=("strategy", "spread_bp"))


@query("blended_financing", """WITH w AS (SELECT d AS strategy, asset, vol/SUM(vol) OVER (PARTITION BY d) AS w, CASE asset WHEN 'ECONOMY' THEN 3 WHEN 'LARGE' THEN 15 WHEN 'MEDIUM' THEN 50 ELSE 110 END AS bp FROM px_m)
  SELECT strategy, round(SUM(w*bp), 6)+0.0 AS proportional_bp, round(SUM(w*bp) FILTER (WHERE asset NOT IN ('PROMO', 'SMALL'))/SUM(w) FILTER (WHERE asset NOT IN ('PROMO', 'SMALL')), 6)+0.0 AS overlay_bp FROM w GROUP BY 1""")
def _(t):
    total = F.sum("vol").over(Window.partitionBy("d"))
    w = t.px_m.select(F.col("d").alias("strategy"), "asset", (F.col("vol") / total).alias("w"))
    rates = t.dim([("ECONOMY", 3.0), ("LARGE", 15.0), ("MEDIUM", 50.0), ("PROMO", 110.0), ("SMALL", 110.0), ("STANDARD", 110.0)], "asset string, bp double")
    return out(M.blended_financing(w, rates, ["strategy"], ["PROMO", "SMALL"]), "proportional_bp", "overlay_bp", keys=("strategy",))


view("l2b", """SELECT a.strategy, a.span, d, r, rf, CASE WHEN a.strategy = 'MEDIUM' THEN 1 ELSE b.vol/a.vol END AS la, b.vol/a.vol AS lo, CASE WHEN a.strategy < 'M' THEN 10.0 ELSE 40.0 END AS bp
  FROM pfs a JOIN pfs b ON a.span = b.span AND b.strategy = 'MEDIUM' JOIN span_m m ON m.strategy = a.strategy AND m.span = a.span""")


@query("lever_to_benchmark", sq({"aligned": "la*(r - rf) + rf - greatest((la - 1)*bp/1e4/12, 0)", "overlaid": "CASE WHEN lo <= 1 THEN r ELSE lo*(r - rf) + rf - (lo - 1)*bp/1e4/12 END"}, "l2b", "strategy, span, d"))
def _(t):
    s = M.with_windows(t.strat_m, SPANS)
    spreads = t.dim([("ECONOMY", 10.0), ("LARGE", 10.0), ("MEDIUM", 40.0), ("PROMO", 40.0), ("SMALL", 40.0), ("STANDARD", 40.0)], "strategy string, spread_bp double")
    keys = ["strategy", "span", "d"]
    a = M.lever_to_benchmark(s, "MEDIUM", spreads, ["span"]).select(*keys, F.col("levered").alias("aligned"))
    o = M.lever_to_benchmark(s, "MEDIUM", spreads, ["span"], mode="overlay").select(*keys, F.col("levered").alias("overlaid"))
    return out(a.join(o, keys), "aligned", "overlaid", keys=keys)


@query("breakeven_spread", """WITH e AS (SELECT strategy, stddev_samp(r)*sqrt(12) AS v, AVG(r - rf)*12 AS m, stddev_samp(r - rf)*sqrt(12) AS s FROM strat_m GROUP BY 1), b AS (SELECT v AS bv, m/s AS bs FROM e WHERE strategy = 'SMALL')
  SELECT strategy, round(bv/v, 6)+0.0 AS leverage, round(greatest((bv/v)*(m - bs*s)/(bv/v - 1)*1e4, 0), 6)+0.0 AS breakeven_bp FROM e, b WHERE strategy <> 'SMALL' AND bv/v > 1""")
def _(t):
    return out(M.breakeven_spread(t.strat_m, "SMALL"), "leverage", "breakeven_bp", keys=("strategy",))


@query("certainty_equivalent", "SELECT strategy, round(AVG(r - rf)*12 - 2.5*var_samp(r - rf)*12, 6)+0.0 AS ce FROM strat_m GROUP BY 1")
def _(t):
    return out(M.certainty_equivalent(t.strat_m, ["strategy"]), "ce", keys=("strategy",))


@query("ce_gain", "SELECT strategy, round(AVG(s.r - rf)*12 - 2.5*var_samp(s.r - rf)*12 - (AVG(b.r - rf)*12 - 2.5*var_samp(b.r - rf)*12), 6)+0.0 AS ce_gain FROM strat_m s JOIN bench_m b USING (d) GROUP BY 1")
def _(t):
    return out(M.ce_gain(t.strat_m, t.bench_m.select("d", F.col("r").alias("b")), ["strategy"]), "ce_gain", keys=("strategy",))
