"""Queries: row transforms of one entity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6, roll_mean, roll_std, win
from ..operators import align as A
from ..operators import timeseries as T
from .registry import query, view

def wa():
    return win(["asset"])


def F_(n, lag=0):
    """SQL text of a trailing frame."""
    return f"(PARTITION BY asset ORDER BY d ROWS BETWEEN {n - 1 + lag} PRECEDING AND {lag} PRECEDING)"


def gd(agg, x, n, m=None, lag=0):
    """SQL text of a rolling aggregate guarded by its count."""
    return f"CASE WHEN COUNT({x}) OVER {F_(n, lag)} >= {n if m is None else m} THEN {agg}({x}) OVER {F_(n, lag)} END"


def zs(x, n, m):
    return f"({x} - {gd('AVG', x, n, m)})/NULLIF({gd('stddev_samp', x, n, m)}, 0)"


def out(df, *cols, keys=("asset", "d")):
    """Keys plus rounded columns."""
    return df.select(*keys, *[r6(k).alias(k) for k in cols])


def sq(expr_by_name: dict, src="ret_m", keys="asset, d"):
    return f"SELECT {keys}, " + ", ".join(f"round({e}, 6)+0.0 AS {n}" for n, e in expr_by_name.items()) + f" FROM {src}"


@query("rolling_zscore", sq({"z": zs("px", 36, 12)}))
def _(t):
    return out(t.ret_m.withColumn("z", T.zscore("px", wa(), 36)), "z")


@query("trend_deviation", sq({"a": f"r - {gd('AVG', 'r', 36, 12)}", "b": f"r - {gd('AVG', 'r', 36, 18)}", "c": f"r - {gd('AVG', 'r', 12, 6)}"}))
def _(t):
    return out(t.ret_m.withColumn("a", T.trend_deviation("r", wa(), 36)).withColumn("b", T.trend_deviation("r", wa(), 36, 18))
               .withColumn("c", T.trend_deviation("r", wa(), 12)), "a", "b", "c")


@query("yoy", sq({"y": "px/LAG(px, 12) OVER (PARTITION BY asset ORDER BY d) - 1"}))
def _(t):
    return out(t.ret_m.withColumn("y", T.yoy("px", wa())), "y")


@query("diff", sq({"d3": "r - LAG(r, 3) OVER (PARTITION BY asset ORDER BY d)", "nd12": "-(r - LAG(r, 12) OVER (PARTITION BY asset ORDER BY d))"}))
def _(t):
    return out(t.ret_m.withColumn("d3", T.diff("r", wa(), 3)).withColumn("nd12", -T.diff("r", wa(), 12)), "d3", "nd12")


@query("pct_change", """WITH f AS (SELECT series, h, x, last_value(x IGNORE NULLS) OVER (PARTITION BY series ORDER BY h) AS p FROM grid_h LEFT JOIN events_h USING (series, h))
  SELECT series, h, round(p/NULLIF(LAG(p, 5) OVER (PARTITION BY series ORDER BY h), 0) - 1, 6)+0.0 AS padded, round(x/NULLIF(LAG(x, 5) OVER (PARTITION BY series ORDER BY h), 0) - 1, 6)+0.0 AS plain FROM f""")
def _(t):
    g = A.reindex(t.events_h, A.spine(t.events_h, ["series"], "1 hour", "h"), ["series", "h"])
    g = T.pct_change(g, ["series"], "x", 5, "padded", order="h")
    g = T.pct_change(g, ["series"], "x", 5, "plain", pad=False, order="h")
    return out(g, "padded", "plain", keys=("series", "h"))


@query("momentum", sq({"m6": f"{gd('product', '(1+r)', 6)} - 1", "p6": "px/LAG(px, 6) OVER (PARTITION BY asset ORDER BY d) - 1"}))
def _(t):
    return out(t.ret_m.withColumn("m6", T.momentum("r", wa(), 6)).withColumn("p6", T.momentum("px", wa(), 6, is_return=False)), "m6", "p6")


@query("realized_vol", sq({"v": f"{gd('stddev_samp', 'r', 12)}*sqrt(12)"}))
def _(t):
    return out(t.ret_m.withColumn("v", T.realized_vol("r", wa())), "v")


view("ret_b", "SELECT a.asset, a.d, a.r, b.r AS rb FROM ret_m a JOIN bench_m b USING (d)")


@query("rolling_corr", sq({"rho": f"CASE WHEN COUNT(r*rb) OVER {F_(36)} >= 18 THEN corr(r, rb) OVER {F_(36)} END"}, "ret_b"))
def _(t):
    b = t.bench_m.select("d", F.col("r").alias("rb"))
    return out(t.ret_m.join(b, "d").withColumn("rho", T.rolling_corr("r", "rb", wa(), 36)), "rho")


@query("rank_pct", """WITH p AS (SELECT asset, d, r, row_number() OVER (PARTITION BY asset ORDER BY d) AS i FROM ret_m),
  s AS (SELECT a.asset, a.d, a.r, a.i, COUNT(*) FILTER (WHERE b.i < a.i) AS n, COUNT(*) FILTER (WHERE b.i < a.i AND b.r < a.r) AS below, COUNT(b.r) AS known
        FROM p a JOIN p b ON a.asset = b.asset AND b.i BETWEEN a.i - 35 AND a.i GROUP BY 1, 2, 3, 4)
  SELECT asset, d, round(CASE WHEN known >= 9 THEN CASE WHEN r IS NULL THEN 0.0 ELSE below END / NULLIF(n, 0) END, 6)+0.0 AS rk FROM s""")
def _(t):
    return out(T.with_rank_pct(t.ret_m, ["asset"], "r", "rk", 36), "rk")


@query("winsorize", f"""WITH q AS (SELECT asset, d, r, CASE WHEN COUNT(r) OVER {F_(36)} >= 9 THEN quantile_cont(r, 0.05) OVER {F_(36)} END AS lo,
  CASE WHEN COUNT(r) OVER {F_(36)} >= 9 THEN quantile_cont(r, 0.95) OVER {F_(36)} END AS hi FROM ret_m)
  SELECT asset, d, round(CASE WHEN r IS NOT NULL THEN least(greatest(r, COALESCE(lo, r)), COALESCE(hi, r)) END, 6)+0.0 AS w FROM q""")
def _(t):
    return out(t.ret_m.withColumn("w", T.winsorize("r", wa(), 0.05, 0.95, 36)), "w")


view("std_long", "SELECT 'px_' || asset AS signal, d, px AS x FROM ret_m UNION ALL SELECT 'r_' || asset, d, r FROM ret_m")


def std_long(t):
    return t.ret_m.select("d", F.explode(F.array(
        F.struct(F.concat(F.lit("px_"), "asset").alias("signal"), F.col("px").alias("x")),
        F.struct(F.concat(F.lit("r_"), "asset").alias("signal"), F.col("r").alias("x")))).alias("e")).select("e.signal", "d", "e.x")


@query("standardize_panel", sq({"z": zs("x", 24, 12).replace("asset", "signal")}, "std_long", "signal, d"))
def _(t):
    return out(std_long(t).withColumn("z", T.zscore("x", win(["signal"]), 24)), "z", keys=("signal", "d"))


@query("ma_ratio", sq({"ratio": f"{gd('AVG', 'px', 3)}/{gd('AVG', 'px', 12)} - 1", "cross_": f"CASE WHEN {gd('AVG', 'px', 3)} >= {gd('AVG', 'px', 12)} THEN 1.0 WHEN {gd('AVG', 'px', 3)} < {gd('AVG', 'px', 12)} THEN 0.0 END"}))
def _(t):
    return out(t.ret_m.withColumn("ratio", T.ma_ratio("px", wa(), 3, 12)).withColumn("cross_", T.ma_cross("px", wa(), 3, 12)), "ratio", "cross_")


@query("mom_state", "SELECT asset, d, CASE WHEN LAG(px, 9) OVER w IS NOT NULL THEN CASE WHEN px >= LAG(px, 9) OVER w THEN 1.0 ELSE 0.0 END END AS s FROM ret_m WINDOW w AS (PARTITION BY asset ORDER BY d)")
def _(t):
    return t.ret_m.select("asset", "d", T.mom_state("px", wa(), 9).alias("s"))


view("obv_m", "SELECT asset, d, r, px, SUM(COALESCE(sign(r), 0)*vol) OVER (PARTITION BY asset ORDER BY d) AS obv FROM ret_m")


@query("on_balance_volume", f"SELECT asset, d, round(obv, 2)+0.0 AS obv, CASE WHEN {gd('AVG', 'obv', 2)} >= {gd('AVG', 'obv', 9)} THEN 1.0 WHEN {gd('AVG', 'obv', 9)} IS NOT NULL THEN 0.0 END AS state FROM obv_m")
def _(t):
    o = T.on_balance_volume(t.ret_m, ["asset"], "r", "vol")
    return o.select("asset", "d", r6("obv", 2).alias("obv"), T.ma_cross("obv", wa(), 2, 9).alias("state"))


def cr(x, s, g):
    return f"CASE WHEN {gd('AVG', x, s)} >= {gd('AVG', x, g)} THEN 1.0 WHEN {gd('AVG', x, g)} IS NOT NULL THEN 0.0 END"


@query("rule_vote", f"""WITH s AS (SELECT asset, d, {cr('px', 1, 9)} AS a, {cr('px', 2, 12)} AS b, CASE WHEN LAG(px, 9) OVER (PARTITION BY asset ORDER BY d) IS NOT NULL
  THEN CAST(px >= LAG(px, 9) OVER (PARTITION BY asset ORDER BY d) AS INT) END AS c FROM ret_m)
  SELECT asset, d, round(AVG(x), 6)+0.0 AS vote FROM (SELECT asset, d, a AS x FROM s UNION ALL SELECT asset, d, b FROM s UNION ALL SELECT asset, d, c FROM s) GROUP BY 1, 2""")
def _(t):
    states = F.array(T.ma_cross("px", wa(), 1, 9), T.ma_cross("px", wa(), 2, 12), T.mom_state("px", wa(), 9))
    long = t.ret_m.withColumn("s", states).select("asset", "d", F.explode("s").alias("x"))
    return out(T.rule_vote(long, ["asset", "d"]), "vote")


view("grow_m", "SELECT asset, d, r, px, vol, CASE WHEN r IS NOT NULL THEN product(1+r) OVER (PARTITION BY asset ORDER BY d) END AS g FROM ret_m")


@query("cum_growth", sq({"g": "g"}, "grow_m"))
def _(t):
    return out(T.with_growth(t.ret_m, ["asset"]), "g")


@query("reversal", sq({"rev1": "-(g/LAG(g, 1) OVER (PARTITION BY asset ORDER BY d) - 1)", "rev5": "-(g/LAG(g, 5) OVER (PARTITION BY asset ORDER BY d) - 1)"}, "grow_m"))
def _(t):
    g = T.with_growth(t.ret_m, ["asset"])
    return out(g.withColumn("rev1", T.reversal("g", wa(), 1)).withColumn("rev5", T.reversal("g", wa(), 5)), "rev1", "rev5")


@query("momentum_skip", sq({"m": "LAG(g, 1) OVER (PARTITION BY asset ORDER BY d)/LAG(g, 12) OVER (PARTITION BY asset ORDER BY d) - 1", "m2": f"{gd('product', '(1+r)', 11, lag=2)} - 1"}, "grow_m"))
def _(t):
    g = T.with_growth(t.ret_m, ["asset"])
    return out(g.withColumn("m", T.momentum_skip("g", wa(), 12, 1)).withColumn("m2", T.momentum("r", wa(), 11, lag=2)), "m", "m2")


_CAND = " UNION ALL ".join(
    f"SELECT asset, d, {2 * k} AS pos, 'mom{n}' AS candidate, round({gd('AVG', 'r', n, lag=2)}*{n}, 6)+0.0 AS x FROM ret_m UNION ALL "
    f"SELECT asset, d, {2 * k + 1}, 'momsharpe{n}', round({gd('AVG', 'r', n, lag=2)}/NULLIF({gd('stddev_samp', 'r', n, lag=2)}, 0), 6)+0.0 FROM ret_m"
    for k, n in enumerate((3, 6, 9, 12, 18, 24, 30, 36)))


@query("momentum_sharpe", _CAND)
def _(t):
    c = T.momentum_candidates(t.ret_m, ["asset"], windows=(3, 6, 9, 12, 18, 24, 30, 36), skip=2)
    return out(c, "x", keys=("asset", "d", "pos", "candidate"))


view("dd_m", "SELECT asset, d, r, g0/MAX(g0) OVER (PARTITION BY asset ORDER BY d) - 1 AS dd FROM (SELECT asset, d, r, product(1+COALESCE(r, 0)) OVER (PARTITION BY asset ORDER BY d) AS g0 FROM ret_m)")


@query("drawdown", sq({"dd": "dd"}, "dd_m"))
def _(t):
    return out(T.drawdown(t.ret_m, ["asset"]), "dd")


@query("sahm_rule", f"WITH u AS (SELECT asset, d, {gd('AVG', 'r', 3)} AS u3 FROM ret_m) SELECT asset, d, round(u3 - {gd('MIN', 'u3', 12)}, 6)+0.0 AS sahm FROM u")
def _(t):
    return out(T.sahm_rule(t.ret_m, ["asset"], "r"), "sahm")


@query("vol_gap", sq({"vrp": f"rb*100 - {gd('stddev_samp', 'r', 12, 8)}*sqrt(12)*100", "term_ratio": "rb/NULLIF(r, 0)"}, "ret_b"))
def _(t):
    b = t.bench_m.select("d", F.col("r").alias("rb"))
    j = t.ret_m.join(b, "d")
    return out(j.withColumn("vrp", F.col("rb") * 100 - T.realized_vol("r", wa(), 12, 12, 8) * 100)
               .withColumn("term_ratio", F.col("rb") / F.nullif("r", F.lit(0.0))), "vrp", "term_ratio")


@query("compound_gap", f"""WITH m AS (SELECT asset, d, {gd('product', '(1+r)', 12)} AS m FROM ret_m)
  SELECT a.d, round(a.m - b.m, 6)+0.0 AS gap FROM m a JOIN m b USING (d) WHERE a.asset = 'PROMO' AND b.asset = 'SMALL'""")
def _(t):
    return out(T.compound_gap(t.ret_m, "PROMO", "SMALL", 12), "gap", keys=("d",))


view("val_m", "SELECT asset, d, px AS p, vol/1000 AS dv, px*(1+COALESCE(r, 0))/10 AS e, px/vol*100 AS cape, vol/100 AS gs10 FROM ret_m")
_VAL = {"gw_dp": "ln(dv)-ln(p)", "gw_dy": "ln(dv)-ln(LAG(p) OVER (PARTITION BY asset ORDER BY d))", "gw_ep": "ln(e)-ln(p)", "gw_de": "ln(dv)-ln(e)",
        "gw_cape": "cape", "gw_cape_inv": "1/NULLIF(cape, 0)", "gw_ygap": "e/p - gs10/100"}


def _dev(k):
    return {f"{k}_dev": f"{k} - {gd('AVG', k, 24, 12)}", f"{k}_z": zs(k, 24, 12)}


@query("valuation_ratios", "WITH b AS (SELECT asset, d, " + ", ".join(f"{e} AS {n}" for n, e in _VAL.items()) + " FROM val_m) " +
       sq({**{n: n for n in _VAL}, **_dev("gw_dp"), **_dev("gw_ep"), **_dev("gw_cape")}, "b"))
def _(t):
    v = valuation_input(t)
    o = T.valuation_ratios(v, ["asset"], window=24, min_periods=12)
    return out(o, *[k for k in o.columns if k not in ("asset", "d")])


def valuation_input(t):
    return t.ret_m.select("asset", "d", F.col("px").alias("p"), (F.col("vol") / 1000).alias("dv"),
                          (F.col("px") * (1 + F.coalesce("r", F.lit(0.0))) / 10).alias("e"), (F.col("px") / F.col("vol") * 100).alias("cape"), (F.col("vol") / 100).alias("gs10"))


@query("realised_variance", "SELECT asset, last_day(d) AS d, round(SUM(r*r), 6)+0.0 AS svar, round(ln(NULLIF(SUM(r*r), 0)), 6)+0.0 AS svar_log FROM ret_d GROUP BY 1, 2")
def _(t):
    return out(T.realised_variance(t.ret_d, ["asset"]), "svar", "svar_log")


@query("return_spread", """SELECT d, round(LAG(s) OVER (ORDER BY d), 6)+0.0 AS spread FROM (SELECT d, MAX(CASE WHEN asset = 'LARGE' THEN r END) - MAX(CASE WHEN asset = 'MEDIUM' THEN r END) AS s FROM ret_m GROUP BY d)""")
def _(t):
    u = t.ret_m.withColumn("universe", F.lit("all"))
    return out(T.return_spread(u, "LARGE", "MEDIUM", by=["universe"]), "spread", keys=("d",))


@query("ratio_dev", """WITH s AS (SELECT 'all' AS asset, d, price/rf AS k FROM macro_m JOIN rf_m USING (d)) """ + sq({"ratio": "k/1e6", "dev": f"(k - {gd('AVG', 'k', 24, 12)})/1e6"}, "s", "d"))
def _(t):
    j = t.macro_m.join(t.rf_m, "d").select(F.lit("all").alias("asset"), "d", (F.col("price") / F.col("rf") / 1e6).alias("ratio"))
    return out(j.withColumn("dev", T.trend_deviation("ratio", wa(), 24, 12)), "ratio", "dev", keys=("d",))


@query("recursive_quadratic_gap", """WITH p AS (SELECT asset, d, ln(px) AS y, row_number() OVER (PARTITION BY asset ORDER BY d) - 1.0 AS t FROM ret_m),
  s AS (SELECT a.asset, a.d, a.y AS y1, a.t AS t1, COUNT(*) AS n, AVG(b.y) AS my, AVG(b.t) AS mt FROM p a JOIN p b ON a.asset = b.asset AND b.t <= a.t GROUP BY ALL),
  u AS (SELECT s.asset, s.d, s.y1, s.t1 - s.mt AS u1, s.n, s.my, SUM(POW(b.t - s.mt, 2)) AS s2, SUM(POW(b.t - s.mt, 4)) AS s4,
        SUM((b.t - s.mt)*(b.y - s.my)) AS suy, SUM(POW(b.t - s.mt, 2)*(b.y - s.my)) AS su2y FROM s JOIN p b ON s.asset = b.asset AND b.t <= s.t1 GROUP BY ALL),
  k AS (SELECT *, su2y/NULLIF(s4 - s2*s2/n, 0) AS c2, suy/NULLIF(s2, 0) AS c1 FROM u)
  SELECT asset, d, round(CASE WHEN n >= 24 THEN y1 - my - c1*u1 - c2*(u1*u1 - s2/n) END, 6)+0.0 AS gap FROM k""")
def _(t):
    g = T.quadratic_gap(t.ret_m.withColumn("y", F.ln("px")), ["asset"], "y", min_obs=24)
    return out(g, "gap")


view("label_m", """SELECT asset, d, r, CASE WHEN r > 0 AND px > 3000 THEN 'Reflation' WHEN r > 0 THEN 'Goldilocks' WHEN r IS NULL THEN NULL WHEN vol > 3500 THEN 'Stagflation' ELSE 'Deflation' END AS regime FROM ret_m""")


def label_m(t):
    return t.ret_m.select("asset", "d", "r", F.when((F.col("r") > 0) & (F.col("px") > 3000), "Reflation").when(F.col("r") > 0, "Goldilocks").when(
        F.col("r").isNull(), None).when(F.col("vol") > 3500, "Stagflation").otherwise("Deflation").alias("regime"))


@query("regime_dummies", " UNION ALL ".join(f"SELECT asset, d, 'regime_{s.lower()}' AS signal, CASE WHEN regime = '{s}' THEN 1.0 ELSE 0.0 END AS x FROM label_m" for s in T.REGIMES))
def _(t):
    return T.regime_dummies(label_m(t), ["asset", "d"])


@query("lag_panel", """SELECT signal, d, round(CASE WHEN signal LIKE '%\\_PROMO' ESCAPE '\\' OR signal LIKE '%\\_SMALL' ESCAPE '\\' THEN LAG(x, 2) OVER w ELSE LAG(x, 1) OVER w END, 6)+0.0 AS x
  FROM std_long WHERE signal LIKE 'r%' WINDOW w AS (PARTITION BY signal ORDER BY d)""")
def _(t):
    s = std_long(t).filter(F.col("signal").startswith("r"))
    return out(T.lag_panel(s, ["signal"], stale=("PROMO", "SMALL")), "x", keys=("signal", "d"))


@query("prune_signals", """SELECT signal, d, round(LAG(x) OVER (PARTITION BY signal ORDER BY d), 6)+0.0 AS x FROM std_long
  WHERE signal IN (SELECT signal FROM std_long GROUP BY 1 HAVING COUNT(x) > 82 AND stddev_samp(x) > 1e-12) """)
def _(t):
    kept = T.prune_signals(std_long(t), min_count=82)
    return out(T.lag_panel(kept, ["signal"]), "x", keys=("signal", "d"))


@query("signal_catalog", """WITH s AS (SELECT replace(replace(signal, 'px_', 'mom12_'), 'r_', 'vix_') AS signal, d, x FROM std_long), p AS (SELECT *, LAG(x) OVER (PARTITION BY signal ORDER BY d) AS px FROM s)
  SELECT signal, COUNT(x) AS n_obs, round(COUNT(x)/COUNT(*), 6)+0.0 AS coverage, MIN(d) FILTER (WHERE x IS NOT NULL) AS first, MAX(d) FILTER (WHERE x IS NOT NULL) AS last,
  round(AVG(x), 6)+0.0 AS mean, round(stddev_samp(x), 6)+0.0 AS std, round(corr(x, px), 6)+0.0 AS autocorr_1, CASE WHEN signal LIKE 'mom%' THEN 'momentum' ELSE 'volatility' END AS family FROM p GROUP BY 1""")
def _(t):
    s = std_long(t).withColumn("signal", F.regexp_replace(F.regexp_replace("signal", "px_", "mom12_"), "r_", "vix_"))
    g = T.signal_catalog(s)
    return g.select("signal", "family", "n_obs", "first", "last", *[r6(k).alias(k) for k in ("coverage", "mean", "std", "autocorr_1")])


@query("family_of", """SELECT DISTINCT n.name, CASE WHEN p.k % 4 = 0 THEN 'momentum' WHEN p.k % 4 = 1 THEN 'curve shape' WHEN p.k % 4 = 2 THEN 'regime interaction' ELSE 'macro and other' END AS family
  FROM (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'd_mom5_' WHEN 1 THEN 'curve_slope_' WHEN 2 THEN 'unrate x ' ELSE 'unrate_' END || o_orderpriority AS name FROM orders) p JOIN (SELECT DISTINCT
  CASE o_orderkey % 4 WHEN 0 THEN 'd_mom5_' WHEN 1 THEN 'curve_slope_' WHEN 2 THEN 'unrate x ' ELSE 'unrate_' END || o_orderpriority AS name FROM orders) n ON n.name = p.name""")
def _(t):
    m = F.col("o_orderkey") % 4
    pre = F.when(m == 0, "d_mom5_").when(m == 1, "curve_slope_").when(m == 2, "unrate x ").otherwise("unrate_")
    names = t.orders.select(F.concat(pre, "o_orderpriority").alias("name")).distinct()
    return names.select("name", T.family_of("name").alias("family"))
