"""Queries: regimes, regime portfolios, tails, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6, win
from ..operators import components as CO
from ..operators import crosssection as X
from ..operators import regimes as R
from ..operators import tails as K
from ..operators import timeseries as T
from ..session import stored
from .curve import curve
from .registry import query, view, views
from .risk import U, due, ex_m, lw_views
from .series import out, sq
from .sqlmath import erc_views, newton, phi, solve_views, top_views

REG = R.REGIMES


def qd(g, i):
    return f"CASE WHEN ({g}) AND NOT ({i}) THEN 'Goldilocks' WHEN ({g}) AND ({i}) THEN 'Reflation' WHEN NOT ({g}) AND ({i}) THEN 'Stagflation' WHEN NOT ({g}) AND NOT ({i}) THEN 'Deflation' END"


def tm(x, n, m):
    f = f"OVER (ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN COUNT({x}) {f} >= {m} THEN AVG({x}) {f} END"


view("reg0", "SELECT d, growth/LAG(growth, 12) OVER (ORDER BY d) - 1 AS g, price/LAG(price, 12) OVER (ORDER BY d) - 1 AS i FROM macro_m")
view("rel_dev", f"SELECT d, g, i, g - {tm('g', 24, 12)} AS gd, i - {tm('i', 24, 12)} AS idv, g - {tm('g', 24, 8)} AS gd3, i - {tm('i', 24, 8)} AS id3 FROM reg0")
view("rel_m", f"SELECT d, gd, idv, CASE WHEN gd IS NOT NULL AND idv IS NOT NULL THEN {qd('gd > 0', 'idv > 0')} END AS regime FROM rel_dev")
# a faster label for portfolios: year-on-year change against its trailing year
view("lab_r", f"SELECT d, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {qd('a > 0', 'b > 0')} END AS label FROM (SELECT d, g - {tm('g', 6, 3)} AS a, i - {tm('i', 6, 3)} AS b FROM reg0)")


def reg0(t):
    w = win(["universe"])
    m = t.macro_m.withColumn("universe", F.lit("all"))
    return m.select("universe", "d", (F.col("growth") / F.lag("growth", 12).over(w) - 1).alias("growth"), (F.col("price") / F.lag("price", 12).over(w) - 1).alias("inflation"))


def rel(t):
    return R.classify_relative(reg0(t), U, 24)


def lab(t):
    return R.classify_relative(reg0(t), U, 6, 3).select("universe", "d", F.col("regime").alias("label"))


@query("classify_relative", f"SELECT d, round(gd, 6)+0.0 AS growth_dev, round(idv, 6)+0.0 AS inflation_dev, COALESCE(gd > 0, false) AS growth_up, COALESCE(idv > 0, false) AS inflation_up, regime, CASE WHEN gd3 IS NOT NULL AND id3 IS NOT NULL THEN {qd('gd3 > 0', 'id3 > 0')} END AS third FROM rel_m JOIN (SELECT d, gd3, id3 FROM rel_dev) USING (d)")
def _(t):
    third = R.classify_relative(reg0(t), U, 24, 8).select("d", F.col("regime").alias("third"))
    return out(rel(t).join(third, "d"), "growth_dev", "inflation_dev", keys=("d", "growth_up", "inflation_up", "regime", "third"))


@query("classify_absolute", f"SELECT d, {qd('g > 0.0', 'i > 0.01')} AS regime FROM reg0")
def _(t):
    return reg0(t).select("d", R.classify_absolute(F.col("growth"), F.col("inflation"), 0.0, 0.01).alias("regime"))


@query("classify_hybrid", f"SELECT d, CASE WHEN gd3 IS NOT NULL AND id3 IS NOT NULL THEN {qd('gd3 > 0 OR g > 0.05', 'id3 > 0 AND i > 0.01')} END AS regime FROM rel_dev")
def _(t):
    return R.classify_hybrid(reg0(t), U, 24, 0.05, 0.01).select("d", "regime")


def rkp(x):
    return f"""(SELECT a.d, CASE WHEN COUNT(b.{x}) >= 6 THEN CASE WHEN ANY_VALUE(a.{x}) IS NULL THEN 0.0 ELSE COUNT(*) FILTER (WHERE b.rn < a.rn AND b.{x} < a.{x}) END/NULLIF(COUNT(*) FILTER (WHERE b.rn < a.rn), 0) END AS {x}r
      FROM reg_n a JOIN reg_n b ON b.rn BETWEEN a.rn - 23 AND a.rn GROUP BY 1)"""


view("reg_n", "SELECT *, row_number() OVER (ORDER BY d) AS rn FROM reg0")


@query("classify_percentile", f"SELECT d, {qd('gr > 0.5', 'ir > 0.5')} AS regime FROM {rkp('g')} JOIN {rkp('i')} USING (d)")
def _(t):
    return R.classify_percentile(reg0(t), U, 24).select("d", "regime")


@query("classify_factors", f"SELECT d, {qd('gd > 0.02', 'idv > -0.01')} AS regime FROM rel_dev")
def _(t):
    return rel(t).select("d", R.quadrant(F.col("growth_dev") > 0.02, F.col("inflation_dev") > -0.01).alias("regime"))


@query("macro_signals", "SELECT d, round(LAG(i) OVER (ORDER BY d), 6)+0.0 AS inflation, round(LAG(g) OVER (ORDER BY d), 6)+0.0 AS growth FROM reg0")
def _(t):
    return out(R.macro_signals(t.macro_m.withColumn("universe", F.lit("all")), U, "price", "growth"), "inflation", "growth", keys=("d",))


view("ep_rows", "SELECT *, SUM(CASE WHEN label = p THEN 0 ELSE 1 END) OVER (ORDER BY d) AS ep FROM (SELECT d, label, LAG(label) OVER (ORDER BY d) AS p FROM lab_r WHERE label IS NOT NULL)")
view("eps", "SELECT label AS regime, ep, MIN(d) AS s, MAX(d) AS e, COUNT(*) AS months FROM ep_rows GROUP BY 1, 2")


def labelled(t):
    return lab(t).withColumnRenamed("label", "regime")


@query("episodes", 'SELECT regime, s AS start, e AS "end", months FROM eps')
def _(t):
    return R.episodes(labelled(t), U).select("regime", "start", "end", "months")


@query("completed_months", """SELECT r.d, r.label AS regime, COUNT(e.ep) AS n_completed, CAST(COALESCE(SUM(e.months), 0) AS BIGINT) AS completed_months FROM ep_rows r LEFT JOIN eps e ON e.regime = r.label AND e.e < r.d GROUP BY 1, 2""")
def _(t):
    c = R.with_completed(labelled(t), U)
    return c.select("d", "regime", F.col("n_completed").cast("long").alias("n_completed"), F.col("completed_months").cast("long").alias("completed_months"))


@query("run_length", "SELECT d, label AS regime, row_number() OVER (PARTITION BY ep ORDER BY d) AS run_length FROM ep_rows")
def _(t):
    return R.with_episode(labelled(t), U).select("d", "regime", F.col("run_length").cast("long").alias("run_length"))


@query("learning_curve", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY e) AS k FROM eps) SELECT regime, COUNT(*) AS episodes_total, MAX(CASE WHEN k = 1 THEN e END) AS first_completed, MAX(CASE WHEN k = 2 THEN e END) AS second_completed,
  round(quantile_cont(months, 0.5), 6)+0.0 AS median_months FROM k GROUP BY 1""")
def _(t):
    return out(R.learning_curve(labelled(t), U), "median_months", keys=("regime", "episodes_total", "first_completed", "second_completed"))


_TR = ", ".join(f"round(COUNT(*) FILTER (WHERE nx = '{s}')/COUNT(nx), 6)+0.0 AS {s}" for s in REG)


@query("transition_matrix", f"SELECT label AS from_regime, {_TR} FROM (SELECT d, label, LEAD(label) OVER (ORDER BY d) AS nx FROM lab_r WHERE label IS NOT NULL) WHERE nx IS NOT NULL GROUP BY 1")
def _(t):
    return out(R.transition_matrix(labelled(t), U), *REG, keys=("from_regime",))


@query("persistence", "SELECT regime, round(AVG(months), 6)+0.0 AS mean_months, COUNT(*) AS n_spells, MAX(months) AS longest FROM eps GROUP BY 1")
def _(t):
    return out(R.persistence(labelled(t), U), "mean_months", keys=("regime", "n_spells", "longest"))


@query("regime_stats", """SELECT label AS regime, strategy AS asset, COUNT(*) AS months, round(POW(product(1 + r), 12.0/COUNT(*)) - 1, 6)+0.0 AS ann_return, round(stddev_samp(r)*sqrt(12), 6)+0.0 AS ann_vol,
  round(AVG(r - rf)*12/(stddev_samp(r)*sqrt(12)), 6)+0.0 AS sharpe, round(AVG(CAST(r > 0 AS DOUBLE)), 6)+0.0 AS hit_rate FROM strat_m JOIN lab_r USING (d) WHERE label IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 12""")
def _(t):
    s = R.regime_stats(t.strat_m.withColumnRenamed("strategy", "asset"), labelled(t).select("d", "regime"))
    return out(s, "ann_return", "ann_vol", "sharpe", "hit_rate", keys=("regime", "asset", "months"))


view("per_rows", "SELECT d, label, SUM(CASE WHEN label = p THEN 0 ELSE 1 END) OVER (ORDER BY d) AS run FROM (SELECT d, label, LAG(label) OVER (ORDER BY d) AS p FROM lab_r)")
view("per_ok", "SELECT run, ANY_VALUE(label) AS label, COUNT(*) AS n FROM per_rows WHERE label IS NOT NULL GROUP BY 1")


@query("enforce_persistence", """SELECT r.d, r.label AS regime, CASE WHEN r.label IS NOT NULL THEN (SELECT arg_max(k.label, k.run) FROM per_ok k WHERE k.run <= r.run AND (k.n >= 3 OR k.run = (SELECT MIN(run) FROM per_ok))) END AS steady FROM per_rows r""")
def _(t):
    return R.enforce_persistence(labelled(t), U).select("d", "regime", "steady")


@query("separation", """WITH j AS (SELECT e.asset, e.d, e.x, l.label FROM ex_c e LEFT JOIN lab_r l USING (d)), g AS (SELECT asset, label, COUNT(*) AS n, AVG(x) AS m FROM j WHERE label IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 12),
  k AS (SELECT j.asset, COUNT(DISTINCT g.label) AS k, COUNT(*) AS n, AVG(x) AS gm, (MAX(m) - MIN(m))*12 AS spread, SUM(POW(x - m, 2)) AS ssw FROM j JOIN g ON g.asset = j.asset AND g.label = j.label GROUP BY 1 HAVING COUNT(DISTINCT g.label) >= 2),
  b AS (SELECT k.asset, SUM(g.n*POW(g.m - k.gm, 2)) AS ssb FROM k JOIN g ON g.asset = k.asset GROUP BY 1), h AS (SELECT AVG(spread) AS ms, AVG((ssb/(k - 1))/(ssw/(n - k))) AS mf FROM k JOIN b USING (asset)),
  lab_days AS (SELECT d, label, LAG(label) OVER (ORDER BY d) AS p FROM (SELECT DISTINCT d, label FROM j)), runs AS (SELECT run, COUNT(*) AS l FROM (SELECT label, SUM(CASE WHEN label = p THEN 0 ELSE 1 END) OVER (ORDER BY d) AS run FROM lab_days) WHERE label IS NOT NULL GROUP BY 1),
  c AS (SELECT label, COUNT(*) AS c FROM lab_days WHERE label IS NOT NULL GROUP BY 1)
  SELECT round(ms, 6)+0.0 AS mean_spread, round(mf, 6)+0.0 AS mean_f_stat, (SELECT CAST(SUM(c) AS BIGINT) FROM c) AS n_labelled, (SELECT COUNT(*) FROM c WHERE c > 11) AS n_states_used, (SELECT round(MIN(c)/MAX(c), 6)+0.0 FROM c) AS balance,
  (SELECT round(quantile_cont(l, 0.5), 6)+0.0 FROM runs) AS median_episode, (SELECT round(AVG(CAST(l <= 2 AS DOUBLE)), 6)+0.0 FROM runs) AS pct_episodes_le2 FROM h""")
def _(t):
    s = R.separation(ex_m(t), labelled(t), U)
    return out(s, "mean_spread", "mean_f_stat", "balance", "median_episode", "pct_episodes_le2", keys=("n_labelled", "n_states_used"))


@query("state_vs_label", "SELECT asset, round(AVG(p) FILTER (WHERE y = 1), 6)+0.0 AS mean_inside, round(AVG(p) FILTER (WHERE y = 0), 6)+0.0 AS mean_outside, round(CASE WHEN stddev_pop(y) > 0 THEN corr(p, y) END, 6)+0.0 AS correlation, COUNT(*) FILTER (WHERE y = 1) AS months_inside FROM auc_m GROUP BY 1")
def _(t):
    from .evidence import auc_input

    return out(R.state_vs_label(auc_input(t).withColumnRenamed("y", "label"), ["asset"]), "mean_inside", "mean_outside", "correlation", keys=("asset", "months_inside"))


@query("regime_asof_daily", "WITH l AS (SELECT d + 45 AS d, label FROM lab_r WHERE label IS NOT NULL), k AS (SELECT DISTINCT d FROM px_d) SELECT k.d, l.label AS regime FROM k ASOF LEFT JOIN l ON k.d >= l.d")
def _(t):
    days = t.px_d.select(F.lit("all").alias("universe"), "d").distinct()
    return R.regime_asof_daily(days, labelled(t), U).select("d", "regime")


# ---- regime portfolios ----


view("rw_x", "SELECT label, asset, d, x FROM ex_c JOIN lab_r USING (d) WHERE label IS NOT NULL")
view("rw_src", "SELECT label AS rk, asset, d, x FROM rw_x UNION ALL SELECT 'ALL', asset, d, x FROM rw_x")
lw_views("lw_rw", "rw_src", "rk")
views(erc_views("erc_rw", "SELECT rk AS k, i, j, s FROM lw_rw WHERE n >= 14"))
view("rw", f"""SELECT g.regime, a.asset, COALESCE(o.w, al.w, 1.0/COUNT(*) OVER (PARTITION BY g.regime)) AS w, COALESCE(c.n, 0) AS n, o.w IS NOT NULL AS own FROM (SELECT unnest({list(REG)}) AS regime) g CROSS JOIN (SELECT DISTINCT asset FROM rw_x) a
  LEFT JOIN erc_rw o ON o.k = g.regime AND o.asset = a.asset LEFT JOIN erc_rw al ON al.k = 'ALL' AND al.asset = a.asset LEFT JOIN (SELECT label, COUNT(DISTINCT d) AS n FROM rw_x GROUP BY 1) c ON c.label = g.regime""")


@query("regime_weights", "SELECT regime, asset, round(w, 6)+0.0 AS w, n, own FROM rw")
def _(t):
    return out(R.regime_weights(ex_m(t), stored(lab(t)), U, min_months=14), "w", keys=("regime", "asset", "n", "own"))


@query("regime_weight_table", "SELECT regime, n AS n_months, " + ", ".join(f"round(MAX(CASE WHEN asset = '{a}' AND own THEN w END), 6)+0.0 AS {a}" for a in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM rw GROUP BY 1, 2")
def _(t):
    from .alignment import ASSETS

    w = R.regime_weights(ex_m(t), stored(lab(t)), U, min_months=14)
    return out(R.regime_weight_table(w, U, ASSETS), *ASSETS, keys=("regime", "n_months"))


view("hs_ep", "SELECT d AS ed, rn AS ern, state FROM (SELECT d, rn, last_value(label IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM (SELECT DISTINCT d, rn FROM ex_rn) LEFT JOIN lab_r USING (d)) WHERE rn >= 36 AND (rn = 36 OR rn % 6 = 0)")
view("hs_h", "SELECT e.ed, x.asset, x.d, x.x, l.label = e.state AS same FROM hs_ep e JOIN ex_rn x ON x.rn < e.ern LEFT JOIN lab_r l ON l.d = x.d")
view("hs_c", "SELECT ed, COUNT(DISTINCT d) FILTER (WHERE same) AS n_same FROM hs_h GROUP BY 1")
view("hs_src", "SELECT h.ed, h.asset, h.d, h.x FROM hs_h h JOIN hs_c c ON c.ed = h.ed WHERE n_same < 8 OR same")
lw_views("lw_hs", "hs_src", "ed")
views(erc_views("erc_hs", "SELECT ed AS k, i, j, s FROM lw_hs"))


@query("regime_hard_switch", "SELECT k AS d, CASE WHEN n_same >= 8 THEN 'regime' ELSE 'all' END AS scope, asset, round(w, 6)+0.0 AS w FROM erc_hs JOIN hs_c ON ed = k")
def _(t):
    return out(R.hard_switch(ex_m(t), stored(lab(t)), U, due(36, 6), min_months=8), "w", keys=("d", "scope", "asset"))


@query("transition_row", f"""WITH k AS (SELECT d, label, LAG(label) OVER (ORDER BY d) AS p, row_number() OVER (ORDER BY d) AS rn FROM lab_r WHERE label IS NOT NULL), s AS (SELECT unnest({list(REG)}) AS regime),
  e AS (SELECT d, p AS state, rn FROM k WHERE p IS NOT NULL), c AS (SELECT e.d, e.state, e.rn, s.regime, COUNT(k.d) + 0.5 AS n FROM e CROSS JOIN s LEFT JOIN k ON k.d < e.d AND k.p = e.state AND k.label = s.regime GROUP BY ALL)
  SELECT d, state, regime, round(CASE WHEN rn - 1 < 2 THEN CASE WHEN state = regime THEN 1 ELSE 0 END ELSE 0.7*n/SUM(n) OVER (PARTITION BY d) + 0.3*CASE WHEN state = regime THEN 1 ELSE 0 END END, 6)+0.0 AS p FROM c""")
def _(t):
    return out(R.transition_rows(lab(t), U, smoothing=0.7), "p", keys=("d", "state", "regime"))


@query("regime_blend")
def _(t):
    return out(R.regime_blend(ex_m(t), stored(lab(t)), U, due(36, 6), min_months=8), "w", keys=("d", "asset"))


def equal_bench(x):
    """Equal weights over the assets of each universe."""
    return x.select("universe", "asset").distinct().withColumn("w", 1.0 / F.count(F.lit(1)).over(X.over(["universe"])))


view("ew_i", """SELECT r.d AS ld, r.label, r.ep, row_number() OVER (PARTITION BY r.ep ORDER BY r.d) AS run, (SELECT COUNT(*) FROM eps e WHERE e.regime = r.label AND e.e < r.d) AS nc, (SELECT COALESCE(SUM(e.months), 0) FROM eps e WHERE e.regime = r.label AND e.e < r.d) AS cm FROM ep_rows r""")
view("ew_e", """SELECT c.d AS ed, i.label, i.ep, CASE WHEN i.label IS NULL OR nc < 1 THEN 'benchmark' WHEN cm < 6 THEN 'benchmark_thin' ELSE 'regime' END AS action, CASE WHEN nc >= 1 AND cm >= 6 THEN 1 - POW(0.5, run) ELSE 0 END AS alpha
  FROM (SELECT DISTINCT d, rn FROM ex_rn WHERE rn >= 24 AND (rn = 24 OR rn % 6 = 0)) c ASOF LEFT JOIN (SELECT * FROM ew_i WHERE ld IN (SELECT d FROM ex_rn)) i ON c.d > i.ld""")
view("ew_src", "SELECT e.ed, x.asset, x.d, x.x FROM ew_e e JOIN ep_rows l ON l.label = e.label AND l.ep < e.ep JOIN ex_c x ON x.d = l.d WHERE e.action = 'regime'")
lw_views("lw_ew", "ew_src", "ed")
views(erc_views("erc_ew", "SELECT ed AS k, i, j, s FROM lw_ew"))


@query("episodic_weights", """SELECT e.ed AS d, a.asset, round(CASE WHEN action = 'regime' THEN alpha*w.w + (1 - alpha)/a.n ELSE 1.0/a.n END, 6)+0.0 AS w, round(alpha, 6)+0.0 AS alpha, action, label AS state
  FROM ew_e e CROSS JOIN (SELECT asset, COUNT(*) OVER () AS n FROM (SELECT DISTINCT asset FROM ex_c)) a LEFT JOIN erc_ew w ON w.k = e.ed AND w.asset = a.asset""")
def _(t):
    x = ex_m(t)
    return out(R.episodic_weights(x, stored(lab(t)), equal_bench(x), U, due(24, 6), min_months=6), "w", "alpha", keys=("d", "asset", "action", "state"))


view("rmt0", "SELECT e.asset, e.d, e.x, l.label, l.ep, row_number() OVER (PARTITION BY e.asset, l.ep ORDER BY e.d) AS run FROM ex_c e LEFT JOIN ep_rows l USING (d)")
view("rmt1", """SELECT a.asset, a.d, a.label, a.run, AVG(b.x)*12 AS mu, COUNT(b.x) FILTER (WHERE b.label = a.label AND b.ep < a.ep) AS n, AVG(b.x) FILTER (WHERE b.label = a.label AND b.ep < a.ep)*12 AS mr,
  COUNT(DISTINCT b.ep) FILTER (WHERE b.label = a.label AND b.ep < a.ep) AS ncomp FROM rmt0 a JOIN rmt0 b ON a.asset = b.asset AND b.d <= a.d WHERE a.label IS NOT NULL GROUP BY 1, 2, 3, 4""")
view("rmt2", "SELECT *, CASE WHEN n < 6 THEN 0 ELSE n/(n + 60.0)*(mr - mu) END AS e, CASE WHEN ncomp < 1 THEN 0 ELSE 1 - POW(0.5, run) END AS alpha FROM rmt1")
view("rmt3", "SELECT *, stddev_pop(e) OVER (PARTITION BY d) AS sd, AVG(e) OVER (PARTITION BY d) AS me FROM rmt2")
view("rmt4", "SELECT rmt3.*, eq, CASE WHEN sd < 1e-12 OR ncomp < 1 THEN eq ELSE greatest(eq + alpha*least(greatest((e - me)/sd*0.15, -0.15), 0.15), 0) END AS w0 FROM rmt3, (SELECT 1.0/COUNT(DISTINCT asset) AS eq FROM ex_c)")
view("rmt5", "SELECT *, SUM(abs(w0 - eq)) OVER (PARTITION BY d) AS ex FROM rmt4")
view("rmt6", "SELECT *, CASE WHEN ex > 0.4 THEN greatest(eq + (w0 - eq)*0.4/ex, 0) ELSE w0 END AS w1 FROM rmt5")


@query("regime_mean_tilt", "SELECT d, asset, n AS n_obs, round(alpha, 6)+0.0 AS alpha, round(CASE WHEN SUM(w1) OVER (PARTITION BY d) > 1 THEN w1/SUM(w1) OVER (PARTITION BY d) ELSE w1 END, 6)+0.0 AS w FROM rmt6")
def _(t):
    x = ex_m(t)
    return out(R.regime_mean_tilt(x, stored(lab(t)), equal_bench(x), U), "w", "alpha", keys=("d", "asset", "n_obs"))


@query("regime_edge_table", """WITH u AS (SELECT asset, AVG(x)*12 AS mu FROM ex_c GROUP BY 1), g AS (SELECT label, asset, COUNT(*) AS n, AVG(x)*12 AS raw FROM ex_c JOIN lab_r USING (d) WHERE label IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 6)
  SELECT label AS regime, asset, n, round(raw, 6)+0.0 AS raw, round(mu, 6)+0.0 AS unconditional, round(n/(n + 60.0)*raw + (1 - n/(n + 60.0))*mu, 6)+0.0 AS shrunk FROM g JOIN u USING (asset)""")
def _(t):
    return out(R.regime_edge_table(ex_m(t), lab(t), U), "raw", "unconditional", "shrunk", keys=("regime", "asset", "n"))


AD_WINDOWS = (3, 6, 9, 12, 18, 24, 30, 36)
view("ad_c", " UNION ALL ".join(
    f"SELECT asset, d, {2 * k} AS pos, 'mom{n}' AS candidate, CASE WHEN COUNT(r) OVER w >= {n} THEN AVG(r) OVER w*{n} END AS x FROM ret_m WINDOW w AS (PARTITION BY asset ORDER BY d ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) UNION ALL "
    f"SELECT asset, d, {2 * k + 1}, 'momsharpe{n}', CASE WHEN COUNT(r) OVER w >= {n} THEN AVG(r) OVER w/NULLIF(stddev_samp(r) OVER w, 0) END FROM ret_m WINDOW w AS (PARTITION BY asset ORDER BY d ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    for k, n in enumerate(AD_WINDOWS)))
view("ad_f", "SELECT asset, d, row_number() OVER (PARTITION BY asset ORDER BY d) - 1 AS rn, LEAD(r) OVER (PARTITION BY asset ORDER BY d) AS fwd FROM ret_m")
view("ad_w", """SELECT c.asset, c.pos, c.candidate, g.g, c.x, f.fwd FROM ad_c c JOIN ad_f f USING (asset, d) JOIN (SELECT unnest(range(24, 83, 6)) AS g) g ON f.rn >= greatest(g.g - 36, 0) AND f.rn < g.g - 1 WHERE c.x IS NOT NULL AND f.fwd IS NOT NULL""")
view("ad_r", """SELECT asset, pos, candidate, g, rank() OVER (PARTITION BY asset, pos, g ORDER BY x) + (COUNT(*) OVER (PARTITION BY asset, pos, g, x) - 1)/2.0 AS rx, rank() OVER (PARTITION BY asset, pos, g ORDER BY fwd) + (COUNT(*) OVER (PARTITION BY asset, pos, g, fwd) - 1)/2.0 AS ry FROM ad_w""")
view("ad_b", "SELECT asset, g, arg_min(candidate, (-ic, pos)) AS candidate FROM (SELECT asset, pos, candidate, g, CASE WHEN COUNT(*) >= 12 THEN round(corr(rx, ry), 12) ELSE NULL END AS ic FROM ad_r GROUP BY 1, 2, 3, 4) WHERE ic IS NOT NULL GROUP BY 1, 2")


@query("adaptive_window_signal", """WITH z AS (SELECT asset, d, candidate, COALESCE((x - AVG(x) OVER (PARTITION BY d, candidate))/NULLIF(stddev_samp(x) OVER (PARTITION BY d, candidate), 0), 0) AS z FROM ad_c)
  SELECT f.asset, f.d, b.candidate, round(z.z, 6)+0.0 AS z FROM ad_f f ASOF JOIN ad_b b ON b.asset = f.asset AND f.rn >= b.g JOIN z ON z.asset = f.asset AND z.d = f.d AND z.candidate = b.candidate""")
def _(t):
    r = stored(t.ret_m.select(F.lit("all").alias("universe"), "asset", "d", "r"))
    cand = T.momentum_candidates(r, ["universe", "asset"], windows=AD_WINDOWS, skip=1)
    ch = CO.adaptive_choice(cand, r, U, burn_in=24, step=6, window=36, horizon=1, min_pairs=12)
    z = cand.withColumn("z", X.xs_z("x", ["universe", "d", "candidate"], fill=True))
    return out(ch.join(z, ["universe", "asset", "d", "candidate"]), "z", keys=("asset", "d", "candidate"))


# ---- tails ----

view("uni_m", "SELECT asset, d, x, (rank() OVER (PARTITION BY asset ORDER BY x) + (COUNT(*) OVER (PARTITION BY asset, x) - 1)/2.0)/(COUNT(*) OVER (PARTITION BY asset) + 1.0) AS u FROM ex_c")
view("cut_m", "SELECT e.*, x < quantile_cont(x, 0.25) OVER (PARTITION BY asset) AS lo, x > quantile_cont(x, 0.75) OVER (PARTITION BY asset) AS hi FROM ex_c e")


@query("to_uniform", sq({"u": "u"}, "uni_m"))
def _(t):
    return out(K.to_uniform(ex_m(t), U), "u")


@query("empirical_tail_dependence", """WITH p AS (SELECT a.asset AS i, b.asset AS j, CASE WHEN a.asset = b.asset THEN 1 ELSE AVG(CAST(a.u < 0.2 AND b.u < 0.2 AS DOUBLE))/0.2 END AS lam FROM uni_m a JOIN uni_m b USING (d) GROUP BY 1, 2)
  SELECT i, j, round(lam, 6)+0.0 AS lam, round(lam - 0.2, 6)+0.0 AS excess FROM p""")
def _(t):
    u = stored(K.to_uniform(ex_m(t), U))
    a, b = K.empirical_tail_dependence(u, U, 0.2), K.empirical_tail_dependence(u, U, 0.2, excess=True)
    return out(a.join(b.withColumnRenamed("lam", "excess"), ["universe", "i", "j"]), "lam", "excess", keys=("i", "j"))


@query("exceedance_counts", "SELECT a.asset AS i, b.asset AS j, COUNT(*) FILTER (WHERE a.lo AND b.lo) AS n FROM cut_m a JOIN cut_m b USING (d) GROUP BY 1, 2")
def _(t):
    return K.exceedance_counts(ex_m(t), U, 0.25).select("i", "j", "n")


def _exc(side):
    return f"SELECT '{side}' AS side, a.asset AS i, b.asset AS j, CASE WHEN a.asset = b.asset THEN 1 WHEN COUNT(*) FILTER (WHERE a.{side} AND b.{side}) >= 5 THEN corr(CASE WHEN a.{side} AND b.{side} THEN a.x END, CASE WHEN a.{side} AND b.{side} THEN b.x END) END AS rho FROM cut_m a JOIN cut_m b USING (d) GROUP BY 2, 3"


@query("exceedance_correlation", f"SELECT side, i, j, round(rho, 6)+0.0 AS rho FROM ({_exc('lo')} UNION ALL {_exc('hi')})")
def _(t):
    x = ex_m(t)
    lo = K.exceedance_correlation(x, U, 0.25, "lower", 5).withColumn("side", F.lit("lo"))
    hi = K.exceedance_correlation(x, U, 0.25, "upper", 5).withColumn("side", F.lit("hi"))
    return out(lo.unionByName(hi), "rho", keys=("side", "i", "j"))


view("ns_u", f"SELECT asset, d, {newton(phi, 'exp(-0.5*z*z)/sqrt(2*pi())', 'u', 0.0)} AS z FROM uni_m")


@query("normal_score_corr", "SELECT a.asset AS i, b.asset AS j, round(CASE WHEN a.asset = b.asset THEN 1 ELSE corr(a.z, b.z) END, 6)+0.0 AS rho FROM ns_u a JOIN ns_u b ON a.d = b.d AND a.asset <= b.asset GROUP BY 1, 2")
def _(t):
    return out(K.normal_score_corr(K.to_uniform(ex_m(t), U), U), "rho", keys=("i", "j"))


# ---- components ----

view("blk", "SELECT o_orderpriority AS series, last_day(CAST(o_orderdate AS DATE)) AS d, AVG(o_totalprice)/1e5 AS x FROM orders GROUP BY 1, 2")


def blk(t):
    s = t.orders.groupBy(F.lit("all").alias("universe"), F.col("o_orderpriority").alias("series"), F.last_day(F.col("o_orderdate").cast("date")).alias("d")).agg((F.avg("o_totalprice") / 1e5).alias("x"))
    specs = t.dim([("1-URGENT", "yoy"), ("2-HIGH", "yoy"), ("3-MEDIUM", "diff12"), ("4-NOT SPECIFIED", "neg_diff12"), ("5-LOW", "yoy")], "series string, how string")
    return CO.block_panel(s, specs, U)


@query("block_panel", """WITH b AS (SELECT series, d, x, LAG(x, 12) OVER (PARTITION BY series ORDER BY d) AS p FROM blk), r AS (SELECT series, d, CASE WHEN series < '3' OR series > '5' THEN x/p - 1 WHEN series < '4' THEN x - p ELSE p - x END AS x FROM b)
  SELECT series, d, round(LAG(x) OVER (PARTITION BY series ORDER BY d), 6)+0.0 AS x FROM r""")
def _(t):
    return out(blk(t), "x", keys=("series", "d"))


def by_block(t):
    return blk(t).withColumn("block", F.when(F.col("series") < "4", "growth").otherwise("inflation"))


@query("block_factors")
def _(t):
    """The first component of each indicator block, recursively."""
    return out(CO.recursive_pc1(by_block(t), ["block"], min_obs=30), "score", keys=("block", "d"))


@query("joint_factors", "SELECT d, round(growth, 6)+0.0 AS growth, round(inflation, 6)+0.0 AS inflation, round(explained, 6)+0.0 AS explained FROM rp_j")
def _(t):
    """Two components of all indicators together, named after the block they load on."""
    f = CO.recursive_pc12(blk(t), U, ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["4-NOT SPECIFIED", "5-LOW"], min_obs=30)
    return out(f, "growth", "inflation", "explained", keys=("d",))


# the inflation block has two series, whose first component is their standardised sum or difference
view("bf_n", "SELECT d, x4, x5, COUNT(*) FILTER (WHERE x4 IS NOT NULL AND x5 IS NOT NULL) OVER w AS n, AVG(CASE WHEN x5 IS NOT NULL THEN x4 END) OVER w AS m4, AVG(CASE WHEN x4 IS NOT NULL THEN x5 END) OVER w AS m5, stddev_samp(CASE WHEN x5 IS NOT NULL THEN x4 END) OVER w AS s4, stddev_samp(CASE WHEN x4 IS NOT NULL THEN x5 END) OVER w AS s5, corr(x4, x5) OVER w AS rho FROM ve_w WINDOW w AS (ORDER BY d)")


view("bf_d", "SELECT d, row_number() OVER (ORDER BY d) AS k, COUNT(x4) OVER (ORDER BY d) AS c4, COUNT(x5) OVER (ORDER BY d) AS c5 FROM ve_w WHERE d IN (SELECT d FROM ve_x WHERE series > '4')")
view("bf_s", "SELECT d, n, abs((x4 - m4)/s4 + CASE WHEN rho >= 0 THEN 1 ELSE -1 END*(x5 - m5)/s5)/sqrt(2)/(sqrt((1 + abs(rho))*(n - 1)/n) + 1e-12) AS size FROM bf_n WHERE n >= 30 AND x4 IS NOT NULL AND x5 IS NOT NULL")


@query("block_factors_check", "SELECT d, size FROM (SELECT d, round(last_value(size IGNORE NULLS) OVER (ORDER BY d), 6)+0.0 AS size, k, c4, c5 FROM bf_d LEFT JOIN bf_s USING (d)) WHERE k > 30 AND c4 >= 0.6*k AND c5 >= 0.6*k AND size IS NOT NULL")
def _(t):
    """Size of the inflation block's score against its closed form."""
    f = CO.recursive_pc1(by_block(t).filter("block = 'inflation'"), ["block"], min_obs=30)
    return f.select("d", r6(F.abs("score")).alias("size"))


# recursive components of all five series: complete rows so far, and the latest of them at each date
view("rp_n", "SELECT d AS rd, x1, x2, x3, x4, x5, row_number() OVER (ORDER BY d) AS k, " + ", ".join(f"COUNT(x{i}) OVER (ORDER BY d) AS c{i}" for i in range(1, 6)) + ", " + " AND ".join(f"x{i} IS NOT NULL" for i in range(1, 6)) + " AS whole FROM ve_w")
view("rp_h", "SELECT a.rd AS k, s.i, t.i AS j, corr(CASE s.i " + " ".join(f"WHEN {i} THEN b.x{i}" for i in range(1, 6)) + " END, CASE t.i " + " ".join(f"WHEN {i} THEN b.x{i}" for i in range(1, 6)) + " END) AS rho FROM rp_n a JOIN rp_n b ON b.rd <= a.rd AND b.whole, (SELECT unnest(range(1, 6)) AS i) s, (SELECT unnest(range(1, 6)) AS i) t WHERE a.whole GROUP BY 1, 2, 3 HAVING COUNT(*) >= 30")
view("rp_r", "SELECT k, list(r ORDER BY i) AS m FROM (SELECT k, i, list(CASE WHEN i = j THEN 1.0 ELSE rho END ORDER BY j) AS r FROM rp_h GROUP BY 1, 2) GROUP BY 1")
views(top_views("rp_1", "SELECT k, m FROM rp_r", 5))
views(top_views("rp_2", "SELECT k, list_transform(range(1, 6), lambda i: list_transform(range(1, 6), lambda j: m[i][j] - value*v[i]*v[j])) AS m FROM rp_1", 5))
view("rp_z", "SELECT a.rd AS k, COUNT(*) AS n, " + "[" + ", ".join(f"(ANY_VALUE(a.x{i}) - AVG(b.x{i}))/stddev_samp(b.x{i})" for i in range(1, 6)) + "] AS z FROM rp_n a JOIN rp_n b ON b.rd <= a.rd AND b.whole WHERE a.whole GROUP BY 1")
view("rp_s", """SELECT k, n, v1, v2, l1, l2, list_dot_product(z, v1)/(sqrt(l1*(n - 1)/n) + 1e-12) AS s1, list_dot_product(z, v2)/(sqrt(l2*(n - 1)/n) + 1e-12) AS s2 FROM (SELECT k, v AS v1, value AS l1 FROM rp_1) JOIN (SELECT k, v AS v2, value AS l2 FROM rp_2) USING (k) JOIN rp_z USING (k)""")
view("rp_d", "SELECT d.rd AS d, s.* FROM rp_n d ASOF JOIN rp_s s ON d.rd >= s.k WHERE d.k > 30 AND " + " AND ".join(f"d.c{i} >= 0.6*d.k" for i in range(1, 6)))


@query("recursive_pc1", "SELECT d, round(CASE WHEN list_sum(v1) >= 0 THEN s1 ELSE -s1 END, 6)+0.0 AS score FROM rp_d")
def _(t):
    return out(CO.recursive_pc1(blk(t), U, min_obs=30), "score", keys=("d",))


view("rp_q", "SELECT d, (l1 + l2)/5 AS explained, s1, s2, " + ", ".join(f"abs(v{c}[1]) + abs(v{c}[2]) + abs(v{c}[3]) > abs(v{c}[4]) + abs(v{c}[5]) AS g{c}, v{c}[1] + v{c}[2] + v{c}[3] AS a{c}, v{c}[4] + v{c}[5] AS b{c}" for c in (1, 2)) + " FROM rp_d")
view("rp_j", "SELECT d, explained, " + ", ".join(f"CASE WHEN g1 THEN CASE WHEN {x}1 < 0 THEN -s1 ELSE s1 END ELSE CASE WHEN {x}2 < 0 THEN -s2 ELSE s2 END END AS growth" if x == "a" else f"CASE WHEN g1 THEN CASE WHEN {x}2 < 0 THEN -s2 ELSE s2 END ELSE CASE WHEN {x}1 < 0 THEN -s1 ELSE s1 END END AS inflation" for x in ("a", "b")) + " FROM rp_q WHERE g1 <> g2")


@query("recursive_pc12", f"SELECT d, {qd('growth > 0', 'inflation > 0')} AS regime, round(growth, 6)+0.0 AS growth, round(inflation, 6)+0.0 AS inflation, round(explained, 6)+0.0 AS explained FROM rp_j")
def _(t):
    f = CO.recursive_pc12(blk(t), U, ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["4-NOT SPECIFIED", "5-LOW"], min_obs=30)
    f = f.withColumn("regime", R.quadrant(F.col("growth") > 0, F.col("inflation") > 0))
    return out(f, "growth", "inflation", "explained", keys=("d", "regime"))


# eigenvalues of a 2x2 and a 3x3 correlation matrix in closed form
view("ve_x", """WITH b AS (SELECT series, d, x, LAG(x, 12) OVER (PARTITION BY series ORDER BY d) AS p FROM blk), r AS (SELECT series, d, CASE WHEN series < '3' OR series > '5' THEN x/p - 1 WHEN series < '4' THEN x - p ELSE p - x END AS x FROM b)
  SELECT series, d, LAG(x) OVER (PARTITION BY series ORDER BY d) AS x FROM r""")
view("ve_w", "SELECT d, " + ", ".join(f"MAX(CASE WHEN series LIKE '{k}-%' THEN x END) AS x{k}" for k in range(1, 6)) + " FROM ve_x GROUP BY d")
view("ve_g", "SELECT COUNT(*) AS n, corr(x1, x2) AS a, corr(x1, x3) AS b, corr(x2, x3) AS c FROM ve_w WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL")
view("ve_t", "SELECT n, sqrt((a*a + b*b + c*c)/3) AS q, acos(a*b*c/POW((a*a + b*b + c*c)/3, 1.5))/3 AS th FROM ve_g")


@query("variance_explained", """SELECT 'growth' AS block, 3::BIGINT AS n_series, n AS n_months, round((1 + 2*q*cos(th))/3, 6)+0.0 AS pc1_share, round((1 + 2*q*cos(th - 2*pi()/3))/3, 6)+0.0 AS pc2_share FROM ve_t
  UNION ALL SELECT 'inflation', 2, COUNT(*), round((1 + abs(corr(x4, x5)))/2, 6)+0.0, round((1 - abs(corr(x4, x5)))/2, 6)+0.0 FROM ve_w WHERE x4 IS NOT NULL AND x5 IS NOT NULL""")
def _(t):
    return out(CO.variance_explained(by_block(t), ["block"]), "pc1_share", "pc2_share", keys=("block", "n_series", "n_months"))


@query("cp_factor")
def _(t):
    f, g = CO.cp_factor(stored(curve(t)))
    return out(f.join(g.select("curve", "r2"), "curve"), "factor", "r2", keys=("curve", "d"))


view("cp_x", "SELECT f.d, f.f, y.y, row_number() OVER (ORDER BY f.d) - 1 AS rn FROM (SELECT d, list(f ORDER BY n) AS f FROM fwd_m GROUP BY 1) f JOIN (SELECT d, AVG(rx) AS y FROM rx_m GROUP BY 1) y USING (d)")
view("cp_t", "SELECT a.d AS k, b.f, b.y, COUNT(*) OVER (PARTITION BY a.d) AS n FROM cp_x a JOIN cp_x b ON b.rn <= a.rn - 13 WHERE a.rn >= 36 AND b.y IS NOT NULL")
view("cp_c", "SELECT k, i, list(c ORDER BY j) AS r FROM (SELECT k, i, j, covar_pop(f[i], CASE WHEN j = 6 THEN y ELSE f[j] END) AS c FROM cp_t, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 7)) AS j) WHERE n >= 36 GROUP BY 1, 2, 3) GROUP BY 1, 2")
views(solve_views("cp_g", "SELECT k, list(r ORDER BY i) AS a FROM cp_c GROUP BY 1", 5))
view("cp_m", "SELECT k, AVG(y) AS my, [" + ", ".join(f"AVG(f[{i}])" for i in range(1, 6)) + "] AS mf FROM cp_t GROUP BY 1")


@query("cp_factor_expanding", "SELECT 'usd' AS curve, c.d, round(my + list_dot_product(x, c.f) - list_dot_product(x, mf), 6)+0.0 AS factor FROM cp_x c JOIN cp_g g ON g.k = c.d JOIN cp_m m ON m.k = c.d")
def _(t):
    return out(CO.cp_factor_expanding(stored(curve(t)), min_obs=36), "factor", keys=("curve", "d"))


@query("curve_pca")
def _(t):
    load, scores = CO.curve_pca(stored(curve(t)))
    s = scores.groupBy("curve", "pc").agg(F.stddev_samp("score").alias("score_sd"), F.count("*").alias("n"))
    return out(load.join(s, ["curve", "pc"]), "loading", "share", "score_sd", keys=("curve", "pc", "tenor", "n"))


@query("svensson_fit_grid")
def _(t):
    f = CO.svensson_fit_grid(curve(t).filter("tenor >= 0.25"))
    return out(f, "beta0", "tau1", "tau2", "rmse", keys=("curve", "d"))


# ---- checks of fits and rotations by the conditions that define them ----


@query("curve_pca_check", "SELECT k AS pc, 1.0::DOUBLE AS norm, 0.0::DOUBLE AS gap FROM (SELECT unnest([1, 2, 3]) AS k)")
def _(t):
    """Loadings have length one, and a component's variance is its share of the total."""
    c = stored(curve(t))
    load, scores = CO.curve_pca(c)
    w = win(["curve", "tenor"])
    total = c.select("curve", "tenor", (F.col("zero") - F.lag("zero").over(w)).alias("x")).groupBy("curve", "tenor").agg(F.var_samp("x").alias("v")).groupBy("curve").agg(F.sum("v").alias("total"))
    each = load.groupBy("curve", "pc").agg(F.sum(F.col("loading") * F.col("loading")).alias("norm"), F.max("share").alias("share"))
    var = scores.groupBy("curve", "pc").agg(F.var_samp("score").alias("v"))
    j = each.join(var, ["curve", "pc"]).join(total, "curve").withColumn("gap", F.col("v") / F.col("total") - F.col("share"))
    return out(j, "norm", "gap", keys=("pc",))


@query("cp_factor_check", "SELECT k, 0.0::DOUBLE AS slope FROM (SELECT unnest([0, 1, 2, 3, 4]) AS k)")
def _(t):
    """The residual of the mean excess return on the factor is orthogonal to every forward rate."""
    c = stored(curve(t))
    f, _g = CO.cp_factor(c)
    x = CO._cp_inputs(c, (2, 3, 4, 5), 12).filter("y is not null").join(f, ["curve", "d"]).withColumn("e", F.col("y") - F.col("factor"))
    each = x.select("curve", "e", F.posexplode("f").alias("k", "v"))
    return out(each.groupBy("curve", "k").agg((F.covar_samp("e", "v") / F.var_samp("v")).alias("slope")), "slope", keys=("k",))


view("sv_n", "SELECT d, COUNT(*) AS n FROM disc_m WHERE tenor >= 0.25 AND zero IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 6")


@query("svensson_fit_check", "SELECT d, n, 0.0::DOUBLE AS rmse_gap, TRUE AS inside, TRUE AS stationary FROM sv_n")
def _(t):
    """The fitted curve has the stated error, parameters keep their bounds, and free coefficients leave no slope in the error."""
    c = stored(curve(t).filter("tenor >= 0.25"))
    f = stored(CO.svensson_fit_grid(c))
    x1, x2 = F.col("tenor") / F.col("tau1"), F.col("tenor") / F.col("tau2")
    s1, s2 = (1 - F.exp(-x1)) / x1, (1 - F.exp(-x2)) / x2
    load = [F.lit(1.0), s1, s1 - F.exp(-x1), s2 - F.exp(-x2)]
    j = c.filter("zero is not null").join(f, ["curve", "d"]).withColumn("e", F.col("zero") - sum((F.col(f"beta{k}") * load[k] for k in range(4)), F.lit(0.0)))
    g = j.groupBy("curve", "d", *[f"beta{k}" for k in range(4)], "tau1", "tau2", "rmse").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("own"), *[F.sum(F.col("e") * load[k]).alias(f"g{k}") for k in range(4)])
    low, high, tol = CO.BETA_LOW, CO.BETA_HIGH, 1e-6
    inside = (F.col("tau2") - F.col("tau1") >= 0.5 - 1e-9) & F.col("tau1").between(0.1, 10.0 + 1e-9) & F.col("tau2").between(1.0, 30.0 + 1e-9)
    still = F.lit(True)
    for k in range(4):
        b, s = F.col(f"beta{k}"), F.col(f"g{k}")
        inside = inside & b.between(low[k] - 1e-9, high[k] + 1e-9)
        still = still & ((s <= tol) | (b >= high[k] - 1e-9)) & ((s >= -tol) | (b <= low[k] + 1e-9))
    return out(g.withColumn("rmse_gap", F.col("rmse") - F.col("own")).withColumn("inside", inside).withColumn("stationary", still), "rmse_gap", keys=("d", "n", "inside", "stationary"))
