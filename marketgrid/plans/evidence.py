"""Queries: forecast evaluation and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6, win
from ..operators import backtest as B
from ..operators import covariance as V
from ..operators import forecast as FC
from ..operators import inference as I
from ..operators import metrics as M
from ..operators import timeseries as T
from ..operators import weights as P
from ..session import stored
from .forecasting import bench, evt, forecasts
from .portfolio import bt_chain
from .registry import query, view, views
from .risk import U, ex_m, lw_views
from .scoring import SPANS
from .series import out, sq
from .sqlmath import erc_views, phi, quantile, t_cdf, t_quantile

view("ev", "SELECT f.asset, f.signal, f.d, f.y, f.forecast, b.bench FROM fc_m f JOIN bench_fc b ON b.asset = f.asset AND b.d = f.d WHERE f.forecast IS NOT NULL AND b.bench IS NOT NULL")
view("r2_m", "SELECT asset, signal, COUNT(*) AS n, 1 - AVG(POW(y - forecast, 2))/AVG(POW(y - bench, 2)) AS r2 FROM ev GROUP BY 1, 2 HAVING COUNT(*) >= 12")
view("cw_h", "SELECT asset, signal, row_number() OVER (PARTITION BY asset, signal ORDER BY d) AS i, h - AVG(h) OVER (PARTITION BY asset, signal) AS e, AVG(h) OVER (PARTITION BY asset, signal) AS m, COUNT(*) OVER (PARTITION BY asset, signal) AS n FROM (SELECT *, POW(y - bench, 2) - POW(y - forecast, 2) + POW(bench - forecast, 2) AS h FROM ev)")
view("cw_l", "SELECT DISTINCT asset, signal, n, m, floor(4*POW(n/100.0, 2.0/9)) AS l FROM cw_h WHERE n >= 24")
view("cw_c", "SELECT a.asset, a.signal, b.i - a.i AS k, AVG(a.e*b.e) AS g FROM cw_h a JOIN cw_h b ON a.asset = b.asset AND a.signal = b.signal AND b.i - a.i BETWEEN 0 AND 8 GROUP BY 1, 2, 3")
view("cw_m", """SELECT l.asset, l.signal, l.n, l.m AS mean, l.m/sqrt(greatest(SUM(CASE WHEN k = 0 THEN g ELSE 2*(1 - k/(l.l + 1))*g END), 1e-18)/l.n) AS stat FROM cw_l l JOIN cw_c c ON c.asset = l.asset AND c.signal = l.signal AND c.k <= greatest(l.l, 1) GROUP BY 1, 2, 3, 4""")
view("scan_m", "SELECT r.asset, r.signal, r.n, r.r2, c.stat, CASE WHEN r.signal LIKE 'mom%' THEN 'momentum' ELSE 'volatility' END AS family FROM r2_m r LEFT JOIN cw_m c ON c.asset = r.asset AND c.signal = r.signal WHERE r.n >= 36")
view("rank_m", "SELECT signal, family, AVG(r2) AS mean_r2, AVG(stat) AS mean_t, COUNT(*) FILTER (WHERE stat > 1.645) AS n_sig, COUNT(*) FILTER (WHERE r2 > 0) AS n_positive, COUNT(*) AS n_assets FROM scan_m GROUP BY 1, 2 HAVING COUNT(*) >= 3")

AS = ["asset", "signal"]


def scored(t):
    return forecasts(t).join(bench(t).drop("y"), ["asset", "d"])


def scan(t):
    s = FC.signal_scan(stored(scored(t)), min_rows=36)
    return s.withColumn("family", T.family_of("signal"))


@query("oos_r2", sq({"r2": "r2"}, "r2_m", "asset, signal, n"))
def _(t):
    return out(FC.oos_r2(scored(t), AS), "r2", keys=("asset", "signal", "n"))


@query("clark_west", sq({"mean": "mean", "stat": "stat"}, "cw_m", "asset, signal, n"))
def _(t):
    return out(FC.clark_west(scored(t), AS), "mean", "stat", keys=("asset", "signal", "n"))


@query("clark_west_p", sq({"stat": "stat", "p": f"1 - {phi('abs(stat)')}"}, "cw_m", "asset, signal, n"))
def _(t):
    c = I.with_normal_p(FC.clark_west(scored(t), AS), "stat")
    return out(c, "stat", "p", keys=("asset", "signal", "n"))


view("nw_x", "SELECT s.strategy, s.d, s.r - s.rf AS y, b.r - s.rf AS x FROM strat_m s JOIN bench_m b USING (d)")
view("nw_f", """SELECT f.*, y - a - b*x AS e, row_number() OVER (PARTITION BY f.strategy ORDER BY d) AS i FROM (SELECT n.*, b, my - b*mx AS a, cnt, mx, vx FROM nw_x n JOIN (SELECT strategy, covar_pop(x, y)/var_pop(x) AS b, AVG(y) AS my, AVG(x) AS mx, var_pop(x) AS vx, COUNT(*) AS cnt FROM nw_x GROUP BY 1) s USING (strategy)) f""")
view("nw_s", """SELECT a.strategy, SUM(w*a.e*b.e) AS s00, SUM(w*a.e*b.e*(a.x + b.x)/2) AS s01, SUM(w*a.e*b.e*a.x*b.x) AS s11 FROM (SELECT *, greatest(1, CAST(floor(4*POW(cnt/100.0, 2.0/9)) AS INT)) AS l FROM nw_f) a JOIN nw_f b ON a.strategy = b.strategy AND b.i BETWEEN a.i AND a.i + a.l,
  LATERAL (SELECT CASE WHEN b.i = a.i THEN 1.0 ELSE 2*(1 - (b.i - a.i)/(a.l + 1.0)) END AS w) GROUP BY 1""")
view("nwo", """SELECT f.strategy, ANY_VALUE(cnt) AS n, ANY_VALUE(a) AS alpha, ANY_VALUE(b) AS beta, ANY_VALUE(mx) AS mx, ANY_VALUE(vx) AS vx, ANY_VALUE(s00) AS s00, ANY_VALUE(s01) AS s01, ANY_VALUE(s11) AS s11 FROM nw_f f JOIN nw_s s ON s.strategy = f.strategy GROUP BY 1""")
view("nwo_t", """SELECT strategy, n, alpha, beta, alpha/sqrt(POW((vx + mx*mx)/(n*vx), 2)*s00 - 2*(vx + mx*mx)*mx/POW(n*vx, 2)*s01 + mx*mx/POW(n*vx, 2)*s11) AS t_alpha, beta/sqrt((mx*mx*s00 - 2*mx*s01 + s11)/POW(n*vx, 2)) AS t_beta FROM nwo""")


def strat_b(t):
    return t.strat_m.join(t.bench_m.select("d", F.col("r").alias("b")), "d")


@query("nw_ols", sq({k: k for k in ("alpha", "beta", "t_alpha", "t_beta")}, "nwo_t", "strategy, n"))
def _(t):
    x = strat_b(t).select("strategy", "d", (F.col("r") - F.col("rf")).alias("y"), (F.col("b") - F.col("rf")).alias("x"))
    return out(FC.nw_ols(x, ["strategy"]), "alpha", "beta", "t_alpha", "t_beta", keys=("strategy", "n"))


view("jk_x", "SELECT s.strategy, s.span, s.d, s.r - s.rf AS xs, b.r - s.rf AS xb FROM span_m s JOIN bench_m b USING (d)")
view("jk", "SELECT strategy, span, n, (sa - sb)/sqrt((2*(1 - r) + 0.5*(sa*sa + sb*sb - 2*sa*sb*r*r))/n) AS z FROM (SELECT strategy, span, COUNT(*) AS n, AVG(xs)/stddev_samp(xs) AS sa, AVG(xb)/stddev_samp(xb) AS sb, corr(xs, xb) AS r FROM jk_x GROUP BY 1, 2)")


@query("jobson_korkie", sq({"z": "z"}, "jk", "strategy, span, n"))
def _(t):
    x = I.excess_pairs(M.with_windows(strat_b(t), SPANS))
    return out(I.jobson_korkie(x, ["strategy", "span"]), "z", keys=("strategy", "span", "n"))


@query("paired_t", """SELECT strategy, span, COUNT(*) AS n_obs, round(AVG(xs - xb)*12, 6)+0.0 AS mean_difference, round(stddev_samp(xs - xb)/sqrt(COUNT(*))*12, 6)+0.0 AS se, round(AVG(xs - xb)/(stddev_samp(xs - xb)/sqrt(COUNT(*))), 6)+0.0 AS t_stat FROM jk_x GROUP BY 1, 2""")
def _(t):
    x = I.excess_pairs(M.with_windows(strat_b(t), SPANS))
    return out(I.paired_t(x, ["strategy", "span"]), "mean_difference", "se", "t_stat", keys=("strategy", "span", "n_obs"))


view("pt_all", "SELECT strategy, COUNT(*) AS n_obs, AVG(xs - xb)*12 AS md, stddev_samp(xs - xb)/sqrt(COUNT(*))*12 AS se, AVG(xs - xb)/(stddev_samp(xs - xb)/sqrt(COUNT(*))) AS t FROM (SELECT s.strategy, s.r - s.rf AS xs, b.r - s.rf AS xb FROM strat_m s JOIN bench_m b USING (d)) GROUP BY 1")
view("pt_q", f"SELECT n_obs, {t_quantile(0.975, 'n_obs - 1')} AS c FROM (SELECT DISTINCT n_obs FROM pt_all)")


@query("paired_t_p", f"""SELECT strategy, n_obs, round(t, 6)+0.0 AS t_stat, round(1 - {t_cdf('t', 'n_obs - 1')}, 6)+0.0 AS p_one_sided, round(md - c*se, 6)+0.0 AS ci_lo, round(md + c*se, 6)+0.0 AS ci_hi FROM pt_all JOIN pt_q USING (n_obs)""")
def _(t):
    p = I.with_t_interval(I.paired_t(I.excess_pairs(strat_b(t)), ["strategy"]))
    return out(p, "t_stat", "p_one_sided", "ci_lo", "ci_hi", keys=("strategy", "n_obs"))


def boot_sql(reps, n):
    """SQL of resampled positions (rep, t, idx) of a path of length n (an expression)."""
    return f"""SELECT rep, t, n, (last_value(CASE WHEN j THEN s END IGNORE NULLS) OVER w + t - last_value(CASE WHEN j THEN t END IGNORE NULLS) OVER w) % n AS idx FROM (
      SELECT rep, t, n, t = 0 OR ('0x' || substr(h, 1, 13))::BIGINT/4503599627370496.0 < 1/12.0 AS j, CAST(floor(('0x' || substr(h, 14, 13))::BIGINT/4503599627370496.0*n) AS INT) AS s FROM (
      SELECT rep, t, n, md5('20260830:' || rep || ':' || t) AS h FROM (SELECT unnest(range(0, {reps}))::INT AS rep), (SELECT n, unnest(range(0, n))::INT AS t FROM ({n})))) WINDOW w AS (PARTITION BY rep, n ORDER BY t)"""


view("boot", boot_sql(I.REPS, "SELECT COUNT(DISTINCT d)::INT AS n FROM strat_m"))


@query("stationary_bootstrap_index", "SELECT rep, t, CAST(idx AS INT) AS idx FROM boot")
def _(t):
    n = t.strat_m.agg(F.countDistinct("d").alias("n"))
    return I.bootstrap_index(n, I.REPS).select("rep", "t", "idx")


view("sd_x", "SELECT s.strategy, row_number() OVER (PARTITION BY s.strategy ORDER BY s.d) - 1 AS i, s.r - s.rf AS xs, b.r - s.rf AS xb FROM strat_m s JOIN bench_m b USING (d) WHERE b.r IS NOT NULL")
view("sd_d", "SELECT strategy, rep, (AVG(xs)/stddev_samp(xs) - AVG(xb)/stddev_samp(xb))*sqrt(12) AS draw FROM boot JOIN sd_x ON i = idx GROUP BY 1, 2")
view("sd_o", "SELECT strategy, COUNT(*) AS n_months, AVG(xs)/stddev_samp(xs)*sqrt(12) AS ss, AVG(xb)/stddev_samp(xb)*sqrt(12) AS sb FROM sd_x GROUP BY 1")


@query("sharpe_difference", """WITH m AS (SELECT strategy, AVG(draw) AS m, stddev_samp(draw) AS se, quantile_cont(draw, 0.025) AS lo, quantile_cont(draw, 0.975) AS hi FROM sd_d GROUP BY 1),
  p AS (SELECT d.strategy, AVG(CAST(draw - m >= abs(ss - sb) AS DOUBLE)) AS p1, AVG(CAST(draw - m >= ss - sb AS DOUBLE)) AS p2 FROM sd_d d JOIN m USING (strategy) JOIN sd_o USING (strategy) GROUP BY 1)
  SELECT strategy, n_months, round(ss, 6)+0.0 AS sharpe_strategy, round(sb, 6)+0.0 AS sharpe_benchmark, round(ss - sb, 6)+0.0 AS difference, round(se, 6)+0.0 AS se, round(lo, 6)+0.0 AS ci_lo, round(hi, 6)+0.0 AS ci_hi,
  round(p1, 6)+0.0 AS p_one_sided, round(p2, 6)+0.0 AS p_upper FROM sd_o JOIN m USING (strategy) JOIN p USING (strategy)""")
def _(t):
    s = I.sharpe_difference(stored(strat_b(t)), ["strategy"])
    return out(s, *[k for k in s.columns if k not in ("strategy", "n_months")], keys=("strategy", "n_months"))


view("rc_x", "SELECT strategy, i, xs - xb AS x FROM sd_x")
view("rc_b", "SELECT strategy, rep, AVG(x) AS m, ANY_VALUE(n) AS n FROM boot JOIN rc_x ON i = idx GROUP BY 1, 2")
view("rc_s", "SELECT strategy, dbar, n, omega, sqrt(n)*dbar/omega AS t_obs, sqrt(n)*dbar/omega >= -sqrt(2*ln(greatest(ln(n), 1.0001))) AS keep FROM (SELECT strategy, AVG(x) AS dbar, COUNT(*) AS n FROM rc_x GROUP BY 1) JOIN (SELECT strategy, greatest(stddev_samp(m)*sqrt(ANY_VALUE(n)), 1e-12) AS omega FROM rc_b GROUP BY 1) USING (strategy)")


@query("reality_check", """WITH z AS (SELECT rep, greatest(MAX(sqrt(s.n)*(m - dbar)/omega), 0) AS w, greatest(MAX(sqrt(s.n)*(m - CASE WHEN keep THEN dbar ELSE 0 END)/omega), 0) AS h FROM rc_b b JOIN rc_s s USING (strategy) GROUP BY 1),
  o AS (SELECT COUNT(*) AS n_strategies, MAX(n) AS n_months, arg_max(strategy, t_obs) AS best, MAX(t_obs) AS bt, COUNT(*) FILTER (WHERE keep) AS n_in_null FROM rc_s)
  SELECT n_strategies, n_months, best, round(bt, 6)+0.0 AS best_t, round(greatest(bt, 0), 6)+0.0 AS spa_statistic, n_in_null, (SELECT round(AVG(CAST(w >= greatest(bt, 0) AS DOUBLE)), 6)+0.0 FROM z) AS p_reality_check, (SELECT round(AVG(CAST(h >= greatest(bt, 0) AS DOUBLE)), 6)+0.0 FROM z) AS p_spa FROM o""")
def _(t):
    g = stored(strat_b(t).select(F.lit("all").alias("family"), "strategy", "d", (F.col("r") - F.col("b")).alias("x")))
    return out(I.reality_check(g, ["family"]), "best_t", "spa_statistic", "p_reality_check", "p_spa", keys=("n_strategies", "n_months", "best", "n_in_null"))


@query("shape_moments", """WITH m AS (SELECT strategy, COUNT(*) AS n, AVG(r) AS m, stddev_samp(r) AS s, stddev_pop(r) AS p FROM strat_m GROUP BY 1)
  SELECT strategy, n, round(ANY_VALUE(m/s), 6)+0.0 AS sr, round(AVG(POW((r - m)/p, 3)), 6)+0.0 AS skew, round(AVG(POW((r - m)/p, 4)), 6)+0.0 AS kurtosis FROM strat_m JOIN m USING (strategy) GROUP BY 1, 2""")
def _(t):
    return out(I.shape_moments(t.strat_m, ["strategy"]), "sr", "skew", "kurtosis", keys=("strategy", "n"))


view("ds_m", """WITH m AS (SELECT strategy, COUNT(*) AS n, AVG(r) AS m, stddev_samp(r) AS s, stddev_pop(r) AS p FROM strat_m GROUP BY 1)
  SELECT strategy, n, ANY_VALUE(m/s) AS sr, AVG(POW((r - m)/p, 3)) AS g3, AVG(POW((r - m)/p, 4)) AS g4 FROM strat_m JOIN m USING (strategy) GROUP BY 1, 2""")
view("ds_q", f"SELECT {quantile(1 - 1 / 50)} AS q1, {quantile(1 - 1 / (50 * 2.718281828459045))} AS q2, {quantile(0.95)} AS q95")
view("ds_z", f"SELECT *, sqrt(1.0/n)*((1 - {I.EULER})*q1 + {I.EULER}*q2) AS sr0, 1 - g3*sr + (g4 - 1)/4.0*sr*sr AS shape FROM ds_m, ds_q")
view("ds_y", "SELECT *, (sr - sr0)*sqrt(n - 1)/sqrt(greatest(shape, 1e-12)) AS zz FROM ds_z")


@query("deflated_sharpe", f"""SELECT strategy, n, 50 AS n_trials, round(sr*sqrt(12), 6)+0.0 AS sharpe_annual, round(sr0*sqrt(12), 6)+0.0 AS expected_max_under_null, round(g3, 6)+0.0 AS skew, round(g4, 6)+0.0 AS kurtosis,
  round({phi('zz')}, 6)+0.0 AS deflated_sharpe_prob, CASE WHEN sr > sr0 THEN round(1 + shape*POW(q95/greatest(sr - sr0, 1e-6), 2), 6)+0.0 END AS min_track_record_months FROM ds_y""")
def _(t):
    d = I.deflated_sharpe(t.strat_m, ["strategy"], n_trials=50)
    return out(d, *[k for k in d.columns if k not in ("strategy", "n", "n_trials")], keys=("strategy", "n", "n_trials"))


view("re_m", "SELECT universe, asset, AVG(r) AS skill, stddev_samp(r) AS vol, round(AVG(px)/500) AS dur FROM univ_ret_q WHERE r IS NOT NULL GROUP BY 1, 2")


def _rank(x, desc=""):
    return f"(rank() OVER (PARTITION BY universe ORDER BY {x} {desc}) + (COUNT(*) OVER (PARTITION BY universe, {x}) - 1)/2.0)"


def _ev(k):
    return f"""SELECT universe, '{k}' AS predictor, COUNT(*) AS n, CASE WHEN stddev_pop(rx) > 0 THEN corr(ry, rx) END AS spearman, CASE WHEN stddev_pop({k}) > 0 THEN corr(skill, {k}) END AS pearson, CASE WHEN var_pop({k}) > 0 THEN covar_pop(skill, {k})/var_pop({k}) END AS slope
      FROM (SELECT *, {_rank('skill')} AS ry, {_rank(k)} AS rx FROM re_m) GROUP BY 1"""


@query("rank_evidence", f"SELECT universe, predictor, n, round(spearman, 6)+0.0 AS spearman, round(pearson, 6)+0.0 AS pearson, round(slope, 6)+0.0 AS slope, round(pearson*pearson, 6)+0.0 AS r2, round(pearson*sqrt((n - 2)/(1 - pearson*pearson)), 6)+0.0 AS t_slope FROM ({_ev('vol')} UNION ALL {_ev('dur')})")
def _(t):
    e = evidence_input(t)
    return out(I.rank_evidence(e, U, "skill", ["vol", "dur"]), "spearman", "pearson", "slope", "r2", "t_slope", keys=("universe", "predictor", "n"))


def evidence_input(t):
    return t.univ_ret_q.filter("r is not null").groupBy("universe", "asset").agg(F.avg("r").alias("skill"), F.stddev_samp("r").alias("vol"), F.round(F.avg("px") / 500).alias("dur"))


@query("dense_ranks", f"SELECT universe, asset, CAST(floor({_rank('skill', 'DESC')}) AS INT) AS rank_skill, CAST(floor({_rank('dur', 'DESC')}) AS INT) AS rank_dur FROM re_m")
def _(t):
    return I.dense_ranks(evidence_input(t), U, ["skill", "dur"]).select("universe", "asset", "rank_skill", "rank_dur")


@query("signal_scan", sq({"r2": "r2", "stat": "stat"}, "scan_m", "asset, signal, family, n"))
def _(t):
    return out(scan(t), "r2", "stat", keys=("asset", "signal", "family", "n"))


@query("signal_rank", sq({"mean_r2": "mean_r2", "mean_t": "mean_t"}, "rank_m", "signal, family, n_sig, n_positive, n_assets"))
def _(t):
    return out(FC.signal_rank(scan(t), 6), "mean_r2", "mean_t", keys=("signal", "family", "n_sig", "n_positive", "n_assets"))


@query("family_rank", """SELECT family, COUNT(*) AS signals, round(AVG(mean_r2), 6)+0.0 AS mean_r2, round(MAX(mean_r2), 6)+0.0 AS best_r2, round(AVG(mean_t), 6)+0.0 AS mean_t, CAST(SUM(n_sig) AS BIGINT) AS sig_pairs, CAST(SUM(n_assets) AS BIGINT) AS pairs,
  round(SUM(n_sig)/SUM(n_assets), 6)+0.0 AS pct_sig FROM rank_m GROUP BY 1""")
def _(t):
    return out(FC.family_rank(FC.signal_rank(scan(t), 6)), "mean_r2", "best_r2", "mean_t", "pct_sig", keys=("family", "signals", "sig_pairs", "pairs"))


@query("multiplicity", "SELECT CAST(SUM(n_assets) AS BIGINT) AS pairs, CAST(SUM(n_sig) AS BIGINT) AS significant, round(0.05*SUM(n_assets)::DOUBLE, 6)+0.0 AS expected_by_chance, round(SUM(n_sig)/(0.05*SUM(n_assets)), 6)+0.0 AS ratio FROM rank_m")
def _(t):
    return out(FC.multiplicity(FC.signal_rank(scan(t), 6)), "expected_by_chance", "ratio", keys=("pairs", "significant"))


view("top_m", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY r2 DESC, signal) AS rank FROM scan_m) WHERE rank <= 10")


@query("top_k_per_asset", sq({"r2": "r2"}, "top_m", "asset, rank, signal, family"))
def _(t):
    return out(FC.top_k_per_asset(scan(t), 10), "r2", keys=("asset", "rank", "signal", "family"))


@query("recurring_signals", "SELECT signal, family, COUNT(DISTINCT asset) AS assets, round(quantile_cont(r2, 0.5), 6)+0.0 AS median_r2, round(MAX(r2), 6)+0.0 AS best_r2, arg_max(asset, r2) AS best_on FROM top_m GROUP BY 1, 2 HAVING COUNT(DISTINCT asset) >= 2")
def _(t):
    return out(FC.recurring_signals(FC.top_k_per_asset(scan(t), 10), 2), "median_r2", "best_r2", keys=("signal", "family", "assets", "best_on"))


@query("score_table", """SELECT p.strategy, round(p.cagr, 6)+0.0 AS ret, round(p.vol, 6)+0.0 AS vol, round(p.sharpe, 6)+0.0 AS sharpe, round(p.sharpe - b.s, 6)+0.0 AS vs_bench, round(o.alpha*1200, 6)+0.0 AS alpha_pct_yr, round(o.t_alpha, 6)+0.0 AS t_alpha, round(o.beta, 6)+0.0 AS beta
  FROM pf p JOIN nwo_t o USING (strategy), (SELECT AVG(r - rf)/stddev_samp(r - rf)*sqrt(12) AS s FROM bench_m JOIN rf_m USING (d) WHERE r IS NOT NULL) b""")
def _(t):
    s = stored(strat_b(t))
    p = M.performance(s, ["strategy"])
    o = FC.nw_ols(s.select("strategy", "d", (F.col("r") - F.col("rf")).alias("y"), (F.col("b") - F.col("rf")).alias("x")), ["strategy"])
    b = s.groupBy("strategy").agg(M.sharpe_of(F.col("b") - F.col("rf"), 12).alias("bs"))
    j = p.join(o.drop("n"), "strategy").join(b, "strategy")
    return out(j.withColumn("ret", F.col("cagr")).withColumn("vs_bench", F.col("sharpe") - F.col("bs")).withColumn("alpha_pct_yr", F.col("alpha") * 1200),
               "ret", "vol", "sharpe", "vs_bench", "alpha_pct_yr", "t_alpha", "beta", keys=("strategy",))


@query("significance_compare", "SELECT strategy, span, n, round(z, 6)+0.0 AS z FROM jk")
def _(t):
    """Textbook statistic per window; `significance_compare_p` sets both p-values side by side."""
    return out(I.jobson_korkie(I.excess_pairs(M.with_windows(strat_b(t), SPANS)), ["strategy", "span"]), "z", keys=("strategy", "span", "n"))


view("sp_x", "SELECT strategy, span, xs, xb, row_number() OVER (PARTITION BY strategy, span ORDER BY d) - 1 AS i, COUNT(*) OVER (PARTITION BY strategy, span) AS n FROM jk_x")
view("sp_boot", boot_sql(I.REPS, "SELECT DISTINCT CAST(n AS INT) AS n FROM sp_x"))
view("sp_d", "SELECT strategy, span, rep, (AVG(xs)/stddev_samp(xs) - AVG(xb)/stddev_samp(xb))*sqrt(12) AS draw FROM sp_boot b JOIN sp_x x ON x.i = b.idx AND x.n = b.n GROUP BY 1, 2, 3")
view("sp_o", "SELECT strategy, span, (AVG(xs)/stddev_samp(xs) - AVG(xb)/stddev_samp(xb))*sqrt(12) AS edge FROM sp_x GROUP BY 1, 2")


@query("significance_compare_p", f"""WITH m AS (SELECT strategy, span, AVG(draw) AS m FROM sp_d GROUP BY 1, 2), p AS (SELECT d.strategy, d.span, AVG(CAST(draw - m >= abs(edge) AS DOUBLE)) AS p FROM sp_d d JOIN m USING (strategy, span) JOIN sp_o USING (strategy, span) GROUP BY 1, 2)
  SELECT jk.strategy, jk.span, jk.n, round(edge, 6)+0.0 AS edge, round(z, 6)+0.0 AS z, round(1 - {phi('abs(z)')}, 6)+0.0 AS p_t, round(p, 6)+0.0 AS p_boot FROM jk JOIN sp_o USING (strategy, span) JOIN p USING (strategy, span)""")
def _(t):
    s = stored(M.with_windows(strat_b(t), SPANS))
    keys = ["strategy", "span"]
    z = I.with_normal_p(I.jobson_korkie(I.excess_pairs(s), keys), "z", "p_t")
    b = I.sharpe_difference(s, keys).select(*keys, F.col("p_one_sided").alias("p_boot"), F.col("difference").alias("edge"))
    return out(z.join(b, keys), "edge", "z", "p_t", "p_boot", keys=("strategy", "span", "n"))


view("rg_s", "SELECT * FROM (VALUES " + ", ".join(f"('L{lb or 'all'}_e{ev}', {lb or 'NULL'}, {ev})" for lb in (None, 24, 36) for ev in (3, 6, 12)) + ") v(spec, lb, ev)")
view("rg_e", "SELECT spec, d AS ed, rn AS ern, lb, spec || '|' || d AS gk FROM (SELECT DISTINCT d, rn FROM ex_rn), rg_s WHERE rn >= 36 AND (rn = 36 OR rn % ev = 0)")
view("rg_src", "SELECT e.gk, x.asset, x.d, x.x FROM rg_e e JOIN ex_rn x ON x.rn < e.ern AND x.rn >= COALESCE(greatest(e.ern - lb, 0), 0)")
lw_views("lw_rg", "rg_src", "gk")
views(erc_views("rg_w", "SELECT gk AS k, i, j, s FROM lw_rg"))
view("rg_t", "SELECT e.spec AS strategy, w.asset, e.ed AS d, w.w AS target FROM rg_w w JOIN rg_e e ON e.gk = w.k UNION ALL SELECT 'eq ' || e.spec, w.asset, e.ed, 1.0/COUNT(*) OVER (PARTITION BY w.k) FROM rg_w w JOIN rg_e e ON e.gk = w.k")
bt_chain("btr", "rg_t")
view("rg_z", """SELECT strategy, mult, span, AVG(z)*12/NULLIF(stddev_samp(z)*sqrt(12), 0) AS sharpe FROM (SELECT strategy, mult, span, gross - mult*turnover*0.001 - rf AS z FROM btr JOIN rf_m USING (d), (SELECT unnest([0.0, 1.0, 2.0])::DOUBLE AS mult),
  (VALUES ('dev', DATE '1995-01-01', DATE '1999-12-31'), ('oos', DATE '2000-01-01', DATE '2001-12-31')) s(span, lo, hi) WHERE d BETWEEN lo AND hi) GROUP BY 1, 2, 3""")


@query("robustness_grid", "SELECT a.strategy, a.mult, a.span, round(a.sharpe, 6)+0.0 AS sharpe, round(a.sharpe - b.sharpe, 6)+0.0 AS edge FROM rg_z a JOIN rg_z b ON b.strategy = 'eq ' || a.strategy AND b.mult = a.mult AND b.span = a.span")
def _(t):
    """27 specs (lookback x cadence x cost) from one table of running pair sums."""
    x = ex_m(t)
    cal = V.calendar(x, U).withColumn("chunk", F.col("rn").cast("long"))
    specs = [(f"L{lb or 'all'}_e{ev}", lb, ev) for lb in (None, 24, 36) for ev in (3, 6, 12)]
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("spec"), F.lit(lb).cast("int").alias("lb"), F.lit(ev).alias("ev")) for s, lb, ev in specs]))
    due = cal.withColumn("_s", rows).select("universe", "d", "rn", "_s.*").filter("rn >= 36 and (rn = 36 or rn % ev = 0)")
    due = due.select("universe", "d", "spec", F.coalesce(F.greatest(F.col("rn") - F.col("lb"), F.lit(0)), F.lit(0)).cast("long").alias("lo"), F.col("rn").cast("long").alias("hi"), F.lit(True).alias("due"))
    sums = V.pair_sums(x.join(cal.select("universe", "d", "chunk"), ["universe", "d"]), U, chunk=F.col("chunk"))
    ep = V.epoch_sums(sums, due, U, rolling=True, extra=["spec"])
    w = P.cov_rule(V.ledoit_wolf(ep, ["universe", "d", "spec"]), ["universe", "d", "spec"], "erc")
    r = stored(t.ret_m.filter("r is not null").select(F.lit("all").alias("universe"), "asset", "d", "r"))
    eq = P.equal_weight(w, ["universe", "d", "spec"]).select("universe", F.concat(F.lit("eq "), "spec").alias("strategy"), "asset", "d", F.col("w").alias("target"))
    tg = stored(w.select("universe", F.col("spec").alias("strategy"), "asset", "d", F.col("w").alias("target")).unionByName(eq))
    rates = r.select("asset").distinct().withColumn("rate", F.lit(0.001))
    bt = B.backtest(r, tg, rates).join(t.rf_m, "d").withColumn("mult", F.explode(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))))
    scored_ = M.with_windows(bt.withColumn("x", F.col("gross") - F.col("mult") * F.col("cost") - F.col("rf")), {"dev": ("1995-01", "1999-12"), "oos": ("2000-01", "2001-12")})
    s = scored_.groupBy("strategy", "mult", "span").agg(M.sharpe_of(F.col("x"), 12).alias("sharpe"))
    own = s.filter(~F.col("strategy").startswith("eq "))
    base = s.filter(F.col("strategy").startswith("eq ")).select(F.expr("substr(strategy, 4)").alias("strategy"), "mult", "span", F.col("sharpe").alias("b"))
    return out(own.join(base, ["strategy", "mult", "span"]).withColumn("edge", F.col("sharpe") - F.col("b")), "sharpe", "edge", keys=("strategy", "mult", "span"))


view("auc_m", "SELECT asset, y, round(1/(1 + exp(3*r)), 2) AS p FROM evt WHERE y IS NOT NULL")


def auc_input(t):
    return evt(t).filter("y is not null").select("asset", "y", F.round(1.0 / (1.0 + F.exp(3.0 * F.col("r"))), 2).alias("p"))


@query("auc", """WITH k AS (SELECT *, rank() OVER (PARTITION BY asset ORDER BY p) + (COUNT(*) OVER (PARTITION BY asset, p) - 1)/2.0 AS rk FROM auc_m)
  SELECT asset, round((SUM(rk) FILTER (WHERE y = 1) - COUNT(*) FILTER (WHERE y = 1)*(COUNT(*) FILTER (WHERE y = 1) + 1)/2.0)/NULLIF(COUNT(*) FILTER (WHERE y = 1)*COUNT(*) FILTER (WHERE y = 0), 0), 6)+0.0 AS auc FROM k GROUP BY 1""")
def _(t):
    return out(FC.auc(auc_input(t), ["asset"]), "auc", keys=("asset",))


@query("auc_wide", """WITH g AS (SELECT substr(asset, 1, 1) AS u, y, p FROM auc_m), k AS (SELECT *, rank() OVER (PARTITION BY u ORDER BY p) + (COUNT(*) OVER (PARTITION BY u, p) - 1)/2.0 AS rk FROM g)
  SELECT u, round((SUM(rk) FILTER (WHERE y = 1) - COUNT(*) FILTER (WHERE y = 1)*(COUNT(*) FILTER (WHERE y = 1) + 1)/2.0)/NULLIF(COUNT(*) FILTER (WHERE y = 1)*COUNT(*) FILTER (WHERE y = 0), 0), 6)+0.0 AS auc FROM k GROUP BY 1""")
def _(t):
    return out(FC.auc(auc_input(t).withColumn("u", F.substring("asset", 1, 1)), ["u"], wide=True), "auc", keys=("u",))


@query("brier", "SELECT asset, round(AVG(POW(p - y, 2)), 6)+0.0 AS brier FROM auc_m GROUP BY 1")
def _(t):
    return out(FC.brier(auc_input(t), ["asset"]), "brier", keys=("asset",))


@query("classification_report", """SELECT asset, COUNT(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, COUNT(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, COUNT(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, COUNT(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, COUNT(*) AS n_obs,
  COUNT(*) FILTER (WHERE p >= 0.5) AS n_signals, round(AVG(y), 6)+0.0 AS base_rate, round(AVG(POW(p - y, 2)), 6)+0.0 AS brier, round(COUNT(*) FILTER (WHERE p >= 0.5 AND y = 1)/NULLIF(COUNT(*) FILTER (WHERE p >= 0.5), 0), 6)+0.0 AS precision,
  round(COUNT(*) FILTER (WHERE p >= 0.5 AND y = 1)/NULLIF(COUNT(*) FILTER (WHERE y = 1), 0), 6)+0.0 AS recall FROM auc_m GROUP BY 1""")
def _(t):
    return out(FC.classification_report(auc_input(t), ["asset"]), "base_rate", "brier", "precision", "recall", keys=("asset", "tp", "fp", "fn", "tn", "n_obs", "n_signals"))


view("yr_g", "SELECT strategy, YEAR(d) AS y, d, r, product(1 + r) OVER (PARTITION BY strategy, YEAR(d) ORDER BY d) AS g FROM strat_m")


@query("yearly_returns", """WITH x AS (SELECT *, g/MAX(g) OVER (PARTITION BY strategy, y ORDER BY d) - 1 AS dd FROM yr_g) SELECT strategy, y, round(product(1 + r) - 1, 6)+0.0 AS ret, round(MIN(dd), 6)+0.0 AS worst_drawdown FROM x GROUP BY 1, 2""")
def _(t):
    x = T.drawdown(t.strat_m.withColumn("y", F.year("d")), ["strategy", "y"])
    return out(x.groupBy("strategy", "y").agg((F.product(1.0 + F.col("r")) - 1.0).alias("ret"), F.min("dd").alias("worst_drawdown")), "ret", "worst_drawdown", keys=("strategy", "y"))


@query("episode_returns", """WITH s AS (SELECT * FROM span_m WHERE span <> 'full'), g AS (SELECT *, product(1 + r) OVER (PARTITION BY strategy, span ORDER BY d) AS g FROM s), x AS (SELECT *, g/MAX(g) OVER (PARTITION BY strategy, span ORDER BY d) - 1 AS dd FROM g)
  SELECT strategy, span, round(product(1 + r) - 1, 6)+0.0 AS ret, round(MIN(dd), 6)+0.0 AS worst_drawdown FROM x GROUP BY 1, 2""")
def _(t):
    x = T.drawdown(M.with_windows(t.strat_m, {k: v for k, v in SPANS.items() if v}), ["strategy", "span"])
    return out(x.groupBy("strategy", "span").agg((F.product(1.0 + F.col("r")) - 1.0).alias("ret"), F.min("dd").alias("worst_drawdown")), "ret", "worst_drawdown", keys=("strategy", "span"))
