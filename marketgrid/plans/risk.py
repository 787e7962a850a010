"""Queries: covariance, breadth, weighting rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.expr import expanding, r6, win
from ..operators import align as A
from ..operators import covariance as V
from ..operators import crosssection as X
from ..operators import hierarchy
from ..operators import weights as P
from ..session import stored
from .registry import QUERIES, query, view, views
from .series import out, sq
from .sqlmath import erc_views

U = ["universe"]


def ex_m(t):
    """Excess returns of one universe, complete dates."""
    x = t.excess_m.withColumn("universe", F.lit("all"))
    return stored(A.complete_dates(x, U, "x"))


def ex_q(t):
    """Quarterly returns of many universes, pairwise complete."""
    return stored(t.univ_ret_q.filter("r is not null").select("universe", "asset", "d", F.col("r").alias("x")))


def due(first: int, every: int):
    return (F.col("rn") >= first) & ((F.col("rn") == first) | (F.col("rn") % every == 0))


def lw_views(prefix: str, src: str, key: str) -> None:
    """SQL of the shrinkage on a relation (key, d, asset, x) of complete dates."""
    view(f"{prefix}_c", f"SELECT {key}, d, asset, x - AVG(x) OVER (PARTITION BY {key}, asset) AS x FROM {src}")
    view(f"{prefix}_p", f"""SELECT a.{key}, a.asset AS i, b.asset AS j, COUNT(*) AS t, AVG(a.x*b.x) AS s, AVG(a.x*a.x*b.x*b.x) AS m22, AVG(a.x*a.x*a.x*b.x) AS m31,
      AVG(a.x*a.x) AS vi, AVG(b.x*b.x) AS vj FROM {prefix}_c a JOIN {prefix}_c b ON a.{key} = b.{key} AND a.d = b.d GROUP BY 1, 2, 3""")
    view(f"{prefix}_r", f"SELECT {key}, AVG(s/sqrt(vi*vj)) FILTER (WHERE i <> j) AS rbar FROM {prefix}_p GROUP BY 1")
    view(f"{prefix}_k", f"""SELECT p.{key}, ANY_VALUE(rbar) AS rbar, ANY_VALUE(t) AS t, SUM(m22 - s*s) AS pi, SUM(m22 - s*s) FILTER (WHERE i = j) AS pid,
      SUM(sqrt(vi/vj)*(m31 - vi*s)) FILTER (WHERE i <> j) AS tr, SUM(sqrt(vj/vi)*(m31 - vi*s)) FILTER (WHERE i <> j) AS td,
      SUM(POW(rbar*sqrt(vi*vj) - s, 2)) FILTER (WHERE i <> j) AS gam FROM {prefix}_p p JOIN {prefix}_r r ON p.{key} = r.{key} GROUP BY 1""")
    view(f"{prefix}_d", f"SELECT {key}, rbar, t, least(greatest((pi - pid - rbar*tr)/gam/t, 0), 1) AS delta, least(greatest((pi - pid - rbar*td)/gam/t, 0), 1) AS delta_dm FROM {prefix}_k")
    view(prefix, f"""SELECT p.{key}, i, j, p.t AS n, delta, delta_dm, s AS s0, delta*CASE WHEN i = j THEN s ELSE rbar*sqrt(vi*vj) END + (1 - delta)*s AS s,
      delta_dm*CASE WHEN i = j THEN s ELSE rbar*sqrt(vi*vj) END + (1 - delta_dm)*s AS s_dm FROM {prefix}_p p JOIN {prefix}_d g ON p.{key} = g.{key} WHERE i <= j""")


view("ex_one", "SELECT 'all' AS universe, asset, d, x FROM ex_c")
view("ex_rn", "SELECT *, dense_rank() OVER (ORDER BY d) - 1 AS rn FROM ex_one")
lw_views("lw_all", "ex_one", "universe")
# epochs: rows 24, then every 12th, expanding and 36-row histories
view("ep_m", "SELECT DISTINCT d AS ed, rn AS ern FROM ex_rn WHERE rn >= 24 AND (rn = 24 OR rn % 12 = 0)")
view("hist_m", "SELECT e.ed, x.asset, x.d, x.x FROM ep_m e JOIN ex_rn x ON x.rn < e.ern")
view("hist_roll", "SELECT e.ed, x.asset, x.d, x.x FROM ep_m e JOIN ex_rn x ON x.rn < e.ern AND x.rn >= e.ern - 36")
lw_views("lw_ep", "hist_m", "ed")
lw_views("lw_roll", "hist_roll", "ed")


@query("cov_sample", """SELECT a.universe, a.asset AS i, b.asset AS j, COUNT(*)::DOUBLE AS n, round(covar_samp(a.r, b.r)*4, 6)+0.0 AS s FROM univ_ret_q a JOIN univ_ret_q b
  ON a.universe = b.universe AND a.d = b.d AND a.asset <= b.asset WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    return out(V.cov_sample(ex_q(t), U, ppy=4), "s", keys=("universe", "i", "j", "n"))


@query("cov_ledoit_wolf", "SELECT i, j, round(delta, 6)+0.0 AS delta, round(delta_dm, 6)+0.0 AS delta_dm, round(s*12, 6)+0.0 AS s, round(s_dm*12, 6)+0.0 AS s_dm FROM lw_all")
def _(t):
    pairs = V.total(V.pair_sums(ex_m(t), U), U)
    a = V.ledoit_wolf(pairs, U)
    b = V.ledoit_wolf(pairs, U, ratio="delta_method").select("i", "j", F.col("s").alias("s_dm"), F.col("delta").alias("delta_dm"))
    return out(a.join(b, ["i", "j"]), "delta", "delta_dm", "s", "s_dm", keys=("i", "j"))


@query("shrinkage_intensity", """WITH c AS (SELECT a.asset AS i, b.asset AS j, covar_samp(a.x, b.x) AS cs FROM ex_one a JOIN ex_one b USING (d) WHERE a.asset <= b.asset GROUP BY 1, 2)
  SELECT round(sqrt(SUM(CASE WHEN i = j THEN 1 ELSE 2 END*POW(s - cs, 2)))/(sqrt(SUM(CASE WHEN i = j THEN 1 ELSE 2 END*cs*cs)) + 1e-12), 6)+0.0 AS intensity FROM lw_all JOIN c USING (i, j)""")
def _(t):
    pairs = V.total(V.pair_sums(ex_m(t), U), U)
    return out(V.shrinkage_intensity(pairs, U), "intensity", keys=())


@query("cov_ewma", """WITH w AS (SELECT asset, x, d, POW(0.97, (SELECT MAX(rn) FROM ex_rn) - rn) AS w FROM ex_rn), m AS (SELECT asset, SUM(w*x)/SUM(w) AS mu FROM w GROUP BY 1)
  SELECT a.asset AS i, b.asset AS j, round(SUM(a.w*(a.x - ma.mu)*(b.x - mb.mu))/SUM(a.w)*12, 6)+0.0 AS s FROM w a JOIN w b ON a.d = b.d AND a.asset <= b.asset
  JOIN m ma ON ma.asset = a.asset JOIN m mb ON mb.asset = b.asset GROUP BY 1, 2""")
def _(t):
    return out(V.cov_ewma(ex_m(t), U), "s", keys=("i", "j"))


@query("cov_windowed", "SELECT 'expanding' AS span, ed AS d, i, j, round(s*12, 6)+0.0 AS s FROM lw_ep UNION ALL SELECT 'rolling', ed, i, j, round(s*12, 6)+0.0 FROM lw_roll")
def _(t):
    x = ex_m(t)
    a = V.cov_windowed(x, U, due(24, 12)).withColumn("span", F.lit("expanding"))
    b = V.cov_windowed(x, U, due(24, 12), lookback=36).withColumn("span", F.lit("rolling"))
    return out(a.unionByName(b), "s", keys=("span", "d", "i", "j"))


view("lab_m", "SELECT d, CASE WHEN LAG(r) OVER (ORDER BY d) > 0 THEN 'up' WHEN LAG(r) OVER (ORDER BY d) <= 0 THEN 'down' END AS label FROM bench_m")


def lab_m(t):
    p = F.lag("r").over(win(["asset"]))
    return t.bench_m.select("d", F.when(p > 0, "up").when(p <= 0, "down").alias("label"))


view("hist_lab0", "SELECT h.*, l.label = e.label AS same FROM hist_m h JOIN lab_m l ON l.d = h.d JOIN lab_m e ON e.d = h.ed")
view("hist_cnt", "SELECT ed, COUNT(DISTINCT d) FILTER (WHERE same) AS k FROM hist_lab0 GROUP BY 1")
view("hist_lab", "SELECT h.ed, h.asset, h.d, h.x FROM hist_lab0 h JOIN hist_cnt c ON c.ed = h.ed WHERE k < 16 OR same")
lw_views("lw_lab", "hist_lab", "ed")


@query("cov_regime", "SELECT ed AS d, i, j, CASE WHEN k >= 16 THEN 'regime' ELSE 'all' END AS scope, round(s*12, 6)+0.0 AS s FROM lw_lab JOIN hist_cnt USING (ed)")
def _(t):
    return out(V.cov_regime(ex_m(t), lab_m(t), U, due(24, 12), min_regime=16), "s", keys=("d", "i", "j", "scope"))


@query("cov_refit_cadence", """WITH e AS (SELECT DISTINCT d, rn FROM ex_rn WHERE rn >= 24), k AS (SELECT d, 24 + 12*((rn - 24)//12) AS ern FROM e)
  SELECT k.d, round(AVG(x.x), 6)+0.0 AS mean_x, COUNT(DISTINCT x.d) AS n FROM k JOIN ex_rn x ON x.rn < k.ern GROUP BY 1""")
def _(t):
    x = ex_m(t)
    cal = V.calendar(x, U).withColumn("epoch", V.refit_epoch(F.col("rn"), 24, 12))
    rows = x.join(cal, ["universe", "d"])
    per = rows.groupBy("universe", F.coalesce(F.col("epoch") + 1, F.lit(0)).alias("epoch")).agg(F.sum("x").alias("s"), F.count("x").alias("c"), F.countDistinct("d").alias("k"))
    w = expanding(win(["universe"], "epoch"))
    cum = per.select("universe", "epoch", (F.sum("s").over(w) / F.sum("c").over(w)).alias("mean_x"), F.sum("k").over(w).alias("n"))
    return cal.filter("epoch is not null").join(cum, ["universe", "epoch"]).select("d", r6("mean_x").alias("mean_x"), "n")


_NW = """WITH l AS (SELECT asset, x, """ + ", ".join(f"LAG(x, {k}) OVER (PARTITION BY asset ORDER BY d) AS l{k}" for k in range(1, 6)) + """ FROM excess_m)
  SELECT asset, round(greatest(1 + """ + " + ".join(f"2*(1 - {k}/6.0)*corr(x, l{k})" for k in range(1, 6)) + ", 0.25), 6)+0.0 AS nw FROM l GROUP BY 1"
view("nw_m", _NW.replace("round(", "(").replace(", 6)+0.0", ")"))


@query("nw_variance_factor", _NW)
def _(t):
    return out(V.nw_variance_factor(t.excess_m, ["asset"], min_obs=60), "nw", keys=("asset",))


@query("cov_stale_adjust", "SELECT i, j, round(s*12*sqrt(a.nw*b.nw), 6)+0.0 AS s FROM lw_all JOIN nw_m a ON a.asset = i JOIN nw_m b ON b.asset = j")
def _(t):
    x = ex_m(t)
    nw = V.nw_variance_factor(x, ["universe", "asset"], min_obs=60)
    return out(V.cov_stale_adjust(V.ledoit_wolf(V.total(V.pair_sums(x, U), U), U), nw, U), "s", keys=("i", "j"))


@query("autocorr", "SELECT asset, round(corr(x, l), 6)+0.0 AS autocorr FROM (SELECT asset, x, LAG(x, 1) OVER (PARTITION BY asset ORDER BY d) AS l FROM excess_m) GROUP BY 1")
def _(t):
    return out(V.autocorr(t.excess_m, ["asset"]), "autocorr", keys=("asset",))


view("rho_q", """SELECT a.universe, a.asset AS i, b.asset AS j, CASE WHEN a.asset = b.asset THEN 1 WHEN stddev_pop(a.r) > 0 AND stddev_pop(b.r) > 0 THEN corr(a.r, b.r) END AS rho FROM univ_ret_q a JOIN univ_ret_q b
  ON a.universe = b.universe AND a.d = b.d AND a.asset <= b.asset WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2, 3""")


@query("corr_matrix", sq({"rho": "rho"}, "rho_q", "universe, i, j"))
def _(t):
    return out(V.corr_matrix(ex_q(t), U), "rho", keys=("universe", "i", "j"))


@query("mean_pair_corr", "SELECT universe, round(AVG(rho), 6)+0.0 AS mean_rho FROM rho_q WHERE i <> j GROUP BY 1")
def _(t):
    return out(V.mean_pair_corr(V.corr_matrix(ex_q(t), U), U), "mean_rho", keys=("universe",))


@query("participation_ratio", "SELECT universe, COUNT(*) FILTER (WHERE i = j) AS n_assets, round(POW(COUNT(*) FILTER (WHERE i = j), 2)/SUM(CASE WHEN i = j THEN 1 ELSE 2*rho*rho END), 6)+0.0 AS participation_ratio FROM rho_q GROUP BY 1")
def _(t):
    return out(V.participation_ratio(V.corr_matrix(ex_q(t), U), U), "participation_ratio", keys=("universe", "n_assets"))


@query("corr_eigen")
def _(t):
    return out(V.corr_eigen(V.corr_matrix(ex_q(t), U), U), "eigenvalue", "share", "cumulative", keys=("universe", "rank"))


@query("risk_share", "WITH v AS (SELECT asset, var_samp(x) AS v FROM excess_m GROUP BY 1) SELECT asset, round(v/SUM(v) OVER (), 6)+0.0 AS risk_share FROM v")
def _(t):
    return out(V.risk_share(t.excess_m.withColumn("universe", F.lit("all")), U), "risk_share", keys=("asset",))


def with_rf(t):
    return t.ret_m.filter("r is not null").join(t.rf_m, "d").withColumn("universe", F.lit("all"))


@query("moments", "SELECT asset, round(AVG(r - rf)*12, 6)+0.0 AS mu, round(POW(product(1 + r), 12.0/COUNT(r)) - 1, 6)+0.0 AS geometric FROM strat_m JOIN (SELECT DISTINCT asset FROM ret_m) ON asset = strategy GROUP BY 1")
def _(t):
    return out(V.moments(with_rf(t), U), "mu", "geometric", keys=("asset",))


@query("portfolio_stats", """WITH w AS (SELECT asset, CASE asset WHEN 'PROMO' THEN 0.3 ELSE 0.1 END AS w FROM (SELECT DISTINCT asset FROM ret_m)), c AS (SELECT a.asset AS i, b.asset AS j, covar_samp(a.x, b.x)*12 AS s FROM ex_c a JOIN ex_c b USING (d) GROUP BY 1, 2),
  r AS (SELECT SUM(w*mu) AS e, 1 - SUM(w) AS cash FROM w JOIN (SELECT asset, AVG(x)*12 AS mu FROM excess_m GROUP BY 1) USING (asset)), v AS (SELECT sqrt(SUM(a.w*b.w*s)) AS vol FROM c JOIN w a ON a.asset = i JOIN w b ON b.asset = j)
  SELECT round(e, 6)+0.0 AS exp_excess_return, round(cash, 6)+0.0 AS cash_weight, round(vol, 6)+0.0 AS vol, round(e/vol, 6)+0.0 AS sharpe FROM r, v""")
def _(t):
    x = ex_m(t)
    w = x.select("universe", "asset").distinct().withColumn("w", F.when(F.col("asset") == "PROMO", 0.3).otherwise(0.1))
    return out(V.portfolio_stats(w, V.moments(with_rf(t), U), V.cov_sample(x, U), U), "exp_excess_return", "cash_weight", "vol", "sharpe", keys=())


# ---- weighting rules ----

KD = ["universe", "d"]


def lw_epochs(t):
    return V.cov_windowed(ex_m(t), U, due(24, 12))


@query("equal_weight", "SELECT universe, d, asset, round(1.0/COUNT(*) OVER (PARTITION BY universe, d), 6)+0.0 AS w FROM univ_ret_q WHERE r IS NOT NULL")
def _(t):
    return out(P.equal_weight(ex_q(t), KD), "w", keys=("universe", "d", "asset"))


@query("inverse_vol", "WITH v AS (SELECT ed AS d, i AS asset, 1/greatest(sqrt(s*12), 1e-9) AS iv FROM lw_ep WHERE i = j) SELECT d, asset, round(iv/SUM(iv) OVER (PARTITION BY d), 6)+0.0 AS w FROM v")
def _(t):
    return out(P.inverse_vol(lw_epochs(t), KD), "w", keys=("d", "asset"))


views(erc_views("erc_ep", "SELECT ed AS k, i, j, s FROM lw_ep"))


@query("erc", "SELECT k AS d, asset, round(w, 6)+0.0 AS w FROM erc_ep")
def _(t):
    return out(P.cov_rule(lw_epochs(t), KD, "erc"), "w", keys=("d", "asset"))


@query("hrp")
def _(t):
    return out(hierarchy.hrp(lw_epochs(t), KD), "w", keys=("d", "asset"))


@query("group_risk_budget")
def _(t):
    groups = t.dim([("ECONOMY", "a"), ("LARGE", "a"), ("MEDIUM", "b"), ("PROMO", "b"), ("SMALL", "c"), ("STANDARD", "c")], "asset string, grp string")
    return out(P.group_risk_budget(lw_epochs(t), groups, KD), "w", keys=("d", "asset"))


@query("min_variance_clip")
def _(t):
    return out(P.cov_rule(lw_epochs(t), KD, "min_variance"), "w", keys=("d", "asset"))


@query("max_diversification_clip")
def _(t):
    return out(P.cov_rule(lw_epochs(t), KD, "max_diversification"), "w", keys=("d", "asset"))


@query("mean_variance_gross")
def _(t):
    x = ex_m(t)
    cov = V.cov_windowed(x, U, due(24, 12))
    w = win(["universe", "asset"])
    mu = x.select("universe", "asset", "d", (F.avg("x").over(expanding(w, 1)) * 12).alias("mu"))
    return out(P.mean_variance(cov, mu, KD), "w", keys=("d", "asset"))


@query("weight_fn_cov", "SELECT ed AS d, i AS asset, round((1/s)/SUM(1/s) OVER (PARTITION BY ed), 6)+0.0 AS w FROM lw_ep WHERE i = j")
def _(t):
    return out(P.cov_rule(lw_epochs(t), KD, lambda s: np.diag(1.0 / s) / np.diag(1.0 / s).sum()), "w", keys=("d", "asset"))


@query("rule_registry")
def _(t):
    w = P.cov_rules(lw_epochs(t), KD, ["equal", "inverse_vol", "erc", "hrp"])
    return out(w, "w", keys=("d", "rule", "asset"))


# ---- checks of the solvers by the conditions that define their weights ----


def with_risk(cov, w):
    """Weights w with the covariance-weighted sum of all weights beside each: (universe, d, asset, w, sw)."""
    full = V.mirror(cov.select(*KD, "i", "j", "s"), ["s"])
    sw = full.join(w.select(*KD, F.col("asset").alias("j"), F.col("w").alias("_w")), [*KD, "j"]).groupBy(*KD, F.col("i").alias("asset")).agg(F.sum(F.col("s") * F.col("_w")).alias("sw"))
    return w.join(sw, [*KD, "asset"])


def solved(t, rule, raw):
    """The rule's weights with the unclipped solution and its product with the matrix."""
    cov = stored(lw_epochs(t))
    r = with_risk(cov, stored(P.cov_rule(cov, KD, raw))).select(*KD, "asset", F.col("w").alias("raw"), "sw")
    sd = cov.filter("i = j").select(*KD, F.col("i").alias("asset"), F.sqrt("s").alias("sd"))
    return stored(P.cov_rule(cov, KD, rule)).join(r, [*KD, "asset"]).join(sd, [*KD, "asset"])


_ASSETS = "SELECT ed AS d, i AS asset, {} FROM lw_ep WHERE i = j"


@query("erc_check", _ASSETS.format("round(1.0/COUNT(*) OVER (PARTITION BY ed), 6)+0.0 AS risk_share, 1.0::DOUBLE AS total"))
def _(t):
    """Equal-risk weights: every asset has the same share of the variance, and weights sum to one."""
    cov = stored(lw_epochs(t))
    w = with_risk(cov, stored(P.cov_rule(cov, KD, "erc"))).withColumn("rc", F.col("w") * F.col("sw"))
    one = X.over(KD)
    return out(w.withColumn("risk_share", F.col("rc") / F.sum("rc").over(one)).withColumn("total", F.sum("w").over(one)), "risk_share", "total", keys=("d", "asset"))


@query("group_risk_budget_check", _ASSETS.format("round(1.0/COUNT(*) OVER (PARTITION BY ed, CASE WHEN i < 'M' THEN 'a' WHEN i < 'S' THEN 'b' ELSE 'c' END), 6)+0.0 AS inner_share, 1.0::DOUBLE AS group_vol, 1.0::DOUBLE AS total"))
def _(t):
    """Risk is equal inside each group, the groups' own volatilities are equal, and weights sum to one."""
    names = [("ECONOMY", "a"), ("LARGE", "a"), ("MEDIUM", "b"), ("PROMO", "b"), ("SMALL", "c"), ("STANDARD", "c")]
    g = t.dim(names, "asset string, grp string")
    cov = stored(lw_epochs(t))
    w = stored(P.group_risk_budget(cov, g, KD)).join(g, "asset")
    inside = cov.join(g.select(F.col("asset").alias("i"), F.col("grp").alias("gi")), "i").join(g.select(F.col("asset").alias("j"), F.col("grp").alias("gj")), "j").filter("gi = gj")
    r = with_risk(inside, w).withColumn("rc", F.col("w") * F.col("sw"))
    one, grp = X.over(KD), X.over([*KD, "grp"])
    r = r.withColumn("v", F.sqrt(F.sum("rc").over(grp))).withColumn("inner_share", F.col("rc") / F.sum("rc").over(grp))
    return out(r.withColumn("group_vol", F.col("v") / F.max("v").over(one)).withColumn("total", F.sum("w").over(one)), "inner_share", "group_vol", "total", keys=("d", "asset"))


@query("min_variance_check", _ASSETS.format("1.0::DOUBLE AS first_order, 0.0::DOUBLE AS gap"))
def _(t):
    """The unclipped solution has equal marginal variances; the weights are its positive part, scaled to one."""
    s = solved(t, "min_variance", lambda m: np.linalg.solve(m, np.ones(len(m))))
    long = F.greatest(F.col("raw") * F.signum(F.sum("raw").over(X.over(KD))), F.lit(0.0))
    s = s.withColumn("_l", long).withColumn("gap", F.col("w") - F.col("_l") / F.sum("_l").over(X.over(KD)))
    return out(s.withColumn("first_order", F.col("sw")), "first_order", "gap", keys=("d", "asset"))


@query("max_diversification_check", _ASSETS.format("1.0::DOUBLE AS first_order, 0.0::DOUBLE AS gap"))
def _(t):
    """The unclipped solution's marginal variances are the volatilities; the weights are its positive part."""
    s = solved(t, "max_diversification", lambda m: np.linalg.solve(m, np.sqrt(np.diag(m))))
    s = s.withColumn("_l", F.greatest("raw", F.lit(0.0))).withColumn("gap", F.col("w") - F.col("_l") / F.sum("_l").over(X.over(KD)))
    return out(s.withColumn("first_order", F.col("sw") / F.col("sd")), "first_order", "gap", keys=("d", "asset"))


@query("mean_variance_check", "WITH m AS (SELECT e.ed, h.asset, AVG(h.x)*12 AS mu FROM ep_m e JOIN hist_m h ON h.ed = e.ed GROUP BY 1, 2) SELECT ed AS d, asset, round(mu, 6)+0.0 AS mu, TRUE AS within FROM m")
def _(t):
    """Weights times the matrix point along the means, with a gross exposure of at most two."""
    x = ex_m(t)
    cov = stored(V.cov_windowed(x, U, due(24, 12)))
    mu = x.select("universe", "asset", "d", (F.avg("x").over(expanding(win(["universe", "asset"]), 1)) * 12).alias("m"))
    w = with_risk(cov, stored(P.mean_variance(cov, mu.withColumnRenamed("m", "mu"), KD))).join(mu, [*KD, "asset"])
    one = X.over(KD)
    scale = F.sum(F.col("sw") * F.col("m")).over(one) / F.sum(F.col("sw") * F.col("sw")).over(one)
    return out(w.withColumn("mu", F.col("sw") * scale).withColumn("within", F.sum(F.abs("w")).over(one) <= 2.0 + 1e-9), "mu", keys=("d", "asset", "within"))


@query("hrp_check", """SELECT ed AS d, COUNT(*) AS assets, 1.0::DOUBLE AS total, TRUE AS positive, 0.0::DOUBLE AS gap FROM lw_ep WHERE i = j GROUP BY 1""")
def _(t):
    """Hierarchical weights are positive, sum to one, and agree with those from whole small matrices."""
    cov = stored(lw_epochs(t))
    whole = P.cov_rule(cov, KD, "hrp").withColumnRenamed("w", "_whole")
    w = hierarchy.hrp(cov, KD).join(whole, [*KD, "asset"])
    return w.groupBy("d").agg(F.count("*").alias("assets"), r6(F.sum("w")).alias("total"), F.min(F.col("w") > 0).alias("positive"), r6(F.max(F.abs(F.col("w") - F.col("_whole")))).alias("gap"))


@query("rule_registry_check", """WITH v AS (SELECT ed AS d, 1/greatest(sqrt(s*12), 1e-9) AS iv FROM lw_ep WHERE i = j), h AS (SELECT d, SUM(iv*iv)/POW(SUM(iv), 2) AS c, COUNT(*) AS n FROM v GROUP BY 1)
  SELECT d, 'equal' AS rule, round(1.0/n, 6)+0.0 AS concentration, 1.0::DOUBLE AS total FROM h UNION ALL SELECT d, 'inverse_vol', round(c, 6)+0.0, 1.0 FROM h""")
def _(t):
    w = P.cov_rules(lw_epochs(t), KD, ["equal", "inverse_vol"])
    return w.groupBy("d", "rule").agg(r6(F.sum(F.col("w") * F.col("w"))).alias("concentration"), r6(F.sum("w")).alias("total"))


@query("corr_eigen_check", """WITH f AS (SELECT universe, i, j, CASE WHEN i = j THEN 1 ELSE rho END AS r FROM rho_q UNION ALL SELECT universe, j, i, rho FROM rho_q WHERE i <> j), q AS (SELECT a.universe, a.i, b.j, SUM(a.r*b.r) AS r FROM f a JOIN f b ON a.universe = b.universe AND a.j = b.i GROUP BY 1, 2, 3)
  SELECT f.universe, round(SUM(CASE WHEN f.i = f.j THEN f.r ELSE 0 END), 3)+0.0 AS trace, round(SUM(f.r*f.r), 3)+0.0 AS squares, round(SUM(f.r*q.r), 3)+0.0 AS cubes FROM f JOIN q ON q.universe = f.universe AND q.i = f.j AND q.j = f.i GROUP BY 1""")
def _(t):
    """Power sums of the eigenvalues against traces of the matrix powers."""
    e = QUERIES["corr_eigen"](t.spark, t.sf_dir)
    p = lambda k: r6(F.sum(F.pow("eigenvalue", F.lit(k))), 3)
    return e.groupBy("universe").agg(p(1.0).alias("trace"), p(2.0).alias("squares"), p(3.0).alias("cubes"))
