"""Queries: forecasts, model training, forecast targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.expr import r6, roll_std, win
from ..operators import align as A
from ..operators import forecast as FC
from ..operators import learn as L
from ..operators import timeseries as T
from ..session import stored
from .registry import query, view, views
from .series import F_, gd, out, sq
from .sqlmath import net_views, solve_views

MIN = 24
# lagged signals common to all assets: three-row momentum and six-row volatility of each
view("sig0", f"SELECT asset, d, {gd('product', '(1+r)', 3)} - 1 AS mom3, {gd('stddev_samp', 'r', 6)} AS rvol6 FROM ret_m")
view("sig1", "SELECT 'mom3_' || asset AS signal, d, LAG(mom3) OVER (PARTITION BY asset ORDER BY d) AS x FROM sig0 UNION ALL SELECT 'rvol6_' || asset, d, LAG(rvol6) OVER (PARTITION BY asset ORDER BY d) FROM sig0")
view("fx", "SELECT e.asset, s.signal, e.d, s.x, e.x AS y, row_number() OVER (PARTITION BY e.asset, s.signal ORDER BY e.d) AS i FROM excess_m e JOIN sig1 s USING (d)")
# direct regressions on all earlier pairs
view("fpair", "SELECT *, row_number() OVER (PARTITION BY asset, signal ORDER BY d) AS k FROM fx WHERE x IS NOT NULL")
view("fcoef", """SELECT a.asset, a.signal, a.d, CASE WHEN COUNT(*) >= 24 THEN CASE WHEN var_pop(b.x) > 1e-14 THEN covar_pop(b.x, b.y)/var_pop(b.x) ELSE 0 END END AS b, AVG(b.x) AS mx, AVG(b.y) AS my
  FROM fpair a JOIN fpair b ON a.asset = b.asset AND a.signal = b.signal AND b.k <= a.k - 1 GROUP BY 1, 2, 3""")
view("fc_m", "SELECT f.asset, f.signal, f.d, f.x, f.y, c.my - c.b*c.mx + c.b*f.x AS forecast FROM fx f LEFT JOIN fcoef c ON c.asset = f.asset AND c.signal = f.signal AND c.d = f.d")
view("bench_fc", "SELECT asset, d, x AS y, CASE WHEN COUNT(x) OVER w >= 24 THEN AVG(x) OVER w END AS bench FROM excess_m WINDOW w AS (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


def signals(t):
    w = win(["asset"])
    base = t.ret_m.select("asset", "d", T.momentum("r", w, 3).alias("mom3"), roll_std("r", w, 6).alias("rvol6"))
    long = base.unpivot(["asset", "d"], ["mom3", "rvol6"], "kind", "x").select(F.concat_ws("_", "kind", "asset").alias("signal"), "d", "x")
    return T.lag_panel(long, ["signal"])


def target(t):
    return t.excess_m.withColumnRenamed("x", "y")


def panel(t):
    return target(t).join(signals(t), "d")


def forecasts(t):
    return FC.univariate_forecasts(panel(t), ["asset", "signal"], min_obs=MIN)


def bench(t):
    return FC.prevailing_mean(target(t), ["asset"], min_obs=MIN)


K = ("asset", "signal", "d")


@query("prevailing_mean", sq({"bench": "bench"}, "bench_fc"))
def _(t):
    return out(bench(t), "bench")


@query("univariate_forecasts", sq({"forecast": "forecast"}, "fc_m", "asset, signal, d"))
def _(t):
    return out(forecasts(t), "forecast", keys=K)


@query("combine_forecasts", """WITH q AS (SELECT asset, d, AVG(forecast) AS m, quantile_cont(forecast, 0.5) AS md, quantile_cont(forecast, 0.1) AS lo, quantile_cont(forecast, 0.9) AS hi FROM fc_m GROUP BY 1, 2),
  tr AS (SELECT f.asset, f.d, AVG(forecast) FILTER (WHERE forecast BETWEEN lo - 1e-15 AND hi + 1e-15) AS tm FROM fc_m f JOIN q USING (asset, d) GROUP BY 1, 2)
  SELECT asset, d, round(m, 6)+0.0 AS mean_f, round(md, 6)+0.0 AS median_f, round(tm, 6)+0.0 AS trimmed_f FROM q JOIN tr USING (asset, d)""")
def _(t):
    f = stored(forecasts(t))
    parts = [FC.combine(f, ["asset", "d"], method=m).withColumnRenamed("pooled", f"{m}_f") for m in ("mean", "median", "trimmed")]
    return out(A.align_outer(parts, ["asset", "d"]), "mean_f", "median_f", "trimmed_f")


@query("campbell_thompson", "SELECT asset, signal, f.d, round(CASE WHEN forecast IS NOT NULL THEN greatest(least(greatest(forecast, bench - 0.01), bench + 0.01), 0) END, 6)+0.0 AS f FROM fc_m f JOIN bench_fc b USING (asset, d)")
def _(t):
    j = forecasts(t).join(bench(t).drop("y"), ["asset", "d"])
    return out(j.withColumn("f", FC.campbell_thompson("forecast", "bench", 0.0, 0.01)), "f", keys=K)


@query("forecast_edges", "SELECT asset, d, round(AVG(forecast), 6)+0.0 AS pooled FROM fc_m GROUP BY 1, 2")
def _(t):
    return out(FC.forecast_edges(target(t), signals(t), min_obs=MIN), "pooled")


view("feat_m", "SELECT asset, signal, abs(corr(x, y)) AS s FROM fx WHERE d <= DATE '1998-12-31' GROUP BY 1, 2")


@query("select_features", """SELECT asset, signal, rank, round(s, 6)+0.0 AS strength FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY s DESC, signal) AS rank FROM feat_m) WHERE rank <= 5""")
def _(t):
    return out(FC.select_features(panel(t).filter("d <= date'1998-12-31'"), ["asset"], 5), "strength", keys=("asset", "signal", "rank"))


@query("purged_split", "SELECT d, rn AS pos, CASE WHEN rn - 1 - 12 >= 24 THEN rn - 1 - 12 END AS train_end FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS rn FROM (SELECT DISTINCT d FROM excess_m))")
def _(t):
    cal = t.excess_m.select(F.lit("all").alias("u"), "d").distinct().withColumn("pos", F.row_number().over(win(["u"])) - 1)
    return cal.select("d", "pos", FC.purged_end(F.col("pos"), 1, 12, 24).alias("train_end"))


@query("interactions", """WITH c AS (SELECT signal, abs(corr(COALESCE(s.x, 0), m.y)) AS s FROM sig1 s JOIN (SELECT d, AVG(x) AS y FROM excess_m GROUP BY 1) m USING (d) GROUP BY 1 HAVING COUNT(s.x) > 60),
  k AS (SELECT signal FROM c ORDER BY s DESC, signal LIMIT 3), l AS (SELECT asset AS who, d, regime FROM label_m),
  g AS (SELECT unnest(['goldilocks', 'reflation', 'stagflation', 'deflation']) AS st)
  SELECT who AS asset, signal || ' x ' || st AS signal, d, round(x*CASE WHEN lower(regime) = st THEN 1 ELSE 0 END, 6)+0.0 AS x FROM sig1 JOIN k USING (signal) JOIN l USING (d), g""")
def _(t):
    from .series import label_m

    s = stored(signals(t))
    y = t.excess_m.groupBy("d").agg(F.avg("x").alias("y"))
    top = FC.select_features(s.join(y, "d").withColumn("u", F.lit("all")), ["u"], 3, fill=True, min_known=60)
    lab = stored(label_m(t).select("asset", "d", "regime"))
    best = s.join(top.select("signal"), "signal", "left_semi").select("signal", "d", "x").join(lab.select("asset", "d"), "d")
    return out(T.interactions(best, T.regime_dummies(lab, ["asset", "d"]), ["asset", "d"]), "x", keys=("asset", "signal", "d"))


@query("forward_sum_target", f"SELECT asset, d, round({gd('SUM', 'x', 3)}, 6)+0.0 AS target FROM excess_m")
def _(t):
    return out(FC.forward_sum_target(t.excess_m, ["asset"], "x", 3), "target")


view("evt", "SELECT asset, d, CASE WHEN r IS NULL THEN NULL WHEN r < -0.1 THEN 1.0 ELSE 0.0 END AS y, r FROM ret_m")
view("evt_f", "SELECT asset, d, y, r, CASE WHEN LEAD(1, 5) OVER (PARTITION BY asset ORDER BY d) IS NOT NULL THEN MAX(y) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) END AS target FROM evt")


def evt(t):
    return t.ret_m.select("asset", "d", F.when(F.col("r") < -0.1, 1.0).when(F.col("r").isNotNull(), 0.0).alias("y"), "r")


@query("forward_event_target", sq({"target": "target"}, "evt_f"))
def _(t):
    return out(FC.forward_event_target(evt(t), ["asset"], "y", 6), "target")


@query("visible_target", "SELECT asset, d, round(LAG(target, 12) OVER (PARTITION BY asset ORDER BY d), 6)+0.0 AS target FROM evt_f")
def _(t):
    return out(FC.visible_target(evt(t), ["asset"], "y", 6), "target")


@query("recession_labels", "SELECT asset, last_day(d) AS d, CASE WHEN arg_max(px, d) < 2500 THEN 1.0 ELSE 0.0 END AS flag FROM px_d GROUP BY 1, 2")
def _(t):
    from ..operators import dates as D

    s = t.px_d.select("asset", "d", F.when(F.col("px") < 2500, 1.0).otherwise(0.0).alias("flag"))
    return A.fill_forward(D.resample_last(s, ["asset"], "flag"), ["asset"], "flag").select("asset", "d", "flag")


# ---- models ----

SPECS = [("ridge", "ridge", {"alpha": 10.0}), ("elastic_net", "elastic_net", {"alpha": 0.1, "l1_ratio": 0.5})]


def ml_inputs(t):
    p = stored(panel(t))
    return p.select("asset", "signal", "d", "x"), p.select("asset", "d", "y").distinct()


def linear(t, specs):
    x, y = ml_inputs(t)
    coefs = L.linear_coefficients(x, y, specs, min_train=30, refit_every=12, horizon=1, embargo=3)
    return L.linear_forecasts(x, stored(coefs)), y


# every refit on the complete rows before it, solved in SQL; k names the fit as asset|position
view("ml_w", "SELECT asset, d, list(x ORDER BY signal) AS xs, list(signal ORDER BY signal) AS names, COUNT(x) AS known, COUNT(*) AS width, ANY_VALUE(y) AS y, row_number() OVER (PARTITION BY asset ORDER BY d) - 1 AS rn FROM fx GROUP BY asset, d")
view("ml_e", "SELECT a.asset, a.rn, b.d AS fit, a.asset || '|' || a.rn AS k FROM ml_w a JOIN ml_w b ON b.asset = a.asset AND b.rn = a.rn + 4 WHERE a.rn >= 30 AND (a.rn - 30) % 12 = 0")
view("ml_t", "SELECT e.k, t.d, t.xs, t.y, COUNT(*) OVER (PARTITION BY e.k) AS n FROM ml_e e JOIN ml_w t ON t.asset = e.asset AND t.rn < e.rn WHERE t.known = t.width AND t.y IS NOT NULL")
view("ml_u", "SELECT k, n, d, y, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM ml_t WHERE n >= 15")
view("ml_s", "SELECT k, i, ANY_VALUE(n) AS n, AVG(x) AS mx, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sx, AVG(y) AS my, stddev_samp(y) AS sy, covar_pop(x, y) AS c FROM ml_u GROUP BY 1, 2")
view("ml_g", "SELECT a.k, a.i, b.i AS j, covar_pop(a.x, b.x) AS g FROM ml_u a JOIN ml_u b ON a.k = b.k AND a.d = b.d GROUP BY 1, 2, 3")
view("ml_m", "SELECT g.k, g.i, list(g.g/s.sx/r.sx ORDER BY g.j) AS r, ANY_VALUE(s.c/s.sx/s.sy) AS c, ANY_VALUE(s.n) AS n FROM ml_g g JOIN ml_s s ON s.k = g.k AND s.i = g.i JOIN ml_s r ON r.k = g.k AND r.i = g.j GROUP BY 1, 2")
views(solve_views("ml_ridge", "SELECT k, list(list_append(list_transform(range(1, 13), lambda j: r[j] + CASE WHEN i = j THEN 10.0/n ELSE 0 END), c) ORDER BY i) AS a FROM ml_m GROUP BY 1", 12))
views(net_views("ml_net", "SELECT k, list(r ORDER BY i) AS g, list(c ORDER BY i) AS c FROM ml_m GROUP BY 1", 12, 0.05, 0.05))
view("ml_b", "SELECT k, 'ridge' AS spec, x FROM ml_ridge UNION ALL SELECT k, 'elastic_net', x FROM ml_net")
view("ml_c", "SELECT e.asset, e.fit, b.spec, s.i, b.x[s.i] AS b, s.mx, s.sx, s.my, s.sy FROM ml_b b JOIN ml_s s USING (k) JOIN ml_e e USING (k)")
view("ml_l", "SELECT w.*, e.fit FROM ml_w w ASOF JOIN (SELECT DISTINCT asset, fit FROM ml_c) e ON e.asset = w.asset AND w.d >= e.fit")


@query("walk_forward_ml", "SELECT l.asset, c.spec, l.d, round(SUM(c.b*(l.xs[c.i] - c.mx)/c.sx)*ANY_VALUE(c.sy) + ANY_VALUE(c.my), 6)+0.0 AS forecast FROM ml_l l JOIN ml_c c ON c.asset = l.asset AND c.fit = l.fit WHERE l.known = l.width GROUP BY 1, 2, 3")
def _(t):
    f, _y = linear(t, SPECS)
    return out(f, "forecast", keys=("asset", "spec", "d"))


@query("linear_models", "SELECT c.asset, c.fit, c.spec, w.names[c.i] AS signal, round(c.b, 6)+0.0 AS b, round(c.mx, 6)+0.0 AS mx, round(c.sx, 6)+0.0 AS sx FROM ml_c c JOIN ml_w w ON w.asset = c.asset AND w.d = c.fit")
def _(t):
    x, y = ml_inputs(t)
    c = L.linear_coefficients(x, y, SPECS, min_train=30, refit_every=12, horizon=1, embargo=3)
    return out(c, "b", "mx", "sx", keys=("asset", "fit", "spec", "signal"))


def tree_wide(t):
    p = stored(panel(t))
    names = sorted(r[0] for r in p.select("signal").distinct().collect())  # a dozen signals
    return stored(p.groupBy("asset", "d", "y").pivot("signal", names).agg(F.first("x"))), names


def forest(t, specs):
    wide, names = tree_wide(t)
    return L.walk_forward_trees(wide, names, specs, min_train=30, refit_every=12, embargo=3)


@query("tune_grid")
def _(t):
    """The best parameters of every model's grid by mean out-of-sample R2."""
    specs = [(f"ridge_{p['alpha']:g}", "ridge", p) for p in L.GRIDS["ridge"]] + [(f"enet_{p['alpha']:g}_{p['l1_ratio']:g}", "elastic_net", p) for p in L.GRIDS["elastic_net"]]
    trees = [(f"forest_{p['max_depth']}", "random_forest", p) for p in L.GRIDS["random_forest"]] + [(f"boost_{p['learning_rate']:g}", "gradient_boosting", p) for p in L.GRIDS["gradient_boosting"]]
    f, y = linear(t, specs)
    f = stored(f.select("asset", "d", "spec", "forecast").unionByName(forest(t, trees)))
    b = FC.prevailing_mean(y, ["asset"], min_obs=MIN)
    scored = FC.oos_r2(f.join(b, ["asset", "d"]), ["asset", "spec"]).groupBy("spec").agg(F.avg("r2").alias("score"))
    model = scored.join(t.dim([(name, m) for name, m, _p in specs + trees], "spec string, model string"), "spec")
    return model.groupBy("model").agg(F.max_by("spec", "score").alias("best"), r6(F.max("score")).alias("score"))


@query("tree_models")
def _(t):
    f = forest(t, [(m, m, None) for m in ("random_forest", "gradient_boosting", "shallow_tree")])
    return out(f.withColumnRenamed("spec", "model"), "forecast", keys=("asset", "model", "d"))


def events(t):
    """Events that are visible by now, and the two latest returns."""
    w = win(["asset"])
    return stored(FC.visible_target(evt(t), ["asset"], "y", 6, lag=6).select("asset", "d", F.col("target").alias("y"), F.lag("r", 1).over(w).alias("x1"), F.lag("r", 2).over(w).alias("x2")))


@query("walk_forward_classifier")
def _(t):
    e = events(t)
    each = [L.walk_forward_classifier(e, ["x1", "x2"], m, min_train=36, refit_every=1, ddof=0).withColumn("model", F.lit(m)) for m in L.CLASSIFIERS]
    return out(reduce(lambda a, b: a.unionByName(b), each), "p", keys=("asset", "d", "model"))


view("evt_v", """SELECT asset, d, LAG(target, 6) OVER w AS y, LAG(r, 1) OVER w AS x1, LAG(r, 2) OVER w AS x2 FROM evt_f WINDOW w AS (PARTITION BY asset ORDER BY d)""")
view("evt_cal", "SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos FROM (SELECT DISTINCT d FROM evt_v)")


@query("walk_forward_classifier_check", """WITH t AS (SELECT c.d AS fit, v.* FROM evt_cal c JOIN evt_cal e ON e.pos < c.pos JOIN evt_v v ON v.d = e.d WHERE c.pos >= 36 AND y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
  s AS (SELECT fit, COUNT(*) AS n, SUM(y) AS events, AVG(x1) AS m1, AVG(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2 FROM t GROUP BY 1 HAVING COUNT(*) >= 18 AND SUM(y) BETWEEN 1 AND COUNT(*) - 1)
  SELECT fit, model, k.term, n, events, round(CASE k.term WHEN 'x1' THEN m1 WHEN 'x2' THEN m2 END, 6)+0.0 AS mean_x, round(CASE k.term WHEN 'x1' THEN s1 WHEN 'x2' THEN s2 END, 6)+0.0 AS sd_x, 0.0::DOUBLE AS residual
  FROM s, (VALUES ('(intercept)'), ('x1'), ('x2')) k(term), (VALUES ('logit'), ('logit_l1')) g(model)""")
def _(t):
    """Every fit of both logits solves its score equations: residuals balance the penalty, or lie within it where a beta is zero."""
    e = events(t)
    rows = e.dropna(subset=["y", "x1", "x2"])
    parts = []
    for model, (inverse, kind) in L.LOGITS.items():
        f = stored(L.walk_forward_logit(e, ["x1", "x2"], model, min_train=36, refit_every=1, ddof=0)[1].filter("intercept is not null"))
        z = lambda i: (F.col(f"x{i}") - F.col("terms")[i - 1]["mean"]) / F.col("terms")[i - 1]["sd"]
        score = F.col("intercept") + F.col("terms")[0]["beta"] * z(1) + F.col("terms")[1]["beta"] * z(2)
        miss = 1.0 / (1.0 + F.exp(-score)) - F.col("y")
        j = f.join(rows, F.col("d") < F.col("fit"))
        g = j.groupBy("fit", "n", "events", "terms").agg(F.sum(miss).alias("g0"), *(F.sum(miss * z(i)).alias(f"g{i}") for i in (1, 2)))

        def residual(beta, grad):
            if kind == "l2":
                return grad + beta / inverse
            return F.when(beta != 0, grad + F.signum(beta) / inverse).otherwise(F.greatest(F.abs(grad) - 1.0 / inverse, F.lit(0.0)))

        lines = [F.struct(F.lit("(intercept)").alias("term"), F.lit(None).cast("double").alias("mean_x"), F.lit(None).cast("double").alias("sd_x"), F.col("g0").alias("residual"))]
        lines += [F.struct(F.lit(f"x{i}").alias("term"), F.col("terms")[i - 1]["mean"].alias("mean_x"), F.col("terms")[i - 1]["sd"].alias("sd_x"), residual(F.col("terms")[i - 1]["beta"], F.col(f"g{i}")).alias("residual")) for i in (1, 2)]
        parts.append(g.select("fit", F.lit(model).alias("model"), "n", "events", F.explode(F.array(*lines)).alias("l")).select("fit", "model", "n", "events", "l.*"))
    return out(reduce(lambda a, b: a.unionByName(b), parts), "mean_x", "sd_x", "residual", keys=("fit", "model", "term", "n", "events"))


@query("skill_split", """WITH f AS (SELECT f.*, bench, row_number() OVER (PARTITION BY f.asset, signal ORDER BY f.d) - 1 AS k FROM fc_m f JOIN bench_fc b USING (asset, d)),
  s AS (SELECT asset, signal, 'all rows' AS sample, 1 - AVG(POW(y - forecast, 2))/AVG(POW(y - bench, 2)) AS r2 FROM f WHERE forecast IS NOT NULL AND bench IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT asset, signal, 'every third', 1 - AVG(POW(y - forecast, 2))/AVG(POW(y - bench, 2)) FROM f WHERE forecast IS NOT NULL AND bench IS NOT NULL AND k % 3 = 0 GROUP BY 1, 2)
  SELECT CASE WHEN signal LIKE 'mom%' THEN 'momentum' ELSE 'volatility' END AS family, sample, round(AVG(r2), 6)+0.0 AS "all", round(AVG(r2) FILTER (WHERE asset IN ('PROMO', 'SMALL')), 6)+0.0 AS stale, round(AVG(r2) FILTER (WHERE asset NOT IN ('PROMO', 'SMALL')), 6)+0.0 AS clean FROM s GROUP BY 1, 2""")
def _(t):
    f = stored(forecasts(t).join(bench(t).drop("y"), ["asset", "d"]))
    thin = f.withColumn("_k", F.row_number().over(win(["asset", "signal"])) - 1).filter("_k % 3 = 0").drop("_k")
    s = FC.oos_r2(f, ["asset", "signal"]).withColumn("sample", F.lit("all rows")).unionByName(FC.oos_r2(thin, ["asset", "signal"]).withColumn("sample", F.lit("every third")))
    return out(FC.skill_split(s.withColumn("family", T.family_of("signal")), ["PROMO", "SMALL"]), "all", "stale", "clean", keys=("family", "sample"))
