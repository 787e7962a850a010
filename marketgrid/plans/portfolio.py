"""Queries: schedules, backtests, holdings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import expanding, r6, win
from ..operators import backtest as B
from ..operators import covariance as V
from ..operators import crosssection as X
from ..operators import metrics as M
from ..operators import weights as P
from ..session import stored
from .registry import QUERIES, query, view, views
from .risk import U, due, ex_m
from .series import out, sq
from .sqlmath import erc_views

BPS = [("ECONOMY", 5.0), ("LARGE", 10.0), ("MEDIUM", 15.0), ("PROMO", 20.0)]
FIRST = 24

view("bt_r", "SELECT asset, d, r, dense_rank() OVER (ORDER BY d) - 1 AS rn FROM ret_m WHERE r IS NOT NULL")
view("bt_rate", "SELECT asset, CASE asset WHEN 'ECONOMY' THEN 5.0 WHEN 'LARGE' THEN 10.0 WHEN 'MEDIUM' THEN 15.0 WHEN 'PROMO' THEN 20.0 ELSE 10.0 END/10000*2 AS rate FROM (SELECT DISTINCT asset FROM ret_m)")
view("bt_cal", "SELECT DISTINCT d, rn FROM bt_r")
view("bt_iv", "SELECT asset, d, rn, 1/stddev_samp(r) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS iv FROM bt_r")
view("bt_w", "SELECT asset, d, rn, iv/SUM(iv) OVER (PARTITION BY d) AS w FROM bt_iv WHERE rn >= 24")


def bt_chain(prefix: str, targets: str, drift: bool = True, rows: str = "bt_r") -> None:
    """SQL of the backtest of relation (strategy, asset, d, target) on the returns of `rows`."""
    view(f"{prefix}_x", f"""SELECT s.strategy, r.asset, r.d, r.r, t.target AS t0, COUNT(t.target) OVER w AS epoch, last_value(t.target IGNORE NULLS) OVER w AS tgt
      FROM {rows} r CROSS JOIN (SELECT DISTINCT strategy FROM {targets}) s LEFT JOIN {targets} t ON t.strategy = s.strategy AND t.asset = r.asset AND t.d = r.d
      WINDOW w AS (PARTITION BY s.strategy, r.asset ORDER BY r.d)""")
    g = "COALESCE(product(1 + r) OVER (PARTITION BY strategy, asset, epoch ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)" if drift else "1"
    view(f"{prefix}_g", f"SELECT *, {g} AS g0 FROM {prefix}_x WHERE epoch > 0")
    tot = "(SUM(tgt*g0) OVER (PARTITION BY strategy, d) + 1 - SUM(tgt) OVER (PARTITION BY strategy, d))" if drift else "1"
    view(f"{prefix}_h", f"SELECT *, tgt*g0/{tot} AS held, (1 - SUM(tgt) OVER (PARTITION BY strategy, d))/{tot} AS cash FROM {prefix}_g")
    e = "held*(1 + r)/(SUM(held*(1 + r)) OVER (PARTITION BY strategy, d) + cash)" if drift else "held"
    view(f"{prefix}_e", f"SELECT *, {e} AS he FROM {prefix}_h")
    view(f"{prefix}_q", f"SELECT *, COALESCE(LAG(he) OVER (PARTITION BY strategy, asset ORDER BY d), 0) AS pre FROM {prefix}_e")
    view(prefix, f"""SELECT strategy, d, SUM(held*r) AS gross, ANY_VALUE(cash) AS cash, SUM(CASE WHEN t0 IS NOT NULL THEN abs(t0 - pre)*rate ELSE 0 END) AS cost,
      SUM(CASE WHEN t0 IS NOT NULL THEN abs(t0 - pre) ELSE 0 END) AS turnover, MAX(epoch) AS epoch FROM {prefix}_q JOIN bt_rate USING (asset) GROUP BY 1, 2""")


def returns(t):
    """Monthly returns of one universe, written once: targets, drift and costs all read them."""
    return stored(t.ret_m.filter("r is not null").select(F.lit("all").alias("universe"), "asset", "d", "r"))


def rates(t):
    return B.cost_rates(t.part.select(F.col("p_type").alias("asset")), t.dim(BPS, "asset string, bps double"), multiplier=2.0)


def with_rn(r):
    """Each row with its date's position in the universe's calendar, the same for all assets whatever gaps they have."""
    return r.join(V.calendar(r, U), ["universe", "d"])


def iv_path(r):
    """Inverse-volatility weights from the rows before each date, for every live date."""
    past = expanding(win(["universe", "asset"]), 1)
    p = with_rn(r).withColumn("iv", 1.0 / F.stddev_samp("r").over(past)).filter(F.col("rn") >= FIRST)
    return p.withColumn("w", X.normalise("iv", ["universe", "d"]))


def annual_targets(r, share: float = 0.9):
    """Annual trades into inverse-volatility weights, the rest in cash."""
    p = iv_path(r)
    flag = (F.col("rn") == FIRST) | (F.year("d") != F.year(F.lag("d").over(win(["universe", "asset"]))))
    p = p.withColumn("due", flag).filter("due")
    return stored(p.select("universe", F.lit("iv_annual").alias("strategy"), "asset", "d", (F.col("w") * share).alias("target")))


view("tg_annual", "SELECT 'iv_annual' AS strategy, asset, d, w*0.9 AS target FROM bt_w WHERE rn = 24 OR YEAR(d) <> (SELECT YEAR(c.d) FROM bt_cal c WHERE c.rn = bt_w.rn - 1)")
bt_chain("bta", "tg_annual")
_BT = {"gross": "gross", "cost": "cost", "net": "gross - cost", "turnover": "turnover", "cash": "cash"}


@query("flagship_backtest", """SELECT strategy, round(POW(product(1 + gross - cost), 12.0/COUNT(*)) - 1, 6)+0.0 AS cagr, round(AVG(gross - cost - rf)*12/(stddev_samp(gross - cost - rf)*sqrt(12)), 6)+0.0 AS sharpe,
  round(AVG(turnover)*12, 6)+0.0 AS turnover_pa, round(AVG(b.r - rf)*12/(stddev_samp(b.r - rf)*sqrt(12)), 6)+0.0 AS bench_sharpe, COUNT(*) AS periods
  FROM bta JOIN rf_m USING (d) JOIN bench_m b USING (d) GROUP BY 1""")
def _(t):
    r = returns(t)
    bt = B.backtest(r, annual_targets(r), rates(t)).join(t.rf_m, "d").join(t.bench_m.select("d", F.col("r").alias("b")), "d")
    bt = bt.withColumn("r", F.col("net"))
    p = M.performance(bt, ["strategy"], turnover="turnover")
    b = bt.groupBy("strategy").agg(M.sharpe_of(F.col("b") - F.col("rf"), 12).alias("bench_sharpe"))
    return out(p.join(b, "strategy"), "cagr", "sharpe", "turnover_pa", "bench_sharpe", keys=("strategy", "periods"))


@query("backtest", sq(_BT, "bta", "strategy, d"))
def _(t):
    r = returns(t)
    return out(B.backtest(r, annual_targets(r), rates(t)), *_BT, keys=("strategy", "d"))


@query("drift", sq({"held": "held", "target": "tgt"}, "bta_h", "asset, d"))
def _(t):
    r = returns(t)
    return out(B.held_weights(r, annual_targets(r)), "held", "target", keys=("asset", "d"))


@query("trade_cost", "SELECT d, round(SUM(abs(t0 - pre)*rate), 6)+0.0 AS cost FROM bta_q JOIN bt_rate USING (asset) WHERE t0 IS NOT NULL GROUP BY 1")
def _(t):
    r = returns(t)
    return out(B.backtest(r, annual_targets(r), rates(t)).filter("turnover > 0"), "cost", keys=("d",))


@query("cost_model", "SELECT asset, round(rate, 8)+0.0 AS rate, round(AVG(rate) OVER (), 8)+0.0 AS avg_rate FROM bt_rate")
def _(t):
    r = rates(t)
    return r.withColumn("avg_rate", B.average_rate(r).scalar()).select("asset", r6("rate", 8).alias("rate"), r6("avg_rate", 8).alias("avg_rate"))


@query("schedule_every_n", "SELECT n, d FROM bt_cal, (SELECT unnest([1, 5, 12]) AS n) WHERE rn >= 24 AND (rn = 24 OR rn % n = 0)")
def _(t):
    cal = V.calendar(returns(t), U).withColumn("n", F.explode(F.array(F.lit(1), F.lit(5), F.lit(12))))
    return cal.filter(B.every_n(F.col("rn"), F.col("n"), FIRST)).select("n", "d")


view("cal_y", "SELECT d, rn, YEAR(d)*12 + MONTH(d) - 1 AS mi FROM bt_cal")


@query("schedule_calendar", "SELECT m AS months, d FROM (SELECT *, (YEAR(d)*12 + (MONTH(d) - 1)//m) <> LAG(YEAR(d)*12 + (MONTH(d) - 1)//m) OVER (PARTITION BY m ORDER BY d) AS fresh FROM cal_y, (SELECT unnest([3, 12]) AS m)) WHERE rn >= 24 AND (rn = 24 OR fresh)")
def _(t):
    cal = V.calendar(returns(t), U)
    a = cal.withColumn("due", B.calendar_months(3, FIRST, U)).filter("due").select(F.lit(3).alias("months"), "d")
    b = cal.withColumn("due", B.calendar_months(12, FIRST, U)).filter("due").select(F.lit(12).alias("months"), "d")
    return a.unionByName(b)


@query("schedule_catalog", """SELECT schedule, COUNT(*) AS dates, SUM(CAST(due AS INT)) AS trades FROM (SELECT s.schedule, d, rn >= 24 AND (rn = 24 OR
  (YEAR(d)*12 + (MONTH(d) - 1)//s.m) <> LAG(YEAR(d)*12 + (MONTH(d) - 1)//s.m) OVER (PARTITION BY s.schedule ORDER BY d)) AS due FROM bt_cal, (VALUES ('monthly', 1), ('quarterly', 3), ('annual', 12)) s(schedule, m)) GROUP BY 1""")
def _(t):
    c = B.schedule_catalog(V.calendar(returns(t), U), U, FIRST)
    return c.groupBy("schedule").agg(F.count("*").alias("dates"), F.sum(F.col("due").cast("long")).alias("trades"))


@query("train_window", "SELECT d, greatest(rn - 1 + 1 - 36, 0) AS first_row, rn - 1 + 1 AS end_row FROM bt_cal WHERE rn - 1 + 1 >= 24")
def _(t):
    lo, end = B.train_window(F.col("rn"), 1, 36)
    return V.calendar(returns(t), U).select("d", lo.alias("first_row"), end.alias("end_row")).filter("end_row >= 24")


# fixed-mix band schedules: the trade chain in SQL hops from trade to next trade
view("bd_t", "SELECT asset, d, rn, CASE asset WHEN 'PROMO' THEN 0.3 ELSE 0.14 END AS target FROM bt_r WHERE rn >= 24")
view("bd_g", "SELECT *, product(1 + r) OVER (PARTITION BY asset ORDER BY d) AS g FROM (SELECT b.*, r.r FROM bd_t b JOIN bt_r r USING (asset, d))")
view("bd_p", """SELECT a.rn AS r0, b.rn AS r1, a.asset, a.target AS t0, b.target AS t1, a.target*p.g/a.g*(1 + a.r) AS grown FROM bd_g a JOIN bd_g b ON a.asset = b.asset AND b.rn > a.rn
  JOIN bd_g p ON p.asset = a.asset AND p.rn = b.rn - 1""")
view("bd_d", "SELECT r0, r1, SUM(abs(t1 - grown/tot)) AS l1, MAX(abs(grown/tot - t0)) AS mx FROM (SELECT *, SUM(grown) OVER (PARTITION BY r0, r1) AS tot FROM bd_p) GROUP BY 1, 2")


def bd_sql(cond):
    return f"""WITH RECURSIVE nx AS (SELECT r0, MIN(r1) AS r1 FROM bd_d WHERE {cond} GROUP BY 1), ch AS (SELECT 24::BIGINT AS rn UNION ALL SELECT nx.r1 FROM ch JOIN nx ON nx.r0 = ch.rn)
      SELECT d FROM bt_cal JOIN ch USING (rn)"""


def fixed_mix(t):
    r = returns(t)
    p = with_rn(r).filter(F.col("rn") >= FIRST)
    mix = F.when(F.col("asset") == "PROMO", 0.3).otherwise(0.14)
    return r, p.select("universe", F.lit("mix").alias("strategy"), "asset", "d", mix.alias("target"))


@query("schedule_band_l1", bd_sql("l1 >= 0.05 AND r1 - r0 >= 2"))
def _(t):
    r, path = fixed_mix(t)
    return B.band_trades(r, path, 0.05, "l1", min_gap=2).select("d")


@query("schedule_band_max", bd_sql("mx > 0.02"))
def _(t):
    r, path = fixed_mix(t)
    return B.band_trades(r, path, 0.02, "max").select("d")


# long-only path re-targeted every 6 rows; dates without a positive return, or where an asset has none, fall back to 1/n of all assets
view("lo_g", "SELECT a.asset, c.d, c.rn, r.r FROM bt_cal c CROSS JOIN (SELECT DISTINCT asset FROM bt_r) a LEFT JOIN bt_r r ON r.asset IS NOT DISTINCT FROM a.asset AND r.d IS NOT DISTINCT FROM c.d")
view("lo_r", "SELECT asset, d, rn, COALESCE(r, 0) AS r FROM lo_g")
view("lo_z", "SELECT asset, d, rn, CASE WHEN r IS NOT NULL THEN greatest(r, 0) END AS z FROM lo_g WHERE rn >= 24")
view("lo_t", """SELECT 'lo' AS strategy, asset, d, CASE WHEN COUNT(z) OVER w = COUNT(*) OVER w AND SUM(z) OVER w > 0 THEN z/SUM(z) OVER w ELSE 1.0/COUNT(*) OVER w END AS target FROM lo_z WHERE rn % 6 = 0 WINDOW w AS (PARTITION BY d)""")
bt_chain("btl", "lo_t", rows="lo_r")


def long_path(t):
    """Returns of all assets on all dates, null where an asset has none (flat in the backtest), and the path, whose weights miss there."""
    r = returns(t)
    grid = V.calendar(r, U).join(r.select("universe", "asset").distinct(), U).join(r, ["universe", "asset", "d"], "left")
    p = grid.filter((F.col("rn") >= FIRST) & (F.col("rn") % 6 == 0))
    z = F.when(F.col("r").isNotNull(), F.greatest("r", F.lit(0.0)))
    return grid.drop("rn"), p.select("universe", F.lit("lo").alias("strategy"), "asset", "d", z.alias("target"))


@query("backtest_weight_path", "SELECT strategy, d, round(gross - cost, 6)+0.0 AS net, round(CASE WHEN epoch = 1 THEN 0 ELSE turnover/2 END, 6)+0.0 AS turnover FROM btl")
def _(t):
    r, p = long_path(t)
    return out(B.backtest(r, p, rates(t), turnover="one_way", renormalise=True), "net", "turnover", keys=("strategy", "d"))


view("ls_t", "SELECT 'ls' AS strategy, asset, d, target FROM (SELECT asset, d, r - AVG(r) OVER (PARTITION BY d) AS target FROM bt_r WHERE rn >= 24 AND rn % 3 = 0) WHERE target IS NOT NULL")
bt_chain("bts", "ls_t", drift=False)


@query("backtest_spread", "SELECT strategy, d, round(gross - cost, 6)+0.0 AS net, round(cost, 6)+0.0 AS cost FROM bts")
def _(t):
    r = returns(t)
    p = with_rn(r).filter((F.col("rn") >= FIRST) & (F.col("rn") % 3 == 0))
    z = F.col("r") - F.avg("r").over(X.over(["universe", "d"]))
    tg = B.hold_last_valid(p.select("universe", F.lit("ls").alias("strategy"), "asset", "d", z.alias("target")))
    return out(B.backtest(r, tg, rates(t), drift=False), "net", "cost", keys=("strategy", "d"))


@query("backtest_cov_rule")
def _(t):
    x = ex_m(t)
    cov = V.cov_windowed(x, U, due(FIRST, 12))
    nw = V.nw_variance_factor(x, ["universe", "asset"], min_obs=60)
    w = P.cov_rules(V.cov_stale_adjust(cov, nw, U), ["universe", "d"], ["erc", "hrp", "equal"])
    r = returns(t)
    bt = B.backtest(r, w.select("universe", F.col("rule").alias("strategy"), "asset", "d", F.col("w").alias("target")), rates(t), turnover="one_way", renormalise=True)
    return out(bt, "net", "turnover", keys=("strategy", "d"))


view("ed_z", "SELECT asset, d, rn, LAG(r) OVER (PARTITION BY asset ORDER BY d) AS e FROM bt_r")
view("ed_s", "SELECT asset, d, rn, e, AVG(e) OVER w AS m, stddev_pop(e) OVER w AS sd, COUNT(*) OVER w AS n FROM ed_z WHERE rn >= 24 WINDOW w AS (PARTITION BY d)")
view("ed_t", "SELECT 'edge' AS strategy, asset, d, w/SUM(w) OVER (PARTITION BY d) AS target FROM (SELECT asset, d, greatest(1.0/n + least(greatest((e - m)/sd*0.5/n, -0.1), 0.1), 0) AS w FROM ed_s)")
bt_chain("bte", "ed_t")


@query("backtest_edges", sq({"net": "gross - cost", "turnover": "turnover"}, "bte", "strategy, d"))
def _(t):
    r = returns(t)
    p = with_rn(r).withColumn("e", F.lag("r").over(win(["universe", "asset"]))).filter(F.col("rn") >= FIRST)
    tg = X.with_edge_tilt(p, "e", ["universe", "d"], out="target").withColumn("strategy", F.lit("edge"))
    return out(B.backtest(r, tg, rates(t)), "net", "turnover", keys=("strategy", "d"))


view("cr_c", "SELECT ed AS k, i, j, s*sqrt(a.nw*b.nw) AS s FROM lw_ep JOIN nw_m a ON a.asset = i JOIN nw_m b ON b.asset = j")
views(erc_views("cr_w", "SELECT * FROM cr_c"))
view("cr_t", "SELECT 'erc' AS strategy, asset, k AS d, w AS target FROM cr_w UNION ALL SELECT 'equal', asset, k, 1.0/COUNT(*) OVER (PARTITION BY k) FROM cr_w")
bt_chain("btc", "cr_t")


@query("backtest_cov_rule_check", "SELECT strategy, d, round(gross - cost, 6)+0.0 AS net, round(CASE WHEN epoch = 1 THEN 0 ELSE turnover/2 END, 6)+0.0 AS turnover FROM btc")
def _(t):
    """The two rules that SQL can restate, from covariance to net returns."""
    return QUERIES["backtest_cov_rule"](t.spark, t.sf_dir).filter("strategy in ('erc', 'equal')")


@query("turnover_from_path", """WITH k AS (SELECT asset, d, held, row_number() OVER (PARTITION BY asset ORDER BY d) - 1 AS i FROM bta_h), c AS (SELECT d, abs(held - LAG(held) OVER (PARTITION BY asset ORDER BY d)) AS c FROM k WHERE i % 6 = 0),
  s AS (SELECT d, COALESCE(SUM(c), 0) AS c FROM c GROUP BY 1) SELECT round(AVG(c)*2/2, 6)+0.0 AS turnover_pa FROM s""")
def _(t):
    r = returns(t)
    return out(B.turnover_from_path(B.held_weights(r, annual_targets(r)), 6), "turnover_pa", keys=())


@query("break_even_cost", "SELECT round(AVG(gross - b.r)/AVG(turnover), 6)+0.0 AS break_even FROM bta JOIN bench_m b USING (d)")
def _(t):
    r = returns(t)
    return out(B.break_even_cost(B.backtest(r, annual_targets(r), rates(t)), t.bench_m.select("d", F.col("r").alias("b"))), "break_even", keys=())


DUR = [("ECONOMY", 1.9), ("LARGE", 4.6), ("MEDIUM", 8.4), ("PROMO", 18.5), ("SMALL", 2.5), ("STANDARD", 5.0)]
view("dur_m", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {v}::DOUBLE)" for a, v in DUR) + ") v(asset, dur)")
view("pdur", "SELECT strategy, d, SUM(held*dur) AS duration FROM bta_h JOIN dur_m USING (asset) GROUP BY 1, 2")


def held(t):
    r = returns(t)
    return B.held_weights(r, annual_targets(r))


@query("portfolio_duration", "SELECT strategy, round(AVG(duration), 6)+0.0 AS mean_duration, round(MIN(duration), 6)+0.0 AS min_duration, round(MAX(duration), 6)+0.0 AS max_duration FROM pdur GROUP BY 1")
def _(t):
    p = B.portfolio_duration(held(t), t.dim(DUR, "asset string, dur double"))
    return p.groupBy("strategy").agg(r6(F.avg("duration")).alias("mean_duration"), r6(F.min("duration")).alias("min_duration"), r6(F.max("duration")).alias("max_duration"))


@query("duration_matched_benchmark", """WITH b AS (SELECT d, AVG(dur) AS bd FROM bt_r JOIN dur_m USING (asset) GROUP BY 1), k AS (SELECT p.d, least(greatest(duration/bd, 0), 5) AS k FROM pdur p JOIN b USING (d))
  SELECT d, round(k, 6)+0.0 AS scale, round(k*r + (1 - k)*rf, 6)+0.0 AS matched FROM k JOIN bench_m USING (d) JOIN rf_m USING (d)""")
def _(t):
    dims = t.dim(DUR, "asset string, dur double")
    bd = returns(t).join(dims, "asset").groupBy("d").agg(F.avg("dur").alias("duration"))
    bench = t.bench_m.select("d", F.col("r").alias("b")).join(t.rf_m, "d")
    return out(B.duration_matched_benchmark(bench, bd, B.portfolio_duration(held(t), dims), B.KEYS), "scale", "matched", keys=("d",))


@query("return_contribution", "SELECT asset, round(SUM(held*r)/SUM(SUM(held*r)) OVER (), 6)+0.0 AS share FROM bta_h GROUP BY 1")
def _(t):
    return out(B.return_contribution(held(t)), "share", keys=("asset",))


@query("weight_summary", "SELECT asset, round(AVG(held), 6)+0.0 AS mean_w, round(MIN(held), 6)+0.0 AS min_w, round(MAX(held), 6)+0.0 AS max_w, row_number() OVER (ORDER BY AVG(held) DESC, asset) AS rank FROM bta_h GROUP BY 1")
def _(t):
    return out(B.weight_summary(held(t)), "mean_w", "min_w", "max_w", keys=("asset", "rank"))


@query("weight_fn_train", """WITH c AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS rn FROM (SELECT DISTINCT d FROM ret_m WHERE r IS NOT NULL)), e AS (SELECT d AS epoch, rn FROM c WHERE rn >= 24 AND rn % 24 = 0),
  s AS (SELECT epoch, asset, 1/stddev_samp(r.r) AS iv FROM e JOIN c ON c.rn < e.rn JOIN ret_m r ON r.d = c.d WHERE r.r IS NOT NULL GROUP BY 1, 2) SELECT epoch, asset, round(iv/SUM(iv) OVER (PARTITION BY epoch), 6)+0.0 AS w FROM s""")
def _(t):
    r = stored(returns(t).join(t.rf_m, "d"))
    epochs = V.calendar(r, U).filter(due(FIRST, 24)).select("universe", F.col("d").alias("epoch"))
    w = P.train_rule_windows(r, epochs, U, lambda train, rf: 1.0 / train.std() / (1.0 / train.std()).sum())
    return out(w, "w", keys=("epoch", "asset"))
