"""Queries: yield curves and bond returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6, win
from ..operators import curves as C
from ..operators import dates as D
from .registry import query, view
from .series import F_, gd, out, sq, zs

GRID = "[" + ", ".join(repr(g) for g in C.curve_grid()) + "]::DOUBLE[]"

# quotes with a missing long end every May and one date with too few quotes
view("quotes", "SELECT 'usd' AS curve, d, tenor, par FROM cmt_m")
view("pch0", """SELECT d, tenor AS x, par/100 AS y, LEAD(tenor) OVER w AS x1, LEAD(par/100) OVER w AS y1, COUNT(*) OVER (PARTITION BY d) AS n, row_number() OVER w AS rn
  FROM quotes WINDOW w AS (PARTITION BY d ORDER BY tenor)""")
view("pch1", "SELECT *, x1 - x AS h, (y1 - y)/(x1 - x) AS m FROM pch0 WHERE n >= 4")
view("pch2", """SELECT *, LAG(h) OVER w AS hp, LAG(m) OVER w AS mp, LEAD(h) OVER w AS hn, LEAD(m) OVER w AS mn, LAG(h, 2) OVER w AS hpp, LAG(m, 2) OVER w AS mpp
  FROM pch1 WINDOW w AS (PARTITION BY d ORDER BY x)""")


def _end(h0, h1, d0, d1):
    s = f"(((2*{h0} + {h1})*{d0} - {h0}*{d1})/({h0} + {h1}))"
    return f"CASE WHEN sign({s}) <> sign({d0}) THEN 0 WHEN sign({d0}) <> sign({d1}) AND abs({s}) > 3*abs({d0}) THEN 3*{d0} ELSE {s} END"


view("pch3", f"""SELECT *, CASE WHEN rn = 1 THEN {_end('h', 'hn', 'm', 'mn')} WHEN rn = n THEN {_end('hp', 'hpp', 'mp', 'mpp')}
  WHEN m*mp <= 0 THEN 0 ELSE 3*(h + hp)/((2*h + hp)/mp + (h + 2*hp)/m) END AS s FROM pch2""")
view("pch4", "SELECT *, LEAD(s) OVER (PARTITION BY d ORDER BY x) AS s1 FROM pch3")
view("span_d", "SELECT d, MIN(x) AS x_lo, MAX(x) AS x_hi, arg_min(y, x) AS y_lo, arg_max(y, x) AS y_hi FROM pch1 GROUP BY 1")
view("par_grid", f"""SELECT g.d, g.tenor, CASE WHEN g.tenor <= x_lo THEN y_lo WHEN g.tenor >= x_hi THEN y_hi ELSE
  (1 + 2*u)*(1 - u)*(1 - u)*y + u*(1 - u)*(1 - u)*h*s + u*u*(3 - 2*u)*y1 + u*u*(u - 1)*h*s1 END AS par FROM
  (SELECT span_d.*, tenor FROM span_d, (SELECT unnest({GRID}) AS tenor)) g LEFT JOIN (SELECT pch4.*, t.tenor, (t.tenor - x)/h AS u FROM pch4, (SELECT unnest({GRID}) AS tenor) t
  WHERE t.tenor > x AND t.tenor <= x1) p ON p.d = g.d AND p.tenor = g.tenor""")
view("boot_rec", """SELECT d, 1 AS k, 1/(1 + par/2) AS disc, 1/(1 + par/2) AS run FROM par_grid WHERE tenor = 0.5 UNION ALL
  SELECT b.d, b.k + 1, (1 - p.par/2*b.run)/(1 + p.par/2), b.run + (1 - p.par/2*b.run)/(1 + p.par/2) FROM boot_rec b JOIN par_grid p ON p.d = b.d AND p.tenor = 0.5*(b.k + 1)""")
view("disc0", "SELECT d, CAST(0.5*k AS DOUBLE) AS tenor, disc FROM boot_rec UNION ALL SELECT d, tenor, 1/(1 + par*tenor) FROM par_grid WHERE tenor < 0.4")
view("disc_m", "SELECT 'usd' AS curve, d, CAST(tenor AS DOUBLE) AS tenor, disc, -ln(disc)/tenor*100 AS zero, (COALESCE(LAG(disc) OVER (PARTITION BY d ORDER BY tenor), 1)/disc - 1)*200 AS fwd, ln(disc) AS lnd FROM disc0 WHERE d NOT IN (SELECT d FROM disc0 WHERE disc <= 0)")
# interpolation text: log discount of date column `dd` at time `tt`
view("seg_m", """SELECT d, tenor AS t0, lnd AS l0, zero AS z0, COALESCE(LEAD(tenor) OVER w, 1e9) AS t1, COALESCE(LEAD(lnd) OVER w, lnd) AS l1, COALESCE(LEAD(zero) OVER w, zero) AS z1 FROM disc_m WINDOW w AS (PARTITION BY d ORDER BY tenor)
  UNION ALL SELECT d, -1e9, arg_min(lnd, tenor), arg_min(zero, tenor), MIN(tenor), arg_min(lnd, tenor), arg_min(zero, tenor) FROM disc_m GROUP BY 1""")
LN = "(s.l0 + (s.l1 - s.l0)*({t} - s.t0)/(s.t1 - s.t0))"
ZN = "(s.z0 + (s.z1 - s.z0)*({t} - s.t0)/(s.t1 - s.t0))"


def quotes(t):
    return t.cmt_m.withColumn("curve", F.when(F.col("tenor") > 0, "usd"))


def curve(t):
    return C.curve_table(quotes(t))


KT = ("d", "tenor")


@query("interp_linear", f"""WITH w AS (SELECT d, t FROM (SELECT DISTINCT d FROM disc_m), (SELECT unnest([0.01, 0.1, 0.3, 1.75, 7.2, 29.9, 40.0])::DOUBLE AS t))
  SELECT w.d, w.t AS tenor, round({ZN.format(t='w.t')}, 6)+0.0 AS y FROM w JOIN seg_m s ON s.d = w.d AND w.t >= s.t0 AND w.t < s.t1""")
def _(t):
    z = curve(t)
    targets = z.select("curve", "d").distinct().withColumn("tenor", F.explode(F.array(*map(F.lit, [0.01, 0.1, 0.3, 1.75, 7.2, 29.9, 40.0]))))
    return out(C.interp_linear(z.withColumnRenamed("zero", "y"), targets), "y", keys=KT)


@query("discount_at", f"""WITH w AS (SELECT d, t FROM (SELECT DISTINCT d FROM disc_m), (SELECT unnest([0.01, 0.1, 0.3, 1.75, 7.2, 29.9, 40.0])::DOUBLE AS t))
  SELECT w.d, w.t AS tenor, round(exp({LN.format(t='w.t')}), 6)+0.0 AS discount FROM w JOIN seg_m s ON s.d = w.d AND w.t >= s.t0 AND w.t < s.t1""")
def _(t):
    p = C.pack(curve(t), F.ln("discount"), "lnd").withColumn("tenor", F.explode(F.array(*map(F.lit, [0.01, 0.1, 0.3, 1.75, 7.2, 29.9, 40.0]))))
    return out(p.withColumn("discount", C.discount_at("tenor")), "discount", keys=KT)


@query("par_on_grid", sq({"par_root": "sqrt(par)"}, "par_grid", "d, tenor"))
def _(t):
    return out(C.par_on_grid(quotes(t)).withColumn("par_root", F.sqrt("par")), "par_root", keys=KT)


@query("bootstrap_curve", sq({"discount": "disc"}, "disc_m", "d, tenor"))
def _(t):
    return out(C.bootstrap_curve(C.par_on_grid(quotes(t))), "discount", keys=KT)


@query("zero_from_discount", sq({"cc": "zero", "semi": "(POW(1/disc, 1/(2*tenor)) - 1)*200"}, "disc_m", "d, tenor"))
def _(t):
    z = C.bootstrap_curve(C.par_on_grid(quotes(t)))
    return out(z.withColumn("cc", C.zero_from_discount("discount", "tenor")).withColumn("semi", C.zero_from_discount("discount", "tenor", False)), "cc", "semi", keys=KT)


@query("forward_from_discount", sq({"forward": "fwd"}, "disc_m", "d, tenor"))
def _(t):
    return out(curve(t), "forward", keys=KT)


@query("max_quoted", "SELECT d, MAX(tenor) AS max_quoted FROM quotes GROUP BY 1")
def _(t):
    return C.max_quoted(quotes(t)).select("d", "max_quoted")


# bonds of two maturities on every date; cash flows by exploding the schedule
view("bond_cf", """SELECT d, m, m - 0.5*j AS t FROM (SELECT DISTINCT d FROM disc_m), (SELECT unnest([1.8, 9.7])::DOUBLE AS m), (SELECT unnest(range(0, 20)) AS j) WHERE m - 0.5*j > 1e-9""")
view("bond_df", f"SELECT c.d, c.m, c.t, {LN.format(t='c.t')} AS l FROM bond_cf c JOIN seg_m s ON s.d = c.d AND c.t >= s.t0 AND c.t < s.t1")


def bonds(t):
    return C.pack(curve(t), F.ln("discount"), "lnd").withColumn("m", F.explode(F.array(F.lit(1.8), F.lit(9.7))))


@query("coupon_schedule", "SELECT d, m, round(t, 6)+0.0 AS t FROM bond_cf")
def _(t):
    return bonds(t).select("d", "m", F.explode(C.coupon_times(F.col("m"))).alias("t")).select("d", "m", r6("t").alias("t"))


view("node_par", "SELECT d, tenor, 2*(1 - disc)/SUM(disc) OVER (PARTITION BY d ORDER BY tenor) AS p FROM disc_m WHERE tenor >= 0.5")


@query("par_yield", """WITH a AS (SELECT d, m, 2*(1 - MAX(CASE WHEN t = m THEN exp(l) END))/SUM(exp(l)) AS sched FROM bond_df GROUP BY 1, 2)
  SELECT a.d, a.m, round(a.sched*100, 6)+0.0 AS on_schedule, round((l.p + (h.p - l.p)*(a.m - l.tenor)/0.5)*100, 6)+0.0 AS y FROM a
  JOIN node_par l ON l.d = a.d AND l.tenor = floor(a.m/0.5)*0.5 JOIN node_par h ON h.d = a.d AND h.tenor = floor(a.m/0.5)*0.5 + 0.5""")
def _(t):
    b = bonds(t).withColumn("on_schedule", C.par_yield_on_schedule(F.col("m")) * 100).withColumn("y", C.par_yield(F.col("m")) * 100)
    return out(b, "on_schedule", "y", keys=("d", "m"))


@query("price_bond", "SELECT d, m, round(2.5*SUM(exp(l)) + 100*MAX(CASE WHEN t = m THEN exp(l) END), 6)+0.0 AS price FROM bond_df GROUP BY 1, 2")
def _(t):
    return out(bonds(t).withColumn("price", C.price_bond(F.lit(0.05), F.col("m"))), "price", keys=("d", "m"))


@query("duration_convexity", """WITH k AS (SELECT d, m, t, l, least(greatest(t, 1.0/12), 30) AS tc FROM bond_df),
  p AS (SELECT d, m, SUM((2.5 + CASE WHEN t = m THEN 100 ELSE 0 END)*exp(l)) AS p0, SUM((2.5 + CASE WHEN t = m THEN 100 ELSE 0 END)*exp(l - 1e-4*tc)) AS up,
  SUM((2.5 + CASE WHEN t = m THEN 100 ELSE 0 END)*exp(l + 1e-4*tc)) AS dn FROM k GROUP BY 1, 2)
  SELECT d, m, round((dn - up)/(2*p0*1e-4), 6)+0.0 AS mod_dur, round((up + dn - 2*p0)/(p0*1e-8), 2)+0.0 AS convexity FROM p""")
def _(t):
    b = C.with_duration_convexity(bonds(t), F.lit(0.05), F.col("m"))
    return b.select("d", "m", r6("mod_dur").alias("mod_dur"), r6("convexity", 2).alias("convexity"))


# constant-maturity returns: pairs of consecutive dates, cash flows of the aged bond on the next curve
view("pair_m", """SELECT * FROM (SELECT d, LEAD(d) OVER (ORDER BY d) AS d1, mq, least(mq, LEAD(mq) OVER (ORDER BY d)) AS reach FROM
  (SELECT x.d, MAX(q.tenor) AS mq FROM (SELECT DISTINCT d FROM disc_m) x JOIN quotes q ON q.d = x.d GROUP BY 1)) WHERE (d1 - d)/365.0 <= 0.088""")
view("cmr_pairs", "SELECT d, d1, (d1 - d)/365.0 AS dt, m, m - (d1 - d)/365.0 AS aged FROM pair_m, (SELECT unnest([2.0, 10.0, 30.0])::DOUBLE AS m) WHERE reach >= m - 1e-9")
view("cmr_y", """SELECT c.*, p0.p AS y0, pl.p + (p0.p - pl.p)*(aged - (m - 0.5))/0.5 AS y_roll, ql.p + (q0.p - ql.p)*(aged - (m - 0.5))/0.5 AS y1 FROM cmr_pairs c
  JOIN node_par p0 ON p0.d = c.d AND p0.tenor = m JOIN node_par pl ON pl.d = c.d AND pl.tenor = m - 0.5
  JOIN node_par q0 ON q0.d = c.d1 AND q0.tenor = m JOIN node_par ql ON ql.d = c.d1 AND ql.tenor = m - 0.5""")
view("cmr_new", f"""SELECT c.d, c.m, SUM((50*c.y0 + CASE WHEN j = 0 THEN 100 ELSE 0 END)*exp({LN.format(t='(c.aged - 0.5*j)')})) AS p_new FROM cmr_y c, (SELECT unnest(range(0, 60)) AS j) k
  JOIN seg_m s ON s.d = c.d1 AND c.aged - 0.5*j >= s.t0 AND c.aged - 0.5*j < s.t1 WHERE c.aged - 0.5*j > 1e-9 GROUP BY 1, 2""")
view("cmr_dur", """SELECT c.d, c.m, SUM(cf*n.disc) AS p0, SUM(cf*n.disc*exp(-1e-4*n.tenor)) AS up, SUM(cf*n.disc*exp(1e-4*n.tenor)) AS dn FROM
  (SELECT d, m, y0, 0.5*j AS t, 50*y0 + CASE WHEN 0.5*j = m THEN 100 ELSE 0 END AS cf FROM cmr_y, (SELECT unnest(range(1, 61)) AS j) WHERE 0.5*j <= m) c JOIN disc_m n ON n.d = c.d AND n.tenor = c.t GROUP BY 1, 2""")
view("cmr_m", """SELECT d1 AS d, m AS maturity, p_new/100 - 1 AS total, y0*dt AS carry, -dur*(y_roll - y0) AS rolldown, -dur*dy AS duration, 0.5*cvx*dy*dy AS convexity, y0 AS ytm, dur AS mod_dur, dy AS d_yield FROM
  (SELECT y.*, n.p_new, (u.dn - u.up)/(2*u.p0*1e-4) AS dur, (u.up + u.dn - 2*u.p0)/(u.p0*1e-8) AS cvx, y.y1 - y.y_roll AS dy FROM cmr_y y JOIN cmr_new n ON n.d = y.d AND n.m = y.m JOIN cmr_dur u ON u.d = y.d AND u.m = y.m)""")


def cmr(t):
    return C.constant_maturity_returns(curve(t), [2.0, 10.0, 30.0], C.max_quoted(quotes(t)), max_gap=0.088)


_CMR = ("total", "carry", "rolldown", "duration", "convexity", "ytm", "mod_dur", "d_yield")


@query("constant_maturity_returns", sq({**{k: k for k in _CMR}, "residual": "total - carry - rolldown - duration - convexity"}, "cmr_m", "d, maturity"))
def _(t):
    return out(cmr(t), *_CMR, "residual", keys=("d", "maturity"))


@query("constant_maturity_bill_returns", f"""WITH a AS (SELECT p.d, p.d1, exp({LN.format(t='0.25')}) AS p0 FROM pair_m p JOIN seg_m s ON s.d = p.d AND 0.25 >= s.t0 AND 0.25 < s.t1),
  b AS (SELECT p.d, exp({LN.format(t='(0.25 - (d1 - p.d)/365.0)')}) AS pr FROM pair_m p JOIN seg_m s ON s.d = p.d AND 0.25 - (d1 - p.d)/365.0 >= s.t0 AND 0.25 - (d1 - p.d)/365.0 < s.t1),
  n AS (SELECT p.d, exp({LN.format(t='(0.25 - (d1 - p.d)/365.0)')}) AS pn FROM pair_m p JOIN seg_m s ON s.d = p.d1 AND 0.25 - (d1 - p.d)/365.0 >= s.t0 AND 0.25 - (d1 - p.d)/365.0 < s.t1)
  SELECT a.d1 AS d, round(pn/p0 - 1, 6)+0.0 AS total, round(pr/p0 - 1, 6)+0.0 AS carry, round(pn/pr - 1, 6)+0.0 AS duration, round(-ln(p0)/0.25, 6)+0.0 AS ytm FROM a JOIN b USING (d) JOIN n USING (d)""")
def _(t):
    return out(C.constant_maturity_bill_returns(curve(t), 0.25, C.max_quoted(quotes(t)), max_gap=0.088), "total", "carry", "duration", "ytm", keys=("d",))


@query("annualize", """SELECT asset, round(POW(product(1 + r), 12.0/COUNT(r)) - 1, 6)+0.0 AS ann_return, round(stddev_samp(r)*sqrt(12), 6)+0.0 AS ann_vol, round(MIN(dd), 6)+0.0 AS max_dd
  FROM (SELECT asset, r, g/MAX(g) OVER (PARTITION BY asset ORDER BY d) - 1 AS dd FROM grow_m WHERE r IS NOT NULL) GROUP BY 1""")
def _(t):
    return out(C.annualize(t.ret_m, ["asset"], ppy=12), "ann_return", "ann_vol", "max_dd", keys=("asset",))


@query("bill_conventions", sq({"price": "100*(1 - rf*1200/100*28/360)", "bey": "(100 - 100*(1 - rf*1200/100*28/360))/(100*(1 - rf*1200/100*28/360))*365/28*100", "simple": "(exp(rf*1200/100/12) - 1)*12*100", "per": "rf*1200/100/12"}, "rf_m", "d"))
def _(t):
    q = t.rf_m.withColumn("q", F.col("rf") * 1200)
    return out(q.withColumn("price", C.discount_to_price("q", 28)).withColumn("bey", C.discount_to_bey("q", 28)).withColumn("simple", C.continuous_to_simple("q", 1 / 12))
               .withColumn("per", C.to_period_return("q", 12)), "price", "bey", "simple", "per", keys=("d",))


view("rfc_m", "SELECT d, (exp(zero/100/12) - 1)*12*100 AS rf_curve FROM disc_m WHERE tenor < 0.1")


@query("risk_free_from_curve", sq({"rf_curve": "rf_curve"}, "rfc_m", "d"))
def _(t):
    return out(C.risk_free_from_curve(curve(t)), "rf_curve", keys=("d",))


@query("compare_risk_free", """WITH q AS (SELECT d, (100 - 100*(1 - rf*12*28/360))/(100*(1 - rf*12*28/360))*365/28*100 AS bey FROM rf_m)
  SELECT last_day(COALESCE(c.d, q.d)) AS d, round(rf_curve, 6)+0.0 AS curve_1m, round(bey, 6)+0.0 AS dtb4wk_bey, round(rf*1200, 6)+0.0 AS french_rf FROM rfc_m c FULL JOIN q ON c.d = q.d LEFT JOIN rf_m f ON f.d = COALESCE(c.d, q.d)""")
def _(t):
    bills = t.rf_m.select("d", (F.col("rf") * 1200).alias("quote"))
    return out(C.compare_risk_free(C.risk_free_from_curve(curve(t)), bills, t.rf_m), "curve_1m", "dtb4wk_bey", "french_rf", keys=("d",))


_AT = {m: f"MAX(CASE WHEN tenor = {m} THEN zero END)" for m in ("2", "10", "30", "0.5")}


@query("curve_factors", f"SELECT d, round(({_AT['2']} + {_AT['10']} + {_AT['30']})/3, 6)+0.0 AS level, round({_AT['10']} - {_AT['2']}, 6)+0.0 AS slope, round(2*{_AT['10']} - {_AT['2']} - {_AT['30']}, 6)+0.0 AS curvature FROM disc_m GROUP BY 1")
def _(t):
    return out(C.curve_factors(curve(t)), "level", "slope", "curvature", keys=("d",))


view("dcs0", "SELECT 'usd' AS asset, d, " + ", ".join(f"MAX(CASE WHEN tenor = {m} THEN par END) AS q{i}" for i, m in enumerate(("0.25", "2", "5", "10", "30"))) + " FROM quotes GROUP BY d")
view("dcs1", "SELECT asset, d, " + ", ".join(f"last_value(q{i} IGNORE NULLS) OVER (ORDER BY d)/100 AS q{i}" for i in range(5)) + " FROM dcs0")
view("dcs2", "SELECT asset, d, q3 - q1 AS d_slope_2s10s, q3 - q0 AS d_slope_10y3m, q4 - q3 AS d_slope_10s30s, q3 AS d_level, 2*q2 - q1 - q3 AS d_curvature FROM dcs1")
DCS = ("d_slope_2s10s", "d_slope_10y3m", "d_slope_10s30s", "d_level", "d_curvature")
DCS_SQL = {}
for _k in DCS:
    DCS_SQL |= {_k: _k, f"{_k}_chg5": f"{_k} - LAG({_k}, 5) OVER (ORDER BY d)", f"{_k}_chg21": f"{_k} - LAG({_k}, 21) OVER (ORDER BY d)", f"{_k}_z": zs(_k, 36, 18)}


def daily_curve(t):
    return C.daily_curve_signals(quotes(t), window=36, min_periods=18)


@query("daily_curve_signals", sq(DCS_SQL, "dcs2", "d"))
def _(t):
    return out(daily_curve(t), *DCS_SQL, keys=("d",))


view("yy_m", "SELECT d, CAST(tenor AS INT) AS n, zero AS y FROM disc_m WHERE tenor IN (1, 2, 3, 4, 5)")
view("fwd_m", "SELECT a.d, a.n, CASE WHEN a.n = 1 THEN a.y ELSE a.n*a.y - (a.n - 1)*b.y END AS f FROM yy_m a LEFT JOIN yy_m b ON b.d = a.d AND b.n = a.n - 1")
view("rx_m", """SELECT a.d, a.n, (a.n*a.y - (a.n - 1)*b.yl - c.y)/100 AS rx FROM yy_m a JOIN (SELECT d, n, LEAD(y, 12) OVER (PARTITION BY n ORDER BY d) AS yl FROM yy_m) b ON b.d = a.d AND b.n = a.n - 1
  JOIN yy_m c ON c.d = a.d AND c.n = 1""")


@query("forward_rates", sq({"f": "f"}, "fwd_m", "d, n"))
def _(t):
    return out(C.forward_rates(curve(t)), "f", keys=("d", "n"))


@query("bond_excess_returns", sq({"rx": "rx"}, "rx_m", "d, n"))
def _(t):
    return out(C.bond_excess_returns(curve(t)), "rx", keys=("d", "n"))


@query("forward_spreads", "SELECT a.d, a.n, round(a.f - b.f, 6)+0.0 AS fb FROM fwd_m a JOIN fwd_m b ON a.d = b.d AND b.n = 1 WHERE a.n > 1")
def _(t):
    return out(C.forward_spreads(C.forward_rates(curve(t))), "fb", keys=("d", "n"))


@query("svensson_eval", """WITH p AS (SELECT d, rf*1000 AS beta0, -rf*200 AS beta1, rf*50 AS beta2, -rf*30 AS beta3, 1.5 AS tau1, 12.0 AS tau2 FROM rf_m), m AS (SELECT unnest([0.5, 2, 10, 30])::DOUBLE AS m)
  SELECT d, m, round(beta0 + beta1*(1 - exp(-m/tau1))/(m/tau1) + beta2*((1 - exp(-m/tau1))/(m/tau1) - exp(-m/tau1)) + beta3*((1 - exp(-m/tau2))/(m/tau2) - exp(-m/tau2)), 6)+0.0 AS y, round(beta0 + beta1, 6)+0.0 AS short FROM p, m""")
def _(t):
    p = t.rf_m.select("d", *[(F.col("rf") * k).alias(n) for n, k in (("beta0", 1000.0), ("beta1", -200.0), ("beta2", 50.0), ("beta3", -30.0))], F.lit(1.5).alias("tau1"), F.lit(12.0).alias("tau2"))
    p = p.withColumn("m", F.explode(F.array(*map(F.lit, [0.5, 2.0, 10.0, 30.0]))))
    return out(p.withColumn("y", C.svensson_eval("m")).withColumn("short", C.short_rate()), "y", "short", keys=("d", "m"))


@query("mean_reversion_ols", """WITH r AS (SELECT tenor, d, par/100 AS r, LAG(par/100) OVER (PARTITION BY tenor ORDER BY d) AS x FROM cmt_m), p AS (SELECT tenor, x, r - x AS dr FROM r WHERE x IS NOT NULL),
  g AS (SELECT tenor, COUNT(*) AS n, covar_pop(x, dr) AS sxy, var_pop(x) AS sxx, var_pop(dr) AS syy FROM p GROUP BY 1)
  SELECT tenor, n, round(greatest(-sxy/sxx*12, 1e-4), 6)+0.0 AS a, round(sqrt((syy - sxy*sxy/sxx)*n/(n - 2))*sqrt(12), 6)+0.0 AS sigma, round(ln(2)/greatest(-sxy/sxx*12, 1e-4), 6)+0.0 AS half_life FROM g""")
def _(t):
    m = C.mean_reversion_ols(t.cmt_m, ["tenor"], "par", ppy=12, min_obs=60)
    return out(m, "a", "sigma", "half_life", keys=("tenor", "n"))


@query("carry_roll_edges", f"""WITH b AS (SELECT * FROM (VALUES ('ust2y', 2.0, 1.9), ('ust10y', 10.0, 8.4), ('ust30y', 30.0, 18.5)) v(asset, m, dur)),
  e AS (SELECT b.asset, n.d, n.zero/12 + (n.zero - {ZN.format(t='(b.m - 1.0/12)')})*dur AS edge FROM b JOIN disc_m n ON n.tenor = b.m JOIN seg_m s ON s.d = n.d AND b.m - 1.0/12 >= s.t0 AND b.m - 1.0/12 < s.t1
    UNION ALL SELECT asset, d, {gd('AVG', 'r', 12, 6)} FROM ret_m)
  SELECT asset, d, round(LAG(edge) OVER (PARTITION BY asset ORDER BY d), 6)+0.0 AS edge FROM e""")
def _(t):
    b = t.dim([("usd", "ust2y", 2.0, 1.9), ("usd", "ust10y", 10.0, 8.4), ("usd", "ust30y", 30.0, 18.5)], "curve string, asset string, maturity double, dur double")
    return out(C.carry_roll_edges(curve(t), b, t.ret_m), "edge")
