"""Yield curves: interpolation, bootstrap, bond repricing, forwards, conventions.

A curve in long form is (curve, d, tenor, ...). For repricing, the nodes of one curve date are packed into
one row of two short arrays (at most one element per grid tenor); every price, par yield and duration is
then a column expression of that row, with no join and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import ColumnLike, c, clip, compound, div, ffill, roll_mean, win
from .timeseries import diff, drawdown, zscore

# fixed values: constant-maturity quote codes and their tenors in years
CMT_TENORS = {"DGS1MO": 1 / 12, "DGS3MO": 0.25, "DGS6MO": 0.5, "DGS1": 1.0, "DGS2": 2.0, "DGS3": 3.0,
              "DGS5": 5.0, "DGS7": 7.0, "DGS10": 10.0, "DGS20": 20.0, "DGS30": 30.0}
MONEY_MARKET = (1 / 12, 0.25)

CURVE = ["curve", "d"]


def curve_grid(horizon: float = 30.0) -> list[float]:
    return [*MONEY_MARKET, *[0.5 * (k + 1) for k in range(int(round(horizon * 2)))]]


def interp_linear(nodes: DataFrame, targets: DataFrame, x: str = "tenor", y: str = "y", keys: list[str] = CURVE) -> DataFrame:
    """Linear interpolation along each date's nodes, flat outside.

    Nodes and targets are sorted together once per curve date; each target reads its two neighbours.
    """
    a = nodes.filter(F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).withColumn("_t", F.lit(0))
    b = targets.select(*keys, F.col(x).alias("_x"), F.lit(None).cast("double").alias("_y")).withColumn("_t", F.lit(1))
    node = F.when(F.col("_t") == 0, F.struct("_x", "_y"))
    w = Window.partitionBy(*keys).orderBy("_x", "_t")
    lo = F.last(node, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first(node, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    u = a.unionByName(b).withColumn("_lo", lo).withColumn("_hi", hi).filter("_t = 1")
    slope = (F.col("_hi._y") - F.col("_lo._y")) / (F.col("_hi._x") - F.col("_lo._x"))
    val = F.when(F.col("_lo").isNull(), F.col("_hi._y")).when(F.col("_hi").isNull(), F.col("_lo._y")).otherwise(
        F.col("_lo._y") + slope * (F.col("_x") - F.col("_lo._x")))
    return u.select(*keys, F.col("_x").alias(x), val.alias(y))


def interp_row(tenors: ColumnLike, values: ColumnLike, t: ColumnLike) -> Column:
    """Linear interpolation inside one row's sorted arrays, flat outside."""
    ten, val, t = c(tenors), c(values), c(t) if isinstance(t, (str, Column)) else F.lit(float(t))
    k = F.size(F.filter(ten, lambda x: x <= t))
    n = F.size(ten)
    lo, hi = F.greatest(k, F.lit(1)), F.least(F.greatest(k + 1, F.lit(1)), n)
    x0, x1, y0, y1 = F.element_at(ten, lo), F.element_at(ten, hi), F.element_at(val, lo), F.element_at(val, hi)
    return F.when(k == 0, F.element_at(val, 1)).when(k >= n, F.element_at(val, -1)).otherwise(y0 + (y1 - y0) / F.nullif(x1 - x0, F.lit(0.0)) * (t - x0))


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """One-sided three-point slope, limited so that the interpolant stays monotone."""
    s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.signum(s) != F.signum(d0), F.lit(0.0)).when(
        (F.signum(d0) != F.signum(d1)) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)


def par_on_grid(quotes: DataFrame, horizon: float = 30.0, tenor: str = "tenor", par: str = "par", min_quotes: int = 4) -> DataFrame:
    """Par yields (as fractions) on the money-market and semiannual grid: monotone cubic inside, flat outside.

    Slopes need only neighbouring quotes, so each quote interval holds all it takes to fill its own grid
    points: one sort per curve date, no join.
    """
    w = Window.partitionBy(*CURVE).orderBy("_x")
    q = quotes.filter(F.col(par).isNotNull()).select(*CURVE, F.col(tenor).alias("_x"), (F.col(par) / 100.0).alias("_y"))
    q = q.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*CURVE))).filter(F.col("_n") >= min_quotes)
    q = q.withColumn("_x1", F.lead("_x").over(w)).withColumn("_y1", F.lead("_y").over(w))
    q = q.withColumn("_h", F.col("_x1") - F.col("_x")).withColumn("_m", (F.col("_y1") - F.col("_y")) / F.col("_h"))
    at = lambda k, n: F.lag(k, n).over(w) if n > 0 else F.lead(k, -n).over(w)
    h, m, hp, mp = F.col("_h"), F.col("_m"), at("_h", 1), at("_m", 1)
    inner = F.when(m * mp <= 0, F.lit(0.0)).otherwise(3 * (h + hp) / ((2 * h + hp) / F.nullif(mp, F.lit(0.0)) + (h + 2 * hp) / F.nullif(m, F.lit(0.0))))
    s = F.when(mp.isNull(), _end_slope(h, at("_h", -1), m, at("_m", -1))).when(
        m.isNull(), _end_slope(hp, at("_h", 2), mp, at("_m", 2))).otherwise(inner)
    q = q.withColumn("_s", s).withColumn("_first", F.row_number().over(w) == 1)
    q = q.withColumn("_s1", F.lead("_s").over(w)).filter("_x1 is not null").withColumn("_last", F.lead("_x").over(w).isNull())
    grid = F.array(*[F.lit(g) for g in curve_grid(horizon)])
    mine = F.filter(grid, lambda g: (F.col("_first") | (g >= F.col("_x"))) & (F.col("_last") | (g < F.col("_x1"))))
    g = q.select("*", F.explode(mine).alias("tenor"))
    u = (F.col("tenor") - F.col("_x")) / F.col("_h")
    v = 1 - u
    cubic = ((1 + 2 * u) * v * v * F.col("_y") + u * v * v * F.col("_h") * F.col("_s")
             + u * u * (3 - 2 * u) * F.col("_y1") - u * u * v * F.col("_h") * F.col("_s1"))
    flat = F.when(F.col("tenor") <= F.col("_x"), F.col("_y")).when(F.col("tenor") >= F.col("_x1"), F.col("_y1")).otherwise(cubic)
    return g.select(*CURVE, "tenor", flat.alias("par"))


def bootstrap_curve(par_grid: DataFrame) -> DataFrame:
    """Discount factors from gridded par yields.

    With q_k = 1 / (1 + c_k / 2) and P_k = q_1 * ... * q_k, the annuity through node k is
    P_k * sum_j q_j / P_j, so the recursion becomes one running product and one running sum. Points below
    six months discount at simple interest and stay outside the recursion. Dates with a non-positive or
    non-finite factor are dropped.
    """
    coupon = F.col("tenor") >= 0.5 - 1e-9
    w = Window.partitionBy(*CURVE).orderBy("tenor").rowsBetween(Window.unboundedPreceding, 0)
    q = F.when(coupon, 1.0 / (1.0 + F.col("par") / 2.0))
    p = par_grid.withColumn("_q", q).withColumn("_p", F.product("_q").over(w))
    p = p.withColumn("_a", F.col("_p") * F.sum(F.col("_q") / F.col("_p")).over(w))
    prev = F.coalesce(F.lag("_a").over(Window.partitionBy(*CURVE).orderBy("tenor")), F.lit(0.0))
    disc = F.when(coupon, F.col("_a") - prev).otherwise(1.0 / (1.0 + F.col("par") * F.col("tenor")))
    d = p.select(*CURVE, "tenor", "par", disc.alias("discount"))
    bad = F.isnan("discount") | (F.col("discount") <= 0) | (F.col("discount") == float("inf")) | F.col("discount").isNull()
    d = d.withColumn("_bad", F.max(bad.cast("int")).over(Window.partitionBy(*CURVE)))
    return d.filter("_bad = 0").drop("_bad")


def zero_from_discount(disc: ColumnLike, tenor: ColumnLike, continuous: bool = True) -> Column:
    """Zero rate in percent."""
    if continuous:
        return -F.ln(c(disc)) / c(tenor) * 100.0
    return (F.pow(1.0 / c(disc), 1.0 / (2.0 * c(tenor))) - 1.0) * 200.0


def forward_from_discount(disc: ColumnLike, keys: list[str] = CURVE, tenor: str = "tenor") -> Column:
    """(previous factor / factor - 1) * 200 along the tenors, the first one from 1."""
    prev = F.lag(c(disc)).over(Window.partitionBy(*keys).orderBy(tenor))
    return (F.coalesce(prev, F.lit(1.0)) / c(disc) - 1.0) * 200.0


def curve_table(quotes: DataFrame, horizon: float = 30.0, continuous: bool = True) -> DataFrame:
    """Quotes to (curve, d, tenor, par, discount, zero, forward)."""
    b = bootstrap_curve(par_on_grid(quotes, horizon))
    return b.withColumn("zero", zero_from_discount("discount", "tenor", continuous)).withColumn("forward", forward_from_discount("discount"))


def max_quoted(quotes: DataFrame, par: str = "par") -> DataFrame:
    return quotes.filter(F.col(par).isNotNull()).groupBy(*CURVE).agg(F.max("tenor").alias("max_quoted"))


def pack(curve: DataFrame, value: Column | str, out: str = "ys") -> DataFrame:
    """One row per curve date: sorted arrays `ten` and `out`. The grid bounds the array length."""
    g = curve.groupBy(*CURVE).agg(F.array_sort(F.collect_list(F.struct("tenor", c(value).alias("v")))).alias("_n"))
    return g.select(*CURVE, F.col("_n.tenor").alias("ten"), F.col("_n.v").alias(out))


# ---- repricing on a packed row: array `lnd` of log discounts on the bootstrap grid ----


def interp_grid(values: ColumnLike, t: ColumnLike | float) -> Column:
    """Linear interpolation on the bootstrap grid, flat outside; the position follows from t, without a search."""
    v, t = c(values), c(t) if isinstance(t, (str, Column)) else F.lit(float(t))
    n = F.size(v)
    mm0, mm1 = MONEY_MARKET
    k = F.when(t < mm0, 0).when(t < mm1, 1).when(t < 0.5, 2).otherwise(F.least(F.floor(t * 2.0).cast("int") + 2, n))
    x0 = F.when(k <= 1, mm0).when(k == 2, mm1).otherwise((k - 2) * 0.5)
    x1 = F.when(k == 1, mm1).otherwise((k - 1) * 0.5)
    y0, y1 = F.element_at(v, F.greatest(k, F.lit(1))), F.element_at(v, F.least(k + 1, n))
    return F.when((k == 0) | (k >= n), y0).otherwise(y0 + (y1 - y0) * (t - x0) / (x1 - x0))


def discount_at(t: ColumnLike | float, lnd: str = "lnd") -> Column:
    return F.exp(interp_grid(lnd, t))


def coupon_times(maturity: Column) -> Column:
    """Semiannual cash-flow times counted back from the maturity."""
    n = F.greatest(F.ceil(maturity / 0.5 - 1e-9).cast("int"), F.lit(1))
    times = F.transform(F.sequence(F.lit(0), n - 1), lambda j: maturity - 0.5 * (n - 1 - j))
    return F.filter(times, lambda t: t > 1e-9)


def annuity(maturity: Column, lnd: str = "lnd") -> Column:
    return F.aggregate(coupon_times(maturity), F.lit(0.0), lambda acc, t: acc + discount_at(t, lnd))


def par_yield_on_schedule(maturity: Column, lnd: str = "lnd") -> Column:
    return 2.0 * (1.0 - discount_at(maturity, lnd)) / annuity(maturity, lnd)


def par_yield(maturity: Column, lnd: str = "lnd") -> Column:
    """Par yield interpolated between the two semiannual maturities around the point."""
    lo = F.greatest(F.floor(maturity / 0.5) * 0.5, F.lit(0.5))
    share = clip((maturity - lo) / 0.5, 0.0, 1.0)
    return par_yield_on_schedule(lo, lnd) * (1 - share) + par_yield_on_schedule(lo + 0.5, lnd) * share


def price_bond(coupon: Column, maturity: Column, face: float = 100.0, lnd: str = "lnd") -> Column:
    return coupon / 2.0 * face * annuity(maturity, lnd) + face * discount_at(maturity, lnd)


def _shift_sums(maturity: Column, bump: float, lnd: str) -> Column:
    """Annuity and final factor with all zero rates moved by -bump, 0 and +bump, in one pass over the cash flows.

    The log factor is linear between nodes, so a parallel move of the node zeros is a term -dy * t there, with
    t held at the end nodes outside them.
    """
    hi = (F.size(lnd) - 2) * 0.5

    def shifted(t: Column, dy: float) -> Column:
        base = interp_grid(lnd, t)
        return F.exp(base - dy * F.least(F.greatest(t, F.lit(MONEY_MARKET[0])), hi) if dy else base)

    zero = F.struct(F.lit(0.0).alias("dn"), F.lit(0.0).alias("p0"), F.lit(0.0).alias("up"))
    ann = F.aggregate(coupon_times(maturity), zero, lambda s, t: F.struct(
        (s["dn"] + shifted(t, -bump)).alias("dn"), (s["p0"] + shifted(t, 0.0)).alias("p0"), (s["up"] + shifted(t, bump)).alias("up")))
    fin = F.struct(shifted(maturity, -bump).alias("dn"), shifted(maturity, 0.0).alias("p0"), shifted(maturity, bump).alias("up"))
    return F.struct(ann.alias("a"), fin.alias("f"))


def with_duration_convexity(df: DataFrame, coupon: Column, maturity: Column, bump: float = 1e-4, face: float = 100.0, lnd: str = "lnd") -> DataFrame:
    """Adds mod_dur and convexity by central differences."""
    d = df.withColumn("_s", _shift_sums(maturity, bump, lnd))
    p = {k: coupon / 2.0 * face * F.col(f"_s.a.{k}") + face * F.col(f"_s.f.{k}") for k in ("dn", "p0", "up")}
    return d.withColumn("mod_dur", (p["dn"] - p["up"]) / (2.0 * p["p0"] * bump)).withColumn(
        "convexity", (p["up"] + p["dn"] - 2.0 * p["p0"]) / (p["p0"] * bump * bump)).drop("_s")


def _date_pairs(curve: DataFrame, max_gap: float, day_count: float, quoted: DataFrame | None) -> DataFrame:
    """Consecutive curve dates side by side, gap in years within the limit."""
    p = pack(curve, F.ln("discount"), "lnd")
    if quoted is not None:
        p = p.join(quoted, CURVE)
    w = Window.partitionBy("curve").orderBy("d")
    nxt = p.withColumn("d1", F.lead("d").over(w)).withColumn("lnd1", F.lead("lnd").over(w))
    if quoted is not None:
        nxt = nxt.withColumn("reach", F.least("max_quoted", F.lead("max_quoted").over(w)))
    gap = nxt.withColumn("dt", F.datediff("d1", "d") / day_count)
    return gap.filter((F.col("dt") > 0) & (F.col("dt") <= max_gap))


def constant_maturity_returns(curve: DataFrame, maturities: list[float], quoted: DataFrame | None = None, max_gap: float = 0.05,
                              day_count: float = 365.0, bump: float = 1e-4) -> DataFrame:
    """Total return of a par bond repriced on the next curve, split into carry, rolldown, duration, convexity and residual."""
    p = _date_pairs(curve, max_gap, day_count, quoted).withColumn("maturity", F.explode(F.array(*[F.lit(float(m)) for m in maturities])))
    if quoted is not None:
        p = p.filter(F.col("reach") >= F.col("maturity") - 1e-9)
    m = F.col("maturity")
    aged = m - F.col("dt")
    p = p.withColumn("ytm", par_yield(m)).withColumn("_roll", par_yield(aged)).withColumn("_y1", par_yield(aged, "lnd1"))
    p = p.withColumn("total", price_bond(F.col("ytm"), aged, lnd="lnd1") / 100.0 - 1.0)
    p = with_duration_convexity(p, F.col("ytm"), m, bump)
    p = p.withColumn("d_yield", F.col("_y1") - F.col("_roll")).withColumn("carry", F.col("ytm") * F.col("dt"))
    p = p.withColumn("rolldown", -F.col("mod_dur") * (F.col("_roll") - F.col("ytm"))).withColumn("duration", -F.col("mod_dur") * F.col("d_yield"))
    p = p.withColumn("convexity", 0.5 * F.col("convexity") * F.col("d_yield") * F.col("d_yield"))
    p = p.withColumn("residual", F.col("total") - F.col("carry") - F.col("rolldown") - F.col("duration") - F.col("convexity"))
    return p.select("curve", F.col("d1").alias("d"), "maturity", "total", "carry", "rolldown", "duration", "convexity", "residual", "ytm", "mod_dur", "d_yield")


def constant_maturity_bill_returns(curve: DataFrame, maturity: float = 0.25, quoted: DataFrame | None = None, max_gap: float = 0.05,
                                   day_count: float = 365.0) -> DataFrame:
    """Zero-coupon version: total, carry with roll, curve shift."""
    p = _date_pairs(curve, max_gap, day_count, quoted)
    if quoted is not None:
        p = p.filter(F.col("reach") >= maturity - 1e-9)
    aged = F.lit(maturity) - F.col("dt")
    p = p.withColumn("p0", discount_at(maturity)).withColumn("pr", discount_at(aged)).withColumn("pn", discount_at(aged, "lnd1"))
    return p.select("curve", F.col("d1").alias("d"), F.lit(maturity).alias("maturity"), (F.col("pn") / F.col("p0") - 1.0).alias("total"),
                    (F.col("pr") / F.col("p0") - 1.0).alias("carry"), F.lit(0.0).alias("rolldown"), (F.col("pn") / F.col("pr") - 1.0).alias("duration"),
                    F.lit(0.0).alias("convexity"),
                    (F.col("pn") / F.col("p0") - 1.0 - (F.col("pr") / F.col("p0") - 1.0) - (F.col("pn") / F.col("pr") - 1.0)).alias("residual"),
                    (-F.ln("p0") / maturity).alias("ytm"), aged.alias("mod_dur"), F.lit(None).cast("double").alias("d_yield"))


def annualize(df: DataFrame, by: list[str], r: str = "r", ppy: float = 252.0, order: str = "d") -> DataFrame:
    d = drawdown(df.filter(F.col(r).isNotNull()), by, r, "_dd", order)
    return d.groupBy(*by).agg((F.pow(compound(F.col(r)) + 1.0, ppy / F.count("*")) - 1.0).alias("ann_return"),
                              (F.stddev_samp(r) * F.sqrt(F.lit(float(ppy)))).alias("ann_vol"), F.min("_dd").alias("max_dd"))


# ---- conventions ----


def discount_to_price(quote_pct: ColumnLike, days: int) -> Column:
    return 100.0 * (1.0 - c(quote_pct) / 100.0 * days / 360.0)


def discount_to_bey(quote_pct: ColumnLike, days: int) -> Column:
    p = discount_to_price(quote_pct, days)
    return (100.0 - p) / p * (365.0 / days) * 100.0


def continuous_to_simple(cc_pct: ColumnLike, years: float) -> Column:
    return (F.exp(c(cc_pct) / 100.0 * years) - 1.0) / years * 100.0


def to_period_return(annual_pct: ColumnLike, ppy: int) -> Column:
    return c(annual_pct) / 100.0 / ppy


def risk_free_from_curve(curve: DataFrame, maturity: float = 1 / 12) -> DataFrame:
    p = pack(curve, "zero")
    return p.select(*CURVE, continuous_to_simple(interp_row("ten", "ys", maturity), maturity).alias("rf_curve"))


def compare_risk_free(curve_rf: DataFrame, bill_quotes: DataFrame | None = None, monthly_rf: DataFrame | None = None) -> DataFrame:
    """Curve rate beside a bill quote's bond-equivalent yield and, by month end, a published monthly rate."""
    j = curve_rf.select("d", F.col("rf_curve").alias("curve_1m"))
    if bill_quotes is not None:
        j = j.join(bill_quotes.select("d", discount_to_bey("quote", 28).alias("dtb4wk_bey")), "d", "outer")
    if monthly_rf is None:
        return j.dropna("all", subset=[k for k in j.columns if k != "d"])
    m = j.groupBy(F.last_day("d").alias("d")).agg(*[F.max_by(k, F.when(F.col(k).isNotNull(), F.col("d"))).alias(k) for k in j.columns if k != "d"])
    m = m.join(monthly_rf.select(F.last_day("d").alias("d"), (F.col("rf") * 12 * 100).alias("french_rf")), "d", "left")
    return m.dropna("all", subset=[k for k in m.columns if k != "d"])


# ---- factors and predictors ----


def _nearest(value: str, m: float) -> Column:
    return F.min_by(value, F.struct(F.abs(F.col("tenor") - m), F.col("tenor")))


def curve_factors(curve: DataFrame, zero: str = "zero", level_span: tuple[float, float] | None = None, slope_short: float = 2.0,
                  keys: list[str] = CURVE) -> DataFrame:
    """Level, slope and curvature from the nearest tenors; the level may be the mean over a tenor span."""
    t2, t10, t30, ts = (_nearest(zero, m) for m in (2.0, 10.0, 30.0, slope_short))
    level = (t2 + t10 + t30) / 3.0 if level_span is None else F.avg(F.when(F.col("tenor").between(*level_span), F.col(zero)))
    return curve.groupBy(*keys).agg(level.alias("level"), (t10 - ts).alias("slope"), (2.0 * t10 - t2 - t30).alias("curvature"))


def change_and_z(df: DataFrame, by: list[str], names: list[str], lags: tuple[int, ...], window: int, min_periods: int, order: str = "d",
                 suffix=lambda k: f"chg{k}") -> DataFrame:
    """Adds changes over the given row lags and a trailing z-score to each column; one sort serves all."""
    w = win(by, order)
    extra = []
    for k in names:
        extra += [diff(k, w, n).alias(f"{k}_{suffix(n)}") for n in lags]
        extra.append(zscore(k, w, window, min_periods).alias(f"{k}_z"))
    return df.select("*", *extra)


def daily_curve_signals(quotes: DataFrame, by: list[str] = ["curve"], window: int = 252, min_periods: int = 120, lags=(5, 21),
                        par: str = "par", d: str = "d") -> DataFrame:
    """Level, slopes and curvature from five step-filled yields, with changes and z-scores."""
    wide = quotes.groupBy(*by, d).agg(*[F.max(F.when(F.col("tenor") == m, F.col(par))).alias(k) for k, m in
                                        (("y3m", 0.25), ("y2", 2.0), ("y5", 5.0), ("y10", 10.0), ("y30", 30.0))])
    w = win(by, d)
    f = wide.select(*by, d, *[(ffill(k, w) / 100.0).alias(k) for k in ("y3m", "y2", "y5", "y10", "y30")])
    s = f.select(*by, d, (F.col("y10") - F.col("y2")).alias("d_slope_2s10s"), (F.col("y10") - F.col("y3m")).alias("d_slope_10y3m"),
                 (F.col("y30") - F.col("y10")).alias("d_slope_10s30s"), F.col("y10").alias("d_level"),
                 (2 * F.col("y5") - F.col("y2") - F.col("y10")).alias("d_curvature"))
    return change_and_z(s, by, [k for k in s.columns if k.startswith("d_")], lags, window, min_periods, d)


def year_yields(curve: DataFrame, years: list[int], zero: str = "zero") -> DataFrame:
    """Zero yields at whole years, long in `n`, interpolated on each date's nodes."""
    p = pack(curve, zero)
    return p.select(*CURVE, F.explode(F.array(*[F.struct(F.lit(n).alias("n"), interp_row("ten", "ys", float(n)).alias("y")) for n in years])).alias("e")).select(*CURVE, "e.*")


def forward_rates(curve: DataFrame, maturities=(1, 2, 3, 4, 5), zero: str = "zero") -> DataFrame:
    """One-year forwards n*y(n) - (n-1)*y(n-1), long in `n`; n = 1 is the spot yield."""
    p = pack(curve, zero)
    y = lambda n: interp_row("ten", "ys", float(n))
    e = [F.struct(F.lit(n).alias("n"), (n * y(n) - (n - 1) * y(n - 1) if n > 1 else y(1)).alias("f")) for n in maturities]
    return p.select(*CURVE, F.explode(F.array(*e)).alias("e")).select(*CURVE, "e.*")


def bond_excess_returns(curve: DataFrame, maturities=(2, 3, 4, 5), horizon: int = 12, zero: str = "zero") -> DataFrame:
    """Log excess return over the next `horizon` rows: n*y_n(t) - (n-1)*y_{n-1}(t+h) - y_1(t), yields as fractions."""
    p = pack(curve, zero)
    w = Window.partitionBy("curve").orderBy("d")
    y = lambda n: interp_row("ten", "ys", float(n)) / 100.0
    wide = p.select(*CURVE, *[y(n).alias(f"_y{n}") for n in range(1, max(maturities) + 1)])
    e = [F.struct(F.lit(n).alias("n"), (n * F.col(f"_y{n}") - (n - 1) * F.lead(f"_y{n - 1}", horizon).over(w) - F.col("_y1")).alias("rx")) for n in maturities]
    return wide.withColumn("_e", F.array(*e)).select(*CURVE, F.explode("_e").alias("e")).select(*CURVE, "e.*")


def forward_spreads(forwards: DataFrame, maturities=(2, 3, 4, 5)) -> DataFrame:
    """f_n - f_1 by date."""
    f1 = F.max(F.when(F.col("n") == 1, F.col("f"))).over(Window.partitionBy(*CURVE))
    return forwards.withColumn("fb", F.col("f") - f1).filter(F.col("n").isin(*maturities)).select(*CURVE, "n", "fb")


def svensson_eval(m: ColumnLike, b0="beta0", b1="beta1", b2="beta2", b3="beta3", tau1="tau1", tau2="tau2") -> Column:
    x1, x2 = F.greatest(c(m) / c(tau1), F.lit(1e-12)), F.greatest(c(m) / c(tau2), F.lit(1e-12))
    s1 = (1.0 - F.exp(-x1)) / x1
    s2 = (1.0 - F.exp(-x2)) / x2
    return c(b0) + c(b1) * s1 + c(b2) * (s1 - F.exp(-x1)) + c(b3) * (s2 - F.exp(-x2))


def short_rate(b0: ColumnLike = "beta0", b1: ColumnLike = "beta1") -> Column:
    return c(b0) + c(b1)


def mean_reversion_ols(df: DataFrame, by: list[str], rate_pct: str, ppy: float = 252.0, min_obs: int = 100, order: str = "d") -> DataFrame:
    """Speed, volatility and half-life of a short rate from the regression of its change on its level."""
    w = win(by, order)
    known = df.filter(F.col(rate_pct).isNotNull()).withColumn("_r", F.col(rate_pct) / 100.0)
    pairs = known.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).withColumn("_x", F.lag("_r").over(w)).withColumn("_dr", F.col("_r") - F.col("_x"))
    g = pairs.filter(F.col("_x").isNotNull() & (F.col("_n") >= min_obs)).groupBy(*by).agg(
        F.count("*").alias("n"), F.covar_pop("_x", "_dr").alias("_sxy"), F.var_pop("_x").alias("_sxx"), F.var_pop("_dr").alias("_syy"))
    slope = F.col("_sxy") / F.nullif("_sxx", F.lit(0.0))
    sse = (F.col("_syy") - slope * F.col("_sxy")) * F.col("n")
    a = F.greatest(-slope * ppy, F.lit(1e-4))
    return g.select(*by, "n", a.alias("a"), (F.sqrt(sse / (F.col("n") - 2)) * F.sqrt(F.lit(float(ppy)))).alias("sigma"), (F.lit(0.6931471805599453) / a).alias("half_life"))


def carry_roll_edges(curve: DataFrame, bonds: DataFrame, funds: DataFrame, zero: str = "zero", window: int = 12, min_periods: int = 6) -> DataFrame:
    """Per asset: yield / 12 plus roll times duration for curve assets, trailing mean return for the rest; lagged one row.

    `bonds` is (curve, asset, maturity, dur); `funds` is (asset, d, r).
    """
    p = pack(curve, zero).join(bonds, "curve")
    grid0 = F.element_at("ten", 1)
    now = interp_row("ten", "ys", F.col("maturity"))
    rolled = interp_row("ten", "ys", F.greatest(F.col("maturity") - 1 / 12, grid0))
    a = p.select("asset", "d", (now / 12.0 + (now - rolled) * F.col("dur")).alias("edge"))
    b = funds.select("asset", "d", roll_mean("r", win(["asset"]), window, min_periods).alias("edge"))
    return a.unionByName(b).withColumn("edge", F.lag("edge").over(win(["asset"])))
