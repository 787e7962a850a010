"""Queries: signal blocks and assembled panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6, win
from ..operators import align as A
from ..operators import signals as S
from ..operators import timeseries as T
from ..session import stored
from .registry import query, view
from .series import F_, cr, gd, out, zs

ROLES = {"equity": "LARGE", "bond": "MEDIUM", "gold": "PROMO", "risky": "SMALL", "safe": "STANDARD"}
STALE = ("PROMO", "SMALL")

# daily series under published codes, from line attributes; monthly macro from orders by priority
_DAY = "CAST(l_shipdate AS DATE)"
view("ser_d", f"""SELECT CASE l_linenumber WHEN 1 THEN 'DGS3MO' WHEN 2 THEN 'DAAA' WHEN 3 THEN 'DBAA' WHEN 4 THEN 'DGS2' WHEN 5 THEN 'DGS5' WHEN 6 THEN 'DGS10' ELSE 'DGS30' END AS series, {_DAY} AS d, AVG(l_discount)*100 AS x FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT CASE l_returnflag WHEN 'R' THEN 'VXVCLS' WHEN 'N' THEN 'VIXCLS' ELSE 'DCOILWTICO' END, {_DAY}, AVG(l_tax)*400 + 5 FROM lineitem GROUP BY 1, 2""")
view("ser_m", """SELECT k.series, m.d, m.x FROM (SELECT o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, AVG(o_totalprice)/1e5 AS x FROM orders GROUP BY 1, 2) m JOIN
  (VALUES ('1-URGENT', 'CPIAUCSL'), ('1-URGENT', 'UNRATE'), ('2-HIGH', 'CPILFESL'), ('2-HIGH', 'UMCSENT'), ('3-MEDIUM', 'INDPRO'), ('3-MEDIUM', 'NFCI'), ('4-NOT SPECIFIED', 'PAYEMS'), ('4-NOT SPECIFIED', 'ANFCI'), ('5-LOW', 'ICSA'), ('5-LOW', 'THREEFYTP10'), ('1-URGENT', 'PCEPILFE'), ('2-HIGH', 'M2SL'), ('3-MEDIUM', 'HOUST'), ('4-NOT SPECIFIED', 'PERMIT'), ('5-LOW', 'AWHMAN'), ('1-URGENT', 'T10Y3M')) k(p, series) ON k.p = m.p""")
view("days", f"SELECT DISTINCT {_DAY} AS d FROM lineitem")
view("dret", "SELECT a.asset, days.d, r.r FROM days CROSS JOIN (SELECT DISTINCT asset FROM px_d) a LEFT JOIN ret_d r ON r.asset = a.asset AND r.d = days.d")
_STEP = ["DAAA", "DBAA", "DGS10", "VIXCLS", "VXVCLS", "DCOILWTICO"]
view("lev_d", "SELECT 'all' AS asset, d, " + ", ".join(f"last_value({k} IGNORE NULLS) OVER (ORDER BY d) AS {k}" for k in _STEP) +
     " FROM (SELECT days.d, " + ", ".join(f"MAX(CASE WHEN series = '{k}' THEN x END) AS {k}" for k in _STEP) + " FROM days LEFT JOIN ser_d s ON s.d = days.d GROUP BY days.d)")
_REL = ["CPIAUCSL", "CPILFESL", "INDPRO", "PAYEMS", "UNRATE", "UMCSENT", "NFCI", "ANFCI", "ICSA"]
view("rel_d", "SELECT days.d, 'all' AS asset, " + ", ".join(f"{k}.x AS {k}" for k in _REL) + " FROM days " + " ".join(
    f"ASOF LEFT JOIN (SELECT d + {S.PUBLICATION_DAYS.get(k, 30)} AS d, x FROM ser_m WHERE series = '{k}') {k} ON days.d >= {k}.d" for k in _REL))


def ser_d(t):
    n = F.col("l_linenumber")
    code = F.coalesce(*[F.when(n == k, F.lit(v)) for k, v in ((1, "DGS3MO"), (2, "DAAA"), (3, "DBAA"), (4, "DGS2"), (5, "DGS5"), (6, "DGS10"), (7, "DGS30"))])
    tax = F.when(F.col("l_returnflag") == "R", "VXVCLS").when(F.col("l_returnflag") == "N", "VIXCLS").otherwise("DCOILWTICO")
    day = F.col("l_shipdate").cast("date").alias("d")
    a = t.lineitem.groupBy(code.alias("series"), day).agg((F.avg("l_discount") * 100).alias("x"))
    return a.unionByName(t.lineitem.groupBy(tax.alias("series"), day).agg((F.avg("l_tax") * 400 + 5).alias("x")))


PRIORITY = (("1-URGENT", "CPIAUCSL", "UNRATE", "PCEPILFE", "T10Y3M"), ("2-HIGH", "CPILFESL", "UMCSENT", "M2SL"), ("3-MEDIUM", "INDPRO", "NFCI", "HOUST"), ("4-NOT SPECIFIED", "PAYEMS", "ANFCI", "PERMIT"),
            ("5-LOW", "ICSA", "THREEFYTP10", "AWHMAN"))


def ser_m(t):
    m = t.orders.groupBy(F.col("o_orderpriority").alias("p"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("d")).agg((F.avg("o_totalprice") / 1e5).alias("x"))
    codes = F.coalesce(*[F.when(F.col("p") == p, F.array(*[F.lit(k) for k in codes])) for p, *codes in PRIORITY])
    return m.select(F.explode(codes).alias("series"), "d", "x")


def days(t):
    return t.lineitem.select(F.col("l_shipdate").cast("date").alias("d")).distinct()


def dret(t):
    """Dense daily returns; a date without trades of an asset is NULL."""
    p = t.ret_d.select("asset", "d", "r")
    return A.reindex(p, A.spine(p, ["asset"], "1 day"), ["asset", "d"])


def lev_d(t):
    return S.step_levels(ser_d(t), days(t), _STEP)


def rel_d(t):
    return S.step_levels(ser_m(t), days(t), _REL, release=True)


def quotes_d(t):
    ten = F.coalesce(*[F.when(F.col("series") == k, F.lit(v)) for k, v in (("DGS3MO", 0.25), ("DGS2", 2.0), ("DGS5", 5.0), ("DGS10", 10.0), ("DGS30", 30.0))])
    return ser_d(t).select("d", ten.alias("tenor"), F.col("x").alias("par")).filter("tenor is not null")


def block(df):
    return out(df, "x", keys=("signal", "d"))


def long_sql(cols: dict, src: str, per_asset: bool = False, suffix: str = "") -> str:
    name = (lambda k: f"'{k}_' || asset || '{suffix}'") if per_asset else (lambda k: f"'{k}'")
    return " UNION ALL ".join(f"SELECT {name(k)} AS signal, d, round({e}, 6)+0.0 AS x FROM {src}" for k, e in cols.items())


def lg(x, k=1):
    return f"LAG({x}, {k}) OVER (PARTITION BY asset ORDER BY d)"


def df_(x, k=1):
    return f"({x} - {lg(x, k)})"


def chg(names, lags, n, m):
    c = {}
    for k in names:
        c |= {k: k, **{f"{k}_chg{g}": df_(k, g) for g in lags}, f"{k}_z": zs(k, n, m)}
    return c


# ---- daily ----

_Q = ("DGS3MO", "DGS2", "DGS5", "DGS10", "DGS30")
view("blk_cur0", "SELECT d, " + ", ".join(f"last_value({k} IGNORE NULLS) OVER (ORDER BY d)/100 AS {k}" for k in _Q) + " FROM (SELECT days.d, " + ", ".join(f"MAX(CASE WHEN series = '{k}' THEN x END) AS {k}" for k in _Q) + " FROM days LEFT JOIN ser_d s ON s.d = days.d GROUP BY days.d)")
view("blk_cur", "SELECT 'all' AS asset, d, DGS10 - DGS2 AS d_slope_2s10s, DGS10 - DGS3MO AS d_slope_10y3m, DGS30 - DGS10 AS d_slope_10s30s, DGS10 AS d_level, 2*DGS5 - DGS2 - DGS10 AS d_curvature FROM blk_cur0")
CUR_SQL = long_sql(chg(("d_slope_2s10s", "d_slope_10y3m", "d_slope_10s30s", "d_level", "d_curvature"), (5, 21), 252, 120), "blk_cur")
view("blk_cre", "SELECT asset, d, (DBAA - DAAA)/100 AS d_baa_aaa, (DBAA - DGS10)/100 AS d_baa_10y FROM lev_d")
CRE_SQL = long_sql(chg(("d_baa_aaa", "d_baa_10y"), (5, 21), 252, 120), "blk_cre")
view("blk_rv", f"SELECT asset, d, {gd('stddev_samp', 'r', 21, 15)}*sqrt(252)*100 AS rv, {gd('stddev_samp', 'r', 21, 10)}*sqrt(252) AS d_rvol21, {gd('stddev_samp', 'r', 63, 31)}*sqrt(252) AS d_rvol63 FROM dret")
view("blk_vol", "SELECT l.asset, l.d, VIXCLS AS d_vix, VXVCLS/NULLIF(VIXCLS, 0) AS d_vix_term, VIXCLS - rv AS d_vrp FROM lev_d l LEFT JOIN (SELECT d, rv FROM blk_rv WHERE asset = 'LARGE') v ON v.d = l.d")
VOL_SQL = " UNION ALL ".join([
    long_sql({"d_vix": "d_vix", "d_vix_chg5": df_("d_vix", 5), "d_vix_z": zs("d_vix", 252, 120), "d_vrp": "d_vrp", "d_vrp_z": zs("d_vrp", 252, 120), "d_vix_term": "d_vix_term"}, "blk_vol"),
    long_sql({"d_rvol21": "d_rvol21", "d_rvol63": "d_rvol63"}, "blk_rv", True),
    long_sql({"d_rvol21": zs("d_rvol21", 252, 120), "d_rvol63": zs("d_rvol63", 252, 120)}, "blk_rv", True, "_z")])
view("blk_g0", "SELECT asset, d, CASE WHEN r IS NOT NULL THEN product(1 + r) OVER (PARTITION BY asset ORDER BY d) END AS g FROM dret")
view("blk_g", "SELECT *, last_value(g IGNORE NULLS) OVER (PARTITION BY asset ORDER BY d) AS gp FROM blk_g0")


def pc(x, k, s=0):
    return f"({lg(x, s) if s else x}/NULLIF({lg(x, k + s)}, 0) - 1)"


MOM_SQL = long_sql({**{f"d_mom{n}": pc("gp", n) for n in S.MOM_WINDOWS}, **{f"d_mom{n}s5": pc("gp", n - 5, 5) for n in S.MOM_WINDOWS if n > 21},
                    **{f"d_ma{a}_{b}": f"({gd('AVG', 'g', a)}/NULLIF({gd('AVG', 'g', b)}, 0) - 1)" for a, b in S.MA_PAIRS}}, "blk_g", True)
REV_SQL = long_sql({f"d_rev{n}": f"-{pc('gp', n)}" for n in S.REV_WINDOWS}, "blk_g", True)
view("blk_mac", "SELECT r.*, l.DCOILWTICO FROM rel_d r JOIN lev_d l USING (d)".replace("r.*", "r.asset, r.d, " + ", ".join(_REL)))
MAC_SQL = long_sql({**{f"{k}_yoy": pc(s, 252) for s, k in (("CPIAUCSL", "d_cpi"), ("CPILFESL", "d_core_cpi"), ("INDPRO", "d_indpro"), ("PAYEMS", "d_payems"))},
                    **{n: e for s, k in (("UNRATE", "d_unrate"), ("UMCSENT", "d_sentiment"), ("NFCI", "d_nfci"), ("ANFCI", "d_anfci")) for n, e in ((k, s), (f"{k}_chg", df_(s, 21)))},
                    "d_claims": "ICSA", "d_claims_z": zs("ICSA", 252, 120), "d_oil_mom63": pc("DCOILWTICO", 63), "d_oil_z": zs("DCOILWTICO", 252, 120)}, "blk_mac")
_W = "MAX(CASE WHEN asset = '{a}' THEN r END) AS {n}"
view("blk_x0", "SELECT 'all' AS asset, d, " + ", ".join(_W.format(a=ROLES[k], n=k) for k in ROLES) + " FROM dret GROUP BY d")
view("blk_x", f"SELECT asset, d, equity, bond, gold, risky, safe, CASE WHEN COUNT(equity*bond) OVER {F_(126)} >= 60 THEN corr(equity, bond) OVER {F_(126)} END AS d_stock_bond_corr FROM blk_x0")


def cg(x, n):
    return gd("product", f"(1 + {x})", n)


CRO_SQL = long_sql({"d_stock_bond_corr": "d_stock_bond_corr", "d_stock_bond_corr_chg": df_("d_stock_bond_corr", 21), "d_gold_vs_eq": f"({cg('gold', 126)} - {cg('equity', 126)})", "d_hy_vs_ig": f"({cg('risky', 63)} - {cg('safe', 63)})"}, "blk_x")


def daily_blocks(t):
    r, lv = stored(dret(t)), stored(lev_d(t))
    return [S.daily_curve_block(quotes_d(t), days(t)), S.daily_credit_block(lv), S.daily_volatility_block(lv, r, ROLES), S.daily_momentum_block(r),
            S.daily_reversal_block(r), S.daily_macro_block(rel_d(t), lv), S.daily_cross_asset_block(r, ROLES)]


@query("daily_curve_block", CUR_SQL)
def _(t):
    return block(S.daily_curve_block(quotes_d(t), days(t)))


@query("daily_credit_block", CRE_SQL)
def _(t):
    return block(S.daily_credit_block(lev_d(t)))


@query("daily_volatility_block", VOL_SQL)
def _(t):
    return block(S.daily_volatility_block(lev_d(t), stored(dret(t)), ROLES))


@query("daily_momentum_block", MOM_SQL)
def _(t):
    return block(S.daily_momentum_block(dret(t)))


@query("daily_reversal_block", REV_SQL)
def _(t):
    return block(S.daily_reversal_block(dret(t)))


@query("daily_macro_block", MAC_SQL)
def _(t):
    return block(S.daily_macro_block(rel_d(t), lev_d(t)))


@query("daily_cross_asset_block", CRO_SQL)
def _(t):
    return block(S.daily_cross_asset_block(dret(t), ROLES))


def _lagged(sql, stale=()):
    two = " OR ".join(f"ends_with(signal, '_{a}')" for a in stale) or "false"
    return f"SELECT signal, d, CASE WHEN {two} THEN LAG(x, 2) OVER w ELSE LAG(x, 1) OVER w END AS x FROM ({sql}) WINDOW w AS (PARTITION BY signal ORDER BY d)"


view("daily_all", " UNION ALL ".join([CUR_SQL, CRE_SQL, VOL_SQL, MOM_SQL, REV_SQL, MAC_SQL, CRO_SQL]))


@query("daily_panel", _lagged("SELECT * FROM daily_all", STALE))
def _(t):
    return block(S.daily_panel(daily_blocks(t), stale=STALE))


# ---- monthly ----

view("mret", "SELECT asset, last_day(d) AS d, r FROM ret_m")
view("msd", "SELECT series, last_day(d) AS d, arg_max(x, d) AS x FROM (SELECT * FROM ser_d UNION ALL SELECT * FROM ser_m) GROUP BY 1, 2")


def mlev(ids, lags=None, name="x"):
    """SQL of wide month-end levels with row lags."""
    lags = lags or {}
    base = "SELECT d, " + ", ".join(f"MAX(CASE WHEN series = '{k}' THEN x END) AS {k}" for k in ids) + " FROM (SELECT series, d, x FROM (" + " UNION ALL ".join(
        f"SELECT series, d, LAG(x, {lags.get(k, 0)}) OVER (ORDER BY d) AS x FROM msd WHERE series = '{k}'" for k in ids) + ")) GROUP BY d"
    return f"SELECT 'all' AS asset, d, {', '.join(ids)} FROM ({base})"


def series_all(t):
    return ser_d(t).unionByName(ser_m(t))


def mret(t):
    return t.ret_m.select("asset", F.last_day("d").alias("d"), "r")


view("mb_cre0", mlev(["DBAA", "DAAA", "DGS10"]))
view("mb_cre", "SELECT asset, d, DBAA - DAAA AS baa_aaa, DBAA - DGS10 AS baa_10y, DAAA - DGS10 AS aaa_10y, row_number() OVER (ORDER BY d) AS rn FROM mb_cre0")


def rank_sql(x, src, n=120, m=30):
    return f"""(SELECT a.d, CASE WHEN COUNT(b.{x}) >= {m} THEN CASE WHEN ANY_VALUE(a.{x}) IS NULL THEN 0.0 ELSE COUNT(*) FILTER (WHERE b.rn < a.rn AND b.{x} < a.{x}) END/NULLIF(COUNT(*) FILTER (WHERE b.rn < a.rn), 0) END AS v
      FROM {src} a JOIN {src} b ON b.rn BETWEEN a.rn - {n - 1} AND a.rn GROUP BY 1)"""


_MC = " UNION ALL ".join([long_sql({n: e for k in ("baa_aaa", "baa_10y", "aaa_10y") for n, e in ((k, k), (f"{k}_chg", df_(k)), (f"{k}_chg3", df_(k, 3)), (f"{k}_z", zs(k, 60, 20)))}, "mb_cre"),
                          *[f"SELECT '{k}_rank' AS signal, d, round(v, 6)+0.0 AS x FROM {rank_sql(k, 'mb_cre')}" for k in ("baa_aaa", "baa_10y", "aaa_10y")]])
MCRE_SQL = _lagged(_MC)


def credit_levels(t):
    m = S.month_levels(ser_d(t), ["DBAA", "DAAA", "DGS10"])
    return m.withColumnRenamed("DBAA", "BAA").withColumnRenamed("DAAA", "AAA")


@query("monthly_credit_block", MCRE_SQL)
def _(t):
    return block(S.monthly_credit_block(credit_levels(t)))


view("mb_rv", f"SELECT asset, d, {gd('stddev_samp', 'r', 12)}*sqrt(12) AS rvol FROM mret")
view("mb_vol0", mlev(["VIXCLS"]))
view("mb_vol", "SELECT l.asset, l.d, VIXCLS AS vix, VIXCLS/100 - rvol AS vrp_proxy, row_number() OVER (ORDER BY l.d) AS rn FROM mb_vol0 l LEFT JOIN (SELECT d, rvol FROM mb_rv WHERE asset = 'LARGE') v USING (d)")
MVOL_SQL = " UNION ALL ".join([long_sql({"vix": "vix", "vix_chg": df_("vix"), "vix_z": zs("vix", 60, 20), "vrp_proxy": "vrp_proxy"}, "mb_vol"), f"SELECT 'vix_rank' AS signal, d, round(v, 6)+0.0 AS x FROM {rank_sql('vix', 'mb_vol')}",
                               long_sql({"rvol": "rvol"}, "mb_rv", True), long_sql({"rvol": zs("rvol", 60, 20)}, "mb_rv", True, "_z")])


@query("monthly_volatility_block", MVOL_SQL)
def _(t):
    return block(S.monthly_volatility_block(S.month_levels(ser_d(t), ["VIXCLS"]), mret(t), ROLES))


MACRO_IDS = ["CPIAUCSL", "CPILFESL", "INDPRO", "PAYEMS", "UNRATE", "UMCSENT", "NFCI", "ANFCI", "ICSA", "DCOILWTICO", "PCEPILFE", "M2SL", "HOUST", "PERMIT", "AWHMAN", "T10Y3M"]
_YOY = {f"{k}_yoy": pc(s, 12) for s, k in S.MACRO_YOY}
view("mb_mac0", mlev(MACRO_IDS, S.PUBLICATION_MONTHS))
view("mb_mac", "SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in _YOY.items()) + f", {gd('AVG', 'UNRATE', 3)} AS u3 FROM mb_mac0")
_LEV = {n: e for s, k in S.MACRO_LEVEL for n, e in ((k, s), (f"{k}_chg", df_(s)), (f"{k}_z", zs(s, 60, 20)))}
MMAC_SQL = long_sql({**{k: k for k in _YOY}, **{f"{k}_dev": f"({k} - {gd('AVG', k, 36, 12)})" for k in _YOY}, **_LEV, "sahm": f"(u3 - {gd('MIN', 'u3', 12)})", "oil_yoy": pc("DCOILWTICO", 12), "oil_z": zs("DCOILWTICO", 60, 20)}, "mb_mac")


@query("monthly_macro_block", MMAC_SQL)
def _(t):
    return block(S.monthly_macro_block(S.month_levels(series_all(t), MACRO_IDS, S.PUBLICATION_MONTHS)))


view("mb_x0", "SELECT 'all' AS asset, d, " + ", ".join(_W.format(a=ROLES[k], n=k) for k in ("equity", "bond", "gold")) + " FROM mret GROUP BY d")
view("mb_x", f"SELECT *, CASE WHEN COUNT(equity*bond) OVER {F_(36)} >= 18 THEN corr(equity, bond) OVER {F_(36)} END AS sbc FROM mb_x0")
MMOM_SQL = " UNION ALL ".join([long_sql({**{f"mom{n}": f"({cg('r', n)} - 1)" for n in (1, 3, 6, 12)}, "mom12_1": f"({gd('product', '(1 + r)', 11, lag=1)} - 1)"}, "mret", True),
                               long_sql({"stock_bond_corr": "sbc", "stock_bond_corr_chg": df_("sbc", 3), "gold_vs_equity_12m": f"({cg('gold', 12)} - {cg('equity', 12)})"}, "mb_x")])


@query("monthly_momentum_block", MMOM_SQL)
def _(t):
    return block(S.monthly_momentum_block(mret(t), ROLES))


view("mb_reg", "SELECT 'all' AS asset, last_day(r.d) AS d, r.gd AS growth_dev, r.idv AS inflation_dev, regime, rf*100 AS crisis_prob FROM rel_m r LEFT JOIN rf_m USING (d)")
MREG_SQL = long_sql({**{f"regime_{s.lower()}": f"CASE WHEN regime = '{s}' THEN 1 ELSE 0 END" for s in T.REGIMES}, "growth_dev": "growth_dev", "inflation_dev": "inflation_dev", "crisis_prob": "crisis_prob", "crisis_prob_chg": df_("crisis_prob", 3)}, "mb_reg")


def regime_block(t):
    from .states import rel

    reg = rel(t).withColumn("d", F.last_day("d"))
    return S.monthly_regime_block(reg.select("d", "regime", "growth_dev", "inflation_dev"), t.rf_m.select(F.last_day("d").alias("d"), (F.col("rf") * 100).alias("p")))


@query("monthly_regime_block", MREG_SQL)
def _(t):
    return block(regime_block(t))


view("mb_tp", mlev(["THREEFYTP10"]))
MTP_SQL = long_sql({"term_premium": "THREEFYTP10", "term_premium_chg": df_("THREEFYTP10"), "term_premium_z": zs("THREEFYTP10", 60, 20)}, "mb_tp")


@query("monthly_term_premium_block", MTP_SQL)
def _(t):
    return block(S.monthly_term_premium_block(S.month_levels(ser_m(t), ["THREEFYTP10"])))


view("mb_cur", """SELECT 'all' AS asset, last_day(d) AS d, AVG(zero) FILTER (WHERE tenor BETWEEN 2 AND 30) AS curve_level, MAX(CASE WHEN tenor = 10 THEN zero END) - MAX(CASE WHEN tenor = 0.5 THEN zero END) AS curve_slope,
  2*MAX(CASE WHEN tenor = 10 THEN zero END) - MAX(CASE WHEN tenor = 2 THEN zero END) - MAX(CASE WHEN tenor = 30 THEN zero END) AS curve_curvature, MAX(CASE WHEN tenor = 10 THEN zero END) - MAX(CASE WHEN tenor = 2 THEN zero END) AS curve_slope_2s10s,
  MAX(CASE WHEN tenor < 0.1 THEN zero END) AS short_rate FROM disc_m GROUP BY d""")
_C4 = ("curve_level", "curve_slope", "curve_curvature", "short_rate")
view("cmr_span", "SELECT maturity, last_day(MIN(d)) AS a, last_day(MAX(d)) AS b FROM cmr_m GROUP BY 1")
view("cmr_grid", "SELECT maturity, last_day(d) AS d FROM cmr_span, (SELECT DISTINCT d FROM rf_m) m WHERE last_day(m.d) BETWEEN a AND b")
MCUR_SQL = " UNION ALL ".join([
    long_sql({**{k: k for k in (*_C4, "curve_slope_2s10s")}, **{f"{k}_chg": df_(k) for k in _C4}, **{f"{k}_z": zs(k, 60, 20) for k in _C4}}, "mb_cur"),
    "SELECT 'fwd_f' || n AS signal, last_day(d) AS d, round(f, 6)+0.0 AS x FROM fwd_m",
    "SELECT 'fb' || a.n AS signal, last_day(a.d) AS d, round(a.f - b.f, 6)+0.0 AS x FROM fwd_m a JOIN fwd_m b ON a.d = b.d AND b.n = 1 WHERE a.n > 1",
    "SELECT 'carry_roll_' || CAST(g.maturity AS INT) || 'y' AS signal, g.d, round(COALESCE(SUM(carry + rolldown), 0)*12, 6)+0.0 AS x FROM cmr_grid g LEFT JOIN cmr_m c ON c.maturity = g.maturity AND last_day(c.d) = g.d GROUP BY g.maturity, g.d",
    "SELECT 'mod_dur_' || CAST(g.maturity AS INT) || 'y' AS signal, g.d, round(MAX(mod_dur), 6)+0.0 AS x FROM cmr_grid g LEFT JOIN cmr_m c ON c.maturity = g.maturity AND last_day(c.d) = g.d GROUP BY g.maturity, g.d"])


def curve_block(t):
    from .curve import cmr, curve

    return S.monthly_curve_block(stored(curve(t)), stored(cmr(t)))


@query("monthly_curve_block", MCUR_SQL)
def _(t):
    return block(curve_block(t))


view("monthly_all", " UNION ALL ".join([MCUR_SQL, f"SELECT * FROM ({MCRE_SQL})", MVOL_SQL, MMAC_SQL, MMOM_SQL, MREG_SQL, MTP_SQL]))


@query("monthly_panel", _lagged("SELECT * FROM monthly_all WHERE signal IN (SELECT signal FROM monthly_all GROUP BY 1 HAVING COUNT(x) > 60 AND stddev_samp(x) > 1e-12)"))
def _(t):
    m = stored(mret(t))
    all_ = S.month_levels(stored(series_all(t)), MACRO_IDS, S.PUBLICATION_MONTHS)
    blocks = [curve_block(t), S.monthly_credit_block(credit_levels(t)), S.monthly_volatility_block(S.month_levels(ser_d(t), ["VIXCLS"]), m, ROLES), S.monthly_macro_block(all_),
              S.monthly_momentum_block(m, ROLES), regime_block(t), S.monthly_term_premium_block(S.month_levels(ser_m(t), ["THREEFYTP10"]))]
    panel = stored(S.assemble([block(b) for b in blocks]))
    return block(S.monthly_panel([panel], min_count=60))


view("idx_m", "SELECT 'all' AS asset, d, px, vol, r FROM bench_m")
view("idx_o", "SELECT *, SUM(COALESCE(sign(r), 0)*vol) OVER (ORDER BY d) AS obv FROM idx_m")
_RULES = {**{f"tchi_ma{s}_{g}": cr("px", s, g) for s, g in S.RULE_PAIRS}, **{f"tchi_mom{k}": f"CASE WHEN {lg('px', k)} IS NOT NULL THEN CASE WHEN px >= {lg('px', k)} THEN 1 ELSE 0 END END" for k in S.RULE_LAGS},
          **{f"tchi_vol{s}_{g}": cr("obv", s, g) for s, g in S.RULE_PAIRS}}
view("rules0", long_sql(_RULES, "idx_o"))
RULE_SQL = _lagged("SELECT * FROM rules0 UNION ALL SELECT 'tchi_mean', d, round(AVG(x), 6)+0.0 FROM rules0 GROUP BY d")


def index_m(t):
    return t.bench_m.select(F.lit("all").alias("u"), "d", "px", "vol")


@query("technical_rule_block", RULE_SQL)
def _(t):
    return block(S.technical_rule_block(index_m(t)))


view("lit_v", "SELECT asset, d, " + ", ".join(f"{e} AS {n}" for n, e in {
    "gw_dp": "ln(dv)-ln(p)", "gw_dy": "ln(dv)-ln(LAG(p) OVER (ORDER BY d))", "gw_ep": "ln(e)-ln(p)", "gw_de": "ln(dv)-ln(e)", "gw_cape": "cape", "gw_cape_inv": "1/NULLIF(cape, 0)", "gw_ygap": "e/p - gs10/100"}.items()) +
     " FROM (SELECT 'all' AS asset, d, px AS p, vol/1000 AS dv, px*(1 + COALESCE(r, 0))/10 AS e, px/vol*1000 AS cape, vol/1000 AS gs10 FROM bench_m)")
_LV = ("gw_dp", "gw_dy", "gw_ep", "gw_de", "gw_cape", "gw_cape_inv", "gw_ygap")
view("lit_gap", """SELECT asset, d, gap AS ogap FROM (WITH p AS (SELECT 'all' AS asset, d, ln(px) AS y, row_number() OVER (ORDER BY d) - 1.0 AS t FROM bench_m),
  s AS (SELECT a.asset, a.d, a.y AS y1, a.t AS t1, COUNT(*) AS n, AVG(b.y) AS my, AVG(b.t) AS mt FROM p a JOIN p b ON b.t <= a.t GROUP BY ALL),
  u AS (SELECT s.asset, s.d, s.y1, s.t1 - s.mt AS u1, s.n, s.my, SUM(POW(b.t - s.mt, 2)) AS s2, SUM(POW(b.t - s.mt, 4)) AS s4, SUM((b.t - s.mt)*(b.y - s.my)) AS suy, SUM(POW(b.t - s.mt, 2)*(b.y - s.my)) AS su2y FROM s JOIN p b ON b.t <= s.t1 GROUP BY ALL)
  SELECT asset, d, CASE WHEN n >= 24 THEN y1 - my - suy/NULLIF(s2, 0)*u1 - su2y/NULLIF(s4 - s2*s2/n, 0)*(u1*u1 - s2/n) END AS gap FROM u)""")
view("lit_ik", "SELECT 'all' AS asset, d, price/growth*1e3 AS ik FROM macro_m")
view("lit_sv", "SELECT 'all' AS asset, last_day(d) AS d, COALESCE(SUM(r*r), 0) AS sv FROM dret WHERE asset = 'LARGE' GROUP BY 2")
view("lit_sp", "SELECT 'all' AS asset, d, MAX(CASE WHEN asset = 'MEDIUM' THEN r END) AS ltr, MAX(CASE WHEN asset = 'STANDARD' THEN r END) - MAX(CASE WHEN asset = 'MEDIUM' THEN r END) AS dfr FROM ret_m GROUP BY d")
LIT_SQL = " UNION ALL ".join([
    long_sql({**{k: k for k in _LV}, **{n: e for k in ("gw_dp", "gw_ep", "gw_cape") for n, e in ((f"{k}_dev", f"({k} - {gd('AVG', k, 36, 18)})"), (f"{k}_z", zs(k, 36, 18)))}}, "lit_v"),
    long_sql({"ogap": "ogap", "ogap_chg": df_("ogap")}, "lit_gap"), long_sql({"ik_proxy": "ik", "ik_proxy_dev": f"(ik - {gd('AVG', 'ik', 36, 18)})"}, "lit_ik"),
    long_sql({"gw_svar": "sv", "gw_svar_log": "ln(NULLIF(sv, 0))"}, "lit_sv"), long_sql({"gw_ltr": "ltr", "gw_dfr": "dfr"}, "lit_sp")])


@query("literature_panel", f"{_lagged(LIT_SQL)} UNION ALL SELECT * FROM ({RULE_SQL})")
def _(t):
    b = t.bench_m
    v = b.select(F.lit("all").alias("u"), "d", F.col("px").alias("p"), (F.col("vol") / 1000).alias("dv"), (F.col("px") * (1 + F.coalesce("r", F.lit(0.0))) / 10).alias("e"),
                 (F.col("px") / F.col("vol") * 1000).alias("cape"), (F.col("vol") / 1000).alias("gs10"))
    o = b.select(F.lit("all").alias("u"), "d", F.col("px").alias("x"))
    i = t.macro_m.select(F.lit("all").alias("u"), "d", (F.col("price") * 1e3).alias("inv"), F.col("growth").alias("gdp"))
    dr = dret(t).filter("asset = 'LARGE'").select(F.lit("all").alias("u"), "d", "r")
    return block(S.literature_panel(v, index_m(t), o, i, dr, t.ret_m, "MEDIUM", "STANDARD", window=36, min_periods=18, min_obs=24))


@query("bond_signal_panel", """WITH c AS (SELECT last_day(d) AS d, AVG(zero) FILTER (WHERE tenor BETWEEN 1.5 AND 30) AS level, MAX(CASE WHEN tenor = 10 THEN zero END) - MAX(CASE WHEN tenor = 0.5 THEN zero END) AS slope,
  2*MAX(CASE WHEN tenor = 10 THEN zero END) - MAX(CASE WHEN tenor = 2 THEN zero END) - MAX(CASE WHEN tenor = 30 THEN zero END) AS curvature FROM disc_m GROUP BY 1)
  SELECT 'level' AS signal, d, round(level, 6)+0.0 AS x FROM c UNION ALL SELECT 'slope', d, round(slope, 6)+0.0 FROM c UNION ALL SELECT 'curvature', d, round(curvature, 6)+0.0 FROM c
  UNION ALL SELECT 'fb' || a.n, last_day(a.d), round(a.f - b.f, 6)+0.0 FROM fwd_m a JOIN fwd_m b ON a.d = b.d AND b.n = 1 WHERE a.n > 1
  UNION ALL SELECT 'carry_roll_' || CAST(g.maturity AS INT) || 'y', g.d, round(COALESCE(SUM(carry + rolldown), 0)*12, 6)+0.0 FROM cmr_grid g LEFT JOIN cmr_m c ON c.maturity = g.maturity AND last_day(c.d) = g.d GROUP BY g.maturity, g.d
  UNION ALL SELECT 'term_premium', last_day(d), round(arg_max(x, d), 6)+0.0 FROM ser_m WHERE series = 'THREEFYTP10' GROUP BY 2""")
def _(t):
    from .curve import cmr, curve

    tp = ser_m(t).filter("series = 'THREEFYTP10'")
    return block(S.bond_signal_panel(stored(curve(t)), stored(cmr(t)), term_premium=tp))
