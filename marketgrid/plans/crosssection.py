"""Queries: cross-sectional scores, weights and tilts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6, win
from ..operators import align as A
from ..operators import crosssection as X
from .registry import query, view
from .series import out, sq

# signal x with missing values and one empty date, a tied version xt, the forward return f, and base weights b
view("xs_m", """SELECT asset, d, r, r AS x, round(r * 5) AS xt, LEAD(r) OVER (PARTITION BY asset ORDER BY d) AS f,
  vol/SUM(vol) OVER (PARTITION BY d) AS b FROM ret_m""")


def xs_m(t):
    w = X.over(["d"])
    return t.ret_m.select("asset", "d", "r", F.col("r").alias("x"), F.round(F.col("r") * 5).alias("xt"), F.lead("r").over(win(["asset"])).alias("f"),
                          (F.col("vol") / F.sum("vol").over(w)).alias("b"))


PD = "OVER (PARTITION BY d)"
K = ["d"]


def z_sql(x="x"):
    return f"({x} - AVG({x}) {PD})/NULLIF(stddev_samp({x}) {PD}, 0)"


def rk(x, desc=False, keys="d"):
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {keys} ORDER BY {x} {'DESC' if desc else 'ASC'} NULLS LAST) + (COUNT({x}) OVER (PARTITION BY {keys}, {x}) - 1)/2.0 END"


def r01(x, keys="d"):
    return f"({rk(x, True, keys)} - 1)/NULLIF(COUNT({x}) OVER (PARTITION BY {keys}) - 1, 0)"


@query("xs_z", sq({"z": z_sql(), "zf": f"COALESCE({z_sql()}, 0)"}, "xs_m"))
def _(t):
    return out(xs_m(t).withColumn("z", X.xs_z("x", K)).withColumn("zf", X.xs_z("x", K, fill=True)), "z", "zf")


@query("xs_z_pop", sq({"z": f"COALESCE((x - AVG(x) {PD})/(CASE WHEN stddev_pop(x) {PD} >= 1e-12 THEN stddev_pop(x) {PD} END), 0)"}, "xs_m"))
def _(t):
    return out(xs_m(t).withColumn("z", X.xs_z_pop("x", K)), "z")


@query("xs_rank01", sq({"r01": r01("xt")}, "xs_m"))
def _(t):
    return out(xs_m(t).withColumn("r01", X.xs_rank01("xt", K)), "r01")


@query("wide_rank", "SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS flag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1)/2.0 AS rank FROM lineitem")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"), "l_quantity")
    return X.with_wide_rank(rows, ["flag"], "l_quantity", buckets=16).drop("l_quantity")


@query("xs_long_short", f"""WITH k AS (SELECT asset, d, {rk('x', True)} AS r, COUNT(x) {PD} AS n FROM xs_m)
  SELECT asset, d, CASE WHEN n < 4 THEN 0 WHEN r > n - 2 THEN -0.25 WHEN r <= 2 THEN 0.25 ELSE 0 END::DOUBLE AS w FROM k""")
def _(t):
    return xs_m(t).select("asset", "d", X.xs_long_short("x", K).alias("w"))


@query("rank_weight", f"WITH k AS (SELECT asset, d, POW({r01('xt')} + 1e-6, 2.0) AS p FROM xs_m) SELECT asset, d, round(COALESCE(p/NULLIF(SUM(p) {PD}, 0), 0), 6)+0.0 AS w FROM k")
def _(t):
    return out(X.with_rank_weight(xs_m(t), "xt", K, power=2.0), "w")


@query("xs_tilt", f"""WITH a AS (SELECT asset, d, b, COALESCE({z_sql()}*0.15, 0) AS dev FROM xs_m), e AS (SELECT asset, d, greatest(dev - AVG(dev) {PD} + b, 0) AS w FROM a)
  SELECT asset, d, round(COALESCE(w/NULLIF(SUM(w) {PD}, 0), 0), 6)+0.0 AS w FROM e""")
def _(t):
    return out(X.with_tilt(xs_m(t), "x", "b", K), "w")


view("sig3", "SELECT asset, d, 'a' AS signal, x FROM xs_m UNION ALL SELECT asset, d, 'b', xt FROM xs_m UNION ALL SELECT asset, d, 'c', b FROM xs_m")


@query("xs_composite", f"""WITH k AS (SELECT asset, d, signal, {r01('x', 'd, signal')} AS r FROM sig3)
  SELECT asset, d, round(SUM(r*CASE signal WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.25 ELSE 0.25 END), 6)+0.0 AS score FROM k GROUP BY 1, 2""")
def _(t):
    long = xs_m(t).unpivot(["asset", "d"], ["x", "xt", "b"], "v", "x").withColumn("signal", F.when(F.col("v") == "x", "a").when(F.col("v") == "xt", "b").otherwise("c"))
    return out(X.composite(long.drop("v"), K, {"a": 2.0, "b": 1.0, "c": 1.0}), "score")


view("ic_m", f"""SELECT d, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS ic FROM (SELECT d, {rk('xt')} AS ra, {rk('f')} AS rb FROM (
  SELECT * FROM xs_m WHERE xt IS NOT NULL AND f IS NOT NULL)) GROUP BY d HAVING COUNT(*) >= 3""")


@query("information_coefficient", sq({"ic": "ic"}, "ic_m", "d"))
def _(t):
    return out(X.information_coefficient(xs_m(t), K, "xt", "f"), "ic", keys=("d",))


@query("ic_summary", """SELECT round(AVG(ic), 6)+0.0 AS ic_mean, round(stddev_samp(ic), 6)+0.0 AS ic_std, round(AVG(ic)/stddev_samp(ic)*sqrt(COUNT(ic)), 6)+0.0 AS ic_t_stat,
  round(AVG(ic)/stddev_samp(ic), 6)+0.0 AS ic_ir, round(AVG(CAST(round(ic, 9) > 0 AS DOUBLE)), 6)+0.0 AS hit_rate, COUNT(ic) AS n_periods, round(AVG(ic)*sqrt(12), 6)+0.0 AS implied_ir FROM ic_m""")
def _(t):
    s = X.ic_summary(X.information_coefficient(xs_m(t), K, "xt", "f"))
    return s.select("n_periods", *[r6(k).alias(k) for k in s.columns if k != "n_periods"])


view("z_m", f"SELECT asset, d, r, b, f, COALESCE({z_sql()}, 0) AS z FROM xs_m")


def z_m(t):
    return xs_m(t).withColumn("z", X.xs_z("x", K, fill=True))


@query("long_only_weights", sq({"w": f"COALESCE(greatest(z, 0)/NULLIF(SUM(greatest(z, 0)) {PD}, 0), 1.0/COUNT(*) {PD})"}, "z_m"))
def _(t):
    return out(z_m(t).withColumn("w", X.long_only_weights("z", K)), "w")


@query("dollar_neutral_weights", sq({"w": f"COALESCE(z/greatest(NULLIF(SUM(greatest(z, 0)) {PD}, 0), NULLIF(SUM(-least(z, 0)) {PD}, 0)), 0)"}, "z_m"))
def _(t):
    return out(z_m(t).withColumn("w", X.dollar_neutral_weights("z", K)), "w")


@query("rank_dev_weights", f"""WITH k AS (SELECT asset, d, {rk('xt')} AS r FROM xs_m), e AS (SELECT asset, d, r - AVG(r) {PD} AS dev FROM k)
  SELECT asset, d, round(COALESCE(dev/NULLIF(SUM(greatest(dev, 0)) FILTER (WHERE dev IS NOT NULL) {PD}, 0), 0), 6)+0.0 AS w FROM e""")
def _(t):
    return out(X.with_rank_dev_weights(xs_m(t), "xt", K), "w")


@query("overlay", f"""WITH a AS (SELECT asset, d, greatest(b + 0.5*z*b, 0) AS w1, least(greatest(b + 0.5*z*b, 0), b + 0.02) AS w2 FROM z_m)
  SELECT asset, d, round(w1/SUM(w1) {PD}, 6)+0.0 AS w, round(w2/SUM(w2) {PD}, 6)+0.0 AS wc FROM a""")
def _(t):
    z = z_m(t)
    return out(z.withColumn("w", X.overlay("b", "z", K, 0.5)).withColumn("wc", X.overlay("b", "z", K, 0.5, 0.02)), "w", "wc")


@query("bounded_tilt", f"""WITH a AS (SELECT asset, d, z, 1.0/COUNT(*) {PD} AS n1 FROM z_m), e AS (SELECT asset, d, least(greatest(n1 + 0.5*z*n1, greatest(n1 - 0.1, 0)), n1 + 0.1) AS w FROM a)
  SELECT asset, d, round(w/SUM(w) {PD}, 6)+0.0 AS w FROM e""")
def _(t):
    return out(X.with_bounded_tilt(z_m(t), "z", K), "w")


EDGE = f"""WITH a AS (SELECT asset, d, COUNT(x) {PD} AS k, 1.0/COUNT(*) {PD} AS n1, COALESCE(x, 0) AS e FROM xs_m),
  s AS (SELECT *, stddev_pop(e) {PD} AS sd, AVG(e) {PD} AS m FROM a),
  g AS (SELECT asset, d, CASE WHEN k > 0 AND sd >= 1e-12 THEN greatest(n1 + least(greatest((e - m)/sd*0.5*n1, -0.1), 0.1), 0) ELSE n1 END AS w FROM s)"""


@query("edge_tilt", EDGE + f" SELECT asset, d, round(w/SUM(w) {PD}, 6)+0.0 AS w FROM g")
def _(t):
    return out(X.with_edge_tilt(xs_m(t), "x", K), "w")


view("tilt_m", f"""WITH a AS (SELECT asset, d, b, COALESCE((x - AVG(x) {PD})/(CASE WHEN stddev_pop(x) {PD} >= 1e-12 THEN stddev_pop(x) {PD} END), 0) AS z FROM xs_m),
  w1 AS (SELECT *, greatest(b + least(greatest(0.5*z*0.15, -0.15), 0.15), 0) AS w FROM a),
  w2 AS (SELECT *, SUM(abs(w - b)) {PD} AS ex FROM w1), w3 AS (SELECT asset, d, b, CASE WHEN ex > 0.3 THEN greatest(b + (w - b)*(0.3/ex), 0) ELSE w END AS w FROM w2),
  w4 AS (SELECT asset, d, b, CASE WHEN SUM(w) {PD} > 1 THEN w/SUM(w) {PD} ELSE w END AS w FROM w3),
  w5 AS (SELECT asset, d, b, CASE WHEN asset = 'LARGE' THEN least(w, 0.17) ELSE w END AS w, CASE WHEN asset IN ('PROMO', 'SMALL') THEN 'g' END AS g FROM w4),
  w6 AS (SELECT *, SUM(w) OVER (PARTITION BY d, g) AS gs FROM w5)
  SELECT asset, d, b, CASE WHEN g = 'g' AND gs > 0.3 THEN w*0.3/gs ELSE w END AS w FROM w6""")


def tilt_m(t):
    caps = t.dim([("LARGE", 0.17)], "asset string, cap double")
    groups = t.dim([("g", "PROMO", 0.3), ("g", "SMALL", 0.3)], "grp string, asset string, grp_cap double")
    return X.apply_tilt(xs_m(t), "b", "x", K, max_total=0.3, caps=caps, group_caps=groups)


@query("apply_tilt", sq({"w": "w"}, "tilt_m"))
def _(t):
    return out(tilt_m(t), "w")


@query("forecast_lookup", """WITH e AS (SELECT DISTINCT d FROM px_d), f AS (SELECT d AS fd, asset, r FROM ret_m), fd AS (SELECT DISTINCT d AS fd FROM ret_m),
  n AS (SELECT e.d, MIN(fd.fd) AS next_d FROM e LEFT JOIN fd ON fd.fd > e.d GROUP BY 1)
  SELECT a.asset, n.d, n.next_d, round(f.r, 6)+0.0 AS r FROM n CROSS JOIN (SELECT DISTINCT asset FROM ret_m) a LEFT JOIN f ON f.fd = n.next_d AND f.asset = a.asset""")
def _(t):
    days = t.px_d.select("d").distinct()
    names = t.ret_m.agg(F.sort_array(F.collect_set("asset"))).scalar()
    keyed = days.select("d", F.explode(names).alias("asset"))
    n = A.asof_next(keyed, t.ret_m.select("asset", "d", "r"), ["asset"], ["r"])
    return n.select("asset", "d", "next_d", r6("r").alias("r"))


@query("realized_deviation", "SELECT d, round(SUM(abs(w - b)), 6)+0.0 AS deviation FROM tilt_m GROUP BY 1")
def _(t):
    w = tilt_m(t)
    dev = X.realized_deviation(w.select("d", "asset", F.col("w").alias("held")), xs_m(t).select("d", "asset", F.col("b").alias("base")), K)
    return out(dev, "deviation", keys=("d",))


@query("turnover", "WITH c AS (SELECT d, abs(b - LAG(b) OVER (PARTITION BY asset ORDER BY d)) AS c FROM xs_m) SELECT d, round(COALESCE(SUM(c), 0), 6)+0.0 AS turnover FROM c GROUP BY 1")
def _(t):
    w = xs_m(t).select(F.lit("all").alias("strategy"), "asset", "d", F.col("b").alias("w"))
    return out(X.turnover(w, ["strategy"]), "turnover", keys=("d",))


_ZP = f"COALESCE((x - AVG(x) {PD})/(CASE WHEN stddev_pop(x) {PD} >= 1e-12 THEN stddev_pop(x) {PD} END), 0)"
view("unc_m", f"""WITH a AS (SELECT asset, d, b, CASE WHEN COUNT(x) {PD} = COUNT(*) {PD} AND stddev_pop(x) {PD} >= 1e-12 THEN b + 0.5*{_ZP} END AS w FROM xs_m),
  g AS (SELECT *, SUM(abs(w)) {PD} AS gs FROM a) SELECT asset, d, CASE WHEN w IS NULL THEN b WHEN gs > 2 THEN w*2/gs ELSE w END AS w FROM g""")


@query("scale_to_gross", sq({"w": "w"}, "unc_m"))
def _(t):
    return out(X.unconstrained_tilt(xs_m(t), "x", "b", K, strength=0.5), "w")


@query("exposure_summary", """SELECT d, round(SUM(abs(w)), 6)+0.0 AS gross, round(SUM(w), 6)+0.0 AS net, round(SUM(-least(w, 0)), 6)+0.0 AS short,
  CAST(SUM(abs(w)) >= 2 - 1e-6 AS INT) AS at_limit, round(greatest(SUM(abs(w)) - 1, 0)*0.005/12, 6)+0.0 AS financing, round(SUM(-least(w, 0)*0.01)/12, 6)+0.0 AS short_cost FROM unc_m GROUP BY 1""")
def _(t):
    w = X.unconstrained_tilt(xs_m(t), "x", "b", K, strength=0.5).withColumn("rate", F.lit(0.01))
    s = X.exposure_summary(w, K, rate="rate")
    return s.select("d", "at_limit", *[r6(k).alias(k) for k in ("gross", "net", "short", "financing", "short_cost")])


@query("average_of_ranks", sq({"edge": f"({rk('xt')} + {rk('f')})/2"}, "xs_m"))
def _(t):
    return out(xs_m(t).withColumn("edge", X.average_of_ranks("xt", "f", K)), "edge")
