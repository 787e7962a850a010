"""Queries: sources, alignment joins, calendar operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import ffill, r6, trailing, win
from ..operators import align as A
from ..operators import dates as D
from ..session import scratch_path, stored
from ..sources import files, holdout, specs
from ..sources.panels import month
from .registry import query, view

LAYERS = {"development": ("1995-02", "1998-12"), "holdout": ("1999-01", "2001-12")}
ASSETS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

view("spec_rows", """SELECT o_orderstatus AS phase, o_orderpriority AS family, CAST(YEAR(o_orderdate) AS VARCHAR) AS name,
  COUNT(*) AS n, ROUND(AVG(o_totalprice), 2) AS m FROM orders GROUP BY 1, 2, 3""")
view("spec_log", """SELECT *, substr(sha256('{"config": {"n": ' || n || ', "year": "' || name || '"}, "family": "' || family
  || '", "name": "' || name || '", "phase": "' || phase || '"}'), 1, 16) AS fingerprint FROM spec_rows""")


def spec_rows(t):
    g = t.orders.groupBy(F.col("o_orderstatus").alias("phase"), F.col("o_orderpriority").alias("family"),
                         F.year("o_orderdate").cast("string").alias("name")).agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("m"))
    return g.select("phase", "family", "name",
                    F.create_map(F.lit("year"), F.concat(F.lit('"'), "name", F.lit('"')),
                                 F.lit("n"), F.col("n").cast("string")).alias("config"),
                    F.create_map(F.lit("mean"), F.col("m")).alias("metrics"))


@query("read_panel", "SELECT o_orderkey AS id, 'o_totalprice' AS asset, o_totalprice AS x FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders")
def _(t):
    wide = t.orders.select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_custkey")
    return files.unpivot(wide, ["id"], "asset", "x")


@query("parse_year_month", "SELECT last_day(o_orderdate) AS d, COUNT(*) AS n, COUNT(o_totalprice) AS known, round(SUM(o_totalprice), 2)+0.0 AS total FROM orders GROUP BY 1")
def _(t):
    """Every order under a stamp of its month; October is written 1, as a file that drops trailing zeros has it.

    Each order also leaves a note line with a broken stamp, which the cleaner rejects. Orders without a price say n/a
    and count; those without a date have no stamp to parse and stay together under no month.
    """
    m = F.month("o_orderdate")
    stamp = F.concat(F.year("o_orderdate").cast("string"), F.lit("."), F.when(m == 10, "1").otherwise(F.lpad(m.cast("string"), 2, "0")))
    lines = F.explode(F.array(stamp, F.concat(stamp, F.lit("x")))).alias("stamp")
    raw = t.orders.select(lines, F.coalesce(F.col("o_totalprice").cast("string"), F.lit("n/a")).alias("p"))
    got = files.parse_year_month(raw, numeric=("p",)).select("d", "p")
    undated = t.orders.filter("o_orderdate is null").select(F.last_day("o_orderdate").alias("d"), F.col("o_totalprice").alias("p"))
    return got.unionByName(undated).groupBy("d").agg(F.count("*").alias("n"), F.count("p").alias("known"), r6(F.sum("p"), 2).alias("total"))


view("grid_h", """SELECT series, h FROM (SELECT DISTINCT series FROM events_h) s,
  (SELECT unnest(generate_series(MIN(h), MAX(h), INTERVAL 1 HOUR)) AS h FROM events_h) g""")


@query("step_series_load", """SELECT series, h, round(last_value(x IGNORE NULLS) OVER (PARTITION BY series ORDER BY h)/100, 6)+0.0 AS x
  FROM grid_h LEFT JOIN events_h USING (series, h)""")
def _(t):
    grid = A.spine(t.events_h, ["series"], "1 hour", "h")
    out = A.reindex(t.events_h, grid, ["series", "h"])
    return out.select("series", "h", r6(ffill("x", win(["series"], "h")) / 100).alias("x"))


@query("reindex", "SELECT series, h, round(x, 6)+0.0 AS x FROM grid_h LEFT JOIN events_h USING (series, h)")
def _(t):
    grid = A.spine(t.events_h, ["series"], "1 hour", "h")
    return A.reindex(t.events_h, grid, ["series", "h"]).select("series", "h", r6("x").alias("x"))


@query("ffill", "SELECT series, h, round(last_value(x IGNORE NULLS) OVER (PARTITION BY series ORDER BY h), 6)+0.0 AS x FROM grid_h LEFT JOIN events_h USING (series, h)")
def _(t):
    grid = A.spine(t.events_h, ["series"], "1 hour", "h")
    out = A.fill_forward(A.reindex(t.events_h, grid, ["series", "h"]), ["series"], "x", "h")
    return out.select("series", "h", r6("x").alias("x"))


@query("record_spec", """SELECT fingerprint, phase, family, name FROM spec_log s
  WHERE NOT EXISTS (SELECT 1 FROM spec_log o WHERE o.phase = 'F' AND o.fingerprint = s.fingerprint)""")
def _(t):
    rows = spec_rows(t)
    logged = rows.filter("phase = 'F'").withColumn("fingerprint", specs.fingerprint())
    return specs.new_specs(rows.unionByName(rows), logged).select("fingerprint", "phase", "family", "name")


@query("load_specs", """SELECT fingerprint, phase, family, name, 'cfg_year' AS key, '"' || name || '"' AS value FROM spec_log
  UNION ALL SELECT fingerprint, phase, family, name, 'cfg_n', CAST(n AS VARCHAR) FROM spec_log
  UNION ALL SELECT fingerprint, phase, family, name, 'mean', CAST(round(m, 2) AS VARCHAR) FROM spec_log""")
def _(t):
    rows = spec_rows(t).withColumn("fingerprint", specs.fingerprint())
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    broken = rows.select(F.concat(F.lit("{bad "), "name").alias("value"))
    out = specs.flatten(specs.parse_lines(lines.unionByName(broken)))
    num = F.col("value").try_cast("double")
    return out.withColumn("value", F.when(F.col("key") == "mean", F.regexp_replace(F.format_string("%.2f", num), r"0$", "")).otherwise(F.col("value")))


@query("spec_counts", "SELECT phase, COUNT(*) AS specs FROM spec_log GROUP BY 1")
def _(t):
    return specs.counts(spec_rows(t))


@query("spec_summary", "SELECT phase, COUNT(*) AS specs, COUNT(DISTINCT family) AS families FROM spec_log GROUP BY 1")
def _(t):
    return specs.summary(spec_rows(t))


@query("layer_slice", "SELECT asset, d, round(r, 6)+0.0 AS r FROM ret_m WHERE d BETWEEN DATE '1995-02-01' AND DATE '1998-12-31'")
def _(t):
    return holdout.layer_slice(t.ret_m, "development", LAYERS).select("asset", "d", r6("r").alias("r"))


@query("unseal_audit", "SELECT 'holdout' AS layer, 'final' AS reason, COUNT(*) AS \"rows\" FROM ret_m WHERE d BETWEEN DATE '1999-01-01' AND DATE '2001-12-31'")
def _(t):
    return holdout.audit_row(t.ret_m, "holdout", "final", LAYERS).drop("at")


@query("layer_summary", """SELECT 'development' AS layer, COUNT(*) FILTER (WHERE d BETWEEN DATE '1995-02-01' AND DATE '1998-12-31') AS "rows" FROM ret_m
  UNION ALL SELECT 'holdout', COUNT(*) FILTER (WHERE d BETWEEN DATE '1999-01-01' AND DATE '2001-12-31') FROM ret_m""")
def _(t):
    return holdout.layer_summary(t.ret_m, LAYERS)


@query("align_outer", "SELECT d, round(rf, 6)+0.0 AS rf, round(price, 2)+0.0 AS price, round(r, 6)+0.0 AS r FROM rf_m FULL JOIN macro_m USING (d) FULL JOIN bench_m USING (d)")
def _(t):
    out = A.align_outer([t.rf_m, t.macro_m.select("d", "price"), t.bench_m.select("d", "r")], ["d"])
    return out.select("d", r6("rf").alias("rf"), r6("price", 2).alias("price"), r6("r").alias("r"))


@query("align_inner", "SELECT d, round(rf, 6)+0.0 AS rf, round(price, 2)+0.0 AS price, round(r, 6)+0.0 AS r FROM rf_m JOIN macro_m USING (d) JOIN bench_m USING (d) WHERE r IS NOT NULL")
def _(t):
    out = A.align_inner([t.rf_m, t.macro_m.select("d", "price"), t.bench_m.select("d", "r")], ["d"])
    return out.select("d", r6("rf").alias("rf"), r6("price", 2).alias("price"), r6("r").alias("r"))


@query("asof_ffill", """SELECT p.d, round(m.price, 2)+0.0 AS price FROM (SELECT DISTINCT d FROM px_d) p
  ASOF LEFT JOIN macro_m m ON p.d >= m.d""")
def _(t):
    days = t.px_d.select("d").distinct().withColumn("series", F.lit("price"))
    out = A.asof(days, t.macro_m.withColumn("series", F.lit("price")), ["series"], "price")
    return out.select("d", r6("price", 2).alias("price"))


view("macro_long", "SELECT 'growth' AS series, d, growth AS x FROM macro_m UNION ALL SELECT 'price', d, price FROM macro_m UNION ALL SELECT 'n', d, CAST(n AS DOUBLE) FROM macro_m")


def macro_long(t):
    return t.macro_m.withColumn("n", F.col("n").cast("double")).unpivot(["d"], ["growth", "price", "n"], "series", "x")


@query("publication_asof", """WITH lagd AS (SELECT 'growth' AS series, 45 AS lag UNION ALL SELECT 'n', 5),
  rel AS (SELECT m.series, m.d + CAST(COALESCE(lag, 30) AS INTEGER) AS d, x FROM macro_long m LEFT JOIN lagd USING (series)),
  k AS (SELECT series, d FROM (SELECT DISTINCT series FROM macro_long), (SELECT DISTINCT d FROM px_d))
  SELECT k.series, k.d, round(x, 2)+0.0 AS x FROM k ASOF LEFT JOIN rel r ON k.series = r.series AND k.d >= r.d""")
def _(t):
    days = t.px_d.select("d").distinct().select("d", F.explode(F.array(*map(F.lit, ["growth", "price", "n"]))).alias("series"))
    lags = t.dim([("growth", 45), ("n", 5)], "series string, lag int")
    return A.publication_asof(days, macro_long(t), lags, ["series"], "x").select("series", "d", r6("x", 2).alias("x"))


@query("publication_shift", """SELECT series, d, round(CASE series WHEN 'growth' THEN LAG(x, 2) OVER w WHEN 'price' THEN LAG(x, 1) OVER w ELSE x END, 2)+0.0 AS x
  FROM macro_long WINDOW w AS (PARTITION BY series ORDER BY d)""")
def _(t):
    lags = t.dim([("growth", 2), ("price", 1)], "series string, lag int")
    return A.publication_shift(macro_long(t), lags, [1, 2], ["series"], "x").select("series", "d", r6("x", 2).alias("x"))


@query("common_start", """WITH s AS (SELECT series, CAST(h AS DATE) AS d, SUM(x) AS x FROM events_h WHERE NOT (series = 'view' AND h < TIMESTAMP '2024-01-05') GROUP BY 1, 2),
  b AS (SELECT MAX(f) AS st, COUNT(*) AS n FROM (SELECT series, MIN(d) AS f FROM s GROUP BY 1)),
  k AS (SELECT s.* FROM s, b WHERE d >= st)
  SELECT series, d, round(x, 6)+0.0 AS x FROM k WHERE d IN (SELECT d FROM k GROUP BY d HAVING COUNT(*) = (SELECT n FROM b))""")
def _(t):
    s = t.events_h.filter("not (series = 'view' and h < timestamp'2024-01-05')").groupBy(
        "series", F.col("h").cast("date").alias("d")).agg(F.sum("x").alias("x"))
    return A.common_start(s).select("series", "d", r6("x").alias("x"))


@query("index_intersection", "SELECT d FROM rf_m INTERSECT SELECT d FROM macro_m")
def _(t):
    return t.rf_m.select("d").intersect(t.macro_m.select("d"))


@query("anti_columns", "SELECT asset, d, round(px, 6)+0.0 AS px FROM px_m WHERE asset NOT IN ('PROMO', 'SMALL')")
def _(t):
    return t.px_m.filter(~F.col("asset").isin("PROMO", "SMALL")).select("asset", "d", r6("px").alias("px"))


@query("dedupe_columns", """SELECT 1 AS block, 'px_' || asset AS signal, d, round(px, 6)+0.0 AS x FROM px_m WHERE asset <> 'PROMO'
  UNION ALL SELECT 2, 'px_' || asset, d, round(vol, 6)+0.0 FROM px_m WHERE asset = 'PROMO'
  UNION ALL SELECT 2, 'vol_' || asset, d, round(vol, 6)+0.0 FROM px_m""")
def _(t):
    name = lambda p: F.concat(F.lit(p), "asset").alias("signal")
    a = t.px_m.filter("asset <> 'PROMO'").select(F.lit(1).alias("block"), name("px_"), "d", F.col("px").alias("x"))
    b = t.px_m.select(F.lit(2).alias("block"), name("px_"), "d", F.col("vol").alias("x"))
    v = t.px_m.select(F.lit(2).alias("block"), name("vol_"), "d", F.col("vol").alias("x"))
    return A.dedupe_signals(a.unionByName(b).unionByName(v)).select("block", "signal", "d", r6("x").alias("x"))


@query("stack_frames", "SELECT 'asset' AS kind, d, round(r, 6)+0.0 AS r FROM ret_m UNION ALL SELECT 'market', d, round(r, 6)+0.0 FROM bench_m")
def _(t):
    return A.stack({"asset": t.ret_m.select("d", r6("r").alias("r")), "market": t.bench_m.select("d", r6("r").alias("r"))}, "kind")


@query("spec_grid", """SELECT asset, lb, k, COUNT(*) AS n, round(AVG(r), 6)+0.0 AS mean_r FROM
  (SELECT asset, r, row_number() OVER (PARTITION BY asset ORDER BY d) AS rn FROM ret_m),
  (SELECT unnest([12, 24, 36]) AS lb), (SELECT unnest([1, 2, 3]) AS k) WHERE rn <= lb AND rn % k = 0 GROUP BY 1, 2, 3""")
def _(t):
    rows = t.ret_m.withColumn("rn", F.row_number().over(win(["asset"])))
    hit = A.with_spec_grid(rows, lb=[12, 24, 36], k=[1, 2, 3]).filter((F.col("rn") <= F.col("lb")) & (F.col("rn") % F.col("k") == 0))
    return hit.groupBy("asset", "lb", "k").agg(F.count("*").alias("n"), r6(F.avg("r")).alias("mean_r"))


@query("history_range_join", """WITH p AS (SELECT asset, d, r, row_number() OVER (PARTITION BY asset ORDER BY d) - 1 AS i FROM ret_m)
  SELECT e.asset, e.d, COUNT(h.r) AS n, round(AVG(h.r), 6)+0.0 AS mean_r FROM p e LEFT JOIN p h ON h.asset = e.asset AND h.i >= e.i - 24 AND h.i < e.i
  WHERE e.i % 12 = 0 GROUP BY 1, 2""")
def _(t):
    w = win(["asset"])
    past = trailing(w, 24, lag=1)
    rows = t.ret_m.select("asset", "d", F.row_number().over(w).alias("i"), F.count("r").over(past).alias("n"), r6(F.avg("r").over(past)).alias("mean_r"))
    return rows.filter("(i - 1) % 12 = 0").drop("i")


@query("family_outer_join", """SELECT family, d.n AS n_daily, m.n AS n_monthly FROM
  (SELECT o_orderpriority AS family, COUNT(*) AS n FROM orders WHERE o_orderpriority < '4' GROUP BY 1) d FULL JOIN
  (SELECT o_orderpriority AS family, COUNT(*) AS n FROM orders WHERE o_orderpriority > '2' AND o_orderstatus = 'F' GROUP BY 1) m USING (family)""")
def _(t):
    fam = F.col("o_orderpriority").alias("family")
    daily = t.orders.filter("o_orderpriority < '4'").groupBy(fam).agg(F.count("*").alias("n_daily"))
    monthly = t.orders.filter("o_orderpriority > '2' and o_orderstatus = 'F'").groupBy(fam).agg(F.count("*").alias("n_monthly"))
    return A.align_outer([daily, monthly], ["family"])


@query("pivot_table", "SELECT d, " + ", ".join(f"round(MAX(CASE WHEN asset = '{a}' THEN r END), 6)+0.0 AS \"{a}\"" for a in ASSETS) + " FROM ret_m GROUP BY 1")
def _(t):
    wide = A.pivot_wide(t.ret_m, ["d"], "asset", "r", ASSETS)
    return wide.select("d", *[r6(a).alias(a) for a in ASSETS])


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("crosstab", "SELECT o_orderstatus AS status, " + ", ".join(f"COUNT(*) FILTER (WHERE o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def _(t):
    return A.crosstab(t.orders.withColumnRenamed("o_orderstatus", "status"), "status", "o_orderpriority", list(PRIORITIES))


@query("resample_last", "SELECT asset, last_day(d) AS d, round(arg_max(px, d), 6)+0.0 AS px FROM px_d GROUP BY 1, 2")
def _(t):
    return D.resample_last(t.px_d.select("asset", "d", "px"), ["asset"], "px").select("asset", "d", r6("px").alias("px"))


@query("resample_sum", "SELECT asset, last_day(d) AS d, round(SUM(r)*12, 6)+0.0 AS r FROM ret_d GROUP BY 1, 2")
def _(t):
    return D.resample_sum(t.ret_d.select("asset", "d", "r"), ["asset"], "r", scale=12.0).select("asset", "d", r6("r").alias("r"))


@query("resample_compound", "SELECT asset, last_day(d) AS d, round(product(1+r)-1, 6)+0.0 AS r FROM ret_d GROUP BY 1, 2")
def _(t):
    return D.resample_compound(t.ret_d, ["asset"], "r").select("asset", "d", r6("r").alias("r"))


@query("resample_quarter_ffill", """WITH q AS (SELECT last_day(CAST(date_trunc('quarter', d) AS DATE) + INTERVAL 2 MONTH) AS q, arg_max(growth, d) AS x FROM macro_m GROUP BY 1),
  g AS (SELECT q, CASE WHEN x/LAG(x) OVER (ORDER BY q) - 1 < 0 THEN 1.0 ELSE 0.0 END AS neg FROM q)
  SELECT last_day(m.d) AS d, g.neg FROM macro_m m ASOF LEFT JOIN g ON last_day(m.d) >= g.q""")
def _(t):
    m = t.macro_m.withColumn("series", F.lit("growth"))
    return D.quarter_sign_to_months(m, ["series"], "growth").select("d", "neg")


@query("period_key", """SELECT asset, d, YEAR(d) AS y, CAST(floor((MONTH(d)-1)/3) AS BIGINT) AS b,
  row_number() OVER (PARTITION BY asset, YEAR(d), floor((MONTH(d)-1)/3) ORDER BY d) = 1 AS first_row FROM px_d""")
def _(t):
    return t.px_d.select("asset", "d", F.year("d").alias("y"), F.floor((F.month("d") - 1) / 3).alias("b"),
                         D.first_in_bucket(["asset"], 3).alias("first_row"))


@query("date_slice", "SELECT asset, d, round(r, 6)+0.0 AS r FROM ret_d WHERE d BETWEEN DATE '1996-02-01' AND DATE '1997-12-31'")
def _(t):
    return t.ret_d.filter(D.in_span("1996-02", "1997-12")).select("asset", "d", r6("r").alias("r"))


@query("day_gap", """SELECT asset, d, round(g, 6)+0.0 AS gap FROM (SELECT asset, d, (d - LAG(d) OVER (PARTITION BY asset ORDER BY d))/365.0 AS g FROM px_d)
  WHERE g > 0 AND g <= 0.003""")
def _(t):
    g = t.px_d.select("asset", "d", D.year_gap(["asset"]).alias("g")).filter("g > 0 and g <= 0.003")
    return g.select("asset", "d", r6("g").alias("gap"))


@query("every_nth", "SELECT asset, d FROM (SELECT asset, d, row_number() OVER (PARTITION BY asset ORDER BY d) AS rn FROM ret_m) WHERE (rn - 1) % 7 = 0")
def _(t):
    return D.every_nth(t.ret_m.select("asset", "d"), ["asset"], 7)


@query("coverage", """SELECT series, MIN(h) FILTER (WHERE x IS NOT NULL) AS first, MAX(h) FILTER (WHERE x IS NOT NULL) AS last, COUNT(x) AS n,
  round(COUNT(x)/COUNT(*), 6)+0.0 AS coverage FROM grid_h LEFT JOIN events_h USING (series, h) GROUP BY 1""")
def _(t):
    grid = A.reindex(t.events_h, A.spine(t.events_h, ["series"], "1 hour", "h"), ["series", "h"])
    return D.coverage(grid, ["series"], "x", "h").withColumn("coverage", r6("coverage"))


# ---- files ----


@query("write_panel", "SELECT asset, d, round(r, 6)+0.0 AS r, YEAR(d) AS y FROM ret_m")
def _(t):
    path = scratch_path(t.spark, "written")
    files.write_panel(t.ret_m.select("asset", "d", "r", F.year("d").alias("y")), path, ["y"])
    back = files.read_optional(t.spark, path, "asset string, d date, r double, y int")
    return back.select("asset", "d", r6("r").alias("r"), "y")


@query("read_optional", "SELECT asset, COUNT(*) AS n FROM ret_m GROUP BY 1")
def _(t):
    """A present table and a missing one read the same way; the missing one adds no rows."""
    path, schema = scratch_path(t.spark, "optional"), "asset string, d date, r double"
    files.write_panel(t.ret_m.select("asset", "d", "r"), path)
    parts = [files.read_optional(t.spark, p, schema) for p in (path, path + "-missing")]
    return parts[0].unionByName(parts[1]).groupBy("asset").agg(F.count("*").alias("n"))


_CSV = """SELECT {d} AS d, CAST(tenor AS DOUBLE) AS tenor, round(y, 6)+0.0 AS y FROM (SELECT d, CASE l WHEN 1 THEN 1 ELSE 5*(l - 1) END AS tenor, y FROM
  (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, l_linenumber AS l, ROUND(AVG(l_discount)*100, 4) AS y FROM lineitem GROUP BY 1, 2))"""


def curve_quotes(t):
    """Quotes in percent by month and line number, whichever numbers the table has; written once."""
    q = t.lineitem.groupBy(month("l_shipdate").alias("d"), F.col("l_linenumber").alias("l")).agg(F.round(F.avg("l_discount") * 100, 4).alias("y"))
    tenor = F.when(F.col("l") == 1, 1).otherwise(5 * (F.col("l") - 1))
    return stored(q.select("d", tenor.cast("int").alias("tenor"), "y", F.coalesce(F.col("d").isNotNull() & (tenor > 0), F.lit(False)).alias("filed")))


def curve_csv(t, quotes):
    """A curve file with a free-text preamble, written from the quotes that have a date and a line.

    Absent quotes say NA, and so does every month of the last column, a maturity beyond all quoted ones.
    """
    tenors = sorted({1} | {r.tenor for r in quotes.filter("filed").select("tenor").distinct().collect()})  # the header's columns
    q = quotes.filter("filed").groupBy("d").pivot("tenor", tenors).agg(F.first("y"))
    row = F.concat_ws(",", F.col("d").cast("string"), F.lit("NA"), *[F.when(F.col(f"`{n}`").isNull(), "NA").otherwise(F.format_string("%.4f", f"`{n}`")) for n in tenors], F.lit("NA")).alias("value")
    head = t.spark.range(1).select(F.explode(F.array(F.lit("Yield curve estimates, percent"), F.lit("Date,BETA0," + ", ".join(f"SVENY{n:02d}" for n in [*tenors, tenors[-1] + 1])))).alias("value"))
    path = scratch_path(t.spark, "curve")
    head.unionByName(q.select(row)).write.text(path)
    return files.read_preamble_csv(t.spark, path, files.preamble_header(t.spark, path))


@query("read_curve_csv", _CSV.format(d="d"))
def _(t):
    """Every yield that the file reads as, and NA where a quote has no yield: an NA cell without a quote is no row.

    Quotes without a date or line aren't in the file.
    """
    q = curve_quotes(t)
    quotes = q.withColumn("tenor", F.col("tenor").cast("double"))
    cells = files.curve_yields(curve_csv(t, q), "SVENY").join(quotes.filter("filed").select("d", "tenor", F.lit(True).alias("quoted")), ["d", "tenor"], "left")
    got = cells.filter(F.col("y").isNotNull() | F.col("quoted")).select("d", "tenor", "y")
    return got.unionByName(quotes.filter("not filed").select("d", "tenor", "y")).select("d", "tenor", r6("y").alias("y"))


@query("read_curve_params", "SELECT d, round(y, 6)+0.0 AS SVENY01, CAST(NULL AS DOUBLE) AS BETA0 FROM (" + _CSV.format(d="d") + ") WHERE tenor = 1")
def _(t):
    p = files.curve_params(curve_csv(t, curve_quotes(t)), ("BETA0", "SVENY01"))
    return p.select("d", r6("SVENY01").alias("SVENY01"), "BETA0")


@query("append_audit", """SELECT layer, reason, "rows" FROM (SELECT 'holdout' AS layer, 'first' AS reason, COUNT(*) AS "rows" FROM ret_m WHERE d BETWEEN DATE '1999-01-01' AND DATE '2001-12-31' UNION ALL
  SELECT 'development', 'second', COUNT(*) FROM ret_m WHERE d BETWEEN DATE '1995-02-01' AND DATE '1998-12-31')""")
def _(t):
    path = scratch_path(t.spark, "audit")
    holdout.unseal(t.ret_m, "holdout", "first", path, LAYERS)
    holdout.unseal(t.ret_m, "development", "second", path, LAYERS)
    return holdout.access_log(t.spark, path).select("layer", "reason", "rows")


@query("record_spec_log", "SELECT phase, COUNT(*) AS specs FROM spec_log GROUP BY 1")
def _(t):
    """Two appends of the same specs leave one line each."""
    path = scratch_path(t.spark, "specs")
    rows = spec_rows(t)
    for batch in (rows.filter("phase <> 'P'"), rows):
        specs.record(t.spark, batch, path)
    return specs.counts(specs.load(t.spark, path))


@query("window_udaf", "SELECT asset, d, round(CASE WHEN COUNT(r) OVER w >= 6 THEN mad(r) OVER w END, 6)+0.0 AS m FROM ret_m WINDOW w AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
def _(t):
    """A user aggregate over a row frame, for what no built-in covers: here the median distance from the median."""

    @F.pandas_udf(T.DoubleType())
    def distance(v: pd.Series) -> float:
        v = v.dropna()
        return float((v - v.median()).abs().median()) if len(v) else float("nan")

    f = trailing(win(["asset"]), 6)
    return t.ret_m.select("asset", "d", r6(F.when(F.count("r").over(f) >= 6, distance("r").over(f))).alias("m"))
