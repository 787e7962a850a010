"""Covariance, correlation and breadth from mergeable pair sums.

The base is one table of pair sums per (universe, time chunk, i, j). A chunk is the stretch of dates between
two rebalance bounds (or a year), and assets are cut into blocks of fixed width, so each task forms one
dense product of (dates in chunk) x (two blocks) and emits sums instead of one row per pair and date. Sums of
chunks add up, so expanding and rolling estimates at every rebalance are differences of running totals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.expr import safe_corr, win
from ..session import stored
from .blocks import Blocks

SUMS = ("n", "s10", "s01", "s20", "s02", "s11", "s30", "s03", "s21", "s12", "s22", "s31", "s13")
SECOND = SUMS[:6]  # what covariances and correlations need; shrinkage needs the rest
BLOCK = 256


def _sums(df: DataFrame) -> list[str]:
    return [k for k in SUMS if k in df.columns]


def _block_products(key_cols: list[str], names: tuple[str, ...]):
    """Pair sums of one (chunk, block pair): powers of the two dense blocks multiplied once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        lo, hi = first["_lo"], first["_hi"]
        dates, row = np.unique(pdf["_d"].to_numpy(), return_inverse=True)

        def dense(block):
            part = pdf["_blk"].to_numpy() == block
            names, col = np.unique(pdf["_asset"].to_numpy()[part].astype(str), return_inverse=True)
            x = np.zeros((len(dates), len(names)))
            m = np.zeros_like(x)
            x[row[part], col] = pdf["_x"].to_numpy()[part]
            m[row[part], col] = 1.0
            return names, x, m

        wt = np.zeros(len(dates))
        wt[row] = pdf["_wt"].to_numpy()
        na, xa, ma = dense(lo)
        nb, xb, mb = (na, xa, ma) if lo == hi else dense(hi)
        if not len(na) or not len(nb):
            return pd.DataFrame(columns=[*key_cols, "i", "j", *names])
        top = max(int(e) for k in names for e in k[1:])
        left = {k: (xa**k if k else ma) * wt[:, None] for k in range(top + 1)}
        right = {k: xb**k if k else mb for k in range(top + 1)}
        i, j = np.triu_indices(len(na)) if lo == hi else np.indices((len(na), len(nb))).reshape(2, -1)
        out = {k: first[k] for k in key_cols}
        frame = pd.DataFrame({"i": na[i], "j": nb[j]})
        for name in names:
            a, b = (0, 0) if name == "n" else (int(name[1]), int(name[2]))
            frame[name] = (left[a].T @ right[b])[i, j]
        for k, v in out.items():
            frame[k] = v
        return frame[frame["n"] > 0][[*key_cols, "i", "j", *names]]

    return run


def series_means(panel: DataFrame, by: list[str], asset: str = "asset", x: str = "x") -> DataFrame:
    """Overall mean of each series: the origin that pair sums are taken about."""
    return panel.filter(F.col(x).isNotNull()).groupBy(*by, asset).agg(F.avg(x).alias("_c"))


def pair_sums(panel: DataFrame, by: list[str], asset: str = "asset", d: str = "d", x: str = "x", chunk: Column | None = None,
              label: list[str] | None = None, weight: str | None = None, block: int = BLOCK, centre: bool = True, order: int = 4) -> DataFrame:
    """Sums of powers of (x_i, x_j) over the dates where both exist, i <= j, per chunk; up to the given order, 2 or 4.

    With `centre`, x is taken relative to the asset's overall mean, which leaves central moments unchanged and
    keeps the running totals well conditioned.
    """
    label = label or []
    keys = [*by, *label, "chunk"]
    known = panel.filter(F.col(x).isNotNull())
    means = series_means(panel, by, asset, x)
    blk = F.floor((F.row_number().over(win(by, asset)) - 1) / block).cast("int")
    names = means.withColumn("_blk", blk).withColumn("_nblk", F.max("_blk").over(Window.partitionBy(*by)) + 1)
    rows = known.withColumn("chunk", (chunk if chunk is not None else F.year(d)).cast("long")).join(names, [*by, asset])
    rows = rows.select(*keys, F.col(d).alias("_d"), F.col(asset).cast("string").alias("_asset"), (F.col(x) - F.col("_c") if centre else F.col(x)).cast("double").alias("_x"), "_blk",
                       (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_wt"),
                       F.explode(F.sequence(F.lit(0), F.col("_nblk") - 1)).alias("_o"))
    rows = rows.withColumn("_lo", F.least("_blk", "_o")).withColumn("_hi", F.greatest("_blk", "_o")).drop("_o")
    types = {f.name: f.dataType for f in rows.schema.fields}
    names_ = SECOND if order == 2 else SUMS
    schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [T.StructField(k, T.StringType()) for k in ("i", "j")]
                          + [T.StructField(k, T.DoubleType()) for k in names_])
    return rows.groupBy(*keys, "_lo", "_hi").applyInPandas(_block_products(keys, names_), schema)


def total(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.groupBy(*keys, "i", "j").agg(*[F.sum(k).alias(k) for k in _sums(sums)])


def cov_of(ddof: int = 1) -> Column:
    return (F.col("s11") - F.col("s10") * F.col("s01") / F.col("n")) / F.nullif(F.col("n") - ddof, F.lit(0.0))


def _var(a: str, b: str) -> Column:
    m = F.col(a) / F.col("n")
    return F.greatest(F.col(b) / F.col("n") - m * m, F.lit(0.0))


def corr_of() -> Column:
    return cov_of(0) / F.nullif(F.sqrt(_var("s10", "s20") * _var("s01", "s02")), F.lit(0.0))


def mirror(pairs: DataFrame, values: list[str], swaps: dict[str, str] | None = None) -> DataFrame:
    """Both orders of every pair from the upper triangle."""
    keep = [k for k in pairs.columns if k not in ("i", "j", *values)]
    low = pairs.filter("i <> j").select(*keep, F.col("j").alias("i"), F.col("i").alias("j"),
                                        *[F.col((swaps or {}).get(v, v)).alias(v) for v in values])
    return pairs.select(*keep, "i", "j", *values).unionByName(low)


def cov_sample(panel: DataFrame, by: list[str], ppy: int = 12, **kw) -> DataFrame:
    """Pairwise sample covariance, annualised; upper triangle (by, i, j, s)."""
    t = total(pair_sums(panel, by, order=2, **kw), by)
    return t.select(*by, "i", "j", (cov_of() * ppy).alias("s"), "n")


def corr_matrix(panel: DataFrame, by: list[str], **kw) -> DataFrame:
    return total(pair_sums(panel, by, order=2, **kw), by).select(*by, "i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(corr_of()).alias("rho"), "n")


def mean_pair_corr(corr: DataFrame, by: list[str]) -> DataFrame:
    return corr.filter("i <> j").groupBy(*by).agg(F.avg("rho").alias("mean_rho"))


def participation_ratio(corr: DataFrame, by: list[str]) -> DataFrame:
    """(sum of eigenvalues)^2 / sum of squared eigenvalues = n^2 / sum of squared correlations; no eigensolver."""
    sq = F.sum(F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0 * F.col("rho") * F.col("rho")))
    n = F.sum(F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return corr.groupBy(*by).agg(n.cast("long").alias("n_assets"), (n * n / sq).alias("participation_ratio"))


def corr_eigen(corr: DataFrame, by: list[str], dense: int = 2000, leading: int = 50) -> DataFrame:
    """(by, rank, eigenvalue, share, cumulative) of each universe's correlation matrix, largest first.

    Universes of up to `dense` assets go to a task each and give all eigenvalues. Larger ones stay in blocks and give
    the `leading` ones; shares are of the trace, which is the number of assets.
    """

    def eigen(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["i"]) | set(pdf["j"]))
        pos = {k: n for n, k in enumerate(names)}
        s = np.eye(len(names))
        a, b = pdf["i"].map(pos), pdf["j"].map(pos)
        s[a, b] = s[b, a] = pdf["rho"]
        vals = np.linalg.eigvalsh(s)[::-1]
        out = pd.DataFrame({"rank": range(1, len(vals) + 1), "eigenvalue": vals, "share": vals / vals.sum(), "cumulative": np.cumsum(vals) / vals.sum()})
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out[[*by, "rank", "eigenvalue", "share", "cumulative"]]

    size = corr.filter("i = j").groupBy(*by).agg(F.count("*").alias("_n"))
    sized = stored(corr.select(*by, "i", "j", "rho").join(size, by))
    schema = corr.select(*by).schema.add("rank", "integer").add("eigenvalue", "double").add("share", "double").add("cumulative", "double")
    small = sized.filter(F.col("_n") <= dense).drop("_n").groupBy(*by).applyInPandas(eigen, schema)
    large = sized.filter(F.col("_n") > dense).drop("_n")
    if large.isEmpty():
        return small
    m = Blocks(large, by, "rho")
    ids = m.place.select(*by, "_k").distinct()
    rows = [(k, r + 1, float(v), float(v) / len(m.diagonal[k]), float(c) / len(m.diagonal[k])) for k, vals in m.leading(leading).items() for r, (v, c) in enumerate(zip(vals, np.cumsum(vals)))]
    found = corr.sparkSession.createDataFrame(rows, "_k long, rank int, eigenvalue double, share double, cumulative double")
    return ids.join(found, "_k").drop("_k").unionByName(small)


def _central(pairs: DataFrame) -> DataFrame:
    """Population central moments s, vi, vj, m22, m31, m13 of each pair from its raw sums."""
    n, p, q = F.col("n"), F.col("s10") / F.col("n"), F.col("s01") / F.col("n")
    g = {k: F.col(k) / n for k in SUMS if k != "n"}
    s = g["s11"] - p * q
    vi, vj = g["s20"] - p * p, g["s02"] - q * q
    m22 = (g["s22"] - 2 * q * g["s21"] - 2 * p * g["s12"] + q * q * g["s20"] + p * p * g["s02"] + 4 * p * q * g["s11"] - 3 * p * p * q * q)
    m31 = (g["s31"] - q * g["s30"] - 3 * p * g["s21"] + 3 * p * q * g["s20"] + 3 * p * p * g["s11"] - 3 * p * p * p * q)
    m13 = (g["s13"] - p * g["s03"] - 3 * q * g["s12"] + 3 * p * q * g["s02"] + 3 * q * q * g["s11"] - 3 * q * q * q * p)
    keep = [k for k in pairs.columns if k not in SUMS]
    return pairs.select(*keep, "n", s.alias("s"), vi.alias("vi"), vj.alias("vj"), m22.alias("m22"), m31.alias("m31"), m13.alias("m13"))


def ledoit_wolf(pairs: DataFrame, keys: list[str], ppy: int = 12, ratio: str = "reference") -> DataFrame:
    """Constant-correlation shrinkage of each key's covariance; (keys, i, j, s, delta, n).

    One aggregation per key suffices: the target distance is a quadratic in the mean correlation. `ratio`
    chooses how the rho term scales E[x_i^3 x_j]: "reference" by sd_i / sd_j, "delta_method" by sd_j / sd_i.
    The input must come from complete dates.
    """
    c = _central(pairs)
    off = F.col("i") != F.col("j")
    vi, vj, s = F.col("vi"), F.col("vj"), F.col("s")
    root = F.sqrt(vi * vj)
    fwd, bwd = F.sqrt(vi / F.nullif(vj, F.lit(0.0))), F.sqrt(vj / F.nullif(vi, F.lit(0.0)))
    if ratio == "delta_method":
        fwd, bwd = bwd, fwd
    elif ratio != "reference":
        raise ValueError(f"unknown ratio: {ratio}")
    spread = F.col("m22") - s * s
    third = fwd * (F.col("m31") - vi * s) + bwd * (F.col("m13") - vj * s)
    two = lambda e: F.sum(F.when(off, 2.0 * e))
    a = c.groupBy(*keys).agg(
        F.max("n").alias("_t"), F.coalesce(F.avg(F.when(off, s / F.nullif(root, F.lit(0.0)))), F.lit(0.0)).alias("_r"),
        F.sum(F.when(off, 2.0 * spread).otherwise(spread)).alias("_pi"), F.sum(F.when(~off, spread)).alias("_pid"),
        F.coalesce(F.sum(F.when(off, third)), F.lit(0.0)).alias("_third"), two(vi * vj).alias("_vv"), two(root * s).alias("_rs"), two(s * s).alias("_ss"))
    r = F.col("_r")
    gamma = r * r * F.col("_vv") - 2 * r * F.col("_rs") + F.col("_ss")
    kappa = (F.col("_pi") - F.col("_pid") - r * F.col("_third")) / F.when(gamma > 0, gamma)
    delta = F.coalesce(F.least(F.greatest(kappa / F.col("_t"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    a = a.withColumn("_delta", F.when(gamma > 0, delta).otherwise(0.0)).select(*keys, "_r", "_delta")
    target = F.when(off, F.col("_r") * root).otherwise(s)
    return c.join(a, keys).select(*keys, "i", "j", ((F.col("_delta") * target + (1 - F.col("_delta")) * s) * ppy).alias("s"),
                                  F.col("_delta").alias("delta"), "n")


def shrinkage_intensity(pairs: DataFrame, keys: list[str], ratio: str = "reference") -> DataFrame:
    """Frobenius distance of the shrunk from the sample matrix, over the norm of the sample matrix."""
    lw = ledoit_wolf(pairs, keys, 1, ratio).select(*keys, "i", "j", F.col("s").alias("_lw"))
    both = pairs.select(*keys, "i", "j", cov_of().alias("_s")).join(lw, [*keys, "i", "j"])
    mult = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    dist = F.sum(mult * F.pow(F.col("_lw") - F.col("_s"), 2))
    norm = F.sum(mult * F.col("_s") * F.col("_s"))
    return both.groupBy(*keys).agg((F.sqrt(dist) / (F.sqrt(norm) + 1e-12)).alias("intensity"))


def cov_ewma(panel: DataFrame, by: list[str], lam: float = 0.97, ppy: int = 12, d: str = "d", **kw) -> DataFrame:
    """Exponentially weighted covariance; the newest date of a universe has age 0."""
    cal = panel.select(*by, d).distinct()
    age = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(d).desc())) - 1
    wts = cal.withColumn("_w", F.pow(F.lit(lam), age))
    t = total(pair_sums(panel.join(wts, [*by, d]), by, weight="_w", order=2, **kw), by)
    return t.select(*by, "i", "j", (cov_of(0) * ppy).alias("s"))


# ---- rebalance epochs ----


def calendar(panel: DataFrame, by: list[str], d: str = "d") -> DataFrame:
    """Distinct dates of each universe with their position from 0."""
    return panel.select(*by, d).distinct().withColumn("rn", F.row_number().over(win(by, d)) - 1)


def chunks(cal: DataFrame, by: list[str], due: Column, lookback: int | None = None, d: str = "d") -> DataFrame:
    """Calendar with a chunk number per date, and for due dates the chunk span [lo, hi) of their history."""
    w = win(by, d)
    c = cal.withColumn("due", F.coalesce(due, F.lit(False)))
    bound = F.col("due") if lookback is None else F.col("due") | F.coalesce(F.lead("due", lookback).over(w), F.lit(False))
    c = c.withColumn("chunk", F.sum(bound.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lo = F.lit(0).cast("long") if lookback is None else F.coalesce(F.lag("chunk", lookback).over(w), F.lit(0).cast("long"))
    return c.withColumn("lo", lo).withColumn("hi", F.col("chunk"))


def epoch_sums(sums: DataFrame, epochs: DataFrame, by: list[str], label: list[str] | None = None, rolling: bool = False, d: str = "d", extra: list[str] | None = None) -> DataFrame:
    """Pair sums of the history of every due date: running totals at its end, minus those at its start when rolling."""
    keys = [*by, *(label or [])]
    last = epochs.groupBy(*by).agg(F.max("hi").alias("_k"))
    wp = Window.partitionBy(*keys, "i", "j").orderBy("chunk")
    run = sums.select(*keys, "i", "j", "chunk", *[F.sum(k).over(wp.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k in _sums(sums)],
                      F.lead("chunk").over(wp).alias("_next"))
    # a pair without rows in a chunk keeps its total through it
    run = run.join(last, by).withColumn("_next", F.coalesce("_next", F.col("_k") + 1)).filter(F.col("_next") > F.col("chunk"))
    run = run.withColumn("chunk", F.explode(F.sequence("chunk", F.col("_next") - 1))).drop("_next", "_k")
    extra = extra or []
    due = epochs.filter("due").select(*keys, d, *extra, "lo", "hi")
    at_end = due.withColumn("chunk", F.col("hi") - 1).join(run, [*keys, "chunk"]).drop("chunk")
    if not rolling:
        return at_end.drop("lo", "hi")
    start = run.select(*keys, "i", "j", (F.col("chunk") + 1).alias("lo"), *[F.col(k).alias(f"_{k}") for k in _sums(sums)])
    j = at_end.join(start, [*keys, "lo", "i", "j"], "left")
    out = j.select(*keys, d, *extra, "i", "j", *[(F.col(k) - F.coalesce(f"_{k}", F.lit(0.0))).alias(k) for k in _sums(sums)])
    return out.filter("n > 0.5")


def cov_windowed(panel: DataFrame, by: list[str], due, kind: str = "ledoit_wolf", lookback: int | None = None, ppy: int = 12,
                 ratio: str = "reference", cal: DataFrame | None = None, asset: str = "asset", d: str = "d", x: str = "x", min_obs: int = 2) -> DataFrame:
    """Covariance at every due date from the rows before it; (by, d, i, j, s).

    `due` is a Column over (by, d, rn); `panel` should hold complete dates for Ledoit-Wolf. The calendar
    counts rows of `cal` when given, else of the panel.
    """
    ch = chunks(cal if cal is not None else calendar(panel, by, d), by, due, lookback, d)
    sums = pair_sums(panel.join(ch.select(*by, d, "chunk"), [*by, d]), by, asset, d, x, chunk=F.col("chunk"), order=2 if kind == "sample" else 4)
    e = epoch_sums(sums, ch, by, rolling=lookback is not None, d=d).filter(F.col("n") >= min_obs)
    if kind == "sample":
        return e.select(*by, d, "i", "j", (cov_of() * ppy).alias("s"), "n")
    if kind == "ledoit_wolf":
        return ledoit_wolf(e, [*by, d], ppy, ratio)
    raise ValueError(f"unknown estimator: {kind}")


def cov_regime(panel: DataFrame, labels: DataFrame, by: list[str], due, min_regime: int = 24, ppy: int = 12, kind: str = "ledoit_wolf",
               asset: str = "asset", d: str = "d", x: str = "x", observed: bool = False) -> DataFrame:
    """As `cov_windowed`, on rows whose label equals the due date's label once there are enough of them.

    With `observed` the state is the last label seen before the due date, else the due date's own label.
    """
    on = [*[k for k in by if k in labels.columns], d]
    ch = chunks(calendar(panel, by, d), by, due, None, d).join(labels.select(*on, "label"), on, "left")
    w = win(by, d)
    state = F.last("label", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if observed else F.col("label")
    ch = ch.withColumn("state", state)
    rows = panel.join(ch.select(*by, d, "chunk", "label"), [*by, d]).withColumn("label", F.coalesce("label", F.lit("")))
    sums = pair_sums(rows, by, asset, d, x, chunk=F.col("chunk"), label=["label"])
    every = epoch_sums(sums.groupBy(*by, "chunk", "i", "j").agg(*[F.sum(k).alias(k) for k in _sums(sums)]), ch, by, d=d)
    own = epoch_sums(sums, ch.drop("label").withColumnRenamed("state", "label").filter("label is not null"), by, ["label"], d=d).drop("label")
    own = own.filter(F.col("n") >= min_regime)
    chosen = own.withColumn("scope", F.lit("regime")).unionByName(
        every.join(own.select(*by, d).distinct(), [*by, d], "left_anti").withColumn("scope", F.lit("all")))
    if kind == "sample":
        return chosen.select(*by, d, "scope", "i", "j", (cov_of() * ppy).alias("s"), "n")
    return ledoit_wolf(chosen, [*by, d, "scope"], ppy)


def refit_epoch(rn: Column, first: int, every: int) -> Column:
    """Number of the estimate a row uses when it is renewed every `every` rows from row `first` on."""
    return F.when(rn >= first, F.floor((rn - first) / every))


# ---- autocorrelation ----


def autocorr(df: DataFrame, by: list[str], x: str = "x", k: int = 1, d: str = "d") -> DataFrame:
    return df.withColumn("_l", F.lag(x, k).over(win(by, d))).groupBy(*by).agg(safe_corr(x, "_l").alias("autocorr"))


def nw_variance_factor(df: DataFrame, by: list[str], x: str = "x", lags: int = 5, min_obs: int = 100, d: str = "d") -> DataFrame:
    """1 + 2 * sum of (1 - k / (lags + 1)) * autocorrelation, at least 0.25; 1 for short series."""
    w = win(by, d)
    known = df.filter(F.col(x).isNotNull())
    wide = known.select(*by, x, *[F.lag(x, k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    g = wide.groupBy(*by).agg(F.count(x).alias("_n"), *[safe_corr(x, f"_l{k}").alias(f"_r{k}") for k in range(1, lags + 1)])
    f = F.lit(1.0)
    for k in range(1, lags + 1):
        f = f + 2.0 * (1.0 - k / (lags + 1.0)) * F.coalesce(F.col(f"_r{k}"), F.lit(0.0))
    return g.select(*by, F.when(F.col("_n") < min_obs, 1.0).otherwise(F.greatest(f, F.lit(0.25))).alias("nw"))


def cov_stale_adjust(cov: DataFrame, nw: DataFrame, by: list[str]) -> DataFrame:
    """s_ij * sqrt(nw_i * nw_j); the factor table has one row per asset."""
    a = nw.select(*by, F.col("asset").alias("i"), F.col("nw").alias("_a"))
    b = nw.select(*by, F.col("asset").alias("j"), F.col("nw").alias("_b"))
    return cov.join(a, [*by, "i"]).join(b, [*by, "j"]).withColumn("s", F.col("s") * F.sqrt(F.col("_a") * F.col("_b"))).drop("_a", "_b")


def risk_share(df: DataFrame, by: list[str], x: str = "x", asset: str = "asset") -> DataFrame:
    v = df.groupBy(*by, asset).agg(F.var_samp(x).alias("v"))
    return v.select(*by, asset, (F.col("v") / F.sum("v").over(Window.partitionBy(*by))).alias("risk_share"))


def moments(returns: DataFrame, by: list[str], ppy: int = 12, asset: str = "asset", r: str = "r", rf: str = "rf") -> DataFrame:
    """Annualised mean excess and geometric return per asset; pass complete dates with the risk-free rate beside."""
    return returns.groupBy(*by, asset).agg((F.avg(F.col(r) - F.col(rf)) * ppy).alias("mu"),
                                           (F.pow(F.product(1.0 + F.col(r)), ppy / F.count(r)) - 1.0).alias("geometric"))


def portfolio_stats(weights: DataFrame, mu: DataFrame, cov: DataFrame, by: list[str], asset: str = "asset") -> DataFrame:
    """Expected excess return, volatility, Sharpe and cash of a weight vector."""
    w = weights.join(mu, [*by, asset]).groupBy(*by).agg(F.sum(F.col("w") * F.col("mu")).alias("exp_excess_return"), (1.0 - F.sum("w")).alias("cash_weight"))
    wi = weights.select(*by, F.col(asset).alias("i"), F.col("w").alias("_wi"))
    wj = weights.select(*by, F.col(asset).alias("j"), F.col("w").alias("_wj"))
    mult = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    v = cov.join(wi, [*by, "i"]).join(wj, [*by, "j"]).groupBy(*by).agg(F.sqrt(F.sum(mult * F.col("_wi") * F.col("_wj") * F.col("s"))).alias("vol"))
    j = w.join(v, by)
    return j.withColumn("sharpe", F.col("exp_excess_return") / F.nullif("vol", F.lit(0.0)))
