"""Cross-sectional operators: scores, ranks, weights and tilts within one date.

`keys` names the cross section, e.g. ``["d"]`` or ``["universe", "d"]``. Column expressions over the same
keys share one shuffle. A universe that owns a third of all rows is still split by date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import ColumnLike, c, clip, div, safe_corr, win


def over(keys: list[str]):
    return Window.partitionBy(*keys)


def xs_z(x: ColumnLike, keys: list[str], fill: bool = False) -> Column:
    """(x - mean) / sample sd of the date; NULL on a flat date, or 0 with `fill`."""
    w = over(keys)
    z = div(c(x) - F.avg(c(x)).over(w), F.stddev_samp(c(x)).over(w))
    return F.coalesce(z, F.lit(0.0)) if fill else z


def xs_z_pop(x: ColumnLike, keys: list[str]) -> Column:
    """Population-sd score; 0 for nulls and on empty or flat dates."""
    w = over(keys)
    sd = F.stddev_pop(c(x)).over(w)
    z = (c(x) - F.avg(c(x)).over(w)) / F.when(sd >= 1e-12, sd)
    return F.coalesce(z, F.lit(0.0))


def avg_rank(x: ColumnLike, keys: list[str], ascending: bool = True) -> Column:
    """Average rank of non-null values, 1 = smallest (largest when descending)."""
    x = c(x)
    order = x.asc_nulls_last() if ascending else x.desc_nulls_last()
    ties = F.count(x).over(Window.partitionBy(*keys, x))
    r = F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (ties - 1) / 2.0
    return F.when(x.isNotNull(), r)


def with_wide_rank(df: DataFrame, keys: list[str], x: str, out: str = "rank", buckets: int = 64) -> DataFrame:
    """Exact average ranks of groups too large for one task.

    Equal values are first folded into one counted row, so a value repeated in a third of all rows is one
    row. Approximate quantiles then cut each group into buckets; since the cut points only need to be
    ordered, any error in them shifts load, not results. Ranks are counted within buckets and offset by
    the sizes of the earlier ones, of which there are at most `buckets` + 1 per group.
    """
    known = df.filter(F.col(x).isNotNull())
    folded = known.groupBy(*keys, x).agg(F.count("*").alias("_c"))
    cuts = folded.groupBy(*keys).agg(F.percentile_approx(
        x, F.array(*[F.lit((i + 1) / (buckets + 1)) for i in range(buckets)]), 10000).alias("_cuts"))
    placed = folded.join(cuts, keys).withColumn("_b", F.size(F.filter("_cuts", lambda q: q < F.col(x)))).drop("_cuts")
    before = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s")).withColumn(
        "_off", F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inner = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = placed.withColumn("_in", inner).join(before, [*keys, "_b"]).select(
        *keys, x, (F.col("_off") + F.col("_in") + (F.col("_c") + 1) / 2.0).alias(out))
    return df.join(ranks, [*keys, x], "left")


def xs_rank01(x: ColumnLike, keys: list[str], ascending: bool = False) -> Column:
    """Average rank scaled to [0, 1]."""
    n = F.count(c(x)).over(over(keys))
    return (avg_rank(x, keys, ascending) - 1.0) / F.nullif(n - 1, F.lit(0))


def xs_long_short(x: ColumnLike, keys: list[str], n_long: int = 2, n_short: int = 2, gross: float = 1.0) -> Column:
    """Equal weight on the best and, negative, on the worst; 0 on thin dates. A name in both sets ends short."""
    r = avg_rank(x, keys, ascending=False)
    n = F.count(c(x)).over(over(keys))
    w = F.when(r > n - n_short, -gross / 2.0 / max(n_short, 1)).when(r <= n_long, gross / 2.0 / max(n_long, 1)).otherwise(0.0)
    return F.when(n < n_long + n_short, 0.0).otherwise(w)


def normalise(w: ColumnLike, keys: list[str]) -> Column:
    return div(w, F.sum(c(w)).over(over(keys)))


def with_rank_weight(df: DataFrame, x: str, keys: list[str], power: float = 1.0, out: str = "w") -> DataFrame:
    """Weight proportional to (rank01 + 1e-6)^power with the best name at rank01 = 0, as upstream defines it."""
    d = df.withColumn("_p", F.pow(xs_rank01(x, keys) + 1e-6, F.lit(power)))
    return d.withColumn(out, F.coalesce(normalise("_p", keys), F.lit(0.0))).drop("_p")


def with_tilt(df: DataFrame, x: str, base: str, keys: list[str], strength: float = 0.15, long_only: bool = True, out: str = "w") -> DataFrame:
    """Benchmark plus a zero-net overlay, floored and renormalised when long only."""
    w = over(keys)
    d = df.withColumn("_dev", F.coalesce(xs_z(x, keys) * strength, F.lit(0.0)))
    d = d.withColumn("_w", F.col("_dev") - F.avg("_dev").over(w) + F.col(base))
    if long_only:
        d = d.withColumn("_w", F.greatest("_w", F.lit(0.0)))
        d = d.withColumn("_w", normalise("_w", keys))
    return d.withColumn(out, F.coalesce("_w", F.lit(0.0))).drop("_dev", "_w")


def composite(df: DataFrame, keys: list[str], weights: dict[str, float] | None = None, x: str = "x", asset: str = "asset") -> DataFrame:
    """Weighted sum of rank01 over signals; `df` is long in `signal`."""
    total = sum(weights.values()) if weights else None
    wt = F.lit(1.0) if weights is None else F.coalesce(
        *[F.when(F.col("signal") == k, F.lit(v / total)) for k, v in weights.items()], F.lit(0.0))
    ranked = df.withColumn("_r", xs_rank01(x, [*keys, "signal"]))
    return ranked.groupBy(*keys, asset).agg(F.sum(F.col("_r") * wt).alias("score"))


def information_coefficient(df: DataFrame, keys: list[str], x: str = "x", f: str = "f", min_n: int = 3) -> DataFrame:
    """Per-date Spearman correlation of signal and forward return over the pairs where both exist."""
    both = df.filter(F.col(x).isNotNull() & F.col(f).isNotNull())
    ranked = both.withColumn("_a", avg_rank(x, keys)).withColumn("_b", avg_rank(f, keys))
    return ranked.groupBy(*keys).agg(safe_corr("_a", "_b").alias("ic"), F.count("*").alias("_n")).filter(F.col("_n") >= min_n).drop("_n")


def ic_summary(ic: DataFrame, by: list[str] | None = None, ppy: int = 12) -> DataFrame:
    m, s = F.avg("ic"), F.stddev_samp("ic")
    n = F.count("ic")
    return ic.groupBy(*(by or [])).agg(
        m.alias("ic_mean"), s.alias("ic_std"), (div(m, s) * F.sqrt(n)).alias("ic_t_stat"), div(m, s).alias("ic_ir"),
        F.avg((F.round("ic", 9) > 0).cast("double")).alias("hit_rate"), n.alias("n_periods"), (m * F.sqrt(F.lit(float(ppy)))).alias("implied_ir"))


def long_only_weights(z: ColumnLike, keys: list[str]) -> Column:
    """Positive part normalised; 1/n on a date without any."""
    n = F.count(F.lit(1)).over(over(keys))
    return F.coalesce(normalise(F.greatest(c(z), F.lit(0.0)), keys), 1.0 / n)


def dollar_neutral_weights(z: ColumnLike, keys: list[str]) -> Column:
    """Score over the larger of the two sides' sums."""
    w = over(keys)
    pos = F.nullif(F.sum(F.greatest(c(z), F.lit(0.0))).over(w), F.lit(0.0))
    neg = F.nullif(F.sum(-F.least(c(z), F.lit(0.0))).over(w), F.lit(0.0))
    return F.coalesce(c(z) / F.greatest(pos, neg), F.lit(0.0))


def with_rank_dev_weights(df: DataFrame, x: str, keys: list[str], out: str = "w") -> DataFrame:
    """Rank minus mean rank, scaled so that the positive side sums to one."""
    w = over(keys)
    d = df.withColumn("_r", avg_rank(x, keys))
    d = d.withColumn("_dev", F.col("_r") - F.avg("_r").over(w))
    pos = F.nullif(F.sum(F.greatest("_dev", F.lit(0.0))).over(w), F.lit(0.0))
    return d.withColumn(out, F.coalesce(F.col("_dev") / pos, F.lit(0.0))).drop("_r", "_dev")


def overlay(base: ColumnLike, z: ColumnLike, keys: list[str], lam: float, cap: float | None = None) -> Column:
    """base * (1 + lam * z), floored, optionally capped at base + cap, renormalised."""
    w = F.greatest(c(base) + lam * c(z) * c(base), F.lit(0.0))
    if cap is not None:
        w = F.least(w, c(base) + cap)
    return normalise(w, keys)


def with_bounded_tilt(df: DataFrame, z: str, keys: list[str], strength: float = 0.5, cap: float = 0.10, out: str = "w") -> DataFrame:
    """1/n * (1 + strength * z) within [max(1/n - cap, 0), 1/n + cap], renormalised."""
    b = 1.0 / F.count(F.lit(1)).over(over(keys))
    d = df.withColumn("_w", clip(b + strength * c(z) * b, F.greatest(b - cap, F.lit(0.0)), b + cap))
    return d.withColumn(out, normalise("_w", keys)).drop("_w")


def edge_tilt(edge: ColumnLike, keys: list[str], strength: float = 0.5, cap: float = 0.10) -> Column:
    """1/n plus a clipped population-sd score of the edge (nulls as 0); 1/n on empty or flat dates."""
    w = over(keys)
    n = F.count(F.lit(1)).over(w)
    e = F.coalesce(c(edge), F.lit(0.0))
    sd = F.stddev_pop(e).over(w)
    z = (e - F.avg(e).over(w)) / F.when(sd >= 1e-12, sd)
    raw = F.greatest(1.0 / n + clip(z * strength / n, -cap, cap), F.lit(0.0))
    live = (F.count(c(edge)).over(w) > 0) & (sd >= 1e-12)
    return F.when(live, raw).otherwise(1.0 / n)


def with_edge_tilt(df: DataFrame, edge: str, keys: list[str], strength: float = 0.5, cap: float = 0.10, out: str = "w") -> DataFrame:
    return df.withColumn("_w", edge_tilt(edge, keys, strength, cap)).withColumn(out, normalise("_w", keys)).drop("_w")


def apply_tilt(df: DataFrame, base: str, forecast: str, keys: list[str], strength: float = 0.5, max_dev: float = 0.15, max_total: float = 0.40,
               long_only: bool = True, allow_cash: bool = True, caps: DataFrame | None = None, group_caps: DataFrame | None = None,
               asset: str = "asset", out: str = "w") -> DataFrame:
    """Bounded tilt: clip, floor, total-deviation budget, no leverage, asset caps, grouped caps, in that order.

    `caps` is (asset, cap); `group_caps` is (grp, asset, grp_cap) with disjoint groups.
    """
    w = over(keys)
    floor = (lambda e: F.greatest(e, F.lit(0.0))) if long_only else (lambda e: e)
    d = df.withColumn("_w", floor(F.col(base) + clip(strength * xs_z_pop(forecast, keys) * max_dev, -max_dev, max_dev)))
    d = d.withColumn("_ex", F.sum(F.abs(F.col("_w") - F.col(base))).over(w))
    d = d.withColumn("_w", F.when(F.col("_ex") > max_total, floor(F.col(base) + (F.col("_w") - F.col(base)) * (max_total / F.col("_ex")))).otherwise(F.col("_w")))
    d = d.withColumn("_t", F.sum("_w").over(w))
    scale = (F.col("_t") > 1.0) if allow_cash else (F.col("_t") > 0.0)
    d = d.withColumn("_w", F.when(scale, F.col("_w") / F.col("_t")).otherwise(F.col("_w")))
    if caps is not None:
        d = d.join(caps, asset, "left").withColumn("_w", F.least("_w", F.coalesce("cap", F.col("_w")))).drop("cap")
    if group_caps is not None:
        d = d.join(group_caps, asset, "left").withColumn("_g", F.sum("_w").over(Window.partitionBy(*keys, "grp")))
        hit = F.col("grp").isNotNull() & (F.col("_g") > F.col("grp_cap")) & (F.col("_g") > 0)
        d = d.withColumn("_w", F.when(hit, F.col("_w") * F.col("grp_cap") / F.col("_g")).otherwise(F.col("_w"))).drop("grp", "grp_cap", "_g")
    return d.withColumn(out, F.col("_w")).drop("_w", "_ex", "_t")


def realized_deviation(held: DataFrame, base: DataFrame, keys: list[str], asset: str = "asset", h: str = "held", b: str = "base") -> DataFrame:
    return held.join(base, [*keys, asset]).groupBy(*keys).agg(F.sum(F.abs(F.col(h) - F.col(b))).alias("deviation"))


def turnover(df: DataFrame, by: list[str], w: str = "w", asset: str = "asset", d: str = "d") -> DataFrame:
    """Sum of absolute weight changes per date."""
    prev = F.lag(w).over(win([*by, asset], d))
    return df.withColumn("_c", F.abs(F.col(w) - prev)).groupBy(*by, d).agg(F.coalesce(F.sum("_c"), F.lit(0.0)).alias("turnover"))


MAX_GROSS = 2.0


def scale_to_gross(w: ColumnLike, keys: list[str], max_gross: float = MAX_GROSS) -> Column:
    g = F.sum(F.abs(c(w))).over(over(keys))
    return F.when(g > max_gross, c(w) * (max_gross / g)).otherwise(c(w))


def unconstrained_tilt(df: DataFrame, edge: str, base: str, keys: list[str], strength: float = 0.30, max_gross: float = MAX_GROSS, out: str = "w") -> DataFrame:
    """Benchmark plus strength * population score, scaled to the gross limit; the benchmark when any edge is missing or all are equal."""
    w = over(keys)
    live = (F.count(edge).over(w) == F.count(F.lit(1)).over(w)) & (F.stddev_pop(edge).over(w) >= 1e-12)
    d = df.withColumn("_w", F.when(live, F.col(base) + strength * xs_z_pop(edge, keys))).withColumn("_live", F.col("_w").isNotNull())
    return d.withColumn(out, F.when(F.col("_live"), scale_to_gross("_w", keys, max_gross)).otherwise(F.col(base))).drop("_w", "_live")


def exposure_summary(df: DataFrame, keys: list[str], w: str = "w", max_gross: float = MAX_GROSS, spread_bp: float = 50.0,
                     rate: str | None = None, ppy: int = 12) -> DataFrame:
    """Gross, net and short exposure, limit flag, financing of the borrowed part, fee on shorts."""
    gross = F.sum(F.abs(F.col(w)))
    fee = F.sum(-F.least(F.col(w), F.lit(0.0)) * (F.col(rate) if rate else F.lit(0.0))) / ppy
    return df.groupBy(*keys).agg(
        gross.alias("gross"), F.sum(w).alias("net"), F.sum(-F.least(F.col(w), F.lit(0.0))).alias("short"),
        (gross >= max_gross - 1e-6).cast("int").alias("at_limit"),
        (F.greatest(gross - 1.0, F.lit(0.0)) * (spread_bp / 1e4) / ppy).alias("financing"), fee.alias("short_cost"))


def average_of_ranks(a: ColumnLike, b: ColumnLike, keys: list[str]) -> Column:
    return (avg_rank(a, keys) + avg_rank(b, keys)) / 2.0
