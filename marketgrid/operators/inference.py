"""Inference: stationary bootstrap, Sharpe comparisons, reality check, deflated Sharpe, rank evidence.

Random numbers are hashes of (seed, resample, step), so draws do not depend on partitioning, and every
strategy of a comparison sees the same resamples. Sums over a resample are products of its counts of positions with the
paths, drawn once for a block of paths; blocks of resamples spread over tasks and nothing is joined or sorted per draw.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import c, div, safe_corr
from ..functions.normal import norm_cdf, norm_ppf, norm_sf, t_ppf, t_sf
from ..session import stored
from .crosssection import avg_rank, with_wide_rank

EULER = 0.5772156649015329
# fixed values: seed and resamples of the study
SEED = 20260830
REPS = 5000


def _hash_sql(seed: int, rep: str, t: str) -> str:
    return f"md5(concat_ws(':', '{seed}', cast({rep} as string), cast({t} as string)))"


def _draw_sql(h: str, n: str, t: str, mean_block: float) -> tuple[str, str]:
    """SQL of (a block starts at this step, its start position), both from the step's hash."""
    u, v = (f"(cast(conv(substr({h}, {k}, 13), 16, 10) as double) / 4503599627370496.0D)" for k in (1, 14))
    return f"({t} = 0 or {u} < {1.0 / max(mean_block, 1.0)!r}D)", f"cast(floor({v} * {n}) as int)"


def _spread(df: DataFrame, blocks: int, *keys: str) -> DataFrame:
    """Hash partitions in a fixed number: the rows are few and small, the work per row is not, so size-based coalescing must not merge them."""
    return df.repartition(max(blocks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def bootstrap_index(lengths: DataFrame, reps: int, mean_block: float = 12.0, seed: int = SEED, blocks: int = 64) -> DataFrame:
    """Resampled positions (by..., rep, t, idx) for each row of `lengths`, which holds the column n.

    Within a block the position advances by one and wraps, so idx = (start + t - t_start) mod n.
    """
    by = [k for k in lengths.columns if k != "n"]
    jump, start = _draw_sql("_h", "n", "t", mean_block)
    grid = _spread(lengths.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))), blocks, "rep")
    g = grid.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).withColumn("_h", F.expr(_hash_sql(seed, "rep", "t")))
    g = g.withColumn("_b", F.when(F.expr(jump), F.struct(F.expr(start).alias("s"), F.col("t").alias("t0"))))
    w = Window.partitionBy(*by, "rep").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("_b", F.last("_b", ignorenulls=True).over(w))
    return g.select(*by, "rep", "t", F.pmod(F.col("_b.s") + F.col("t") - F.col("_b.t0"), F.col("n").cast("int")).alias("idx"))


def resample_counts(n: int, reps: range, mean_block: float, seed: int) -> np.ndarray:
    """How often each of n positions occurs in each resample (resamples by positions), from the draws of `bootstrap_index`."""
    jump, start = np.empty((len(reps), n), bool), np.empty((len(reps), n))
    for row, rep in enumerate(reps):
        h = [hashlib.md5(f"{seed}:{rep}:{t}".encode()).hexdigest() for t in range(n)]
        jump[row] = [int(x[:13], 16) / 4503599627370496.0 < 1.0 / max(mean_block, 1.0) for x in h]
        start[row] = [int(x[13:26], 16) / 4503599627370496.0 for x in h]
    jump[:, 0] = True
    t = np.arange(n)
    last = np.maximum.accumulate(np.where(jump, t, 0), axis=1)
    place = (np.floor(np.take_along_axis(start, last, 1) * n).astype(np.int64) + t - last) % n
    return np.bincount((place + n * np.arange(len(reps))[:, None]).ravel(), minlength=n * len(reps)).reshape(len(reps), n).astype(float)


STRATEGIES = 256  # paths that one task multiplies with the same resamples


def _resampled_sums(paths: DataFrame, by: list[str], reps: int, mean_block: float, seed: int, blocks: int, with_b: bool) -> DataFrame:
    """Sums of each resample; `paths` has arrays S (and B) and the length n per key.

    Paths of one length see the same resamples, so these are drawn once for up to STRATEGIES paths, as counts of the
    positions, and multiplied with all of them; a row holds a block of paths, and blocks of resamples spread over tasks.
    """
    names = ["S", "B"] if with_b else ["S"]
    dealt = paths.withColumn("_p", F.floor((F.row_number().over(Window.partitionBy("n").orderBy(*by)) - 1) / STRATEGIES))
    panels = dealt.groupBy("n", "_p").agg(F.collect_list(F.struct(*by, *names)).alias("_k"))  # STRATEGIES paths at most
    spread = _spread(panels.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), blocks, "n", "_p", "_blk")
    per = -(-reps // blocks)
    sums = ["s", "ss", "b", "bb"] if with_b else ["s", "ss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                mine = range(batch.column("_blk")[row].as_py() * per, min((batch.column("_blk")[row].as_py() + 1) * per, reps))
                n, held = int(batch.column("n")[row].as_py()), batch.column("_k")[row].values
                if not len(mine):
                    continue
                counts = resample_counts(n, mine, mean_block, seed)
                out = []
                for c in names:
                    x = held.field(c).flatten().to_numpy(zero_copy_only=False).reshape(len(held), n)
                    out += [counts @ x.T, counts @ (x * x).T]  # resamples by paths
                of = pa.array(np.tile(np.arange(len(held)), len(mine)))
                cols = [held.field(k).take(of) for k in by] + [pa.array(np.repeat(np.array(mine, np.int32), len(held))), pa.array(np.full(len(of), float(n)))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(v.ravel()) for v in out)], [*by, "rep", "n", *sums])

    schema = paths.select(*by).schema.add("rep", "integer").add("n", "double")
    for k in sums:
        schema = schema.add(k, "double")
    return spread.mapInArrow(run, schema)


def _sharpe_from_sums(s: str, ss: str, n: str, ppy: int) -> Column:
    sd = F.sqrt(F.greatest((F.col(ss) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1), F.lit(0.0)))
    return F.when(sd > 1e-12, F.col(s) / F.col(n) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(float(ppy)))).otherwise(0.0)


def excess_pairs(df: DataFrame, s: str = "r", b: str = "b", rf: str | None = "rf") -> DataFrame:
    """Complete (strategy, benchmark) rows, net of the risk-free rate (missing counts as 0)."""
    base = F.coalesce(F.col(rf), F.lit(0.0)) if rf else F.lit(0.0)
    return df.filter(F.col(s).isNotNull() & F.col(b).isNotNull()).withColumn("xs", F.col(s) - base).withColumn("xb", F.col(b) - base)


def _arrays(df: DataFrame, by: list[str], cols: dict[str, str], d: str = "d") -> DataFrame:
    """One row per key with time-ordered arrays; one element per date."""
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(d, *[F.col(v).alias(k) for k, v in cols.items()]))).alias("_p"))
    return g.select(*by, F.size("_p").cast("double").alias("n"), *[F.col(f"_p.{k}").alias(k) for k in cols])


def sharpe_difference(df: DataFrame, by: list[str], reps: int = REPS, mean_block: float = 12.0, ppy: int = 12, seed: int = SEED, blocks: int = 64,
                      s: str = "r", b: str = "b", rf: str | None = "rf") -> DataFrame:
    """Bootstrap of the Sharpe gap to a benchmark: observed values, se, 95% interval, p-values.

    `p_one_sided` is the share of centred draws at or above the absolute gap, as published; `p_upper` uses the
    signed gap.
    """
    paths = _arrays(excess_pairs(df, s, b, rf), by, {"S": "xs", "B": "xb"})
    draws = _resampled_sums(paths, by, reps, mean_block, seed, blocks, True)
    # one short row per resample, read twice below: written once rather than folded twice
    draws = stored(draws.select(*by, "rep", (_sharpe_from_sums("s", "ss", "n", ppy) - _sharpe_from_sums("b", "bb", "n", ppy)).alias("draw")))
    base = excess_pairs(df, s, b, rf).groupBy(*by).agg(
        _sharpe("xs", ppy).alias("sharpe_strategy"), _sharpe("xb", ppy).alias("sharpe_benchmark"), F.count("*").alias("n_months"))
    base = base.withColumn("difference", F.col("sharpe_strategy") - F.col("sharpe_benchmark"))
    stats = draws.groupBy(*by).agg(F.avg("draw").alias("_m"), F.stddev_samp("draw").alias("se"), F.percentile("draw", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    info = base.join(stats, by)
    j = draws.join(info, by)
    at = lambda gap: F.avg(((F.col("draw") - F.col("_m")) >= gap).cast("double"))
    p = j.groupBy(*by).agg(at(F.abs(F.col("difference"))).alias("p_one_sided"), at(F.col("difference")).alias("p_upper"))
    return info.join(p, by).select(*by, "sharpe_strategy", "sharpe_benchmark", "difference", "se", F.col("_q")[0].alias("ci_lo"), F.col("_q")[1].alias("ci_hi"),
                                   "p_one_sided", "p_upper", "n_months")


def _sharpe(x: str, ppy: int) -> Column:
    sd = F.stddev_samp(x)
    return F.when(sd > 1e-12, F.avg(x) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(float(ppy)))).otherwise(0.0)


def reality_check(df: DataFrame, by: list[str], strategy: str = "strategy", x: str = "x", reps: int = REPS, mean_block: float = 12.0, seed: int = SEED,
                  blocks: int = 64, d: str = "d", min_rows: int = 24) -> DataFrame:
    """Reality check and superior predictive ability over a family, on complete dates; x is the gain over the benchmark."""
    n_s = df.groupBy(*by, strategy).agg(F.lit(1).alias("_o")).groupBy(*by).agg(F.count("*").alias("_w"))
    known = df.filter(F.col(x).isNotNull())
    full = known.groupBy(*by, d).agg(F.count("*").alias("_k")).join(n_s, by).filter("_k = _w").select(*by, d)
    k = known.join(full, [*by, d], "left_semi")
    keys = [*by, strategy]
    paths = _arrays(k, keys, {"S": x}, d).filter(F.col("n") >= min_rows)
    boot = stored(_resampled_sums(paths, keys, reps, mean_block, seed, blocks, False).select(*keys, "rep", "n", (F.col("s") / F.col("n")).alias("m")))
    om = boot.groupBy(*keys).agg(F.greatest(F.stddev_samp("m") * F.sqrt(F.max("n")), F.lit(1e-12)).alias("omega"))
    obs = k.groupBy(*keys).agg(F.avg(x).alias("dbar"), F.count("*").alias("_n")).join(om, keys)
    obs = obs.withColumn("t_obs", F.sqrt("_n") * F.col("dbar") / F.col("omega"))
    cut = -F.sqrt(2.0 * F.ln(F.greatest(F.ln(F.col("_n")), F.lit(1.0001))))
    obs = obs.withColumn("keep", F.col("t_obs") >= cut)
    top = obs.groupBy(*by).agg(F.count("*").alias("n_strategies"), F.max("_n").alias("n_months"), F.max_by(strategy, "t_obs").alias("best"), F.max("t_obs").alias("best_t"),
                               F.greatest(F.max("t_obs"), F.lit(0.0)).alias("spa_statistic"), F.count_if("keep").alias("n_in_null"))
    j = boot.join(obs.drop("_n"), keys)
    z = F.sqrt("n") * (F.col("m") - F.col("dbar")) / F.col("omega")
    h = F.sqrt("n") * (F.col("m") - F.when(F.col("keep"), F.col("dbar")).otherwise(0.0)) / F.col("omega")
    mx = j.groupBy(*by, "rep").agg(F.greatest(F.max(z), F.lit(0.0)).alias("_w"), F.greatest(F.max(h), F.lit(0.0)).alias("_h")).join(top.select(*by, "spa_statistic"), by)
    p = mx.groupBy(*by).agg(F.avg((F.col("_w") >= F.col("spa_statistic")).cast("double")).alias("p_reality_check"), F.avg((F.col("_h") >= F.col("spa_statistic")).cast("double")).alias("p_spa"))
    return top.join(p, by)


def jobson_korkie(df: DataFrame, by: list[str], a: str = "xs", b: str = "xb") -> DataFrame:
    """Memmel-corrected z for the difference of two Sharpe ratios; NULL when its variance is not positive."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), (F.avg(a) / F.stddev_samp(a)).alias("_a"), (F.avg(b) / F.stddev_samp(b)).alias("_b"), safe_corr(a, b).alias("_r"))
    sa, sb, r = F.col("_a"), F.col("_b"), F.col("_r")
    theta = (2.0 * (1.0 - r) + 0.5 * (sa * sa + sb * sb - 2.0 * sa * sb * r * r)) / F.col("n")
    return g.select(*by, "n", F.when(theta > 0, (sa - sb) / F.sqrt(F.when(theta > 0, theta))).alias("z"))


def with_normal_p(df: DataFrame, z: str = "z", out: str = "p") -> DataFrame:
    """One-sided p-value of |z|."""
    return df.withColumn(out, norm_sf(F.abs(F.col(z))))


def paired_t(df: DataFrame, by: list[str], ppy: int = 12) -> DataFrame:
    """t statistic of the mean excess difference; annualised mean and standard error."""
    g = df.groupBy(*by).agg(F.count("*").alias("n_obs"), F.avg(F.col("xs") - F.col("xb")).alias("_m"), F.stddev_samp(F.col("xs") - F.col("xb")).alias("_s"))
    g = g.filter("n_obs >= 3 and _s > 0").withColumn("_se", F.col("_s") / F.sqrt("n_obs"))
    return g.select(*by, (F.col("_m") * ppy).alias("mean_difference"), (F.col("_se") * ppy).alias("se"), (F.col("_m") / F.col("_se")).alias("t_stat"), "n_obs")


def with_t_interval(t: DataFrame) -> DataFrame:
    """Adds the one-sided p-value and the 95% interval."""
    df = (F.col("n_obs") - 1).cast("double")
    out = t.withColumn("p_one_sided", t_sf(F.col("t_stat"), df)).withColumn("_c", t_ppf(F.lit(0.975), df))
    return out.withColumn("ci_lo", F.col("mean_difference") - F.col("_c") * F.col("se")).withColumn("ci_hi", F.col("mean_difference") + F.col("_c") * F.col("se")).drop("_c")


def shape_moments(df: DataFrame, by: list[str], x: str = "r", min_rows: int = 24) -> DataFrame:
    """Per-period Sharpe, population skewness and plain (not excess) kurtosis."""
    g = df.filter(F.col(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), (F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0))).alias("sr"),
                                                         F.skewness(x).alias("skew"), (F.kurtosis(x) + 3.0).alias("kurtosis"))
    return g.filter(F.col("n") >= min_rows)


def deflated_sharpe(df: DataFrame, by: list[str], n_trials: int, variance_of_trials: float | None = None, ppy: int = 12, x: str = "r") -> DataFrame:
    """Probability that the Sharpe ratio is skill, given that it is the best of `n_trials`."""
    m = shape_moments(df, by, x)
    v = F.lit(variance_of_trials) if variance_of_trials is not None else 1.0 / F.col("n")
    q1, q2 = F.lit(1.0 - 1.0 / n_trials), F.lit(1.0 - 1.0 / (n_trials * 2.718281828459045))
    m = m.withColumn("_q1", norm_ppf(q1)).withColumn("_q2", norm_ppf(q2)).withColumn("_q95", norm_ppf(F.lit(0.95)))
    sr, g3, g4 = F.col("sr"), F.col("skew"), F.col("kurtosis")
    m = m.withColumn("_sr0", F.sqrt(v) * ((1.0 - EULER) * F.col("_q1") + EULER * F.col("_q2")))
    shape = 1.0 - g3 * sr + (g4 - 1.0) / 4.0 * sr * sr
    z = (sr - F.col("_sr0")) * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(shape, F.lit(1e-12)))
    root = F.sqrt(F.lit(float(ppy)))
    m = m.withColumn("_z", z).withColumn("deflated_sharpe_prob", norm_cdf(F.col("_z")))
    track = F.when(sr > F.col("_sr0"), 1.0 + shape * F.pow(F.col("_q95") / F.greatest(sr - F.col("_sr0"), F.lit(1e-6)), F.lit(2.0)))
    return m.select(*by, "n", (sr * root).alias("sharpe_annual"), (F.col("_sr0") * root).alias("expected_max_under_null"), "skew", "kurtosis",
                    F.lit(n_trials).alias("n_trials"), "deflated_sharpe_prob", track.alias("min_track_record_months"))


def rank_evidence(df: DataFrame, by: list[str], y: str, predictors: list[str], wide: bool = False) -> DataFrame:
    """Spearman, Pearson and least-squares evidence of y against each predictor, one row per predictor."""
    long = df.unpivot([*by, y], predictors, "predictor", "x").filter(F.col("x").isNotNull() & F.col(y).isNotNull())
    keys = [*by, "predictor"]
    if wide:
        r = with_wide_rank(with_wide_rank(long, keys, y, "_ry"), keys, "x", "_rx")
    else:
        r = long.withColumn("_ry", avg_rank(y, keys)).withColumn("_rx", avg_rank("x", keys))
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr("_ry", "_rx").alias("spearman"), safe_corr(y, "x").alias("pearson"),
                             (F.covar_pop(y, "x") / F.nullif(F.var_pop("x"), F.lit(0.0))).alias("slope"))
    r2 = F.col("pearson") * F.col("pearson")
    return g.withColumn("r2", r2).withColumn("t_slope", F.col("pearson") * F.sqrt(div(F.col("n") - 2.0, 1.0 - r2)))


def dense_ranks(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Integer ranks, 1 = largest (average ranks truncated)."""
    return df.select("*", *[F.floor(avg_rank(k, by, ascending=False)).cast("int").alias(f"rank_{k}") for k in cols])
