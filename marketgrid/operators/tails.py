"""Tail dependence of pairs, on the pair sums of the covariance module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normal import norm_ppf
from .covariance import corr_of, mirror, pair_sums, total
from .crosssection import avg_rank


def to_uniform(df: DataFrame, by: list[str], x: str = "x", asset: str = "asset", out: str = "u") -> DataFrame:
    """Average rank over (n + 1) within each asset's history."""
    keys = [*by, asset]
    return df.withColumn(out, avg_rank(x, keys) / (F.count(F.lit(1)).over(Window.partitionBy(*keys)) + 1.0))


def empirical_tail_dependence(u: DataFrame, by: list[str], q: float = 0.10, excess: bool = False) -> DataFrame:
    """P(both < q) / q per pair, 1 on the diagonal; with `excess`, minus q."""
    ind = u.withColumn("_i", (F.col("u") < q).cast("double"))
    t = total(pair_sums(ind, by, x="_i", centre=False, order=2), by)
    lam = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("s11") / F.col("n") / q)
    return mirror(t.select(*by, "i", "j", (lam - q if excess else lam).alias("lam")), ["lam"])


def _beyond(df: DataFrame, by: list[str], q: float, side: str, x: str) -> DataFrame:
    keys = [*by, "asset"]
    cut = df.groupBy(*keys).agg(F.percentile(x, F.lit(q if side == "lower" else 1.0 - q)).alias("_cut"))
    hit = F.col(x) < F.col("_cut") if side == "lower" else F.col(x) > F.col("_cut")
    return df.join(cut, keys).withColumn("_hit", hit).drop("_cut")


def exceedance_counts(df: DataFrame, by: list[str], q: float = 0.10, side: str = "lower", x: str = "x") -> DataFrame:
    """Dates on which both assets are beyond their own quantile; full square."""
    ind = _beyond(df, by, q, side, x).withColumn("_i", F.col("_hit").cast("double"))
    t = total(pair_sums(ind, by, x="_i", centre=False, order=2), by)
    return mirror(t.select(*by, "i", "j", F.round("s11").cast("long").alias("n")), ["n"])


def exceedance_correlation(df: DataFrame, by: list[str], q: float = 0.10, side: str = "lower", min_obs: int = 20, x: str = "x") -> DataFrame:
    """Correlation over the jointly extreme dates, NULL below `min_obs` of them; 1 on the diagonal."""
    hit = _beyond(df, by, q, side, x)
    pairs = total(pair_sums(hit.withColumn("_i", F.col("_hit").cast("double")), by, x="_i", centre=False, order=2), by).select(*by, "i", "j")
    # pairwise-complete moments of the extreme rows are exactly the joint ones
    ext = total(pair_sums(hit.filter("_hit"), by, x=x, order=2), by).filter(F.col("n") >= min_obs).select(*by, "i", "j", corr_of().alias("_r"))
    t = pairs.join(ext, [*by, "i", "j"], "left").withColumn("rho", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("_r"))).drop("_r")
    return mirror(t, ["rho"])


def normal_score_corr(u: DataFrame, by: list[str]) -> DataFrame:
    """Correlation of the normal scores of u."""
    z = u.withColumn("z", norm_ppf(F.col("u")))
    t = total(pair_sums(z, by, x="z", order=2), by)
    return t.select(*by, "i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(corr_of()).alias("rho"))
