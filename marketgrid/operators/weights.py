"""Weighting rules as grouped jobs over (universe, rebalance date, spec)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import solvers
from ..functions.expr import win
from ..session import stored
from . import blocks, hierarchy

DENSE = 2000  # assets of a matrix that one task may hold, 32 MB


def _matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Symmetric matrix from upper-triangle rows: one universe at one date, which a weighting rule needs whole."""
    names = sorted(set(pdf["i"]) | set(pdf["j"]))
    pos = {k: n for n, k in enumerate(names)}
    i, j = pdf["i"].map(pos).to_numpy(), pdf["j"].map(pos).to_numpy()
    s = np.zeros((len(names), len(names)))
    s[i, j] = s[j, i] = pdf["s"].to_numpy()
    return names, s


def _large(cov: DataFrame, keys: list[str], dense: int) -> tuple[DataFrame, DataFrame]:
    """(matrices that fit a task, larger ones) by their number of assets."""
    size = cov.filter("i = j").groupBy(*keys).agg(F.count("*").alias("_n"))
    split = stored(cov.select(*keys, "i", "j", "s").join(size, keys, "left"))
    few = F.coalesce("_n", F.lit(0)) <= dense
    return split.filter(few).drop("_n"), split.filter(~few).drop("_n")


def _by_blocks(cov: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """A registered rule on large matrices; no task holds one whole."""
    if rule == "hrp":
        return hierarchy.hrp(cov, keys).select(*keys, F.col("asset").cast("string").alias("asset"), "w")
    if rule == "inverse_vol":
        return inverse_vol(cov, keys)
    if rule == "equal":
        return equal_weight(cov.filter("i = j").select(*keys, F.col("i").alias("asset")), keys)
    m = blocks.Blocks(cov, keys)
    if rule == "erc":
        return m.table(m.erc())
    if rule == "min_variance":
        raw = m.solve({k: np.ones(len(d)) for k, d in m.diagonal.items()})
        return m.table({k: solvers.normalise(np.maximum(x / x.sum(), 0.0)) for k, x in raw.items()})
    if rule == "max_diversification":
        return m.table({k: solvers.normalise(np.maximum(x, 0.0)) for k, x in m.solve({k: np.sqrt(d) for k, d in m.diagonal.items()}).items()})
    raise ValueError(f"unknown rule: {rule}")


def cov_rule(cov: DataFrame, keys: list[str], rule: str | Callable[[np.ndarray], np.ndarray] = "erc", extra: DataFrame | None = None, dense: int = DENSE) -> DataFrame:
    """Apply ``rule(S) -> w`` to each key's matrix; (keys, asset, w). A rule is a registered name or a function.

    Matrices of up to `dense` assets go to a task each. Larger ones stay in blocks or in the pair table under a
    registered rule; a function needs its matrix whole.
    """
    fn = solvers.RULES[rule] if isinstance(rule, str) else rule
    schema = T.StructType([cov.schema[k] for k in keys] + [T.StructField("asset", T.StringType()), T.StructField("w", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s = _matrix(pdf)
        out = pd.DataFrame({"asset": names, "w": fn(s)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "asset", "w"]]

    if not isinstance(rule, str):
        return cov.select(*keys, "i", "j", "s").groupBy(*keys).applyInPandas(run, schema)
    small, large = _large(cov, keys, dense)
    whole = small.groupBy(*keys).applyInPandas(run, schema)
    return whole if large.isEmpty() else _by_blocks(large, keys, rule).unionByName(whole)


def cov_rules(cov: DataFrame, keys: list[str], rules: list[str], dense: int = DENSE) -> DataFrame:
    """Several registered rules on the same matrices in one pass; (keys, rule, asset, w). Large matrices as in `cov_rule`."""
    schema = T.StructType([cov.schema[k] for k in keys] + [T.StructField("rule", T.StringType()), T.StructField("asset", T.StringType()),
                                                          T.StructField("w", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s = _matrix(pdf)
        out = pd.concat([pd.DataFrame({"rule": r, "asset": names, "w": solvers.RULES[r](s)}) for r in rules])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "rule", "asset", "w"]]

    small, large = _large(cov, keys, dense)
    out = small.groupBy(*keys).applyInPandas(run, schema)
    if not large.isEmpty():
        for r in rules:
            out = out.unionByName(_by_blocks(large, keys, r).withColumn("rule", F.lit(r)))
    return out


def train_rule(history: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame, pd.Series], pd.Series], asset: str = "asset", d: str = "d",
               r: str = "r", rf: str = "rf", epoch: str = "epoch") -> DataFrame:
    """User rule ``fn(train, rf) -> weights`` on each key's training window (wide frame, dates by assets)."""
    schema = T.StructType([history.schema[k] for k in [*keys, epoch]] + [T.StructField("asset", T.StringType()), T.StructField("w", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        train = pdf.pivot(index=d, columns=asset, values=r).sort_index()
        w = fn(train, pdf.groupby(d)[rf].first().sort_index())
        out = pd.DataFrame({"asset": list(train.columns), "w": np.asarray(w, dtype=float)})
        for k in [*keys, epoch]:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, epoch, "asset", "w"]]

    return history.groupBy(*keys, epoch).applyInPandas(run, schema)


PARTS = 8  # groups that the choices of one universe are dealt to


def train_rule_windows(panel: DataFrame, epochs: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame, pd.Series], pd.Series], lookback: int | None = None,
                       parts: int = PARTS, asset: str = "asset", d: str = "d", r: str = "r", rf: str = "rf") -> DataFrame:
    """User rule on the window before each epoch, without a copy of the window for each; (keys, epoch, asset, w).

    `panel` is (keys, asset, d, r, rf), `epochs` (keys, epoch date). Epochs that follow each other share a group, which
    gets the rows from the first one's window to the last one: with a lookback that is each row about twice, as groups
    are as long as the lookback; without one, at most `parts` times. A task holds what its last window needs anyway.
    """
    cal = panel.select(*keys, d).distinct().withColumn("_n", F.row_number().over(win(keys, d)).cast("long") - 1)
    rows = panel.join(cal, [*keys, d])
    # an epoch's end: how many dates lie before it
    marks = cal.select(*keys, F.col(d).alias("_at"), F.lit(None).cast("date").alias("epoch")).unionByName(epochs.select(*keys, F.col("epoch").alias("_at"), "epoch"))
    before = Window.partitionBy(*keys).orderBy(F.col("_at"), F.col("epoch").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    ends = marks.withColumn("_end", F.count(F.when(F.col("epoch").isNull(), 1)).over(before)).filter("epoch is not null").select(*keys, "epoch", "_end")
    if lookback is None:
        dealt = ends.withColumn("_g", F.ntile(parts).over(Window.partitionBy(*keys).orderBy("epoch")).cast("long"))
    else:
        dealt = ends.withColumn("_g", F.floor(F.col("_end") / lookback))
    low = F.lit(0) if lookback is None else F.greatest(F.min("_end") - lookback, F.lit(0))
    groups = dealt.groupBy(*keys, "_g").agg(low.cast("long").alias("_lo"), F.max("_end").alias("_hi"), F.collect_list(F.struct("epoch", "_end")).alias("_e"))
    spans = groups.select(*keys, "_g", F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_n")) if lookback is not None else None
    if spans is None:
        mine = rows.join(groups.select(*keys, "_g", "_hi"), keys).filter(F.col("_n") < F.col("_hi")).drop("_hi")
    else:
        mine = rows.join(spans, [*keys, "_n"])
    wanted = stored(groups.select(*keys, "_g", F.explode("_e").alias("_e")).select(*keys, "_g", "_e.*"))
    schema = T.StructType([panel.schema[k] for k in keys] + [T.StructField("epoch", epochs.schema["epoch"].dataType), T.StructField("asset", T.StringType()), T.StructField("w", T.DoubleType())])

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts_ = []
        if len(left):
            whole = left.pivot(index="_n", columns=asset, values=r).sort_index()
            days = left.drop_duplicates("_n").set_index("_n")[d].reindex(whole.index)
            free = left.groupby("_n")[rf].first().reindex(whole.index)
            for epoch, end in zip(right["epoch"], right["_end"]):
                inside = (whole.index < end) & (whole.index >= (0 if lookback is None else end - lookback))
                if not inside.any():
                    continue
                train = whole[inside].set_axis(pd.Index(days[inside], name=d)).dropna(axis=1, how="all")
                w = fn(train, free[inside].set_axis(train.index))
                parts_.append(pd.DataFrame({"epoch": epoch, "asset": list(train.columns), "w": np.asarray(w, dtype=float)}))
        out = pd.concat(parts_) if parts_ else pd.DataFrame({"epoch": [], "asset": [], "w": []})
        for n, k in enumerate(keys):
            out[k] = key[n]
        return out[[*keys, "epoch", "asset", "w"]]

    return mine.groupBy(*keys, "_g").cogroup(wanted.groupBy(*keys, "_g")).applyInPandas(run, schema)


def mean_variance(cov: DataFrame, mu: DataFrame, keys: list[str], max_gross: float = 2.0, dense: int = DENSE) -> DataFrame:
    """Unbounded mean-variance weights scaled to the gross limit; `mu` is (keys, asset, mu). Large matrices stay in blocks."""
    small, large = _large(cov, keys, dense)
    joined = small.join(mu.select(*keys, F.col("asset").alias("i"), "mu"), [*keys, "i"])
    schema = T.StructType([cov.schema[k] for k in keys] + [T.StructField("asset", T.StringType()), T.StructField("w", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s = _matrix(pdf)
        m = pdf.drop_duplicates("i").set_index("i")["mu"].reindex(names).to_numpy()
        out = pd.DataFrame({"asset": names, "w": solvers.mean_variance_gross(s, m, max_gross)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "asset", "w"]]

    whole = joined.groupBy(*keys).applyInPandas(run, schema)
    if large.isEmpty():
        return whole
    m = blocks.Blocks(large, keys)
    mean = {k: np.zeros(len(d)) for k, d in m.diagonal.items()}
    for k, p, x in m.place.join(mu.select(*keys, "asset", "mu"), [*keys, "asset"]).select("_k", "_p", "mu").collect():  # a number an asset
        mean[k][p] = x
    raw = m.solve(mean)
    return m.table({k: x * min(max_gross / max(np.abs(x).sum(), solvers.FLOOR), 1.0) for k, x in raw.items()}).unionByName(whole)


def group_risk_budget(cov: DataFrame, groups: DataFrame, keys: list[str], budget: dict[str, float] | None = None) -> DataFrame:
    """Equal risk inside groups and between them: ERC per (key, group), then scaling by group volatility.

    `groups` is (asset, grp). Only within-group blocks of the matrix are used.
    """
    gi = groups.select(F.col("asset").alias("i"), F.col("grp"))
    gj = groups.select(F.col("asset").alias("j"), F.col("grp").alias("_gj"))
    inner = cov.select(*keys, "i", "j", "s").join(gi, "i").join(gj, "j").filter("grp = _gj").drop("_gj")
    gk = [*keys, "grp"]
    w = cov_rule(inner, gk, "erc")
    wi = w.select(*gk, F.col("asset").alias("i"), F.col("w").alias("_wi"))
    wj = w.select(*gk, F.col("asset").alias("j"), F.col("w").alias("_wj"))
    mult = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    vol = inner.join(wi, [*gk, "i"]).join(wj, [*gk, "j"]).groupBy(*gk).agg(F.sqrt(F.sum(mult * F.col("_wi") * F.col("_wj") * F.col("s"))).alias("_vol"))
    share = F.lit(1.0) if budget is None else F.coalesce(*[F.when(F.col("grp") == g, F.lit(b)) for g, b in budget.items()], F.lit(0.0))
    raw = w.join(vol, gk).withColumn("_w", F.col("w") * share / F.greatest("_vol", F.lit(solvers.FLOOR)))
    return raw.select(*keys, "asset", (F.col("_w") / F.sum("_w").over(Window.partitionBy(*keys))).alias("w"))


def equal_weight(cov_or_panel: DataFrame, keys: list[str], asset: str = "asset") -> DataFrame:
    return cov_or_panel.select(*keys, asset).distinct().withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def inverse_vol(cov: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse volatility needs the diagonal only, so it stays a window expression."""
    iv = cov.filter("i = j").withColumn("_iv", 1.0 / F.greatest(F.sqrt("s"), F.lit(solvers.FLOOR)))
    return iv.select(*keys, F.col("i").alias("asset"), (F.col("_iv") / F.sum("_iv").over(Window.partitionBy(*keys))).alias("w"))
