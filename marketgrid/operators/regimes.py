"""Regime labels, episodes and regime-conditional portfolios. Frames are (by..., d, growth, inflation) or (by..., d, regime)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import c, clip, compound, div, safe_corr, win
from . import covariance as V
from . import weights as P
from .align import asof
from .crosssection import xs_z_pop
from .timeseries import REGIMES, trend_deviation, with_rank_pct


def quadrant(growth_up: Column, inflation_up: Column) -> Column:
    return (F.when(growth_up & ~inflation_up, REGIMES[0]).when(growth_up & inflation_up, REGIMES[1])
            .when(~growth_up & inflation_up, REGIMES[2]).when(~growth_up & ~inflation_up, REGIMES[3]))


def classify_relative(df: DataFrame, by: list[str], window: int = 36, min_periods: int | None = None, g: str = "growth", i: str = "inflation") -> DataFrame:
    """Each series against its own trailing mean; NULL while either mean is missing."""
    m = window // 2 if min_periods is None else min_periods
    w = win(by)
    d = df.withColumn("growth_dev", trend_deviation(g, w, window, m)).withColumn("inflation_dev", trend_deviation(i, w, window, m))
    d = d.withColumn("growth_up", F.coalesce(F.col("growth_dev") > 0, F.lit(False))).withColumn("inflation_up", F.coalesce(F.col("inflation_dev") > 0, F.lit(False)))
    known = F.col("growth_dev").isNotNull() & F.col("inflation_dev").isNotNull()
    return d.withColumn("regime", F.when(known, quadrant(F.col("growth_up"), F.col("inflation_up"))))


def classify_absolute(growth: Column, inflation: Column, growth_cut: float = 0.01, inflation_cut: float = 0.03) -> Column:
    return quadrant(growth > growth_cut, inflation > inflation_cut)


def classify_hybrid(df: DataFrame, by: list[str], window: int = 36, growth_floor: float = 0.005, inflation_floor: float = 0.025,
                    g: str = "growth", i: str = "inflation") -> DataFrame:
    """Direction or level for growth, direction and level for inflation."""
    w = win(by)
    gd, idv = trend_deviation(g, w, window, window // 3), trend_deviation(i, w, window, window // 3)
    d = df.withColumn("_g", gd).withColumn("_i", idv)
    lab = quadrant((F.col("_g") > 0) | (F.col(g) > growth_floor), (F.col("_i") > 0) & (F.col(i) > inflation_floor))
    return d.withColumn("regime", F.when(F.col("_g").isNotNull() & F.col("_i").isNotNull(), lab)).drop("_g", "_i")


def classify_percentile(df: DataFrame, by: list[str], window: int = 240, cutoff: float = 0.5, g: str = "growth", i: str = "inflation") -> DataFrame:
    d = with_rank_pct(with_rank_pct(df, by, g, "_g", window), by, i, "_i", window)
    return d.withColumn("regime", quadrant(F.col("_g") > cutoff, F.col("_i") > cutoff)).drop("_g", "_i")


def macro_signals(df: DataFrame, by: list[str], price: str, output: str, lag: int = 1, periods: int = 12) -> DataFrame:
    """Year-on-year inflation and growth, shifted by the publication lag; output levels are filled forward first."""
    w = win(by)
    d = df.withColumn("_o", F.last(output, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_i", div(price, F.lag(price, periods).over(w)) - 1.0).withColumn("_g", div("_o", F.lag("_o", periods).over(w)) - 1.0)
    return d.select(*by, "d", F.lag("_i", lag).over(w).alias("inflation"), F.lag("_g", lag).over(w).alias("growth"))


def with_episode(df: DataFrame, by: list[str], regime: str = "regime") -> DataFrame:
    """Labelled rows with their episode number and the run length so far."""
    w = win(by)
    k = df.filter(F.col(regime).isNotNull())
    new = (F.lag(regime).over(w).isNull() | (F.lag(regime).over(w) != F.col(regime))).cast("int")
    k = k.withColumn("_new", new).withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return k.withColumn("run_length", F.row_number().over(win([*by, "episode"]))).drop("_new")


def episodes(df: DataFrame, by: list[str], regime: str = "regime") -> DataFrame:
    return with_episode(df, by, regime).groupBy(*by, "episode", regime).agg(F.min("d").alias("start"), F.max("d").alias("end"), F.count("*").alias("months"))


def with_completed(df: DataFrame, by: list[str], regime: str = "regime") -> DataFrame:
    """Per row: finished earlier episodes of its own regime, and the months they held."""
    e = with_episode(df, by, regime)
    w = win([*by, regime])
    first = (F.col("run_length") == 1).cast("int")
    e = e.withColumn("n_completed", F.sum(first).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return e.withColumn("completed_months", F.row_number().over(w) - F.col("run_length"))


def learning_curve(df: DataFrame, by: list[str], regime: str = "regime") -> DataFrame:
    """Per regime: episodes, end of the first and second, median length."""
    e = episodes(df, by, regime).withColumn("_k", F.row_number().over(win([*by, regime], "end")))
    at = lambda n: F.max(F.when(F.col("_k") == n, F.col("end")))
    return e.groupBy(*by, regime).agg(F.count("*").alias("episodes_total"), at(1).alias("first_completed"), at(2).alias("second_completed"),
                                      F.percentile("months", F.lit(0.5)).alias("median_months"))


def transition_matrix(df: DataFrame, by: list[str], regime: str = "regime", labels=REGIMES) -> DataFrame:
    """Row-normalised transition shares on the fixed label grid; a row without departures is NULL."""
    k = df.filter(F.col(regime).isNotNull()).withColumn("_to", F.lead(regime).over(win(by))).filter("_to is not null")
    n = k.groupBy(*by, F.col(regime).alias("from_regime")).agg(*[F.count_if(F.col("_to") == s).alias(s) for s in labels], F.count("*").alias("_n"))
    grid = df.select(*by).distinct().withColumn("from_regime", F.explode(F.array(*[F.lit(s) for s in labels])))
    return grid.join(n, [*by, "from_regime"], "left").select(*by, "from_regime", *[(F.col(s) / F.col("_n")).alias(s) for s in labels])


def persistence(df: DataFrame, by: list[str], regime: str = "regime") -> DataFrame:
    return episodes(df, by, regime).groupBy(*by, regime).agg(F.avg("months").alias("mean_months"), F.count("*").alias("n_spells"), F.max("months").alias("longest"))


def regime_stats(returns: DataFrame, regimes: DataFrame, on: list[str] = ["d"], asset: str = "asset", ppy: int = 12, min_rows: int = 12) -> DataFrame:
    """Annualised return, volatility, Sharpe (on total sd) and hit rate per (regime, asset)."""
    j = returns.join(regimes.filter("regime is not null"), on).filter("r is not null")
    x, root = F.col("r"), F.sqrt(F.lit(float(ppy)))
    vol = F.stddev_samp(x) * root
    g = j.groupBy(*[k for k in on if k != "d"], "regime", asset).agg(
        F.count("*").alias("months"), (F.pow(compound(x) + 1.0, ppy / F.count(x)) - 1.0).alias("ann_return"), vol.alias("ann_vol"),
        (F.avg(x - F.col("rf")) * ppy / F.nullif(vol, F.lit(0.0))).alias("sharpe"), F.avg((x > 0).cast("double")).alias("hit_rate"))
    return g.filter(F.col("months") >= min_rows)


def enforce_persistence(df: DataFrame, by: list[str], min_rows: int = 3, regime: str = "regime", out: str = "steady") -> DataFrame:
    """Runs shorter than the minimum take the last accepted label; a NULL breaks a run and stays NULL."""
    w = win(by)
    same = F.coalesce(F.lag(regime).over(w) == F.col(regime), F.lit(False))
    d = df.withColumn("_run", F.sum((~same).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*by, "_run")))
    d = d.withColumn("_first", F.min(F.when(F.col(regime).isNotNull(), F.col("_run"))).over(Window.partitionBy(*by)))
    ok = F.col(regime).isNotNull() & ((F.col("_len") >= min_rows) | (F.col("_run") == F.col("_first")))
    last = F.last(F.when(ok, F.col(regime)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(out, F.when(F.col(regime).isNotNull(), last)).drop("_run", "_len", "_first")


def separation(excess: DataFrame, regimes: DataFrame, by: list[str], ppy: int = 12, min_rows: int = 12) -> DataFrame:
    """How differently assets behave across the states of a scheme; `excess` (by, asset, d, x) holds complete dates."""
    j = excess.join(regimes.select(*by, "d", "regime"), [*by, "d"], "left")
    g = j.filter("regime is not null").groupBy(*by, "asset", "regime").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).filter(F.col("n") >= min_rows)
    a = g.groupBy(*by, "asset").agg(F.count("*").alias("k"), F.sum("n").alias("n"), ((F.max("m") - F.min("m")) * ppy).alias("spread"), F.sum(F.col("n") * F.col("m")).alias("_s1"),
                                    F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_s2"), F.sum(F.col("n") * F.col("v")).alias("_w")).filter("k >= 2")
    ssb = F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("n")
    f = F.when((F.col("_w") > 0) & (F.col("n") > F.col("k")), ssb / (F.col("k") - 1) / (F.nullif("_w", F.lit(0.0)) / (F.col("n") - F.col("k"))))
    head = a.groupBy(*by).agg(F.avg("spread").alias("mean_spread"), F.avg(f).alias("mean_f_stat"))
    days = excess.select(*by, "d").distinct().join(regimes.select(*by, "d", "regime"), [*by, "d"], "left")
    w = win(by)
    same = F.coalesce(F.lag("regime").over(w) == F.col("regime"), F.lit(False))
    runs = days.withColumn("_run", F.sum((~same).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("regime is not null").groupBy(*by, "_run").agg(F.count("*").alias("l"))
    lens = runs.groupBy(*by).agg(F.percentile("l", F.lit(0.5)).alias("median_episode"), F.avg((F.col("l") <= 2).cast("double")).alias("pct_episodes_le2"))
    cnt = days.filter("regime is not null").groupBy(*by, "regime").agg(F.count("*").alias("c")).groupBy(*by).agg(
        F.sum("c").alias("n_labelled"), F.count_if(F.col("c") > 11).alias("n_states_used"), (F.min("c") / F.max("c")).alias("balance"))
    return head.join(cnt, by).join(lens, by)


def state_vs_label(df: DataFrame, by: list[str], p: str = "p", label: str = "label") -> DataFrame:
    k = df.filter(F.col(p).isNotNull() & F.col(label).isNotNull())
    return k.groupBy(*by).agg(F.avg(F.when(F.col(label) == 1, F.col(p))).alias("mean_inside"), F.avg(F.when(F.col(label) == 0, F.col(p))).alias("mean_outside"),
                              safe_corr(p, label).alias("correlation"), F.count_if(F.col(label) == 1).alias("months_inside"))


def regime_asof_daily(days: DataFrame, regimes: DataFrame, by: list[str], lag_days: int = 45) -> DataFrame:
    """Monthly labels on daily dates once they are published."""
    return asof(days, regimes.select(*by, F.date_add("d", lag_days).alias("d"), "regime"), by, "regime")


# ---- regime portfolios ----


def regime_weights(excess: DataFrame, labels: DataFrame, by: list[str], rule: str = "erc", min_months: int = 24) -> DataFrame:
    """One portfolio per regime with enough rows, else the one on all labelled rows, else 1/n; (by, regime, asset, w, n, own).

    `excess` holds complete dates, `labels` is (d, label) or (by, d, label).
    """
    on = [*[k for k in by if k in labels.columns], "d"]
    rows = excess.join(labels.filter("label is not null").select(*on, "label"), on)
    sums = V.pair_sums(rows, by, label=["label"])
    own = V.total(sums, [*by, "label"])
    every = V.total(sums, by).withColumn("label", F.lit("ALL")).select(own.columns)
    w = P.cov_rule(V.ledoit_wolf(own.unionByName(every).filter(F.col("n") >= min_months), [*by, "label"]), [*by, "label"], rule)
    counts = rows.select(*by, "d", "label").distinct().groupBy(*by, "label").agg(F.count("*").alias("n"))
    names = rows.select(*by, "asset").distinct().withColumn("_eq", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*by)))
    grid = names.withColumn("label", F.explode(F.array(*[F.lit(s) for s in REGIMES])))
    base = w.filter("label = 'ALL'").select(*by, "asset", F.col("w").alias("_all"))
    j = grid.join(w, [*by, "label", "asset"], "left").join(base, [*by, "asset"], "left").join(counts, [*by, "label"], "left")
    return j.select(*by, F.col("label").alias("regime"), "asset", F.coalesce("w", "_all", "_eq").alias("w"), F.coalesce("n", F.lit(0)).alias("n"), F.col("w").isNotNull().alias("own"))


def regime_weight_table(weights: DataFrame, by: list[str], assets: list[str]) -> DataFrame:
    """Own weights per regime, NULL where the regime was too rare, with its row count."""
    return weights.withColumn("w", F.when(F.col("own"), F.col("w"))).groupBy(*by, "regime", F.col("n").alias("n_months")).pivot("asset", assets).agg(F.first("w"))


def hard_switch(excess: DataFrame, labels: DataFrame, by: list[str], due, rule: str = "erc", min_months: int = 24) -> DataFrame:
    """At each due date, the portfolio of the last regime seen in the training window."""
    cov = V.cov_regime(excess, labels, by, due, min_months, observed=True)
    return P.cov_rule(cov, [*by, "d", "scope"], rule)


def transition_rows(labels: DataFrame, by: list[str], smoothing: float = 1.0) -> DataFrame:
    """For every date: the last earlier label and its smoothed transition probabilities from earlier pairs.

    Sixteen running counts in one pass; half a pseudo-count per cell. A history of a single label stays put.
    """
    k = labels.filter("label is not null")
    w = win(by)
    prev = F.lag("label").over(w)
    k = k.withColumn("_prev", prev)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    cells = {(a, b): F.count_if((F.col("_prev") == a) & (F.col("label") == b)).over(past) for a in REGIMES for b in REGIMES}
    state = F.lag("label").over(w)
    n_hist = F.count(F.lit(1)).over(past)
    rows = []
    for b in REGIMES:
        cnt = F.coalesce(*[F.when(state == a, cells[(a, b)]) for a in REGIMES]) + 0.5
        tot = sum((F.coalesce(*[F.when(state == a, cells[(a, s)]) for a in REGIMES]) + 0.5 for s in REGIMES), F.lit(0.0))
        hard = F.when(state == b, 1.0).otherwise(0.0)
        soft = smoothing * cnt / tot + (1 - smoothing) * hard if smoothing < 1.0 else cnt / tot
        rows.append(F.struct(F.lit(b).alias("regime"), F.when(n_hist < 2, hard).otherwise(soft).alias("p")))
    k = k.withColumn("state", state).withColumn("_e", F.array(*rows)).filter("state is not null")
    return k.select(*by, "d", "state", F.explode("_e").alias("_e")).select(*by, "d", "state", "_e.*")


def regime_blend(excess: DataFrame, labels: DataFrame, by: list[str], due, rule: str = "erc", min_months: int = 24, smoothing: float = 1.0) -> DataFrame:
    """Mixture of the regime portfolios by the transition row of the last seen regime; (by, d, asset, w)."""
    cal = V.calendar(excess, by)
    ch = V.chunks(cal, by, due)
    rows = excess.join(labels.select(*by, "d", "label"), [*by, "d"]).filter("label is not null").join(ch.select(*by, "d", "chunk"), [*by, "d"])
    sums = V.pair_sums(rows, by, chunk=F.col("chunk"), label=["label"])
    each = ch.withColumn("label", F.explode(F.array(*[F.lit(s) for s in REGIMES])))
    own = V.epoch_sums(sums, each, by, ["label"]).filter(F.col("n") >= min_months)
    every = V.epoch_sums(sums.groupBy(*by, "chunk", "i", "j").agg(*[F.sum(k).alias(k) for k in V.SUMS]), ch, by).filter(F.col("n") >= min_months).withColumn("label", F.lit("ALL"))
    keys = [*by, "d", "label"]
    w = P.cov_rule(V.ledoit_wolf(own.unionByName(every), keys), keys, rule)
    p = transition_rows(labels, by, smoothing).withColumnRenamed("regime", "label").join(ch.filter("due").select(*by, "d"), [*by, "d"])
    names = rows.select(*by, "asset").distinct().withColumn("_eq", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*by)))
    j = p.join(names, by).join(w, [*keys, "asset"], "left").join(w.filter("label = 'ALL'").select(*by, "d", "asset", F.col("w").alias("_all")), [*by, "d", "asset"], "left")
    j = j.withColumn("w", F.coalesce("w", "_all", "_eq"))
    return j.groupBy(*by, "d", "asset").agg((F.sum(F.col("p") * F.col("w")) / F.sum("p")).alias("w"))


def episodic_weights(excess: DataFrame, labels: DataFrame, bench: DataFrame, by: list[str], due, rule: str = "erc", min_episodes: int = 1,
                     min_months: int = 12, shade_rate: float = 0.5) -> DataFrame:
    """Benchmark until the current regime has finished often enough; then its learned portfolio, shaded in.

    Output (by, d, asset, w, action, state, alpha). The state of a due date is the last labelled row before it;
    learned rows are those of the state's earlier episodes, picked by episode number.
    """
    cal = V.calendar(excess, by).withColumn("due", F.coalesce(due, F.lit(False)))
    lab = with_completed(labels.withColumnRenamed("label", "regime"), by)
    info = cal.join(lab.select(*by, "d", F.struct("regime", "episode", "run_length", "n_completed", "completed_months").alias("_i")), [*by, "d"], "left")
    seen = F.last("_i", ignorenulls=True).over(win(by).rowsBetween(Window.unboundedPreceding, -1))
    e = info.withColumn("_s", seen).filter("due").select(*by, "d", "_s.*")
    learned = (F.col("n_completed") >= min_episodes) & (F.col("completed_months") >= min_months)
    action = F.when(F.col("regime").isNull() | (F.col("n_completed") < min_episodes), "benchmark").when(~learned, "benchmark_thin").otherwise("regime")
    alpha = F.when(learned, 1.0 - F.pow(F.lit(1.0 - shade_rate), F.col("run_length")) if shade_rate < 1.0 else F.lit(1.0)).otherwise(0.0)
    e = e.withColumn("action", action).withColumn("alpha", F.coalesce(alpha, F.lit(0.0)))
    rows = excess.join(lab.select(*by, "d", F.col("regime").alias("label"), "episode"), [*by, "d"])
    sums = V.pair_sums(rows, by, chunk=F.col("episode"), label=["label"])
    want = e.filter("action = 'regime'").select(*by, F.col("regime").alias("label"), "d", F.lit(0).cast("long").alias("lo"), F.col("episode").alias("hi"), F.lit(True).alias("due"))
    cov = V.ledoit_wolf(V.epoch_sums(sums, want, by, ["label"]), [*by, "d"])
    w = P.cov_rule(cov, [*by, "d"], rule).withColumnRenamed("w", "_w")
    j = e.join(bench.select(*by, "asset", F.col("w").alias("_b")), by).join(w, [*by, "d", "asset"], "left")
    mixed = F.when(F.col("action") == "regime", F.col("alpha") * F.col("_w") + (1.0 - F.col("alpha")) * F.col("_b")).otherwise(F.col("_b"))
    return j.select(*by, "d", "asset", mixed.alias("w"), "action", F.col("regime").alias("state"), "alpha")


def regime_mean_tilt(excess: DataFrame, labels: DataFrame, bench: DataFrame, by: list[str], k_shrink: float = 60.0, max_dev: float = 0.15,
                     max_total: float = 0.40, shade_rate: float = 0.5, min_episodes: int = 1, use_covariance: bool = False, ppy: int = 12) -> DataFrame:
    """Tilt away from a benchmark by shrunk regime means, as of every labelled date; (by, d, asset, w, alpha, n_obs).

    Unconditional means and the means of finished episodes are running sums: those of a regime so far, less
    the ones of the running episode.
    """
    lab = with_completed(labels.withColumnRenamed("label", "regime"), by)
    j = excess.join(lab.select(*by, "d", "regime", "episode", "run_length", "n_completed"), [*by, "d"], "left")
    a = [*by, "asset"]
    up_to = win(a).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_mu", F.avg("x").over(up_to) * ppy).withColumn("_sd", F.stddev_samp("x").over(up_to) * F.sqrt(F.lit(float(ppy)))).filter("regime is not null")
    reg, run = win([*a, "regime"]).rowsBetween(Window.unboundedPreceding, 0), win([*a, "episode"]).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("x").over(reg) - F.count("x").over(run)
    j = j.withColumn("n_obs", n).withColumn("_mr", (F.sum("x").over(reg) - F.sum("x").over(run)) / F.nullif(n, F.lit(0)) * ppy)
    wt = F.col("n_obs") / (F.col("n_obs") + k_shrink)
    edge = F.when(F.col("n_obs") < 6, 0.0).otherwise(wt * (F.col("_mr") - F.col("_mu")))
    if use_covariance:
        edge = edge / F.when(F.col("_sd") > 1e-9, F.col("_sd")).otherwise(1.0)
    key = [*by, "d"]
    over = Window.partitionBy(*key)
    j = j.withColumn("_e", edge).join(bench.select(*a, F.col("w").alias("_b")), a)
    j = j.withColumn("_flat", F.stddev_pop("_e").over(over) < 1e-12)
    alpha = 1.0 - F.pow(F.lit(1.0 - shade_rate), F.col("run_length")) if shade_rate < 1.0 else F.lit(1.0)
    j = j.withColumn("alpha", F.when(F.col("n_completed") < min_episodes, 0.0).otherwise(alpha))
    j = j.withColumn("_w", F.greatest(F.col("_b") + F.col("alpha") * clip(xs_z_pop("_e", key) * max_dev, -max_dev, max_dev), F.lit(0.0)))
    j = j.withColumn("_x", F.sum(F.abs(F.col("_w") - F.col("_b"))).over(over))
    j = j.withColumn("_w", F.when(F.col("_x") > max_total, F.greatest(F.col("_b") + (F.col("_w") - F.col("_b")) * (max_total / F.col("_x")), F.lit(0.0))).otherwise(F.col("_w")))
    j = j.withColumn("_t", F.sum("_w").over(over)).withColumn("_w", F.when(F.col("_t") > 1.0, F.col("_w") / F.col("_t")).otherwise(F.col("_w")))
    still = (F.col("n_completed") < min_episodes) | F.col("_flat")
    return j.select(*key, "asset", F.when(still, F.col("_b")).otherwise(F.col("_w")).alias("w"), "alpha", "n_obs")


def regime_edge_table(excess: DataFrame, labels: DataFrame, by: list[str], k: float = 60.0, ppy: int = 12, min_rows: int = 6) -> DataFrame:
    """Raw and shrunk annual mean per regime and asset, beside the unconditional mean."""
    mu = excess.groupBy(*by, "asset").agg((F.avg("x") * ppy).alias("unconditional"))
    g = excess.join(labels.filter("label is not null").select(*by, "d", "label"), [*by, "d"]).groupBy(*by, F.col("label").alias("regime"), "asset").agg(
        F.count("*").alias("n"), (F.avg("x") * ppy).alias("raw")).filter(F.col("n") >= min_rows)
    wt = F.col("n") / (F.col("n") + k)
    return g.join(mu, [*by, "asset"]).withColumn("shrunk", wt * F.col("raw") + (1.0 - wt) * F.col("unconditional"))
