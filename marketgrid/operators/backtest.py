"""Rebalance schedules and the backtest.

Between trades held weights have a closed form: target times the asset's growth since the trade, over the
portfolio's growth. Date-driven schedules therefore need no sequential step: one running product per
(strategy, asset) and one sum per (strategy, date). Costs are settled on the much smaller epoch table.
Band schedules depend on their own path, but only since their last trade: each date's next trade is searched
without the past, and the chain from the first date is marked by pointer doubling.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import clip, div, ffill, win
from ..session import stored
from .dates import every_nth, period_bucket

KEYS = ["universe", "strategy"]

# fixed values: one-way cost in basis points per unit traded
DEFAULT_BPS = {"sp500": 2.0, "gold": 5.0, "ust3m": 0.5, "ust2y": 1.0, "ust5y": 1.5, "ust10y": 2.0, "ust30y": 3.0,
               "ig": 8.0, "hy": 25.0, "nikkei": 5.0, "ftse": 5.0, "wti": 8.0, "copper": 10.0}
FALLBACK_BPS = 10.0


# ---- schedules: flags over a calendar (keys, d, rn) ----


def every_n(rn: Column, n: int, first: int) -> Column:
    """Row index divisible by n, and the first live row."""
    return (rn >= first) & ((rn == first) | (rn % n == 0))


def calendar_months(months: int, first: int, by: list[str], rn: str = "rn", d: str = "d") -> Column:
    """First row of each month bucket; the first live row is its bucket's trade."""
    b = period_bucket(months, d)
    prev = F.lag(b).over(win(by, d))
    return (F.col(rn) >= first) & ((F.col(rn) == first) | (b != prev))


def schedule_catalog(cal: DataFrame, by: list[str], first: int, daily: bool = False) -> DataFrame:
    """Due flags of every named date-driven schedule, long in `schedule`; band schedules are listed with their band."""
    flags = {"monthly": calendar_months(1, first, by), "quarterly": calendar_months(3, first, by)}
    flags |= {"weekly": every_n(F.col("rn"), 5, first)} if daily else {"annual": calendar_months(12, first, by)}
    e = [F.struct(F.lit(k).alias("schedule"), v.alias("due")) for k, v in flags.items()]
    return cal.withColumn("_e", F.array(*e)).withColumn("_e", F.explode("_e")).select(*cal.columns, "_e.*")


BAND_SCHEDULES = {"band_5pct": 0.05, "band_10pct": 0.10, "band_20pct": 0.20}


def train_window(rn: Column, lag: int = 1, window: int | None = None) -> tuple[Column, Column]:
    """Rows [start, end) usable for a decision at row rn."""
    end = rn - lag + 1
    return (F.lit(0) if window is None else F.greatest(end - window, F.lit(0))), end


CHUNK = 256  # dates that a task of the band search holds of one strategy, twice


def _band_dates(returns: DataFrame, path: DataFrame, d: str) -> DataFrame:
    """A row for each strategy and date: position i, targets by asset, and each asset's growth before the date.

    Growth is the running product of the factors that aren't zero, and how many were, so that the growth between two
    dates is a quotient. Arrays are as long as the strategy has assets.
    """
    grid = path.select(*KEYS, d).distinct().join(path.select(*KEYS, "asset").distinct(), KEYS)
    cells = grid.join(path.select(*KEYS, "asset", d, "target"), [*KEYS, "asset", d], "left").join(returns.select("universe", "asset", d, "r"), ["universe", "asset", d], "left")
    factor = 1.0 + F.coalesce("r", F.lit(0.0)).cast("double")
    before = win([*KEYS, "asset"], d).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_f", factor).withColumn("grown", F.coalesce(F.product(F.when(F.col("_f") != 0, F.col("_f")).otherwise(1.0)).over(before), F.lit(1.0)))
    cells = cells.withColumn("zeros", F.coalesce(F.sum((F.col("_f") == 0).cast("int")).over(before), F.lit(0)).cast("int"))
    cell = F.struct("asset", F.coalesce("target", F.lit(0.0)).cast("double").alias("goal"), "grown", "zeros")
    dates = cells.groupBy(*KEYS, d).agg(F.sort_array(F.collect_list(cell)).alias("_c"))
    dates = dates.select(*KEYS, d, *(F.col(f"_c.{k}").alias(k) for k in ("goal", "grown", "zeros")))
    return dates.withColumn("i", F.row_number().over(win(KEYS, d)).cast("long") - 1).withColumn("c", F.floor(F.col("i") / CHUNK))


def _first_hits(band: float, kind: str, min_gap: int):
    """For the waiting dates of one chunk, the first date of another at which a portfolio traded then leaves the band."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["waits"]], pdf[~pdf["waits"]].sort_values("i")
        i, j = a["i"].to_numpy(), b["i"].to_numpy()
        if not len(i) or not len(j):
            return pd.DataFrame({"universe": [], "strategy": [], "i": [], "nx": []})
        goal, grown, zeros = (np.stack(a[k].to_numpy()) for k in ("goal", "grown", "zeros"))
        goal_b, grown_b, zeros_b = (np.stack(b[k].to_numpy()) for k in ("goal", "grown", "zeros"))
        hit = np.full(len(i), -1)
        for n in range(len(i)):
            value = goal[n] * np.where(zeros_b == zeros[n], grown_b / grown[n], 0.0)
            whole = value.sum(1) + 1.0 - goal[n].sum()
            alive = np.minimum.accumulate(whole > 0)
            held = np.where(alive[:, None], value / np.where(alive, whole, 1.0)[:, None], goal[n])
            off = np.abs(goal_b - held).sum(1) >= band if kind == "l1" else np.abs(held - goal[n]).max(1) > band
            at = np.flatnonzero(off & (j >= i[n] + max(min_gap, 1)))
            hit[n] = j[at[0]] if len(at) else -1
        return pd.DataFrame({"universe": key[0], "strategy": key[1], "i": i[hit >= 0], "nx": hit[hit >= 0]})

    return run


def next_trades(dates: DataFrame, band: float, kind: str, min_gap: int) -> DataFrame:
    """(universe, strategy, i, nx): where a portfolio traded at date i trades next; dates without a next trade are absent.

    A trade forgets the past, so all dates are searched side by side: first in their own and the next chunk, those
    still waiting in the two after it, then four, and so on. A task sees two chunks.
    """
    ends = dates.groupBy(*KEYS).agg(F.max("c").alias("_last"))
    most = ends.agg(F.max("_last")).first()[0]
    kinds = dates.select(*KEYS).schema
    schema = kinds.add("i", "long").add("nx", "long")
    waiting, found, lo, hi = dates.withColumn("c0", F.col("c")), None, 0, 1
    while most is not None:
        pairs = waiting.select(*KEYS, "c0").distinct().join(ends, KEYS).filter(F.col("c0") + lo <= F.col("_last"))
        pairs = pairs.select(*KEYS, "c0", F.explode(F.sequence(F.col("c0") + lo, F.least(F.col("c0") + hi, F.col("_last")))).alias("at"))
        fields = ["i", "goal", "grown", "zeros"]
        a = waiting.join(pairs, [*KEYS, "c0"]).select(*KEYS, "c0", "at", F.lit(True).alias("waits"), *fields)
        b = dates.join(pairs.withColumnRenamed("at", "c"), [*KEYS, "c"]).select(*KEYS, "c0", F.col("c").alias("at"), F.lit(False).alias("waits"), *fields)
        hits = a.unionByName(b).groupBy(*KEYS, "c0", "at").applyInPandas(_first_hits(band, kind, min_gap), schema)
        hits = stored(hits.groupBy(*KEYS, "i").agg(F.min("nx").alias("nx")))
        found = hits if found is None else found.unionByName(hits)
        if hi >= most:
            break
        waiting = stored(waiting.join(hits.select(*KEYS, "i"), [*KEYS, "i"], "left_anti"))
        if waiting.isEmpty():
            break
        lo, hi = hi + 1, 2 * hi + 1
    return found if found is not None else dates.select(*KEYS, "i", F.col("i").alias("nx")).limit(0)


def reached(start: DataFrame, nxt: DataFrame) -> DataFrame:
    """(universe, strategy, i): what the pointers lead to from the start, by pointer doubling.

    After k rounds the pointers jump 2^k trades and the first 2^k trades are marked, so rounds grow with the logarithm
    of the trades. A step back in time is impossible, so chains end.
    """
    seen, jump = stored(start.select(*KEYS, "i")), nxt
    while True:
        new = stored(seen.join(jump, [*KEYS, "i"]).select(*KEYS, F.col("nx").alias("i")))
        if new.isEmpty():
            return seen
        seen = stored(seen.unionByName(new).distinct())
        jump = stored(jump.join(jump.select(*KEYS, F.col("i").alias("nx"), F.col("nx").alias("_far")), [*KEYS, "nx"]).select(*KEYS, "i", F.col("_far").alias("nx")))


def band_trades(returns: DataFrame, path: DataFrame, band: float, kind: str = "l1", min_gap: int = 1, d: str = "d") -> DataFrame:
    """Trade dates of a no-trade band, (universe, strategy, d).

    "l1": total distance of the proposed target from the drifted weights reaches the band; "max": largest
    drift from the last traded target exceeds it. The first date always trades. `path` holds a target per
    (universe, strategy, asset, d); a missing one counts as zero, as does a missing return. A portfolio that has lost
    everything counts with its targets until it trades again. No row or task holds a strategy's whole path.
    """
    if kind not in ("l1", "max"):
        raise ValueError(f"unknown band: {kind}")
    dates = stored(_band_dates(returns, path, d))
    nxt = next_trades(dates, band, kind, min_gap)
    return reached(dates.filter("i = 0"), nxt).join(dates.select(*KEYS, "i", d), [*KEYS, "i"]).select(*KEYS, d)


# ---- cost ----


def cost_rates(assets: DataFrame, bps: DataFrame, fallback: float = FALLBACK_BPS, multiplier: float = 1.0) -> DataFrame:
    """Rate per unit traded for every asset; (asset, rate). `bps` is a lookup of fixed size."""
    return assets.select("asset").distinct().join(bps, "asset", "left").select(
        "asset", (F.coalesce("bps", F.lit(fallback)) * multiplier / 10_000.0).alias("rate"))


def average_rate(rates: DataFrame) -> DataFrame:
    return rates.agg(F.avg("rate").alias("rate"))


# ---- backtest ----


def _clean_targets(targets: DataFrame, renormalise: bool) -> DataFrame:
    if not renormalise:
        return targets
    w = Window.partitionBy(*KEYS, "d")
    t = targets.withColumn("_bad", F.max((F.col("target").isNull() | F.isnan("target")).cast("int")).over(w)).withColumn("_s", F.sum("target").over(w))
    ok = (F.col("_bad") == 0) & (F.col("_s") > 0)
    return t.withColumn("target", F.when(ok, F.col("target") / F.nullif("_s", F.lit(0.0))).otherwise(1.0 / F.count(F.lit(1)).over(w))).drop("_bad", "_s")


def holdings(returns: DataFrame, targets: DataFrame, drift: bool = True) -> DataFrame:
    """Per (strategy, asset, date): epoch, target in force, and growth since the trade up to and after the row."""
    strategies = targets.select(*KEYS).distinct()
    rows = returns.select("universe", "asset", "d", F.coalesce("r", F.lit(0.0)).alias("r")).join(strategies, "universe")
    j = rows.join(targets.select(*KEYS, "asset", "d", "target"), [*KEYS, "asset", "d"], "left")
    w = win([*KEYS, "asset"])
    j = j.withColumn("epoch", F.count("target").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("traded", F.col("target").isNotNull())
    j = j.withColumn("target", ffill("target", w)).filter("epoch > 0")
    we = win([*KEYS, "asset", "epoch"])
    prev = F.coalesce(F.product(1.0 + F.col("r")).over(we.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)) if drift else F.lit(1.0)
    return j.withColumn("g0", prev)


def backtest(returns: DataFrame, targets: DataFrame, rates: DataFrame, turnover: str = "two_way", renormalise: bool = False, drift: bool = True) -> DataFrame:
    """Gross, cost, net, turnover and cash per (universe, strategy, d).

    `returns` is (universe, asset, d, r); an asset without a row on a date counts as cash there and misses that date's
    trade. `targets` has one row per asset on every trade date of a strategy; `rates` is (asset, rate). "two_way"
    turnover counts all trades, "one_way" halves them and leaves out the first. Without drift the target is held
    constant (a spread book).
    """
    h = holdings(returns, _clean_targets(targets, renormalise), drift)
    worth = F.col("target") * F.col("g0")
    day = h.groupBy(*KEYS, "d").agg(F.sum(worth * F.col("r")).alias("_num"), F.sum(worth).alias("_den"), (1.0 - F.sum("target")).alias("_cash"),
                                    F.sum(worth * (1.0 + F.col("r"))).alias("_grown"), F.max("epoch").alias("_epoch"))
    whole, after = (F.col("_den") + F.col("_cash"), F.col("_grown") + F.col("_cash")) if drift else (F.lit(1.0), F.lit(1.0))
    day = day.select(*KEYS, "d", (F.col("_num") / whole).alias("gross"), (F.col("_cash") / whole).alias("cash"), after.alias("_after"), "_epoch")
    # trades live on the epoch table: an asset's end weight of one epoch meets its target of the next
    end = (F.product(1.0 + F.col("r")) if drift else F.lit(1.0))
    ep = h.groupBy(*KEYS, "asset", "epoch").agg(F.min("d").alias("d"), F.max("d").alias("_end"), F.first("target").alias("target"), end.alias("_g"))
    ended = ep.join(day.select(*KEYS, F.col("d").alias("_end"), "_after"), [*KEYS, "_end"]).select(
        *KEYS, "asset", (F.col("epoch") + 1).alias("epoch"), (F.col("target") * F.col("_g") / F.col("_after")).alias("_pre"))
    moved = F.abs(F.col("target") - F.coalesce("_pre", F.lit(0.0)))
    trades = ep.drop("_end").join(ended, [*KEYS, "asset", "epoch"], "left").join(rates, "asset").groupBy(*KEYS, "d").agg(
        F.sum(moved * F.col("rate")).alias("cost"), F.sum(moved).alias("turnover"))
    out = day.join(trades, [*KEYS, "d"], "left").na.fill(0.0, ["cost", "turnover"])
    if turnover == "one_way":
        out = out.withColumn("turnover", F.when(F.col("_epoch") == 1, 0.0).otherwise(F.col("turnover") / 2.0))
    return out.drop("_after", "_epoch").withColumn("net", F.col("gross") - F.col("cost"))


def held_weights(returns: DataFrame, targets: DataFrame, renormalise: bool = False) -> DataFrame:
    """Weights at the start of every date, after any trade; (universe, strategy, asset, d, held, target, epoch, traded, r)."""
    h = holdings(returns, _clean_targets(targets, renormalise))
    w = Window.partitionBy(*KEYS, "d")
    total = F.sum(F.col("target") * F.col("g0")).over(w) + 1.0 - F.sum("target").over(w)
    return h.withColumn("held", F.col("target") * F.col("g0") / total).drop("g0")


def one_way_turnover(bt: DataFrame, ppy: int = 252) -> DataFrame:
    """Annualised turnover of a backtest run with one-way turnover."""
    return bt.groupBy(*KEYS).agg((F.sum("turnover") / (F.count("*") / ppy)).alias("turnover_pa"))


def turnover_from_path(held: DataFrame, every: int, ppy: int = 12) -> DataFrame:
    """Mean absolute change of every n-th held row, annualised and halved; the first row counts as no change."""
    thin = every_nth(held, [*KEYS, "asset"], every)
    ch = thin.withColumn("_c", F.abs(F.col("held") - F.lag("held").over(win([*KEYS, "asset"]))))
    day = ch.groupBy(*KEYS, "d").agg(F.coalesce(F.sum("_c"), F.lit(0.0)).alias("_c"))
    return day.groupBy(*KEYS).agg((F.avg("_c") * (ppy / every) / 2.0).alias("turnover_pa"))


def break_even_cost(bt: DataFrame, benchmark: DataFrame, ppy: int = 12) -> DataFrame:
    """Annual gross edge per unit of annual turnover; infinite without turnover. `benchmark` is (d, b)."""
    j = bt.join(benchmark, "d", "left")
    edge, traded = F.avg(F.col("gross") - F.col("b")) * ppy, F.avg("turnover") * ppy
    return j.groupBy(*KEYS).agg(F.when(traded > 0, edge / F.nullif(traded, F.lit(0.0))).otherwise(F.lit(float("inf"))).alias("break_even"))


def portfolio_duration(held: DataFrame, durations: DataFrame) -> DataFrame:
    """Weighted duration per date; `durations` is (asset, dur)."""
    return held.join(durations, "asset").groupBy(*KEYS, "d").agg(F.sum(F.col("held") * F.col("dur")).alias("duration"))


def duration_matched_benchmark(bench: DataFrame, bench_dur: DataFrame, target_dur: DataFrame, by: list[str]) -> DataFrame:
    """Benchmark scaled to the strategy's duration, the rest in cash.

    `bench` is (d, b, rf); `bench_dur` is (d, duration); `target_dur` is (by, d, duration). The ratio is carried
    forward and clipped to [0, 5].
    """
    k = target_dur.join(bench_dur.withColumnRenamed("duration", "_b"), "d", "left").withColumn("_k", div("duration", "_b"))
    k = k.withColumn("_k", clip(ffill("_k", win(by)), 0.0, 5.0))
    return k.join(bench, "d").select(*by, "d", F.col("_k").alias("scale"), (F.col("_k") * F.col("b") + (1 - F.col("_k")) * F.col("rf")).alias("matched"))


def return_contribution(held: DataFrame) -> DataFrame:
    """Share of the summed return by asset."""
    g = held.groupBy(*KEYS, "asset").agg(F.sum(F.col("held") * F.col("r")).alias("_c"))
    return g.select(*KEYS, "asset", div("_c", F.sum("_c").over(Window.partitionBy(*KEYS))).alias("share"))


def weight_summary(held: DataFrame, w: str = "held") -> DataFrame:
    """Mean, minimum and maximum weight, ranked by mean within the strategy."""
    g = held.groupBy(*KEYS, "asset").agg(F.avg(w).alias("mean_w"), F.min(w).alias("min_w"), F.max(w).alias("max_w"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("mean_w").desc(), "asset")))


def hold_last_valid(targets: DataFrame) -> DataFrame:
    """Drop trade dates where any target is missing, so the previous one stays in force."""
    bad = targets.filter(F.col("target").isNull()).select(*KEYS, "d").distinct()
    return targets.join(bad, [*KEYS, "d"], "left_anti")
