"""Alignment: spines, as-of joins, publication lags, common samples, reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import div, ffill, win


def spine(df: DataFrame, by: list[str], step: str, d: str = "d", common: bool = True) -> DataFrame:
    """Dense (entity x date) grid on a regular step, e.g. ``"1 month"`` or ``"1 hour"``.

    Each entity row carries its own date range and is expanded in place, so no cross join is planned.
    With ``common`` every entity spans the range of the whole panel; the range is folded from one row
    per entity, not from the panel rows.
    """
    ends = df.groupBy(*by).agg(F.min(d).alias("_lo"), F.max(d).alias("_hi"))
    if common:
        lo, hi = ends.agg(F.min("_lo")).scalar(), ends.agg(F.max("_hi")).scalar()
        ends = ends.select(*by, lo.alias("_lo"), hi.alias("_hi"))
    return ends.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step}"))).alias(d))


def reindex(df: DataFrame, grid: DataFrame, on: list[str]) -> DataFrame:
    """Left join on a calendar or grid."""
    return grid.join(df, on, "left")


def asof(left: DataFrame, right: DataFrame, by: list[str], x: str, d: str = "d") -> DataFrame:
    """Last non-null right value at or before each left date.

    One union and one sort per entity: linear in both sides, where a range join would be quadratic. The value keeps
    its own type.
    """
    keys = left.select(*by, d).withColumn("_x", F.lit(None).cast(right.schema[x].dataType)).withColumn("_left", F.lit(1))
    vals = right.select(*by, d, F.col(x).alias("_x")).withColumn("_left", F.lit(0))
    w = Window.partitionBy(*by).orderBy(d, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return (keys.unionByName(vals)
            .withColumn(x, F.last("_x", ignorenulls=True).over(w))
            .filter("_left = 1").select(*by, d, x))


def asof_next(left: DataFrame, right: DataFrame, by: list[str], cols: list[str], d: str = "d") -> DataFrame:
    """First right row strictly after each left date: the columns of that row and its date as `next_d`."""
    payload = F.struct(F.col(d).alias("next_d"), *[F.col(k) for k in cols])
    vals = right.select(*by, d, payload.alias("_p")).withColumn("_left", F.lit(0))
    empty = F.lit(None).cast(vals.schema["_p"].dataType)
    keys = left.select(*by, d).distinct().withColumn("_p", empty).withColumn("_left", F.lit(1))
    w = Window.partitionBy(*by).orderBy(d, "_left").rowsBetween(1, Window.unboundedFollowing)
    return (keys.unionByName(vals).withColumn("_p", F.first("_p", ignorenulls=True).over(w))
            .filter("_left = 1").select(*by, d, "_p.*"))


def publication_asof(left: DataFrame, series: DataFrame, lags: DataFrame, by: list[str], x: str,
                     default_days: int = 30, d: str = "d") -> DataFrame:
    """As-of join on the release date: stamp plus a per-series lag in calendar days."""
    released = (series.join(lags, by, "left")
                .withColumn(d, F.date_add(d, F.coalesce(F.col("lag"), F.lit(default_days)))))
    return asof(left, released, by, x, d)


def lag_by_dim(x: str | Column, k: str, offsets: list[int], w) -> Column:
    """Row lag whose size is read from column `k`; one lag expression per distinct offset."""
    x = F.col(x) if isinstance(x, str) else x
    return reduce(lambda acc, n: F.when(F.col(k) == n, F.lag(x, n).over(w) if n else x).otherwise(acc),
                  offsets, F.lit(None).cast("double"))


def publication_shift(df: DataFrame, lags: DataFrame, offsets: list[int], by: list[str], x: str) -> DataFrame:
    """Shift each series by its own number of rows; series without an entry stay."""
    return (df.join(lags, by, "left").withColumn("lag", F.coalesce("lag", F.lit(0)))
            .withColumn(x, lag_by_dim(x, "lag", sorted({0, *offsets}), win(by))).drop("lag"))


def align_inner(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Inner join on the keys, complete rows only."""
    return reduce(lambda a, b: a.join(b, on), frames).dropna()


def align_outer(frames: list[DataFrame], on: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "outer"), frames)


def common_start(df: DataFrame, series: str = "series", x: str = "x", d: str = "d") -> DataFrame:
    """Rows from the latest first-valid date on, on dates where every series has a value."""
    valid = df.filter(F.col(x).isNotNull())
    first = valid.groupBy(series).agg(F.min(d).alias("_f"))
    kept = valid.filter(F.col(d) >= first.agg(F.max("_f")).scalar())
    full = kept.groupBy(d).agg(F.count("*").alias("_k")).filter(F.col("_k") == first.agg(F.count("*")).scalar()).select(d)
    return kept.join(full, d, "left_semi")


def complete_dates(df: DataFrame, by: list[str], x: str, d: str = "d", asset: str = "asset") -> DataFrame:
    """Rows on dates where every asset of the universe has a value."""
    valid = df.filter(F.col(x).isNotNull())
    n = df.groupBy(*by, asset).agg(F.lit(1).alias("_one")).groupBy(*by).agg(F.count("*").alias("_n"))
    full = valid.groupBy(*by, d).agg(F.count("*").alias("_k")).join(n, by).filter("_k = _n").select(*by, d)
    return valid.join(full, [*by, d], "left_semi")


def dedupe_signals(df: DataFrame, order: str = "block") -> DataFrame:
    """Keep a signal from the first block that defines it; decided on signal names, not on rows."""
    first = df.groupBy("signal").agg(F.min(order).alias(order))
    return df.join(first, ["signal", order], "left_semi")


def stack(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Row-wise concatenation with a key column."""
    return reduce(DataFrame.unionByName, [f.withColumn(key, F.lit(k)) for k, f in frames.items()])


def with_spec_grid(df: DataFrame, **params: list) -> DataFrame:
    """Each row under every combination of parameter values; filter or group on them afterwards. No join."""
    for name, values in params.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def pivot_wide(df: DataFrame, index: list[str], column: str, value: str, names: list) -> DataFrame:
    """Long to wide over a known list of names, so no extra job discovers them."""
    return df.groupBy(*index).pivot(column, names).agg(F.first(value))


def crosstab(df: DataFrame, row: str, col: str, names: list) -> DataFrame:
    return df.groupBy(row).pivot(col, names).agg(F.count(F.lit(1))).na.fill(0)


def share_known(x: str) -> Column:
    return div(F.count(x), F.count("*"))


def fill_forward(df: DataFrame, by: list[str], x: str, d: str = "d") -> DataFrame:
    return df.withColumn(x, ffill(x, win(by, d)))
