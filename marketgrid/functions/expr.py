"""Column helpers: null rules, guarded arithmetic, rounding and window frames."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ColumnLike = Column | str


def c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: ColumnLike) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    x = c(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def div(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, NULL where b is zero."""
    return c(a) / F.nullif(c(b), F.lit(0.0))


def r6(x: ColumnLike, digits: int = 6) -> Column:
    """Round for output; adding zero turns -0.0 into 0.0."""
    return F.round(c(x), digits) + F.lit(0.0)


def clip(x: ColumnLike, lo: ColumnLike | None = None, hi: ColumnLike | None = None) -> Column:
    """Bound x; a NULL stays NULL (least/greatest alone would return the bound)."""
    x = c(x)
    out = x
    if lo is not None:
        out = F.greatest(out, c(lo) if isinstance(lo, (str, Column)) else F.lit(lo))
    if hi is not None:
        out = F.least(out, c(hi) if isinstance(hi, (str, Column)) else F.lit(hi))
    return F.when(x.isNotNull(), out)


def win(by: Iterable[str], order: str = "d") -> WindowSpec:
    """Entity window. One row per (entity, date) bounds each partition by the calendar length."""
    return Window.partitionBy(*by).orderBy(order)


def trailing(w: WindowSpec, n: int, lag: int = 0) -> WindowSpec:
    """The n rows ending `lag` rows before the current one."""
    return w.rowsBetween(-(n - 1) - lag, -lag)


def expanding(w: WindowSpec, lag: int = 0) -> WindowSpec:
    """Every row up to `lag` rows before the current one."""
    return w.rowsBetween(Window.unboundedPreceding, -lag)


def rolling(
    agg: Callable[[Column], Column],
    x: ColumnLike,
    w: WindowSpec,
    n: int,
    min_periods: int | None = None,
    lag: int = 0,
) -> Column:
    """Aggregate of the trailing n rows, NULL until `min_periods` of them hold a value."""
    x = c(x)
    frame = trailing(w, n, lag)
    need = n if min_periods is None else min_periods
    return F.when(F.count(x).over(frame) >= need, agg(x).over(frame))


def roll_mean(x, w, n, min_periods=None, lag=0) -> Column:
    return rolling(F.avg, x, w, n, min_periods, lag)


def roll_std(x, w, n, min_periods=None, lag=0) -> Column:
    return rolling(F.stddev_samp, x, w, n, min_periods, lag)


def roll_sum(x, w, n, min_periods=None, lag=0) -> Column:
    return rolling(F.sum, x, w, n, min_periods, lag)


def compound(x: Column) -> Column:
    """Aggregate: product of (1 + x) minus 1."""
    return F.product(F.lit(1.0) + x) - 1.0


def roll_growth(x, w, n, min_periods=None, lag=0) -> Column:
    return rolling(lambda v: F.product(F.lit(1.0) + v), x, w, n, min_periods, lag)


def ffill(x: ColumnLike, w: WindowSpec) -> Column:
    """Last non-null value at or before the row."""
    return F.last(c(x), ignorenulls=True).over(expanding(w))


def first_of_run(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("int")


def safe_corr(a: ColumnLike, b: ColumnLike, w: WindowSpec | None = None) -> Column:
    """Pearson correlation over the rows where both exist, as an aggregate or over `w`; NULL on a flat side."""
    both = c(a).isNotNull() & c(b).isNotNull()
    x, y = F.when(both, c(a)), F.when(both, c(b))
    on = (lambda e: e.over(w)) if w is not None else (lambda e: e)
    scale = on(F.stddev_pop(x)) * on(F.stddev_pop(y))
    return on(F.covar_pop(x, y)) / F.nullif(scale, F.lit(0.0))


def safe_slope(y: ColumnLike, x: ColumnLike, w: WindowSpec | None = None) -> Column:
    """Least-squares slope of y on x over complete pairs; NULL when x is flat."""
    both = c(y).isNotNull() & c(x).isNotNull()
    u, v = F.when(both, c(x)), F.when(both, c(y))
    on = (lambda e: e.over(w)) if w is not None else (lambda e: e)
    return on(F.covar_pop(u, v)) / F.nullif(on(F.var_pop(u)), F.lit(0.0))
