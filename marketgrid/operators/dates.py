"""Calendar operators: resampling, buckets, slices, gaps, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import compound, expanding, win


def month_end(d: str = "d") -> Column:
    return F.last_day(d)


def month_spine(df: DataFrame, by: list[str], d: str = "d") -> DataFrame:
    """Every month end between an entity's first and last month."""
    ends = df.groupBy(*by).agg(F.trunc(F.min(d), "month").alias("_a"), F.trunc(F.max(d), "month").alias("_b"))
    return ends.select(*by, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 MONTH"))).alias(d)).withColumn(d, F.last_day(d))


def resample_last(df: DataFrame, by: list[str], x: str, d: str = "d") -> DataFrame:
    """Last non-null value of each month, stamped month end; an empty month is a NULL row."""
    agg = df.filter(F.col(x).isNotNull()).groupBy(*by, F.last_day(d).alias("_m")).agg(F.max_by(x, d).alias(x))
    return month_spine(df, by, d).join(agg.withColumnRenamed("_m", d), [*by, d], "left")


def resample_sum(df: DataFrame, by: list[str], x: str, d: str = "d", scale: float = 1.0) -> DataFrame:
    """Month sum times a scale; an empty month is zero."""
    agg = df.groupBy(*by, F.last_day(d).alias("_m")).agg(F.sum(x).alias(x))
    out = month_spine(df, by, d).join(agg.withColumnRenamed("_m", d), [*by, d], "left")
    return out.withColumn(x, F.coalesce(x, F.lit(0.0)) * scale)


def resample_compound(df: DataFrame, by: list[str], x: str, d: str = "d") -> DataFrame:
    """Month return compounded from its rows."""
    return df.groupBy(*by, F.last_day(d).alias(d)).agg(compound(F.col(x)).alias(x))


def quarter_sign_to_months(df: DataFrame, by: list[str], x: str, d: str = "d") -> DataFrame:
    """1.0 in months from a quarter end on whose quarterly growth was negative, carried to the next quarter end."""
    q = df.filter(F.col(x).isNotNull()).groupBy(
        *by, F.last_day(F.add_months(F.date_trunc("quarter", d).cast("date"), 2)).alias("q")).agg(F.max_by(x, d).alias(x))
    g = q.withColumn("neg", (F.coalesce(F.col(x) / F.lag(x).over(win(by, "q")) - 1 < 0, F.lit(False))).cast("double"))
    months = month_spine(df, by, d)
    keyed = months.join(g.select(*by, F.col("q").alias(d), "neg"), [*by, d], "left")
    return keyed.withColumn("neg", F.last("neg", ignorenulls=True).over(expanding(win(by, d))))


def period_bucket(months: int, d: str = "d") -> Column:
    """(year, month bucket) as one integer."""
    return F.year(d) * 12 + F.floor((F.month(d) - 1) / months).cast("int")


def first_in_bucket(by: list[str], months: int, d: str = "d") -> Column:
    """True on the first row of each calendar bucket."""
    b = period_bucket(months, d)
    prev = F.lag(b).over(win(by, d))
    return prev.isNull() | (prev != b)


def in_span(start: str, end: str, d: str = "d") -> Column:
    """Inclusive slice; a partial string such as ``2015-12`` stands for its whole month, ``2015`` for its year."""

    def low(s: str) -> str:
        return s + "-01" * (3 - len(s.split("-")))

    parts = end.split("-")
    if len(parts) == 3:
        hi = F.lit(end).cast("date")
    elif len(parts) == 2:
        hi = F.last_day(F.lit(end + "-01").cast("date"))
    else:
        hi = F.lit(end + "-12-31").cast("date")
    return F.col(d).between(F.lit(low(start)).cast("date"), hi)


def year_gap(by: list[str], d: str = "d", day_count: float = 365.0) -> Column:
    """Years since the previous row of the entity."""
    return F.datediff(F.col(d), F.lag(d).over(win(by, d))) / day_count


def every_nth(df: DataFrame, by: list[str], n: int, d: str = "d") -> DataFrame:
    """Rows 0, n, 2n, ... of each entity."""
    return df.withColumn("_rn", F.row_number().over(win(by, d)) - 1).filter(F.col("_rn") % n == 0).drop("_rn")


def coverage(df: DataFrame, by: list[str], x: str, d: str = "d") -> DataFrame:
    known = F.when(F.col(x).isNotNull(), F.col(d))
    return df.groupBy(*by).agg(F.min(known).alias("first"), F.max(known).alias("last"),
                               F.count(x).alias("n"), (F.count(x) / F.count("*")).alias("coverage"))
