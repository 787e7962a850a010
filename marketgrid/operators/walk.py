"""Refit calendars of walk-forward models, and their rows in the form that batched fits read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import win
from ..session import stored


class Refits(NamedTuple):
    """Refits in order, by position in the calendar: in force on [at, until), trained on [lo, hi)."""

    at: np.ndarray
    until: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def calendar(dates: DataFrame, d: str = "d") -> DataFrame:
    """(d, pos): distinct dates and their positions from 0, written once."""
    cal = dates.select(d).distinct().withColumn("_u", F.lit(1))
    return stored(cal.select(d, (F.row_number().over(win(["_u"], d)) - 1).cast("long").alias("pos")))


def refits(n_dates: int, first: int, every: int, back: int = 0, window: int | None = None) -> Refits:
    """Refits at `first` and every `every` positions on, trained on what lies `back` positions before, of a window or all."""
    at = np.arange(first, n_dates, every, dtype=np.int64)
    lo = np.zeros_like(at) if window is None else np.maximum(at - window, 0)
    return Refits(at, np.append(at[1:], n_dates), lo, at - back)


def complete(features: list[str]):
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() & ~F.isnan(F.col(k).cast("double")) for k in features))


def packed(wide: DataFrame, cal: DataFrame, features: list[str], d: str = "d") -> DataFrame:
    """Rows with all features: (asset, d, pos, y, x) with x as one array."""
    x = F.array(*(F.col(k).cast("double") for k in features)).alias("x")
    return wide.filter(complete(features)).join(cal, d).select("asset", d, "pos", F.col("y").cast("double").alias("y"), x)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of equal length as rows by width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about `rows` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def with_all(rows: DataFrame, cal: DataFrame, first: int, values: DataFrame, keys: list[str], d: str = "d") -> DataFrame:
    """Every (asset, date) from position `first` on beside its values; rows without one have nulls."""
    return rows.select("asset", d).join(cal.filter(F.col("pos") >= first).select(d), d).join(values, keys, "left")
