"""Small hand-made panels."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd


def months(n: int, start: str = "2000-01-01") -> list[dt.date]:
    return [d.date() for d in pd.date_range(start, periods=n, freq="MS")]


def panel(spark, wide: pd.DataFrame, universe: str = "u", value: str = "x"):
    """Wide frame (dates by assets) as long rows (universe, asset, d, value); NaN becomes NULL."""
    long = wide.rename_axis("d").reset_index().melt("d", var_name="asset", value_name=value)
    long.insert(0, "universe", universe)
    long[value] = long[value].astype(object).where(long[value].notna(), None)
    return spark.createDataFrame(long, f"universe string, d date, asset string, {value} double") if list(long.columns) == ["universe", "d", "asset", value] else None


def random_wide(n: int, k: int, seed: int = 0, scale: float = 0.03) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 1)) * scale
    return pd.DataFrame(0.004 + base * 0.5 + rng.standard_normal((n, k)) * scale, index=months(n), columns=[f"a{i}" for i in range(k)])


def series(spark, values, key: str = "s", col: str = "x"):
    rows = [(key, d, None if v is None else float(v)) for d, v in zip(months(len(values)), values)]
    return spark.createDataFrame(rows, f"asset string, d date, {col} double")


def collect(df, key: list[str], value: str) -> dict:
    return {tuple(r[k] for k in key): r[value] for r in df.collect()}
