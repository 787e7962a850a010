"""A quick slice of the SQL checks on the smallest tables; tools/check.py runs all of them."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SLICE = ("publication_asof", "rolling_zscore", "rank_pct", "momentum_skip", "xs_rank01", "apply_tilt", "bootstrap_curve", "constant_maturity_returns", "cov_ledoit_wolf",
         "flagship_backtest", "backtest_weight_path", "comparison_table", "univariate_forecasts", "stationary_bootstrap_index", "enforce_persistence", "monthly_momentum_block")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else str(v)
    return sorted(cols), sorted(tuple(clean(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables absent")
@pytest.mark.parametrize("name", SLICE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in cur.description], cur.fetchall())


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 280
