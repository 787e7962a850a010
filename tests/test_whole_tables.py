"""Registered queries against their SQL on small tables with gaps, which the driver tables don't have."""

import datetime as dt

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from marketgrid.plans import alignment
from test_registry import table


@pytest.fixture()
def equal(spark, tmp_path):
    def check(name, **tables):
        con = duckdb.connect()
        for k, (rows, schema) in tables.items():
            path = f"{tmp_path}/{k}.parquet"
            spark.createDataFrame(rows, schema).write.parquet(path)
            con.execute(f"CREATE VIEW {k} AS SELECT * FROM '{path}/*.parquet'")
        df = entry.queries()[name](spark, str(tmp_path))
        rows = [tuple(r) for r in df.collect()]
        cur = con.execute(entry.oracle_sql()[name])
        assert table(df.columns, rows) == table([d[0] for d in cur.description], cur.fetchall())
        return rows

    return check


def test_orders_without_price_or_date_are_counted(equal):
    day = lambda m: dt.datetime(1996, m, 5)
    rows = [(1, 10.004, day(1)), (2, 20.004, day(1)), (3, None, day(1)), (4, 5.0, day(10)), (5, None, day(12)), (6, 7.0, None), (7, None, None)]
    got = equal("parse_year_month", orders=(rows, "o_orderkey long, o_totalprice double, o_orderdate timestamp"))
    assert {r[0]: r[1:] for r in got} == {dt.date(1996, 1, 31): (3, 2, 30.01), dt.date(1996, 10, 31): (1, 1, 5.0), dt.date(1996, 12, 31): (1, 0, None), None: (2, 1, 7.0)}


def test_curve_file_has_all_quotes_and_no_others(equal):
    a, b, c = (dt.datetime(1996, m, 5) for m in (1, 2, 3))
    rows = [(1, 0.05, a), (2, 0.04, a), (8, 0.03, a), (9, 0.07, b), (7, 0.09, b), (2, None, b), (1, 0.02, None), (3, 0.01, c), (3, 0.02, c), (None, 0.06, c)]
    got = equal("read_curve_csv", lineitem=(rows, "l_linenumber int, l_discount double, l_shipdate timestamp"))
    a, b, c = (x.date().replace(day=1) for x in (a, b, c))
    assert {r[:2]: r[2] for r in got} == {(a, 1.0): 5.0, (a, 5.0): 4.0, (a, 35.0): 3.0, (b, 40.0): 7.0, (b, 30.0): 9.0, (b, 5.0): None, (None, 1.0): 2.0, (c, 10.0): 1.5, (c, None): 6.0}


def test_curve_file_says_na_and_the_result_depends_on_it(equal, spark, tmp_path, monkeypatch):
    """Without hiding a quote, each month of the file has an NA cell; a reader that takes NA for a yield gives other rows."""
    a, b = (dt.datetime(1996, m, 5) for m in (3, 4))
    rows = [(1, 0.05, a), (2, 0.04, a), (1, 0.03, b), (2, 0.02, b), (3, None, b)]
    cells = []
    keep = alignment.files.curve_yields

    def read(df, prefix, fill=None):
        got = keep(df, prefix)
        cells.append(sorted(tuple(r) for r in got.filter("y is null").collect()))
        return got if fill is None else got.na.fill(fill, ["y"])

    monkeypatch.setattr(alignment.files, "curve_yields", read)
    got = equal("read_curve_csv", lineitem=(rows, "l_linenumber int, l_discount double, l_shipdate timestamp"))
    a, b = (x.date().replace(day=1) for x in (a, b))
    assert {r[:2]: r[2] for r in got} == {(a, 1.0): 5.0, (a, 5.0): 4.0, (b, 1.0): 3.0, (b, 5.0): 2.0, (b, 10.0): None}
    assert cells == [[(a, 10.0, None), (a, 11.0, None), (b, 10.0, None), (b, 11.0, None)]]
    monkeypatch.setattr(alignment.files, "curve_yields", lambda df, prefix: read(df, prefix, 0.0))
    wrong = entry.queries()["read_curve_csv"](spark, str(tmp_path))
    assert {tuple(r)[:2] for r in wrong.collect()} == {r[:2] for r in got} | {(a, 10.0), (a, 11.0), (b, 11.0)}


def gappy(*gaps):
    """Monthly prices of three assets over 40 months; `gaps` are (asset, month) without lines."""
    rows = [(p, 100.0 + (37 * m * (p + 2) + m * m) % 23, 1.0, 0.05, dt.datetime(1995 + m // 12, m % 12 + 1, 9)) for p in range(3) for m in range(40) if (p, m) not in gaps]
    return {"lineitem": (rows, "l_partkey long, l_extendedprice double, l_quantity double, l_discount double, l_shipdate timestamp"),
            "part": ([(p, t) for p, t in enumerate(("ECONOMY", "LARGE", "PROMO"))], "p_partkey long, p_type string")}


# months of a return before the first trade, of a trade, of a trade's last month, and from the start
GAPS = ((1, 7), (2, 25), (0, 30), (1, 31), (2, 34), (2, 37))


def test_weight_path_of_assets_with_gaps(equal):
    got = equal("backtest_weight_path", **gappy(*GAPS))
    assert len(got) == 15 and sum(r[3] > 0 for r in got) == 2  # every date from position 24 of the calendar; trades at 24, 30 and 36


def test_weight_path_falls_back_where_an_asset_has_no_return(equal):
    """A trade row with a missing weight is 1/n of all assets, that one too, as a plain loop has it; no return is flat."""
    gaps = ((2, 27), (1, 31), (0, 33))  # months between trades, of the second trade, and between trades
    got = {r[1]: r[2:] for r in equal("backtest_weight_path", **gappy(*gaps))}
    px = np.full((40, 3), np.nan)
    for p, price, *_, day in gappy(*gaps)["lineitem"][0]:
        px[(day.year - 1995) * 12 + day.month - 1, p] = price
    held, rates, want = None, np.array([5.0, 10.0, 20.0]) / 10_000 * 2, {}
    last = px[0]
    for m in range(1, 40):  # the first return is of month 1, position 0
        r, last = np.where(np.isnan(px[m]), np.nan, px[m] / last - 1), np.where(np.isnan(px[m]), last, px[m])
        if m < 25:
            continue
        cost = turnover = 0.0
        if (m - 1) % 6 == 0:
            w = np.clip(r, 0, None)
            goal = np.ones(3) / 3 if not np.isfinite(w).all() or w.sum() <= 0 else w / w.sum()
            moved = np.abs(goal - (0 if held is None else held))
            cost, turnover, held = moved @ rates, 0.0 if held is None else moved.sum() / 2, goal
        r = np.nan_to_num(r)
        want[dt.date(1995 + m // 12, m % 12 + 1, 1)] = (held @ r - cost, turnover)
        held = held * (1 + r) / (held * (1 + r)).sum()
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=2e-6) for d in want)


def test_spread_of_assets_with_gaps(equal):
    got = equal("backtest_spread", **gappy(*GAPS))
    assert len(got) == 15 and sum(r[3] > 0 for r in got) == 5  # trades at 24, 27, 30, 33 and 36
