"""Query registry and the shared view definitions of the SQL checks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.panels import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_MONTH = "CAST(date_trunc('month', l_shipdate) AS DATE)"
_PX = "SUM(l_extendedprice)/SUM(l_quantity) AS px, SUM(l_quantity) AS vol"

# name -> view text; views may use the ones before them
VIEWS: dict[str, str] = {
    "px_m": f"SELECT p_type AS asset, {_MONTH} AS d, {_PX} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "ret_m": "SELECT *, px/LAG(px) OVER (PARTITION BY asset ORDER BY d) - 1 AS r FROM px_m",
    "px_d": f"SELECT p_type AS asset, CAST(l_shipdate AS DATE) AS d, {_PX} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "ret_d": "SELECT *, px/LAG(px) OVER (PARTITION BY asset ORDER BY d) - 1 AS r FROM px_d",
    "rf_m": f"SELECT {_MONTH} AS d, AVG(l_discount)/12 AS rf FROM lineitem GROUP BY 1",
    "bench_m": f"SELECT 'market' AS asset, d, px, vol, px/LAG(px) OVER (ORDER BY d) - 1 AS r FROM (SELECT {_MONTH} AS d, {_PX} FROM lineitem GROUP BY 1)",
    "cmt_m": f"""SELECT {_MONTH} AS d, CAST(CASE l_linenumber WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN 1
                 WHEN 4 THEN 2 WHEN 5 THEN 5 WHEN 6 THEN 10 ELSE 30 END AS DOUBLE) AS tenor,
                 AVG(l_discount)*100 AS par FROM lineitem GROUP BY 1, 2""",
    "macro_m": """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, SUM(o_totalprice) AS growth,
                  AVG(o_totalprice) AS price, COUNT(*) AS n FROM orders GROUP BY 1""",
    "events_h": "SELECT event_type AS series, date_trunc('hour', ts) AS h, SUM(value) AS x FROM events GROUP BY 1, 2",
    "univ_ret_q": f"""SELECT *, px/LAG(px) OVER (PARTITION BY universe, asset ORDER BY d) - 1 AS r FROM (
                      SELECT s_nationkey AS universe, p_type AS asset, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS d, {_PX}
                      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)""",
    "strat_m": "SELECT asset AS strategy, d, r, rf FROM ret_m JOIN rf_m USING (d) WHERE r IS NOT NULL",
    "excess_m": "SELECT asset, d, r - rf AS x FROM ret_m JOIN rf_m USING (d) WHERE r IS NOT NULL",
    "ex_c": "SELECT * FROM excess_m WHERE d IN (SELECT d FROM excess_m GROUP BY 1 HAVING COUNT(*) = (SELECT COUNT(DISTINCT asset) FROM excess_m))",
}


def view(name: str, text: str) -> None:
    """Add a shared view for SQL checks."""
    VIEWS[name] = text


def views(pairs: list[tuple[str, str]]) -> None:
    """Add several shared views."""
    for name, text in pairs:
        view(name, text)


def with_views(body: str) -> str:
    """Prefix the views a query mentions, directly or through other views."""
    names = list(VIEWS)
    need: set[str] = set()

    def visit(text: str) -> None:
        for n in names:
            if n not in need and re.search(rf"\b{n}\b", text):
                need.add(n)
                visit(VIEWS[n])

    visit(body)
    ordered: list[str] = []

    def place(n: str) -> None:
        if n in ordered:
            return
        for m in names:
            if m != n and m in need and re.search(rf"\b{m}\b", VIEWS[n]):
                place(m)
        ordered.append(n)

    for n in names:
        if n in need:
            place(n)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    head = "WITH RECURSIVE "
    stripped = re.sub(r"^\s*WITH(\s+RECURSIVE)?\s+", "", body, flags=re.I)
    glue = ",\n" if stripped != body else "\n"
    return head + ctes + glue + stripped


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and, when given, its SQL check."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def oracle_sql() -> dict[str, str]:
    return {k: with_views(v) for k, v in ORACLE.items()}
