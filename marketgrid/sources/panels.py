"""Long panels derived from the order tables: prices, returns, quotes and macro series.

Every panel is the output of one map-side-combined aggregation, so an asset that owns a third of all
order lines still contributes at most one row per date to what follows.
"""

from __future__ import annotations

from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import win
from ..session import stored

TENORS = {1: 0.25, 2: 0.5, 3: 1.0, 4: 2.0, 5: 5.0, 6: 10.0, 7: 30.0}


def month(ts: str):
    return F.trunc(F.col(ts).cast("date"), "month")


def with_return(px: DataFrame, by: list[str]) -> DataFrame:
    return px.withColumn("r", F.col("px") / F.lag("px").over(win(by)) - 1.0)


class Tables:
    """Raw tables as attributes, plus the derived panels; everything is lazy."""

    RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in Tables.RAW:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    def dim(self, rows: list[tuple], schema: str) -> DataFrame:
        """A lookup table of literal rows. It becomes a local relation, so the planner knows its size."""
        names = [f.split()[0] for f in schema.split(",")]
        return self.spark.createDataFrame(pa.table({k: list(v) for k, v in zip(names, zip(*rows))}), schema)

    def _unit_price(self, lines: DataFrame, *keys) -> DataFrame:
        return lines.groupBy(*keys).agg(
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("px"), F.sum("l_quantity").alias("vol"))

    @cached_property
    def priced_lines(self) -> DataFrame:
        part = self.part.select("p_partkey", F.col("p_type").alias("asset"))
        return self.lineitem.join(part, F.col("l_partkey") == part.p_partkey)

    @cached_property
    def months(self) -> DataFrame:
        """Sums by (asset, month), the one pass over the lines that all monthly panels share; written once.

        Lines without a part keep a null asset, so the market and the rates cover every line.
        """
        part = self.part.select("p_partkey", F.col("p_type").alias("asset"))
        lines = self.lineitem.join(part, F.col("l_partkey") == part.p_partkey, "left")
        sums = [F.sum(k).alias(a) for k, a in (("l_extendedprice", "value"), ("l_quantity", "vol"), ("l_discount", "discount"))]
        return stored(lines.groupBy("asset", month("l_shipdate").alias("d")).agg(*sums, F.count("l_discount").alias("n_discount")))

    @cached_property
    def px_m(self) -> DataFrame:
        return self.months.filter("asset is not null").select("asset", "d", (F.col("value") / F.col("vol")).alias("px"), "vol")

    @cached_property
    def ret_m(self) -> DataFrame:
        return with_return(self.px_m, ["asset"])

    @cached_property
    def px_d(self) -> DataFrame:
        return self._unit_price(self.priced_lines, "asset", F.col("l_shipdate").cast("date").alias("d"))

    @cached_property
    def ret_d(self) -> DataFrame:
        return with_return(self.px_d, ["asset"])

    @cached_property
    def rf_m(self) -> DataFrame:
        return self.months.groupBy("d").agg((F.sum("discount") / F.sum("n_discount") / 12).alias("rf"))

    @cached_property
    def bench_m(self) -> DataFrame:
        px = self.months.groupBy(F.lit("market").alias("asset"), "d").agg((F.sum("value") / F.sum("vol")).alias("px"), F.sum("vol").alias("vol"))
        return with_return(px, ["asset"])

    @cached_property
    def cmt_m(self) -> DataFrame:
        """Par quotes in percent by tenor."""
        tenor = F.element_at(F.create_map(*[F.lit(v) for kv in TENORS.items() for v in kv]), F.col("l_linenumber"))
        return (self.lineitem.groupBy(month("l_shipdate").alias("d"), tenor.alias("tenor"))
                .agg((F.avg("l_discount") * 100).alias("par")))

    @cached_property
    def macro_m(self) -> DataFrame:
        return self.orders.groupBy(month("o_orderdate").alias("d")).agg(
            F.sum("o_totalprice").alias("growth"), F.avg("o_totalprice").alias("price"), F.count("*").alias("n"))

    @cached_property
    def events_h(self) -> DataFrame:
        return self.events.groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("h")).agg(
            F.sum("value").alias("x"))

    @cached_property
    def univ_ret_q(self) -> DataFrame:
        supp = self.supplier.select("s_suppkey", F.col("s_nationkey").alias("universe"))
        lines = self.priced_lines.join(supp, F.col("l_suppkey") == supp.s_suppkey)
        px = self._unit_price(lines, "universe", "asset", F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("d"))
        return with_return(px, ["universe", "asset"])

    @cached_property
    def strat_m(self) -> DataFrame:
        """Each asset held alone, as a strategy return path with the risk-free rate beside it."""
        r = self.ret_m.select(F.col("asset").alias("strategy"), "d", "r").filter("r is not null")
        return r.join(self.rf_m, "d")

    @cached_property
    def excess_m(self) -> DataFrame:
        return self.ret_m.filter("r is not null").join(self.rf_m, "d").select(
            "asset", "d", (F.col("r") - F.col("rf")).alias("x"))
