"""Readers and writers: wide parquet panels, curve files with a preamble, year.month tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.expr import finite


def unpivot(df: DataFrame, ids: list[str], name: str, value: str) -> DataFrame:
    """Wide to long; NaN becomes NULL on the way in."""
    cols = [k for k in df.columns if k not in ids]
    cast = df.select(*ids, *[F.col(f"`{k}`").cast("double").alias(k) for k in cols])
    return cast.unpivot(ids, cols, name, value).withColumn(value, finite(value))


def read_panel(spark: SparkSession, path: str, ids: list[str] | None = None,
               name: str = "asset", value: str = "x") -> DataFrame:
    """Wide parquet panel as long rows."""
    return unpivot(spark.read.parquet(path), ids or ["d"], name, value)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table, or an empty frame with the given schema where none exists."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # only a missing path; an unreadable or foreign table is an error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_panel(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a panel; partition by low-cardinality keys such as the year or the universe only."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_preamble_csv(spark: SparkSession, path: str, columns: list[str], marker: str = "Date,BETA0") -> DataFrame:
    """CSV rows after a free-text preamble; data rows start with an ISO date, ``NA`` is NULL.

    `columns` is the header in file order (see `preamble_header`); rows are recognised by their date, so
    the file can be split and read in parallel.
    """
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2},"))
    parts = F.split(F.col("value"), ",")
    fields = [F.try_to_date(parts.getItem(0)).alias("d")]
    for i, k in enumerate(columns[1:], start=1):
        text = F.trim(F.get(parts, i))
        fields.append(F.when(text != "NA", text).try_cast("double").alias(k))
    return lines.select(*fields)


def preamble_header(spark: SparkSession, path: str, marker: str = "Date,BETA0") -> list[str]:
    """Column names from the first line that starts with the marker; one line reaches the driver."""
    row = spark.read.text(path).filter(F.col("value").startswith(marker)).first()
    return [k.strip() for k in row.value.split(",")]


def curve_yields(df: DataFrame, prefix: str) -> DataFrame:
    """Columns ``<prefix>nn`` to long (d, tenor, y)."""
    cols = [k for k in df.columns if k.startswith(prefix) and k[len(prefix):].isdigit()]
    long = df.select("d", *cols).unpivot(["d"], cols, "code", "y")
    return long.select("d", F.regexp_extract("code", r"(\d+)$", 1).cast("double").alias("tenor"), "y")


def curve_params(df: DataFrame, names: tuple[str, ...] = ("BETA0", "BETA1", "BETA2", "BETA3", "TAU1", "TAU2")) -> DataFrame:
    """Published fit parameters, rows without any value dropped."""
    return df.select("d", *names).dropna(how="all", subset=list(names))


def parse_year_month(df: DataFrame, stamp: str = "stamp", numeric: tuple[str, ...] = (), required: str | None = None) -> DataFrame:
    """Rows stamped ``YYYY.M``: "1990.1" is October (a right-padded "10"), month end, numbers coerced."""
    ok = df.filter(F.trim(stamp).rlike(r"^\d{4}\.\d{1,2}$"))
    parts = F.split(F.trim(stamp), r"\.")
    out = ok.withColumn("d", F.last_day(F.make_date(parts[0].cast("int"), F.rpad(parts[1], 2, "0").cast("int"), F.lit(1))))
    for k in numeric:
        out = out.withColumn(k, F.col(k).try_cast("double"))
    return out.drop(stamp).dropna(subset=[required]) if required else out.drop(stamp)
