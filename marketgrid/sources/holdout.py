"""Holdout discipline: named layers, audited access to the sealed one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dates import in_span

# fixed values: the layer bounds of the study
LAYERS = {"development": ("1980-02", "2015-12"), "holdout": ("2016-01", "2026-12")}

AUDIT_SCHEMA = "layer string, reason string, at string, rows long"


class SealedDataError(RuntimeError):
    """The permitted layer holds no rows, or the frame reaches past it."""


def layer_slice(df: DataFrame, layer: str, layers: dict = LAYERS, d: str = "d") -> DataFrame:
    if layer not in layers:
        raise KeyError(f"unknown layer: {layer}")
    return df.filter(in_span(*layers[layer], d))


def development(df: DataFrame, layers: dict = LAYERS, d: str = "d") -> DataFrame:
    return layer_slice(df, "development", layers, d)


def audit_row(df: DataFrame, layer: str, reason: str, layers: dict = LAYERS, d: str = "d") -> DataFrame:
    """One row: which layer was read, why, when, how many rows."""
    return layer_slice(df, layer, layers, d).agg(F.count("*").alias("rows")).select(
        F.lit(layer).alias("layer"), F.lit(reason).alias("reason"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("at"), "rows")


def unseal(df: DataFrame, layer: str, reason: str, log_path: str, layers: dict = LAYERS, d: str = "d") -> DataFrame:
    """Slice a sealed layer and append the access to the log."""
    audit_row(df, layer, reason, layers, d).write.mode("append").json(log_path)
    return layer_slice(df, layer, layers, d)


def guard(df: DataFrame, allow: str = "development", layers: dict = LAYERS, d: str = "d", strict: bool = False) -> DataFrame:
    """The permitted layer; raises when it is empty and, if strict, when rows lie past it."""
    out = layer_slice(df, allow, layers, d)
    if out.limit(1).isEmpty():
        raise SealedDataError(f"no data in the {allow} layer {layers[allow]}")
    if strict and not df.filter(~in_span("0001-01", layers[allow][1], d)).limit(1).isEmpty():
        raise SealedDataError(f"the frame extends past the {allow} layer {layers[allow]}")
    return out


def access_log(spark: SparkSession, log_path: str) -> DataFrame:
    try:
        return spark.read.schema(AUDIT_SCHEMA).json(log_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], AUDIT_SCHEMA)


def layer_summary(df: DataFrame, layers: dict = LAYERS, d: str = "d") -> DataFrame:
    """Rows per layer in one pass."""
    per = F.array(*[F.struct(F.lit(k).alias("layer"), in_span(*v, d).alias("inside")) for k, v in layers.items()])
    return df.select(F.explode(per).alias("e")).groupBy("e.layer").agg(F.count_if("e.inside").alias("rows"))
