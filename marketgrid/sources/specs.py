"""Specification log: fingerprints, deduplicated append, flattening, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPEC_SCHEMA = ("phase string, family string, name string, config map<string,string>, metrics map<string,double>, "
               "oos_start string, oos_end string, n_periods long, note string, fingerprint string, recorded_at string")


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def fingerprint() -> Column:
    """First 16 hex digits of the SHA-256 of the canonical JSON (sorted keys, ", " and ": " separators).

    Config values are JSON texts, e.g. ``0.5`` or ``"abc"`` with its quotes.
    """
    pairs = F.transform(F.array_sort(F.map_keys("config")),
                        lambda k: F.concat(_quoted(k), F.lit(": "), F.element_at(F.col("config"), k)))
    text = F.concat(F.lit('{"config": {'), F.array_join(pairs, ", "), F.lit('}, "family": '), _quoted(F.col("family")),
                    F.lit(', "name": '), _quoted(F.col("name")), F.lit(', "phase": '), _quoted(F.col("phase")), F.lit("}"))
    return F.substring(F.sha2(text, 256), 1, 16)


def new_specs(incoming: DataFrame, logged: DataFrame) -> DataFrame:
    """Incoming specs whose fingerprint is not logged yet, one row per fingerprint."""
    keyed = incoming.withColumn("fingerprint", fingerprint())
    return keyed.join(logged.select("fingerprint"), "fingerprint", "left_anti").dropDuplicates(["fingerprint"])


def record(spark: SparkSession, incoming: DataFrame, path: str) -> DataFrame:
    """Append new specs to the JSON-lines log; returns the appended rows."""
    fresh = new_specs(incoming, load(spark, path)).withColumn("recorded_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    fresh.write.mode("append").json(path)
    return fresh


def parse_lines(lines: DataFrame) -> DataFrame:
    """JSON lines (column `value`) to log rows; lines that do not parse, or carry no fingerprint, are skipped."""
    parsed = lines.filter(F.trim("value") != "").select(F.from_json("value", SPEC_SCHEMA).alias("e"))
    return parsed.select("e.*").filter(F.col("fingerprint").isNotNull())


def load(spark: SparkSession, path: str) -> DataFrame:
    try:
        return parse_lines(spark.read.text(path))
    except Exception as e:  # a log that was never written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SPEC_SCHEMA)


def flatten(log: DataFrame) -> DataFrame:
    """One row per config or metric entry: config keys are prefixed ``cfg_``."""
    cfg = F.transform(F.map_entries("config"), lambda e: F.struct(
        F.concat(F.lit("cfg_"), e["key"]).alias("key"), e["value"].alias("value")))
    met = F.transform(F.map_entries("metrics"), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("string").alias("value")))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    both = F.concat(F.coalesce(cfg, empty), F.coalesce(met, empty))
    return log.select("fingerprint", "phase", "family", "name", F.explode(both).alias("e")).select(
        "fingerprint", "phase", "family", "name", "e.key", "e.value")


def counts(log: DataFrame) -> DataFrame:
    return log.groupBy("phase").agg(F.count("*").alias("specs"))


def summary(log: DataFrame) -> DataFrame:
    return log.groupBy("phase").agg(F.count("*").alias("specs"), F.countDistinct("family").alias("families"))
