"""Distribution functions against independent formulas."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from marketgrid.functions import normal as N


def test_normal_functions(spark):
    xs = [-38.0, -9.0, -3.2, -1.0, -1e-9, 0.0, 0.3, 1.96, 5.0, 8.0, 40.0, None]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", N.norm_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        assert r.p is None if r.x is None else r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1e-12)
    ps = [1e-300, 1e-15, 1e-6, 0.01, 0.07, 0.075, 0.2, 0.5, 0.9, 0.975, 1 - 1e-12, 0.0, 1.0, -1.0, None]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", N.norm_ppf(F.col("p")).alias("z")).collect():
        if r.p is None or not 0 < r.p < 1:
            assert r.z is None
        else:
            assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-9, abs=1e-12)


def test_student_functions(spark):
    closed = {1: lambda t: 0.5 - math.atan(t) / math.pi, 2: lambda t: 0.5 - t / (2 * math.sqrt(2 + t * t)), 4: lambda t: 0.5 - 0.375 * (t / math.sqrt(1 + t * t / 4)) * (1 - t * t / (12 * (1 + t * t / 4)))}
    rows = [(float(df), t) for df in closed for t in (-3.0, -0.5, 0.0, 1.0, 2.5, 12.0)]
    for r in spark.createDataFrame(rows, "df double, t double").select("*", N.t_sf(F.col("t"), F.col("df")).alias("p")).collect():
        assert r.p == pytest.approx(closed[int(r.df)](r.t), abs=1e-10)
    want = {1.0: 12.706204736, 2.0: 4.302652730, 10.0: 2.228138852, 81.0: 1.989686323, 1000.0: 1.962339081}  # tables
    for r in spark.createDataFrame([(d,) for d in want], "df double").select("df", N.t_ppf(F.lit(0.975), F.col("df")).alias("t")).collect():
        assert r.t == pytest.approx(want[r.df], abs=1e-6)
