import pytest
from pyspark.sql import functions as F

from helpers import months, panel, random_wide
from marketgrid.operators import regimes as R

U = ["universe"]
G, RE, S = R.REGIMES[:3]


def labels(spark, seq):
    return spark.createDataFrame([("u", d, s) for d, s in zip(months(len(seq)), seq)], "universe string, d date, regime string")


def test_short_run_takes_the_accepted_label(spark):
    got = [r.steady for r in R.enforce_persistence(labels(spark, [G, G, G, RE, G, G]), U).orderBy("d").collect()]
    assert got == [G] * 6
    got = [r.steady for r in R.enforce_persistence(labels(spark, [RE, G, G, G, None, S, S]), U).orderBy("d").collect()]
    assert got == [RE, G, G, G, None, G, G]  # the first run always stands, a NULL breaks runs


def test_completed_episodes(spark):
    c = R.with_completed(labels(spark, [G, G, RE, G, RE, RE, G]), U).orderBy("d").collect()
    assert [(r.run_length, r.n_completed, r.completed_months) for r in c] == [(1, 0, 0), (2, 0, 0), (1, 0, 0), (1, 1, 2), (1, 1, 1), (2, 1, 1), (1, 2, 3)]


def test_transition_rows_see_only_the_past(spark):
    lab = labels(spark, [G, G, RE, G, RE]).withColumnRenamed("regime", "label")
    d = months(5)
    p = {(r.d, r.regime): r.p for r in R.transition_rows(lab, U).collect()}
    assert p[(d[1], G)] == 1.0 and p[(d[1], RE)] == 0.0  # a history of one label
    assert p[(d[4], G)] == pytest.approx((1 + 0.5) / (2 + 2.0)) and p[(d[4], RE)] == pytest.approx((1 + 0.5) / (2 + 2.0))


def test_regime_portfolios_sum_to_one(spark):
    w = random_wide(72, 3, seed=21)
    ex = panel(spark, w)
    seq = ([G] * 9 + [RE] * 9) * 4
    lab = labels(spark, seq).withColumnRenamed("regime", "label")
    bench = ex.select("universe", "asset").distinct().withColumn("w", F.lit(1 / 3))
    due = (F.col("rn") >= 30) & (F.col("rn") % 10 == 0)
    for df, keys in ((R.regime_weights(ex, lab, U), ["regime"]), (R.hard_switch(ex, lab, U, due), ["d"]), (R.regime_blend(ex, lab, U, due), ["d"]),
                     (R.episodic_weights(ex, lab, bench, U, due), ["d"])):
        sums = [r.s for r in df.groupBy(*keys).agg(F.sum("w").alias("s")).collect()]
        assert sums and sums == pytest.approx([1.0] * len(sums))


def test_episodic_action_ladder(spark):
    w = random_wide(60, 3, seed=22)
    ex = panel(spark, w)
    lab = labels(spark, [G] * 15 + [RE] * 3 + [G] * 12 + [RE] * 30).withColumnRenamed("regime", "label")
    bench = ex.select("universe", "asset").distinct().withColumn("w", F.lit(1 / 3))
    got = {r.d: r for r in R.episodic_weights(ex, lab, bench, U, F.col("rn").isin(10, 20, 40), min_months=12).filter("asset = 'a0'").collect()}
    d = list(w.index)
    assert got[d[10]].action == "benchmark" and got[d[10]].w == pytest.approx(1 / 3)
    assert got[d[20]].action == "regime" and got[d[20]].alpha == pytest.approx(1 - 0.5**2)
    assert got[d[40]].action == "benchmark_thin" and got[d[40]].alpha == 0.0
