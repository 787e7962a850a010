import datetime as dt
import hashlib
import json

import pytest

from helpers import months
from marketgrid.sources import files, holdout, specs


def spec_rows(spark):
    rows = [("p1", "fam", 'na"me', {"a": "0.5", "b": '"x"'}, {"sharpe": 1.0}), ("p1", "fam2", "n2", {}, {"sharpe": 2.0})]
    return spark.createDataFrame(rows, "phase string, family string, name string, config map<string,string>, metrics map<string,double>")


def test_fingerprint_is_the_hash_of_the_canonical_json(spark):
    got = [r.f for r in spec_rows(spark).select(specs.fingerprint().alias("f")).collect()]
    for f, cfg, fam, name in zip(got, ({"a": 0.5, "b": "x"}, {}), ("fam", "fam2"), ('na"me', "n2")):
        text = json.dumps({"phase": "p1", "family": fam, "name": name, "config": cfg}, sort_keys=True)
        assert f == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_log_dedupes_and_skips_broken_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    specs.record(spark, spec_rows(spark), path)
    specs.record(spark, spec_rows(spark), path)
    (tmp_path / "log" / "bad.json").write_text("{not json\n\n")
    log = specs.load(spark, path)
    assert log.count() == 2
    assert {(r.key, r.value) for r in specs.flatten(log).collect()} >= {("cfg_a", "0.5"), ("sharpe", "1.0")}
    assert specs.summary(log).first().families == 2


def test_holdout_guard_and_audit(spark, tmp_path):
    layers = {"development": ("2000-01", "2000-06"), "holdout": ("2000-07", "2000-12")}
    df = spark.createDataFrame([(d,) for d in months(12)], "d date")
    assert holdout.development(df, layers).count() == 6
    with pytest.raises(holdout.SealedDataError):
        holdout.guard(df, layers=layers, strict=True)
    with pytest.raises(holdout.SealedDataError):
        holdout.guard(df.filter("d > date'2001-01-01'"), layers=layers)
    with pytest.raises(KeyError):
        holdout.layer_slice(df, "nope", layers)
    log = str(tmp_path / "audit")
    assert holdout.access_log(spark, log).count() == 0
    assert holdout.unseal(df, "holdout", "final", log, layers).count() == 6
    r = holdout.access_log(spark, log).first()
    assert (r.layer, r.reason, r.rows) == ("holdout", "final", 6)


def test_preamble_csv(spark, tmp_path):
    p = tmp_path / "curve.csv"
    p.write_text("Some text\n\nDate,BETA0,SVENY01, SVENY10\n2001-01-02,1.5,4.0,NA\n2001-01-03,NA,4.1,5.2\n")
    df = files.read_preamble_csv(spark, str(p), files.preamble_header(spark, str(p)))
    got = {(r.d, r.tenor): r.y for r in files.curve_yields(df, "SVENY").collect()}
    assert got == {(dt.date(2001, 1, 2), 1.0): 4.0, (dt.date(2001, 1, 2), 10.0): None, (dt.date(2001, 1, 3), 1.0): 4.1, (dt.date(2001, 1, 3), 10.0): 5.2}
    assert files.curve_params(df, ("BETA0",)).count() == 1


def test_wide_round_trip_turns_nan_into_null(spark, tmp_path):
    d = spark.createDataFrame([(months(1)[0], 1.0, float("nan"))], "d date, a double, b double")
    files.write_panel(d, str(tmp_path / "w"))
    got = {r.asset: r.x for r in files.read_panel(spark, str(tmp_path / "w")).collect()}
    assert got == {"a": 1.0, "b": None}


def test_year_month_stamp(spark):
    d = spark.createDataFrame([("1990.1", "1"), ("1990.01", "2"), ("1990.11", "x"), ("note", "3")], "stamp string, p string")
    got = {(r.d, r.p) for r in files.parse_year_month(d, numeric=("p",), required="p").collect()}
    assert got == {(dt.date(1990, 10, 31), 1.0), (dt.date(1990, 1, 31), 2.0)}
