"""The pipeline's stages on a small corpus against plain versions, and the registry."""

import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import fields, prose, rows  # noqa: E402
from test_models import plain_counts, quality_texts  # noqa: E402
from test_neardup import edited, plain_groups  # noqa: E402
from test_scans import plain_matches  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from marketgrid.llm import quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def corpus():
    import random

    r = random.Random(4)
    texts = [(i, t) for i, t in quality_texts() if i is not None and i not in (6, 8)]
    item = prose(700, 25)
    texts += [(200 + i, edited(prose(600, 150), i % 9, r)) for i in range(25)] + [(300 + i, prose(600, 150)) for i in range(5)]
    texts += [(400, f"{prose(401, 70)} {item} {prose(402, 30)}"), (401, f"{prose(403, 80)} password=abcdefgh99 {prose(404, 20)}"), (402, prose(405, 70) + " " + " ".join(item.split()[:9]))]
    return texts, [(1, item), (2, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    texts, items = corpus()
    spark.createDataFrame([r[:5] for r in rows(texts)], SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages_equal_plain_versions(spark, folder):
    texts, items = corpus()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "hide_secrets", "pack"]
    docs, steps = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage{k}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        steps.append(docs)
    by = dict(texts)
    good = {r.doc_id for r in quality.judged(spark.read.parquet(f"{folder}/documents.parquet")).where("kept").collect()}
    assert {r.doc_id for r in steps[0].collect()} == good
    assert all(plain_counts(by[i])[0] >= 50 for i in good) and {400, 401, 402} <= good
    one = {d for d, _, _, kept in plain_groups([(i, by[i]) for i in sorted(good)]) if kept}
    assert {r.doc_id for r in steps[1].collect()} == one and len(one) < len(good)
    clean = {r[0] for r in plain_matches([(i, by[i]) for i in sorted(one)], items) if not r[5]}
    assert {r.doc_id for r in steps[2].collect()} == clean and clean == one - {400}
    shown = {r.doc_id: r for r in steps[3].collect()}
    assert {i: r.text for i, r in shown.items()} == {i: re.sub("password=abcdefgh99", "[SECRET]", by[i]) for i in clean}
    assert all(r.n_chars == len(r.text) for r in shown.values())
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in steps[:4])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for i, r in shown.items()}
    packed = steps[4].collect()
    assert sum(r.length for r in packed) == sum(map(len, ids.values()))
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in packed)


def test_run_applies_all_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_an_empty_corpus_runs_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_each_operator_has_one_query():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables absent")
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if re.match(r"op\d+_", n)])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert fields(df, *cols) == sorted(cur.fetchall(), key=repr)
