"""Fill-in-middle against a plain version: forms, cuts, exact round trips, awkward rows."""

import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from marketgrid.llm import infill
from marketgrid.llm.common import flat, pieces, string_array

from fixtures import docs, prose


def plain(doc_id, text, rate=90, spm=20, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)], len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = [None, "", "a", "é", "𝄞x𝄞", "<P", "<P><S>", "a<M>b", "<<S", "<M", ">", "P>", "S>\x00<", "<P<S<M", "line\nline\r\n", prose(1, 40000), "ñ🙂" * 70000, "<" * 999, "x" * 5]


def test_rows_are_those_of_the_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "abc def"), (None, None), (3, "é"), (-7, "same"), (-7, "same"), (2**62, "long id")]
    got = infill.restore(infill.transform(docs(spark, rows).repartition(3)))
    assert got.columns[:2] == ["doc_id", "text"] and {"row", "w"} < set(got.columns)
    found = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got.collect()), key=repr)
    want = sorted(((i, t, *plain(i, t), t or "") for i, t in rows), key=repr)
    assert found == want
    assert {r[3] for r in found} == {"plain", "psm", "spm"}


def test_rates_seed_and_clashing_names(spark):
    df = spark.createDataFrame([(i, "some text", "x", "y", 1) for i in range(50)], "doc_id long, text string, FORM string, output string, draw int")
    got = infill.transform(df, rate=100, spm=100, seed=9).collect()
    assert {(r.doc_id, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got} == {(i, *plain(i, "some text", 100, 100, 9)[1:]) for i in range(50)}
    assert {r.draw for r in got} == {1}
    assert {r.form for r in infill.transform(df, rate=0).collect()} == {"plain"}
    assert infill.restore(infill.transform(df.limit(0))).collect() == []


def test_outputs_without_their_marks_stay_unrestored(spark):
    rows = [("psm", "<P>a<S>b<M>c", "acb"), ("spm", "<S>b<P>a<M>c", "acb"), ("psm", "<S>b<P>a<M>c", "acb"), ("psm", "<P>a<M>b<S>c", None), ("psm", "x<P>a<S>b<M>c", None),
            ("psm", "<P>a<S>b", None), ("plain", "<P>a<S>b<M>c", "<P>a<S>b<M>c"), (None, "q", "q"), ("psm", None, None), ("plain", "", ""), ("psm", "<P><S><M>", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, form string, output string, want string").coalesce(1)
    assert [(r.i, r.restored) for r in infill.restore(df).collect() if r.restored != r.want] == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="<>PSMaé🙂\x00", max_size=30), max_size=12), st.integers(1, 9), st.integers(0, 2**31))
def test_any_block_size_gives_the_same_bytes(texts, block, seed):
    data, off = flat(pa.array(texts, pa.string()))
    draws = np.random.default_rng(seed).integers(0, 2**32, (4, len(texts)))
    got = infill.cut(data, off, draws, block=block)
    out, out_off = infill.scatter(data, off, got["form"], got["first"], got["second"], block)
    outputs = string_array(out, out_off).to_pylist()
    for i, t in enumerate(texts):
        a, b = sorted(int(draws[k][i]) % (len(t) + 1) for k in (0, 1))
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or draws[2][i] % 100 >= 90 else "spm" if draws[3][i] % 100 < 20 else "psm"
        assert got["n"][i] == len(t) and infill.FORMS[got["form"][i]] == form
        want = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        assert outputs[i] == want
    text, start, good = infill.gather(out, out_off, got["form"] > 0, block)
    assert good.all() and string_array(text, start).to_pylist() == texts


def test_pieces_bound_the_bytes_and_keep_all_rows():
    column = pa.array(["a" * (i % 7) if i % 5 else None for i in range(100)] + ["b" * 500] + ["c"] * 3).slice(2)
    batch = pa.RecordBatch.from_arrays([column], ["t"])
    parts = list(pieces(batch, "t", 20))
    assert sum((p.column("t").to_pylist() for p in parts), []) == column.to_pylist()
    assert all(sum(len(t or "") for t in p.column("t").to_pylist()) <= 26 or p.num_rows < 12 for p in parts)
    for p in parts:
        data, off = flat(p.column("t"))
        assert string_array(data, off).to_pylist() == [t or "" for t in p.column("t").to_pylist()]
