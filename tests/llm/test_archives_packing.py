"""WARC bundles and packing: round trips, formats and bounds."""

import random
import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import zstandard
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import docs, fields, prose  # noqa: E402

from marketgrid.llm import packing, warc  # noqa: E402

PAGES = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y", "<p>é</p>"), (3, None, None), (4, "http://b", ""), (5, "http://c d\r\nX: y", prose(1, 20000)), (6, "http://c", "one"), (6, "http://c", "one"), (7, "u", "WARC/1.1\r\n\r\n"), (None, "u", "one"), (None, "u", "null only"), (None, "u", "null only")]


def want(pages):
    out = []
    for i, _, html in pages:
        p = (html or "").encode()
        ids = [j for j, _, h in pages if (h or "").encode() == p and j is not None]
        again = bool(ids) and max(ids) != i
        out.append((None if i is None else str(i), len(p), warc.payload_digest(p), "revisit" if again else "response", str(max(ids)) if again else None))
    return sorted(out, key=repr)


def test_records_come_back_from_frames(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, key string, top string")
    for size in (warc.FRAME_BYTES, 300):
        base, index = warc.write(spark, pages, str(tmp_path / str(size)), frame_bytes=size, file_bytes=900)
        got = warc.read(base, index)
        assert fields(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want(PAGES)
        assert {r.html for r in got.collect() if r.record_type == "response"} == {p[2] or "" for p in PAGES}


def test_files_are_plain_zstandard_with_a_seek_table(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", prose(i, 200)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    base, index = warc.write(spark, pages, str(tmp_path / "a"), frame_bytes=5000)
    files = list((tmp_path / "a").iterdir())
    raw = files[0].read_bytes()
    assert sum(f.stat().st_size for f in files) > 0 and {r.file for r in index.collect()} == {f.name for f in files}
    count, flags, magic = struct.unpack("<IBI", raw[-9:])
    assert magic == 0x8F92EAB1 and flags == 0 and struct.unpack("<I", raw[-17 - 8 * count : -13 - 8 * count])[0] == 0x184D2A5E
    with files[0].open("rb") as f:
        table = warc.read_seek_table(f)
    assert len(table) == count > 3
    whole = b"".join(zstandard.ZstdDecompressor().decompress(raw[a : a + n], max_output_size=m) for a, n, m in table)
    at, seen = 0, 0
    while at < len(whole):
        fields_, _, payload, at = warc.parse(whole, at)
        assert fields_["WARC-Payload-Digest"] == "sha1:" + warc.payload_digest(payload)
        seen += 1
    assert seen == index.where(index.file == files[0].name).count()


def test_no_pages_no_files(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    base, index = warc.write(spark, none, str(tmp_path / "none"))
    assert warc.read(base, index).count() == 0


def test_small_payloads_are_all_responses(spark):
    rows = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    kinds = {(r.page_id, r.html): r.record_type for r in warc.roles(rows, min_bytes=5).collect()}
    assert kinds[("3", "")] == kinds[("4", "")] == "response" and kinds[("1", "<p>é</p>")] == "revisit"


TEXTS = [(1, "Hello   world\n\n  it's  a test — naïve café 日本語 😀"), (2, None), (3, ""), (4, " "), (5, prose(1, 6000)), (6, "x" * 5000), (7, "<|endoftext|> is text"), (8, "\t\r\n    x"), (8, "same id"), (8, "same id"), (None, "no id"), *((i, prose(i, random.Random(i).randint(1, 300))) for i in range(20, 120))]


def test_rank_file_and_tokenizer_give_the_same_ids():
    a, b = (packing.encoder(public_tokenizers.path(n)) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
    r = random.Random(1)
    pieces = ["the", " and", "  ", "\n", "\t", "'ll", "'S", "é", "ß", "123", "日本", "😀", "!!", "…", " ", " ", "\x1c", "\x85", "á", "_", "²", "٣", "ǅ", "\x00"]
    for text in [t or "" for _, t in TEXTS] + ["".join(r.choice(pieces) for _ in range(r.randint(1, 30))) for _ in range(3000)]:
        assert a(text) == b(text), repr(text)


def test_pieces_cover_each_document_once_and_fill_windows(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = packing.pack(docs(spark, TEXTS), path).collect()
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in TEXTS]
    pieces = sorted(repr((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)) for r in rows)
    cuts = []
    for i, x in ids:
        whole = len(x) // 2048 * 2048
        for a, b in [(a, a + 2048) for a in range(0, whole, 2048)] + [(a, min(a + 256, len(x))) for a in range(whole, len(x), 256)]:
            cuts.append(repr((i, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes()), len(x))))
    assert pieces == sorted(cuts)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert w[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(w, w[1:], strict=False)) and sum(n for _, n in w) <= 2048


def test_differencing_balances_and_counts_rise_with_capacity():
    r = random.Random(2)
    for n, k in ((1, 3), (7, 3), (200, 16), (2048, 100)):
        sizes = [r.randint(1, 256) for _ in range(n)]
        bins = packing.difference(sizes, min(k, n))
        assert sorted(i for b in bins for i in b) == list(range(n)) and len(bins) <= k
        sums = [sum(sizes[i] for i in b) for b in bins]
        if n > 5 * k:
            assert max(sums) - min(sums) <= 4
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in b) for b in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    sizes = [r.randint(1, 256) for _ in range(2048)]
    bins = packing.windows(sizes)
    assert max(sum(sizes[i] for i in b) for b in bins) <= 2048 and sum(sizes) / (2048 * len(bins)) > 0.985
    assert len(packing.windows([1500] * 5)) == 5 and packing.windows([]) == [] and packing.windows([5]) == [[0]]


def test_no_documents(spark):
    assert packing.pack(docs(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0
