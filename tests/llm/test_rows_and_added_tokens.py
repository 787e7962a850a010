"""One row of each near-duplicate group also where doc_ids are missing or shared; added tokens of the tokenizer."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import docs, prose  # noqa: E402

import corpus_pipeline  # noqa: E402
from marketgrid.llm import packing, queries  # noqa: E402

TEXTS = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "x <|endoftext|>\n y", "<|endoftext", "é<|endoftext|>日本", "plain", "", None]


def want(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_query_and_stage_equal_the_unmodified_tokenizer(spark, tmp_path):
    table = docs(spark, list(enumerate(TEXTS)))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (queries.op5_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, table, str(tmp_path))):
        assert [(r.doc_id, r.doc_tokens, r.ids_crc32) for r in sorted(got.collect())] == [(i, len(x), crc(x)) for i, x in enumerate(want(TEXTS))]


def test_random_texts_with_added_tokens_encode_alike():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encode = packing.with_added(packing.encoder(path), packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    r, pieces = random.Random(2), ["<|endoftext|>", "<|", "endoftext", "|>", " the", "  ", "\n", "'ll", "é", "12"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 20))) for _ in range(2000)]
    assert [[*encode(x), 1] for x in texts] == want(texts)


def test_each_group_keeps_a_row_whatever_its_doc_ids(spark):
    a, b, c, d = (prose(i, 60) for i in range(900, 904))
    rows = [(None, a), (None, a), (None, a + " more"), (5, b), (5, c), (4, c), (5, c + " more"), (None, d), (9, d + " more"), (None, None), (7, ""), (7, " ")]
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()), key=repr)
    own = [x for x in left if x[0] is None and x[1]]
    assert len(own) == 1 and own[0][1] in (a, a + " more")
    assert sorted((x for x in left if x not in own), key=repr) == sorted([(5, b), (4, c), (9, d + " more"), (None, None), (7, ""), (7, " ")], key=repr)
