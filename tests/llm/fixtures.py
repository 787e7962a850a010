"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, text_key string, node string, hits string, w string, rid string, base string, kept_id string"
WORDS = ["".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(3 + i % 6)) for i in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows(texts):
    return [(i, t, "en", "s", len(t or ""), *["x"] * 8) for i, t in texts]


def docs(spark, texts):
    """Documents of (doc_id, text) pairs with extra columns whose names clash with working names."""
    return spark.createDataFrame(rows(texts), SCHEMA)


def fields(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
