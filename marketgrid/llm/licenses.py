"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

Words are runs of letters and digits in lower case, shingles are five words. Templates with at least 11 shingles
are cut into windows of eight shingles at every place; texts into the same at every fourth. A text window inside
an unchanged copy equals a template window, so all BANDS minima agree; with edits a window pair of similarity s
agrees in one with a chance of 1 - (1 - s) ** BANDS, and a copy holds several windows. Shorter templates use
windows of one shingle against the minima of the whole template, SHORT_BANDS of them: a text with a share c of
the template's shingles misses all with a chance of about (1 - c) ** SHORT_BANDS, 2e-5 at 0.75. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, WINDOW, STEP, BANDS, SHORT_BANDS, PERCENT, MAX_SHINGLES = 5, 8, 4, 4, 8, 75, 50_000
# fixed values: public license notices
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
}
#: a shingle hash is random, so the hash nearest to a seed by exclusive or is a random member of a set
SEEDS = tuple((i * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % (1 << 64) - (1 << 63) for i in range(1, SHORT_BANDS + 1))


def shingled(df: DataFrame, text: str, out: str) -> DataFrame:
    """An array column of the shingle hashes in order; fewer words than a shingle has make one shingle."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")
    w = f"_{out}_words"
    full = F.transform(F.slice(w, 1, F.greatest(F.size(w) - WORDS + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WORDS))))
    return df.withColumn(w, words).withColumn(out, F.when(F.size(w) >= WORDS, full).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.expr("cast(array() as array<long>)"))).drop(w)


def _minima(near: str) -> Column:
    """The least value of each window of an array column."""
    starts = F.when(F.size(near) >= WINDOW, F.sequence(F.lit(1), F.size(near) - WINDOW + 1, F.lit(STEP))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda k: F.array_min(F.slice(near, k, WINDOW)))


def _library(docs: DataFrame, templates: dict[str, str]) -> list[tuple[str, list[int], list[list[int]], list[int]]]:
    """(name, shingles, window minima of each band, short minima); hashed by Spark so both sides agree."""
    rows = shingled(docs.sparkSession.createDataFrame(sorted(templates.items()), "name string, text string"), "text", "h").collect()
    if sum(len(r["h"]) for r in rows) > MAX_SHINGLES:
        raise ValueError(f"the templates hold more than {MAX_SHINGLES} shingles; scan with parts of them")
    out = []
    for r in rows:
        h, long = r["h"], len(r["h"]) >= WINDOW + STEP - 1
        out.append((r["name"], sorted(set(h)), [sorted({min(x ^ s for x in h[k : k + WINDOW]) for k in range(len(h) - WINDOW + 1)}) if long else [] for s in SEEDS[:BANDS]], [] if long else sorted({min(h, key=lambda x: x ^ s) for s in SEEDS})))  # noqa: B023
    return out


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values)) if values else F.expr("cast(array() as array<long>)")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, n_candidates, licenses) of each whole text: the templates of whose shingles it holds ``percent``.

    licenses: their names in order, comma-joined. n_candidates: templates that some band retrieved. Null and
    wordless texts hold none; a template without words matches nothing. Repeated rows are answered each; an empty
    table gives an empty table; other columns are ignored. All work on a text stays in its row: nothing is shuffled,
    and the library, whose size is checked, is part of the plan.
    """
    library = [t for t in _library(docs, templates) if t[1]]
    held = shingled(docs.select("doc_id", "text"), "text", "h").drop("text")
    got = held
    for i, seed in enumerate(SEEDS[:BANDS]):
        near = got.withColumn("_x", F.transform("h", lambda x: x.bitwiseXOR(F.lit(seed))))  # noqa: B023
        got = near.withColumn(f"_b{i}", F.array_intersect(_minima("_x"), _longs(sorted({k for t in library for k in t[2][i]})))).drop("_x")
    got = got.withColumn("_s", F.array_intersect("h", _longs(sorted({k for t in library for k in t[3]}))))
    found, names = [], []
    for name, shingles, bands, short in library:
        keys = [("_s", short)] if short else [(f"_b{i}", k) for i, k in enumerate(bands)]
        found.append(reduce(or_, (F.coalesce(F.arrays_overlap(c, _longs(k)), F.lit(False)) for c, k in keys)))
        names.append(F.when(found[-1] & (F.size(F.array_intersect(_longs(shingles), "h")) * 100 >= percent * len(shingles)), name))
    count = sum((f.cast("long") for f in found), F.lit(0).cast("long"))
    any_hit = reduce(or_, (F.size(c) > 0 for c in ("_s", *(f"_b{i}" for i in range(BANDS)))))
    return got.select(
        "doc_id", F.size("h").cast("long").alias("n_shingles"), F.when(any_hit, count).otherwise(F.lit(0).cast("long")).alias("n_candidates"), F.when(any_hit, F.array_join(F.array(*names), ",")).otherwise("").alias("licenses")
    )
