"""Near-duplicate groups of documents: SuperMinHash signatures, banding, exact verification, star contraction.

A document is its set of distinct five-word shingles (ASCII letters in lower case; words are separated by
ASCII white space). Two documents are linked at a Jaccard similarity of 0.75 or more, counted on the full
sets; groups are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, free_name, mix, octets, stored
from .components import components

WORDS, BANDS, ROWS, PERCENT = 5, 30, 4, 75
SKETCH = 16  # longs of a parity sketch
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GOLDEN = np.uint64(0xD1B54A32D192ED03)
_STEP = 100_000  # words whose bytes are hashed at a time
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than a shingle has make one shingle."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    span = min(words, len(tokens))
    found = []
    for at in range(0, len(tokens) - span + 1, _STEP):
        joined = np.frombuffer(b" ".join(tokens[at : at + _STEP + span - 1]), np.uint8)
        power, inverse = _powers(len(joined) + 1)
        total = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[: len(joined)], out=total[1:])
        gaps = np.flatnonzero(joined == 32)
        starts = np.concatenate([[0], gaps + 1])
        ends = np.concatenate([gaps, [len(joined)]])[span - 1 :]
        starts = starts[: len(ends)]
        found.append(mix(mix((total[ends] - total[starts]) * inverse[starts]) + (ends - starts).astype(np.uint64)))
    return np.unique(np.concatenate(found))


def superminhash(elements: np.ndarray, size: int) -> np.ndarray:
    """Signature registers of a set of 64-bit hashes.

    At level j each element draws the next place of its own random permutation of the registers and a rank
    in [j, j + 1). All elements advance level by level; once every register holds a rank below j + 1 no later
    level can lower one, so the loop stops after about size * ln(size) / elements levels.
    """
    registers = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    if not len(elements):
        return registers
    places = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.int32), (len(elements), 1))
    rows = np.arange(len(elements))
    for level in range(size):
        draw = mix(elements + np.uint64(int(_GOLDEN) * (level + 1) % (1 << 64)))
        other = level + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(size - level)).astype(np.int64)
        place = places[rows, other]
        places[rows, other] = places[:, level]
        np.minimum.at(registers, place, (np.uint64(level) << np.uint64(56)) | ((draw >> np.uint64(32)) << np.uint64(24)) | (elements & np.uint64(0xFFFFFF)))
        if registers.max() < (np.uint64(level + 1) << np.uint64(56)):
            break
    return registers


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN)
    for column in registers.reshape(bands, rows).T:
        keys = mix(keys * _BASE ^ column)
    return keys.view(np.int64)


def _signatures(words: int, bands: int, rows: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            sizes, keys = [], []
            for text in octets(batch.column("text")):
                found = shingle_set(text, words)
                sizes.append(len(found))
                keys.append(band_keys(superminhash(found, bands * rows), bands, rows) if len(found) else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate([*keys, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "key", "n_shingles", "bands"])

    return run


def odd_sketch(elements: np.ndarray) -> np.ndarray:
    """SKETCH longs whose bits are the parities of the counts in as many hash classes.

    Each element of the symmetric difference of two sets flips one bit, so the sketches of the sets differ in at
    most that many bits: a difference of more bits than a link allows rules the link out, without error.
    """
    counts = np.bincount((elements >> np.uint64(20)).astype(np.int64) & (SKETCH * 64 - 1), minlength=SKETCH * 64)
    return np.packbits(counts & 1).view(np.int64)


def _sets(words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            found = [shingle_set(t, words) for t in octets(batch.column("text"))]
            flat = np.concatenate([*(odd_sketch(x) for x in found), np.empty(0, np.int64)])
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * SKETCH), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in found], pa.binary()), sketches], ["node", "items", "sketch"])

    return run


def _overlaps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        shared, union = [], []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            n = int((both[1:] == both[:-1]).sum())
            shared.append(n)
            union.append(len(both) - n)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], ["u", "v", "shared", "total"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; each end joins on its own key, which AQE can split."""
    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u")
    both = one.join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v").select("u", "v", "a", "b")
    counted = both.mapInArrow(_overlaps, "u long, v long, shared long, total long")
    return counted.where(F.col("shared") * 100 >= F.col("total") * percent).select("u", "v")


def _classes(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_shingles) of each row, and (key, node, low, comp) of each class of equal texts with words; see `near_duplicates`."""
    texts = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("key"))
    signed = stored(texts.mapInArrow(_signatures(words, bands, rows), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, n_shingles long, bands array<long>"))
    classes = stored(
        signed.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id())
    )
    placed = classes.select("node", "n", F.explode("bands").alias("b"))
    order = F.col("node").bitwiseXOR(F.col("b"))  # another order of the classes in each bucket
    # aggregates that are joined back by their key are written first, so that AQE can split a hot key of the join
    shared = stored(placed.groupBy("b").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).where("lo < hi").select("b", F.col("lo").bitwiseXOR(F.col("b")).alias("lead")))
    members = stored(placed.join(shared, "b"))

    wanted = classes.select("node", "key").join(members.select("node").distinct(), "node")
    found = texts.select("key", "text").join(wanted, "key").groupBy("node").agg(F.first("text").alias("text"))
    sets = stored(found.mapInArrow(_sets(words), "node long, items binary, sketch array<long>"))
    first = stored(members.where("node <> lead").select(F.least("lead", "node").alias("u"), F.greatest("lead", "node").alias("v")).distinct())
    links = stored(_verified(first, sets, percent))
    groups = stored(components(links))

    grouped = members.join(groups, "node", "left").select("b", "node", "n", F.coalesce("comp", "node").alias("comp"))
    open_ = stored(grouped.groupBy("b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("b"))
    rest = stored(grouped.join(open_, "b").join(sets.select("node", "sketch"), "node"))
    if rest.limit(1).count():
        other = rest.select("b", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "comp", "sketch")))
        apart = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch2")[i])) for i in range(SKETCH)), F.lit(0))
        near = (F.col("n") + F.col("n2")) * (100 - percent) >= apart * (100 + percent)
        pairs = rest.join(other, "b").where((F.col("comp") < F.col("comp2")) & near).select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v")).distinct()
        more = stored(_verified(pairs.join(first, ["u", "v"], "left_anti"), sets, percent))
        if more.limit(1).count():
            groups = stored(components(groups.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(more)))

    joined = classes.select("key", "node", "low").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return signed.select("doc_id", "key", "n_shingles"), joined

def near_duplicates(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs(doc_id, text)``.

    Equal texts fold into one class before anything else, so copies never meet in a bucket. A pair at
    exactly the threshold misses all bands with a chance of (1 - 0.75**rows)**bands, 1e-5 here. In a bucket
    each class is first compared with one leader; only where classes of different groups still share a bucket
    are these compared, across groups. Of those pairs a parity sketch rules out nearly all that can't be links,
    by a bound that never errs, so few rows are made and no candidate link is skipped.

    Null and wordless texts have an empty set and are alone; their component_id is their own doc_id. Repeated
    rows are copies of each other. A null doc_id takes part by its text and is never the smallest id; a class of
    nothing else has a null component_id and isn't kept. Columns other than doc_id and text are ignored.
    """
    signed, joined = _classes(docs, words, bands, rows, percent)
    lowest = stored(joined.groupBy("comp").agg(F.min("low").alias("component_id")))
    named = joined.join(lowest, "comp").select("key", "component_id")
    out = signed.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, unnamed: bool = False, **options) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns: that with the group's smallest doc_id.

    Rows are told apart by doc_id and text, so groups that share a doc_id keep a row each; of equal rows any one
    stays. A row without a doc_id comes last in its group; a group of nothing else keeps one row if ``unnamed``, and
    goes if not. Rows without words are alone, and each of them stays (without a doc_id: if ``unnamed``).
    """
    name, key = free_name(docs, "kept_id"), free_name(docs, "kept_key")
    _, classes = _classes(docs, **options)
    first = classes.groupBy("comp").agg(F.min(F.struct(F.col("low").isNull().alias("last"), "low", "key")).alias("one")).select(F.col("one.low").alias(name), F.col("one.key").alias(key))
    if not unnamed:
        docs, first = docs.where("doc_id is not null"), first.where(F.col(name).isNotNull())
    worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    keyed = docs.where(worded).withColumn(key, F.unhex(F.md5("text")))
    kept = keyed.join(first, keyed["doc_id"].eqNullSafe(first[name]) & (keyed[key] == first[key]), "left_semi").dropDuplicates(["doc_id", key])
    return kept.drop(key).union(docs.where(~worded))
