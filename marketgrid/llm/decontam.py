"""Benchmark decontamination with a positional inverted index of the training documents.

The index is partitioned by document: each row holds a document's postings (term -> positions) for the terms
of the test items, so a term that occurs in every document never meets in one task and no posting is shuffled. It is
written once for all test items; these then go over it in blocks, so the texts are read once however many there are.
Term frequencies over the whole index give the rarest terms. A phrase is found by intersecting offset-adjusted
posting lists, rarest term first; a proximity match needs the rarest distinct terms of an item close together
in any order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, octets, stored

WINDOW, NEAR_TERMS, NEAR_SPAN = 10, 4, 20
BLOCK_BYTES = 4_000_000  # of test text that is broadcast at a time
VOCABULARY_BYTES = 64_000_000  # of distinct test terms in one index; more make another
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STATE = "hits array<struct<start:long,stop:long>>, items array<string>, near array<string>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_NAMES, _INTS = pa.list_(pa.string()), pa.list_(pa.int32())


def words(text: bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters in lower case, and bytes of other characters."""
    return text.translate(_FOLD).split() if text else []


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list[tuple[str | None, list[bytes]]], bool]]:
    """(items, whether it is the last) in blocks of about ``limit`` bytes; the driver holds two blocks at most."""
    block, size, ready = [], 0, None
    for row in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        found = words(row[1].encode())
        if not found:
            continue
        if block and size + len(row[1]) > limit:
            if ready:
                yield ready, False
            ready, block, size = block, [], 0
        block.append((row[0], found))
        size += len(row[1])
    if ready:
        yield ready, not block
    if block or not ready:
        yield block, True


def _postings(shared, carried: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(shared.value)}
        for batch in batches(it):
            sizes, terms, counts, places = [], [], [], []
            for text in octets(batch.column("text")):
                ids = np.array([known.get(w, -1) for w in words(text)], np.int32)
                order = np.argsort(ids, kind="stable").astype(np.int32)
                order = order[np.searchsorted(ids[order], 0) :]
                term, count = np.unique(ids[order], return_counts=True)
                sizes.append(len(ids))
                terms.append(term)
                counts.append(count.astype(np.int32))
                places.append(order)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(sizes, pa.int64()), pa.array(terms, _INTS), pa.array(counts, _INTS), pa.array(places, _INTS)], [*carried, "n_words", "terms", "counts", "places"])

    return run


def _plan(items: list, vocabulary: dict[bytes, int], seen: dict[int, int], window: int, near_terms: int) -> dict:
    """Distinct windows as (term, offset) lists, rarest first, by their rarest term; likewise the items' rarest terms."""
    rarity = lambda w: (seen.get(vocabulary[w], 0), w)
    owners: dict[tuple, set] = defaultdict(set)
    near: dict[int, list] = defaultdict(list)
    for number, (_, found) in enumerate(items):
        span = min(window, len(found))
        for i in range(len(found) - span + 1):
            owners[tuple(found[i : i + span])].add(number)
        rarest = [vocabulary[w] for w in sorted(set(found), key=rarity)[:near_terms]]
        if all(seen.get(t) for t in rarest):
            near[rarest[0]].append((number, rarest))
    phrases: dict[int, list] = defaultdict(list)
    for gram, numbers in owners.items():
        steps = [(vocabulary[gram[o]], o) for o in sorted(range(len(gram)), key=lambda o: (*rarity(gram[o]), o))]
        if seen.get(steps[0][0]):
            phrases[steps[0][0]].append((steps, sorted(numbers)))
    return {"names": [n for n, _ in items], "phrases": dict(phrases), "near": dict(near)}


def _starts(lists: dict[int, np.ndarray], steps: list[tuple[int, int]]) -> np.ndarray | None:
    """Where a phrase starts: the posting lists, each less the term's offset, intersected from the rarest on."""
    at = None
    for term, offset in steps:
        found = lists.get(term)
        if found is None:
            return None
        if at is None:
            at = found - offset
            at = at[at >= 0]
        else:
            spot = np.searchsorted(found, at + offset)
            spot[spot == len(found)] = 0
            at = at[found[spot] == at + offset]
        if not len(at):
            return None
    return at


def _close(lists: dict[int, np.ndarray], terms: list[int], span: int) -> bool:
    """Whether some ``span`` words hold every term."""
    if not all(t in lists for t in terms):
        return False
    begins = np.concatenate([lists[t] for t in terms])
    last = begins.copy()
    for t in terms:
        spot = np.searchsorted(lists[t], begins)
        last = np.maximum(last, np.append(lists[t], np.iinfo(np.int32).max)[spot])
    return bool((last.astype(np.int64) - begins < span).any())


def _merged(runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Overlapping and touching runs as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "stop": b} for a, b in out]


def _search(shared, window: int, span: int, carried: list[str], sparse: bool):
    """What the block's items have in each document: hits, items, near; with `sparse` only documents that have something."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        names, phrases, near = plan["names"], plan["phrases"], plan["near"]
        for batch in batches(it):
            column = lambda c: batch.column(c)  # noqa: B023, E731
            flat = [column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "counts", "places")]
            ends = [np.concatenate([[0], np.cumsum(column(c).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64) for c in ("terms", "places")]
            hits, items, close = ([[] for _ in range(batch.num_rows)] for _ in range(3))
            for i in range(batch.num_rows):
                terms, counts = (f[ends[0][i] : ends[0][i + 1]] for f in flat[:2])
                if not len(terms):
                    continue
                cuts = np.concatenate([[0], np.cumsum(counts)])
                places = flat[2][ends[1][i] : ends[1][i + 1]]
                lists = {int(t): places[a:b] for t, a, b in zip(terms, cuts[:-1], cuts[1:], strict=True)}
                got, numbers, nearby = [], set(), set()
                for t in lists:
                    for steps, owner in phrases.get(t, ()):
                        if (at := _starts(lists, steps)) is not None:
                            got += [(int(s), int(s) + len(steps)) for s in at]
                            numbers.update(owner)
                    for number, rarest in near.get(t, ()):
                        if _close(lists, rarest, span):
                            nearby.add(number)
                hits[i] = _merged(got)
                items[i] = sorted({names[n] for n in numbers if names[n] is not None})
                close[i] = sorted({names[n] for n in nearby if names[n] is not None})
            out = pa.RecordBatch.from_arrays([*(column(c) for c in carried), pa.array(hits, _RUNS), pa.array(items, _NAMES), pa.array(close, _NAMES)], [*carried, "hits", "items", "near"])
            yield out.filter(pa.array([bool(h or n) for h, n in zip(hits, close, strict=True)], pa.bool_())) if sparse else out

    return run


def _gathered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finds of several blocks for one document as one."""
    for batch in it:
        hits = [_merged([(h["start"], h["stop"]) for part in row for h in part]) for row in batch.column("hits").to_pylist()]
        names = [[sorted({n for part in row for n in part}) for row in batch.column(c).to_pylist()] for c in ("items", "near")]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(hits, _RUNS), *(pa.array(n, _NAMES) for n in names)], ["rid", "hits", "items", "near"])


def _vocabularies(benchmark: DataFrame, block_bytes: int, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """(blocks, their distinct terms) of the test items; a vocabulary closes when it passes `limit` bytes."""
    held, size, blocks = set(), 0, 0
    for items, last in _blocks(benchmark, block_bytes):
        new = {w for _, found in items for w in found} - held
        held |= new
        size, blocks = size + sum(map(len, new)), blocks + 1
        if size > limit or last:
            yield blocks, sorted(held)
            held, size, blocks = set(), 0, 0


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near_terms: int = NEAR_TERMS, near_span: int = NEAR_SPAN, block_bytes: int = BLOCK_BYTES, first: str = "doc_id",
            vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """(doc_id, n_words, hits, items, near) for each row of ``docs(doc_id, text)`` against ``benchmark(item_id, text)``.

    hits: runs [start, stop) of words that lie inside occurrences of item windows of ``window`` words (a shorter
    item is one window); items: the ids of those items; near: ids of items whose ``near_terms`` rarest distinct
    terms occur within ``near_span`` words. Rarity is the number of documents with the term, then its bytes.

    The documents are indexed once for all items (once for every VOCABULARY_BYTES of distinct test terms). Items then
    go out in blocks of bounded size, each over the whole index; what more than one block finds meets by document.
    Null and wordless texts have no words and no hits; items of that kind match nothing; an item with a null id marks
    words but isn't listed; equal ids count once. Repeated rows are answered each; an empty table on either side gives
    no hits. Other columns are ignored; ``first`` names the one to carry along in place of doc_id.
    """
    kind = docs.schema[first].dataType.simpleString()
    lists = "terms array<int>, counts array<int>, places array<int>"
    context = spark.sparkContext
    items, only = next(_blocks(benchmark, block_bytes))

    def indexed(rows: DataFrame, terms: list[bytes], carried: list[str]) -> DataFrame:
        fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
        return stored(rows.mapInArrow(_postings(context.broadcast(terms), carried), f"{fields}, n_words long, {lists}"))

    def planned(terms: list[bytes], seen: dict[int, int], block: list):
        return context.broadcast(_plan(block, {w: i for i, w in enumerate(terms)}, seen, window, near_terms))

    def counted(index: DataFrame) -> dict[int, int]:
        return {r[0]: r[1] for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # a row for each test term

    if only:
        terms = sorted({w for _, found in items for w in found})
        index = indexed(docs.select(first, "text"), terms, [first])
        return index.mapInArrow(_search(planned(terms, counted(index), items), window, near_span, [first, "n_words"], False), f"{first} {kind}, n_words long, {_STATE}")
    groups = list(_vocabularies(benchmark, block_bytes, vocabulary_bytes))
    rows, finds, base = docs.select(first, "text", F.monotonically_increasing_id().alias("rid")), [], None
    blocks = _blocks(benchmark, block_bytes)
    for number, (count, terms) in enumerate(groups):
        keep = [first, "rid", *(["text"] if len(groups) > 1 else [])]
        index = indexed(rows, terms, keep if number == 0 else ["rid"])
        if number == 0:
            base, rows = index, index  # later vocabularies read the written rows, whose numbers stand
        seen = counted(index)
        for _ in range(count):
            plan = planned(terms, seen, next(blocks)[0])
            finds.append(stored(index.select("rid", "terms", "counts", "places").mapInArrow(_search(plan, window, near_span, ["rid"], True), f"rid long, {_STATE}")))
            plan.unpersist()
    all_finds = finds[0]
    for f in finds[1:]:
        all_finds = all_finds.unionByName(f)
    each = all_finds.groupBy("rid").agg(*(F.collect_list(c).alias(c) for c in ("hits", "items", "near")))  # a list a block
    found = stored(each.mapInArrow(_gathered, f"rid long, {_STATE}"))
    empty = {c.split(" ", 1)[0]: F.expr(f"cast(array() as {c.split(' ', 1)[1]})") for c in _STATE.split(", ")}
    return base.select("rid", first, "n_words").join(found, "rid", "left").select(first, "n_words", *(F.coalesce(c, e).alias(c) for c, e in empty.items()))


def summary(found: DataFrame) -> DataFrame:
    """The counts of `matches`: words hit, items, and the digest of their ids."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["stop"] - h["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near")
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have no word inside an occurrence of an item's window; without a join."""
    found = matches(spark, docs.select(F.struct("*").alias("row"), "text"), benchmark, first="row", **options)
    return found.where(F.size("hits") == 0).select("row.*")
