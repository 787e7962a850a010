"""Ranked lexical search over a K2-treap of the term-document grid.

The index holds a row for each shard, a run of documents with about SHARD postings. A shard's grid has a row for each
term, frequent ones first, and a column for each document; a point's impact is the tf and length part of the score, an
integer. The grid is halved in both directions again and again: a cell that holds points keeps a 4-bit map of its
quarters, and how far its highest impact lies below that of the cell around it. Cells stand in breadth-first order, so
the number of quarters before a cell is the place of its first quarter.

A search goes down the paths of all rows of an item at once: a range of documents has one cell for each row, and the
sum of weight times maximum bounds every score in the range. Ranges with the highest bounds are halved first, down to
single documents, whose bounds are their scores; what can't reach the k-th best score so far is never opened. A task
carries its best documents from shard to shard, so later shards start with a high bar.

The index is built once, of all terms, without a shuffle: any later set of items searches it. Items go to the tasks in
blocks of bounded size. A block costs two readings of the index and none of the texts.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import flat, octets, pieces, stored

SHARD = 1 << 20  # postings after which a shard is closed
BLOCK_BYTES = 8 << 20  # of distinct item terms sent to the tasks at a time
CELLS = 1 << 20  # places of a frontier beyond which the deepest ranges go first, which keeps it short
SALTS = 32
K = 20

# a byte of a term stays (A-Z in lower case), any other becomes a space
_TERM = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_INSIDE = np.frombuffer(_TERM, np.uint8) != 32
_COUNT = np.array([bin(i).count("1") for i in range(16)], np.uint8)  # set bits of a map
_BEFORE = np.array([[bin(i & ((1 << q) - 1)).count("1") for q in range(4)] for i in range(16)], np.int32)  # of these before quarter q


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def _lengths(text: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = words = 0
        for batch in it:
            for piece in pieces(batch, text):
                data, off = flat(piece.column(text))
                inside = np.concatenate([_INSIDE[data], [False]])
                begin = inside[:-1] & ~np.concatenate([[False], inside[:-2]])
                starts = off[:-1][off[1:] > off[:-1]]
                begin[starts] = inside[starts]  # a term never goes on in the next text
                before = np.concatenate([[0], np.cumsum(begin)])[off]
                n = np.diff(before)
                some, words = some + int((n > 0).sum()), words + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([some], pa.int64()), pa.array([words], pa.int64())], ["some", "words"])

    return run


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents with a term, all their terms)."""
    r = docs.select(F.col(text).alias("text")).mapInArrow(_lengths("text"), "some long, words long").agg(F.sum("some"), F.sum("words")).first()
    return r[0] or 0, r[1] or 0


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of a 32-bit number moved to the even places of a 64-bit one."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def grow(row: np.ndarray, col: np.ndarray, value: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(levels, highest value, maps of the inner cells, drops of all cells but the root), both breadth first."""
    levels = max(int(max(row.max(), col.max())).bit_length(), 1)
    code = (_spread(row) << np.uint64(1)) | _spread(col)
    order = np.argsort(code)
    code, top = code[order], value[order].astype(np.int64)
    maps, drops = [], []
    for _ in range(levels):
        outer = code >> np.uint64(2)
        begin = np.flatnonzero(np.concatenate([[True], outer[1:] != outer[:-1]]))
        high = np.maximum.reduceat(top, begin)
        maps.append(np.bitwise_or.reduceat(np.left_shift(1, (code & np.uint64(3)).astype(np.uint8), dtype=np.uint8), begin))
        drops.append((np.repeat(high, np.diff(np.append(begin, len(code)))) - top).astype(np.uint32))
        code, top = outer[begin], high
    return levels, int(top[0]), np.concatenate(maps[::-1]), np.concatenate(drops[::-1])


class Treap:
    """The cells of a shard, opened for search: maps, place of the first quarter, highest impact of every cell."""

    def __init__(self, levels: int, highest: int, maps: np.ndarray, drops: np.ndarray):
        self.levels, self.maps = levels, maps
        count = _COUNT[maps]
        self.first = (1 + np.cumsum(count, dtype=np.int64) - count).astype(np.int32)
        self.top = np.empty(1 + len(drops), np.int64)
        self.top[0] = highest
        begin, end = 0, 1
        for _ in range(levels):
            nxt = end + int(count[begin:end].sum())
            self.top[end:nxt] = np.repeat(self.top[begin:end], count[begin:end]) - drops[end - 1 : nxt - 1]
            begin, end = end, nxt

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int = 1, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of all documents that score at least `floor` and at least the k-th best score here."""
        width = len(rows)
        level, col = np.zeros(1, np.int64), np.zeros(1, np.int64)
        cell = np.zeros((1, width), np.int32)  # -1: the row has no point in the range
        bound = np.array([int(weights.sum()) * int(self.top[0])])
        found_col, found = np.empty(0, np.int64), np.empty(0, np.int64)
        while len(bound):
            most = max(cells // (8 * width), 1)
            size = min(max(64, len(bound) // 4), most)
            if len(bound) > size:
                rank = -bound if len(bound) * width <= cells else -(level << 48) - (bound >> 16)
                part = np.argpartition(rank, size - 1)
                now, later = part[:size], part[size:]
            else:
                now, later = np.arange(len(bound)), np.empty(0, np.int64)
            old, at = cell[now], level[now]
            bit = (rows[None, :] >> (self.levels - 1 - at)[:, None]) & 1
            have = old >= 0
            held = np.where(have, self.maps[old], 0)
            first = self.first[old]
            nxt = []
            for side in (0, 1):
                quarter = bit * 2 + side
                there = (held >> quarter) & 1 > 0
                child = np.where(there, first + _BEFORE[held, quarter], -1).astype(np.int32)
                high = np.where(there, self.top[child], 0) @ weights
                ok = high >= floor
                nxt.append((at[ok] + 1, col[now][ok] * 2 + side, child[ok], high[ok]))
            lv, cl, ch, hi = (np.concatenate(x) for x in zip(*nxt, strict=True))
            leaf = lv == self.levels
            found_col, found = np.concatenate([found_col, cl[leaf]]), np.concatenate([found, hi[leaf]])
            if len(found) >= k:
                floor = max(floor, int(np.partition(found, len(found) - k)[len(found) - k]))
                good = found >= floor
                found_col, found = found_col[good], found[good]
            keep, new = later[bound[later] >= floor], ~leaf & (hi >= floor)
            level, col = np.concatenate([level[keep], lv[new]]), np.concatenate([col[keep], cl[new]])
            cell, bound = np.concatenate([cell[keep], ch[new]]), np.concatenate([bound[keep], hi[new]])
        return found_col, found


def _shard(vocab: dict[bytes, int], keys: list, ids: list[int], tfs: list[int], sizes: list[int], lengths: list[int], total: int, words: int) -> list:
    """The values of an index row."""
    row, tf = np.array(ids, np.int64), np.array(tfs, np.int64)
    col = np.repeat(np.arange(len(keys)), sizes)
    df = np.bincount(row, minlength=len(vocab))
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(vocab), np.int64)
    rank[order] = np.arange(len(vocab))
    m = 75 + (25 * np.array(lengths, np.int64) * total) // words
    levels, highest, maps, drops = grow(rank[row], col, impact(tf, m[col]))
    names = list(vocab)
    pack = zstandard.ZstdCompressor(level=1).compress
    return [keys, pack(b" ".join([names[i] for i in order.tolist()])), pack(df[order].astype(np.uint32).tobytes()), levels, highest, pack(maps.tobytes()), pack(drops.tobytes())]


SHAPE = "keys array<{key}>, names binary, dfs binary, levels int, highest long, maps binary, drops binary"


def _build(total: int, words: int, postings: int, key_type: pa.DataType):
    types = [pa.list_(key_type), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            vocab: dict[bytes, int] = defaultdict()
            vocab.default_factory = vocab.__len__
            return vocab, [], [], [], [], []

        def close():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_shard(vocab, keys, ids, tfs, sizes, lengths, total, words), types, strict=True)], [f.split()[0] for f in SHAPE.split(", ")])

        vocab, keys, ids, tfs, sizes, lengths = fresh()
        for batch in it:
            for piece in pieces(batch, "text"):
                for key, text in zip(piece.column("key").to_pylist(), octets(piece.column("text")), strict=True):
                    words_here = terms(text)
                    if not words_here:
                        continue
                    count = Counter(words_here)
                    keys.append(key)
                    ids.extend(map(vocab.__getitem__, count))
                    tfs.extend(count.values())
                    sizes.append(len(count))
                    lengths.append(len(words_here))
                    if len(ids) >= postings:
                        yield close()
                        vocab, keys, ids, tfs, sizes, lengths = fresh()
        if keys:
            yield close()

    return run


class Index:
    """A stored index: its shards as a DataFrame, and how many documents with a term it holds."""

    def __init__(self, shards: DataFrame, total: int):
        self.shards, self.total = shards, total


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", postings: int = SHARD) -> Index:
    """Index all whole texts of `docs`; null texts and texts without a term are in no shard. Keys are whole numbers or strings."""
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    total, words = totals(docs)
    kind = docs.schema["key"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind]
    return Index(stored(docs.mapInArrow(_build(total, words, postings, arrow), SHAPE.format(key=kind))), total)


def _unpacked(value: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value)


def _frequencies(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shared.value, Counter()
        for batch in it:
            for names, dfs in zip(batch.column("names"), batch.column("dfs"), strict=True):
                df = np.frombuffer(_unpacked(dfs.as_py()), np.uint32)
                for i, name in enumerate(_unpacked(names.as_py()).split(b" ")):
                    if name in wanted:
                        seen[name] += int(df[i])
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["term", "df"])

    return run


def _order(found: tuple) -> tuple:
    score, key = found
    return -score, key is not None, key if key is not None else 0


def _search(shared, k: int, key_type: pa.DataType):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = shared.value
        best: dict[int, list[tuple[int, object]]] = {}
        for batch in it:
            for shard in range(batch.num_rows):
                value = {c: batch.column(c)[shard].as_py() for c in ("names", "levels", "highest", "maps", "drops")}
                keys = batch.column("keys")[shard].values
                treap = Treap(value["levels"], value["highest"], np.frombuffer(_unpacked(value["maps"]), np.uint8), np.frombuffer(_unpacked(value["drops"]), np.uint32))
                row = {name: i for i, name in enumerate(_unpacked(value["names"]).split(b" ")) if name in weights}
                for item, counts in items:
                    here = [(row[t], weights[t] * c) for t, c in counts if t in row and weights[t] > 0]
                    if not here:
                        continue
                    old = best.get(item, [])
                    rows, heavy = (np.array(x, np.int64) for x in zip(*here, strict=True))
                    cols, scores = treap.best(rows, heavy, k, old[-1][0] if len(old) == k else 1)
                    if len(cols):
                        got = zip(scores.tolist(), (keys[c].as_py() for c in cols.tolist()), strict=True)
                        best[item] = sorted([*old, *got], key=_order)[:k]
        rows = [(item, key, score) for item, found in best.items() for score, key in found]
        item, key, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(key, key_type), pa.array(score, pa.int64())], ["item", "key", "score"])

    return run


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """(name, terms) of the items in blocks; a block closes when its texts pass `limit` bytes."""
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r[0], Counter(terms(r[1].encode("utf-8", "surrogatepass") if r[1] is not None else None))))
        size += len(r[1] or "")
        if size > limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(spark: SparkSession, found: Index, items: DataFrame, item: str = "item_id", text: str = "text", key: str = "doc_id", k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, key, score): the k best documents of each item with a score above 0, equal scores by ascending key.

    Each row of `items` is a query of its own, also where names repeat or are null; items without a term that the
    index weighs have no rows. A null document key comes first among equal scores. Repeated documents rank each. Empty
    tables give an empty table.
    """
    kind, name = found.shards.schema["keys"].dataType.elementType, items.schema[item].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind.simpleString()]
    parts = [spark.createDataFrame([], f"item {name.simpleString()}, rank int, key {kind.simpleString()}, score long")]
    for block in _blocks(items.select(F.col(f"`{item}`"), F.col(f"`{text}`")), block_bytes):
        wanted = spark.sparkContext.broadcast({t for _, counts in block for t in counts})
        df = found.shards.select("names", "dfs").mapInArrow(_frequencies(wanted), "term binary, df long").groupBy("term").agg(F.sum("df")).collect()  # the block's terms at most
        weights = {bytes(t): weight(found.total, n) for t, n in df}
        shared = spark.sparkContext.broadcast((weights, [(i, [(t, c) for t, c in counts.items() if t in weights]) for i, (_, counts) in enumerate(block)]))
        hits = found.shards.select("keys", "names", "levels", "highest", "maps", "drops").mapInArrow(_search(shared, k, arrow), f"item long, key {kind.simpleString()}, score long")
        for by in (["item", "_salt"], ["item"]):  # in two steps, so that no task gets the best of all tasks for one item
            hits = hits.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
            hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("key")))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(block)], f"item long, name {name.simpleString()}")
        parts.append(stored(hits.join(names, "item").select(F.col("name").alias("item"), "rank", "key", "score")))
        wanted.unpersist()
        shared.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
