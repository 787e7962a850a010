"""Pack tokenised documents into training windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and a rest; rests are cut into pieces of at most ``piece`` ids.
Blocks of rests are then packed: each piece starts as a partial partition of the block's windows, and the two
partial partitions with the largest imbalance merge with their imbalances opposed until one is left. Where its
fullest window is over the capacity, the window count rises and the block is packed again.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batches, octets, stored

CAPACITY, PIECE, BLOCK, END = 2048, 256, 2048, 1
_ENCODERS: dict = {}


def encoder(path: str):
    """``text -> ids`` of a byte-level BPE, from a tokenizers .json or a tiktoken rank file; special tokens are plain text."""
    if path not in _ENCODERS:
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _ENCODERS[path] = lambda text: t.encode(text, add_special_tokens=False).ids
    return _ENCODERS[path]


def added_tokens(path: str) -> dict[str, int]:
    """Text -> id of the added tokens of a tokenizers .json, which its defaults find in plain text."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("an added token that isn't matched by its text alone")
    return {t["content"]: t["id"] for t in tokens}


def with_added(encode, added: dict[str, int]):
    """``encode`` between the added tokens, which keep their own ids; of two at one place the longer one counts."""
    if not added:
        return encode
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def run(text: str) -> list[int]:
        parts = cut.split(text)
        if len(parts) == 1:
            return encode(text)
        return [i for k, part in enumerate(parts) for i in ([added[part]] if k % 2 else encode(part) if part else [])]

    return run


def _cut(path: str, capacity: int, piece: int, end: int, added: dict[str, int]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = with_added(encoder(path), added)
        for batch in batches(it):
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for i, text in enumerate(octets(batch.column("text"))):
                ids = np.array([*(encode(text.decode("utf-8", "replace")) if text else []), end], "<u4")
                whole = len(ids) // capacity * capacity
                cuts = [*range(0, whole, capacity), *range(whole, len(ids), piece), len(ids)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    rows.append(i)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(ids[a:b].tobytes()))
                    totals.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in (starts, lengths, sums, totals))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Members of k bins with near-equal sums, by Karmarkar-Karp differencing. Ties go to the earlier piece.

    A partial partition is a list of (sum, members), largest sum first, of its bins that aren't empty; the
    others count as zero. Sums are kept less the smallest, since only imbalances matter for merging.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        apart = k - len(b)  # bins of the first that meet none of the second
        if len(a) <= apart:
            merged = a + b
        else:
            tail = b[::-1][: len(a) - apart]  # smallest of the second against the first's last ... largest against its smallest
            merged = a[:apart] + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[apart:], tail, strict=True)] + b[: len(b) - len(tail)]
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == k else 0
        if least:
            merged = [(s - least, m) for s, m in merged]
        heapq.heappush(heap, (-merged[0][0], serial, merged))
        serial += 1
    return [m for _, m in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Members of as few near-equal windows as differencing fits into the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        bins = difference(sizes, min(k, len(sizes)))
        if all(sum(sizes[i] for i in b) <= capacity for b in bins):
            return bins
        k += max(1, k // 256)


def _place(capacity: int, block: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, held, count = TaskContext.get().partitionId() << 40, [], 0

        def numbered(rows: pa.Table, sequence: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from rows.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).to_batches()

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal serial
            rows = pa.Table.from_batches(held)
            for at in range(0, rows.num_rows, block):
                part = rows.slice(at, block)
                sizes = part.column("length").to_pylist()
                sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                for members in windows(sizes, capacity):
                    filled = 0
                    for i in members:
                        sequence[i], offset[i] = serial, filled
                        filled += sizes[i]
                    serial += 1
                yield from numbered(part, sequence, offset)

        for batch in it:
            length = batch.column("length").to_numpy()
            whole = pa.Table.from_batches([batch.filter(pa.array(length == capacity))])
            yield from numbered(whole, serial + np.arange(whole.num_rows), np.zeros(whole.num_rows))
            serial += whole.num_rows
            if (rest := batch.filter(pa.array(length < capacity))).num_rows:
                held.append(rest)
                count += rest.num_rows
            if count >= block * 8:  # whole blocks go out; the remainder waits for more
                ready = pa.Table.from_batches(held)
                keep = ready.num_rows % block
                held = ready.slice(0, ready.num_rows - keep).to_batches()
                yield from packed()
                held, count = ready.slice(ready.num_rows - keep).to_batches() if keep else [], keep
        if held:
            yield from packed()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, piece: int = PIECE, block: int = BLOCK, end: int = END, added: dict[str, int] | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of the vocabulary file, on every machine. ``end`` follows each document's ids.
    ``added`` holds tokens with ids of their own, wherever they stand in a text (`added_tokens`); without it they
    are plain text.
    Pieces are written once; the packing then reads them task by task in blocks of ``block`` rests, without a
    shuffle, so neither one document's length nor repeated rows gather anywhere. A task that runs again reads
    the same split and numbers its windows alike. Null and empty texts are the end id alone; repeated rows are
    packed each; an empty table gives an empty table. Columns other than doc_id and text are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = stored(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, capacity, piece, end, added or {}), shape))
    return pieces.mapInArrow(_place(capacity, block), f"{shape}, sequence_id long, offset long")
