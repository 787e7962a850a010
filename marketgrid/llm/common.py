"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import stored

__all__ = ["SPACE", "batches", "flat", "free_name", "mix", "octets", "pieces", "stored", "string_array", "strings", "table"]

SPACE = "[\\x20\\x09-\\x0D]"
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def octets(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def strings(column: pa.Array) -> list[str | None]:
    return [None if x is None else x.decode("utf-8", "replace") for x in octets(column)]


def batches(it: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that the Python copies of a few texts are held at a time."""
    for batch in it:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices with about `limit` bytes of text each; a longer text is never split."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = [0, *(np.flatnonzero(np.diff(size // limit)) + 1), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(at, at[1:]) if a < b)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a string column, offsets); null is empty."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = pc.fill_null(column.cast(pa.large_binary()), b"")
    first = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset] if len(whole) else 0
    held = whole.buffers()[2] if len(whole) else None
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = np.frombuffer(held, np.uint8)[first : first + off[-1]] if held is not None and off[-1] else np.empty(0, np.uint8)
    return data, off


def string_array(data: np.ndarray, off: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A string column of data[off[i]:off[i + 1]]."""
    held = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data), held)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, also not in another case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
