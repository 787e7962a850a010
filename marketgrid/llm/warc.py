"""WARC archives as seekable Zstandard bundles.

Records are gathered into independent frames; a skippable frame with a seek table ends each file, so any frame
opens without the ones before it, and an index maps record ids to (file, frame, offset in the frame).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import batches, octets, stored

FRAME_BYTES, FILE_BYTES, LEVEL = 1_000_000, 64_000_000, 3
# fixed values of the seekable format
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
_STAMP = "1970-01-01T00:00:00Z"  # pages carry no time of their own


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str, url: str, payload: bytes, kind: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, whose Content-Length is the payload's, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{page_id}>", f"WARC-Date: {_STAMP}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, bytes, int]:
    """(headers, HTTP head, payload, end) of the record that starts at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    fields = dict(x.split(": ", 1) for x in lines)
    end = stop + 4 + int(fields["Content-Length"])
    block = data[stop + 4 : end]
    split = block.index(b"\r\n\r\n") + 4
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} has no end")
    return fields, block[:split], block[split:], end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame: (compressed, plain) sizes, count, a descriptor without checksums, the magic."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame of an open file."""
    size = f.seek(0, 2)
    f.seek(size - 9)
    count, descriptor, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    f.seek(size - 9 - count * width)
    raw, at, out = f.read(count * width), 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", raw, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def _place(path: str):
    return pafs.FileSystem.from_uri(path)


class _Bundle:
    """Writes one file at a time; its name is new for each task attempt, so a lost attempt leaves no half of a listed file."""

    def __init__(self, base: str, frame_bytes: int, file_bytes: int, level: int):
        self.fs, self.base = _place(base)
        self.fs.create_dir(self.base, recursive=True)
        self.frame_bytes, self.file_bytes, self.packer, self.file = frame_bytes, file_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True), None

    def add(self, record: bytes) -> tuple[str, int, int]:
        if self.file is None:
            self.name, self.frames, self.size, self.buffer = f"{uuid.uuid4().hex}.warc.zst", [], 0, bytearray()
            self.file = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
        spot = self.name, len(self.frames), len(self.buffer)
        self.buffer += record
        if len(self.buffer) >= self.frame_bytes:
            self.flush()
            if self.size >= self.file_bytes:
                self.close()
        return spot

    def flush(self) -> None:
        if self.buffer:
            data = self.packer.compress(bytes(self.buffer))
            self.frames.append((len(data), len(self.buffer)))
            self.file.write(data)
            self.size += len(data)
            self.buffer = bytearray()

    def close(self) -> None:
        if self.file is not None:
            self.flush()
            self.file.write(seek_table(self.frames))
            self.file.close()
            self.file = None


_INDEX = "page_id string, file string, frame int, at long"


def _write(base: str, frame_bytes: int, file_bytes: int, level: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches(it):
            bundle = bundle or _Bundle(base, frame_bytes, file_bytes, level)
            names, urls, kinds, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "refers_to"))
            spots = [bundle.add(record(n or "", u, p or b"", k, r)) for n, u, p, k, r in zip(names, urls, octets(batch.column("html")), kinds, refers, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[i] for s in spots], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64())))], ["page_id", "file", "frame", "at"])
        if bundle is not None:
            bundle.close()

    return run


def _read(base: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(base)
        opened, table, file, frame, data = None, [], None, None, b""
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches(it):
            out = []
            for name, number, at in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "at")), strict=True):
                if opened != name:
                    if file is not None:
                        file.close()
                    file = fs.open_input_file(f"{root}/{name}")
                    table, opened, frame = read_seek_table(file), name, None
                if frame != number:
                    offset, packed, plain = table[number]
                    file.seek(offset)
                    data, frame = unpacker.decompress(file.read(packed), max_output_size=plain), number
                fields, head, payload, _ = parse(data, at)
                length = int(head.decode().split("Content-Length: ")[1].split("\r\n")[0])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and (len(payload) != length or payload_digest(payload) != digest):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                strip = lambda x: x and (x.removeprefix(f"<{_ID}").removesuffix(">") or None)
                out.append((strip(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], length, digest, fields["WARC-Type"], strip(fields.get("WARC-Refers-To")), payload.decode() if fields["WARC-Type"] == "response" else None))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])
        if file is not None:
            file.close()

    return run


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` as (page_id string, url, html, record_type, refers_to).

    Of equal payloads of at least ``min_bytes`` the row with the largest page_id is the response and the others
    revisit it. Payloads are compared by length and SHA-256. Equal ids with equal payloads are all responses; a
    null id is below every other, and rows that have nothing else are responses.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("about:blank")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("url", F.regexp_replace("url", "[\\x00-\\x20\\x7F]+", "%20"))
    keyed = rows.withColumn("bytes", F.octet_length("html")).withColumn("key", F.sha2("html", 256))
    top = stored(keyed.where(F.col("bytes") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1 and top is not null").select("key", "top"))  # written, so that AQE can split a hot payload
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return keyed.join(top, "key", "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("top").cast("string")).alias("refers_to")
    )


def write(spark: SparkSession, pages: DataFrame, base: str | None = None, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> tuple[str, DataFrame]:
    """(folder, index) of the archives of ``pages(page_id, url, html)``.

    Each task writes files of about ``file_bytes`` into the folder, by default a new one in the shared scratch
    folder, through a file system that is chosen by the folder's scheme. The index (page_id, file, frame, at) is
    written with Spark's committer, so it lists the files of the attempts that count, whatever other attempts
    left behind. A null html is an empty payload, a null url is about:blank and a null page_id an empty one; an empty
    table writes no file.
    """
    base = base or scratch_path(spark, "warc")
    rows = roles(pages, min_bytes)
    return base, stored(rows.mapInArrow(_write(base, frame_bytes, file_bytes, level), _INDEX))


def read(base: str, index: DataFrame) -> DataFrame:
    """The records that ``index`` names, each frame opened through its file's seek table; payloads are checked against their digests."""
    return index.mapInArrow(_read(base), "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, html string")
