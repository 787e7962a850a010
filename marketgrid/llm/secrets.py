"""Secret scans of whole texts, also inside nested encodings.

Three base patterns run over the text. A worklist then unwraps percent encoding, character escapes, base64
and compressed bytes; each unwrapped layer is scanned with the same patterns and unwrapped again until
nothing new appears. Layers are bytes, clean text or not; a rule, not an array, maps their bytes to the range of
the original text they came from, so memory follows the text and the layer that is open.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import io
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, free_name, octets

LAYER_BYTES = 64_000_000  # a compressed layer that opens to more is read in parts of this size and reported
OVERLAP = 65_536  # bytes that such parts share
BLOCK = 4096  # bytes of a text between counts of its code points
KINDS = ("assign", "access", "hex")
_ASSIGN = rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
_BASE = (
    ("assign", re.compile(_ASSIGN, re.I), lambda m: m.end(1) - m.start(1) >= 8),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 16),
    ("hex", re.compile(rb"[0-9a-f]+"), lambda m: m.end() - m.start() >= 32),
)
_HEAD = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?(?=[A-Za-z0-9+/_.=-])", re.I)
_VALUE = re.compile(rb"[A-Za-z0-9+/_.=-]+")
_CUE = re.compile(rb"passw(?:or)?d|secret|token|api_?key", re.I)
_LONG_HEX = re.compile(rb"[0-9a-f]{32}")
_PERCENT = re.compile(rb"%[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(rb"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(rb"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
_CHARS = re.compile(rb"[A-Za-z0-9+/_-]+")
_STANDARD = bytes.maketrans(b"-_", b"+/")
_READABLE = re.compile(rb"[\t\r\n\x20-\x7E]{16,}")
_CONTROL = re.compile(rb"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
_WIDE = tuple(re.compile(p) for p in (rb"(?:[\t\r\n\x20-\x7E]\x00){14,}", rb"(?:\x00[\t\r\n\x20-\x7E]){14,}", rb"(?:[\t\r\n\x20-\x7E]\x00{3}){14,}", rb"(?:\x00{3}[\t\r\n\x20-\x7E]){14,}"))  # ASCII in UTF-16 and UTF-32
_MAGIC = re.compile(rb"(\x1F\x8B\x08)|(BZh[1-9])(?=1AY&SY)|(\xFD7zXZ\x00)|(x[\x01\x5E\x9C\xDA])|(\x28\xB5\x2F\xFD)")
_OPENERS = (lambda: zlib.decompressobj(31), bz2.BZ2Decompressor, lzma.LZMADecompressor, zlib.decompressobj, None)
_BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError)


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, in bytes."""
    found = []
    for kind, pattern, good in _BASE:
        if kind == "assign" and not _CUE.search(text) or kind == "access" and b"AKIA" not in text or kind == "hex" and not _LONG_HEX.search(text):
            continue
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if good(m)]
    return found


def _layer_spans(data: bytes) -> list[tuple[str, int, int]]:
    """As `base_spans`, and the assignments that begin inside the match of another keyword, as decoding may put one before them."""
    found = base_spans(data)
    if _CUE.search(data):
        stop, held = 0, set(found)
        for m in _HEAD.finditer(data):
            stop = stop if m.end() < stop else _VALUE.match(data, m.end()).end()
            if stop - m.end() >= 8 and ("assign", m.start(), stop) not in held:
                found.append(("assign", m.start(), stop))
    return found


def _points(text: bytes, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte offsets as code points."""
    if text.isascii() or not found:
        return found
    at, done, place = 0, 0, {}
    for b in sorted({x for f in found for x in f[1:]}):
        done += len(text[at:b].decode("utf-8", "replace"))
        at, place[b] = b, done
    return [(k, place[a], place[b]) for k, a, b in found]


def _utf8(data: bytes) -> bool:
    """Whether the bytes are UTF-8; checked in stretches, since a decoded copy may be four times as long."""
    check = codecs.getincrementaldecoder("utf-8")()
    try:
        for a in range(0, len(data), 1 << 20):
            check.decode(data[a : a + (1 << 20)])
        check.decode(b"", True)
    except UnicodeDecodeError:
        return False
    return True


def _clean(data: bytes) -> bool:
    """Whether the bytes are readable text."""
    return not _CONTROL.search(data) and _utf8(data)


def _members(raw: bytes, at: int, kind: int) -> Iterator[tuple[bytes, int]]:
    """(block, where its input ends) of the compressed stream at ``at`` and of the members that follow it.

    The last block is empty and comes only after a stream without an error or a cut end.
    """
    step = 1 << 20
    if _OPENERS[kind] is None:
        reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw[at:]), read_across_frames=True)
        while block := reader.read(step):
            yield block, len(raw)
        yield b"", len(raw)
        return
    whole = False
    while True:
        d, more = _OPENERS[kind](), b""
        while not d.eof:
            if not more and getattr(d, "needs_input", True):
                if at >= len(raw):
                    rest = d.flush() if hasattr(d, "flush") else b""
                    if rest:
                        yield rest, at
                    if d.eof:
                        break
                    return
                more = raw[at : at + 65536]
                at += len(more)
            block = d.decompress(more, step)
            more = getattr(d, "unconsumed_tail", b"")
            if block:
                yield block, at
        at -= len(d.unused_data)
        follows = at
        while raw[follows : follows + 1] == b"\0":  # padding between members
            follows += 1
        whole = True
        if not ((m := _MAGIC.match(raw, follows)) and m.lastindex == kind + 1):
            break
        at = follows
    if whole:
        yield b"", at


def _inflated(raw: bytes, at: int, kind: int, limit: int) -> Iterator[tuple[bytes, int, bool, bool]]:
    """(content, end of its input, whether the stream ended well, whether it is over the limit), in parts of ``limit`` bytes that overlap.

    What comes before an error counts. Only what is over the limit makes more than one part.
    """
    held, end, well, fresh, cut = bytearray(), at, False, 0, False  # of `held`, the last `fresh` bytes are new
    try:
        for block, end in _members(raw, at, kind):
            well = not block
            held += block
            fresh += len(block)
            while fresh > limit:
                size, cut = len(held) - (fresh - limit), True
                yield bytes(held[:size]), end, False, True
                del held[: max(size - OVERLAP, 0)]
                fresh -= limit
    except _BROKEN:
        well = False
    if fresh:
        content, held = bytes(held), None
        yield content, end, well, cut


class _Points:
    """Where the bytes of a text stand in code points: counts by blocks, the rest looked up."""

    def __init__(self, text: bytes):
        self.lead = None if text.isascii() else np.frombuffer(text, np.uint8)
        if self.lead is not None:
            self.before = np.concatenate([[0], np.cumsum([np.count_nonzero((self.lead[i : i + BLOCK] & 0xC0) != 0x80) for i in range(0, len(text), BLOCK)])])

    def point(self, at: int) -> int:
        if self.lead is None:
            return at
        block = at // BLOCK
        return int(self.before[block]) + int(np.count_nonzero((self.lead[block * BLOCK : at + 1] & 0xC0) != 0x80)) - 1

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.point(a), self.point(b - 1) + 1


class _Fixed:
    """All bytes come from one range."""

    def __init__(self, start: int, end: int):
        self.range = start, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.range


class _Decoded:
    """Bytes of base64 characters that stand in runs of the outer layer, from character `skip` on; padding ends before `stop`."""

    def __init__(self, outer, starts: list[int], before: list[int], skip: int, count: int, stop: int):
        self.outer, self.starts, self.before, self.skip, self.count, self.stop = outer, starts, before, skip, count, stop

    def place(self, n: int) -> int:
        run = bisect_right(self.before, n) - 1
        return self.starts[run] + n - self.before[run]

    def span(self, a: int, b: int) -> tuple[int, int]:
        last = (b - 1) // 3 * 4 + 3
        end = self.place(self.skip + last) + 1 if last < self.count else self.stop
        return self.outer.span(self.place(self.skip + a // 3 * 4), end)


class _Replaced:
    """A stretch of the outer layer with matches replaced: for each match its start, end, and place and length in the result."""

    def __init__(self, outer, begin: int, starts: array, ends: array, places: array, sizes: array):
        self.outer, self.begin, self.starts, self.ends, self.places, self.sizes = outer, begin, starts, ends, places, sizes

    def source(self, at: int) -> tuple[int, int]:
        k = bisect_right(self.places, at) - 1
        if k < 0:
            return self.begin + at, self.begin + at + 1
        over = at - self.places[k] - self.sizes[k]
        return (self.starts[k], self.ends[k]) if over < 0 else (self.ends[k] + over, self.ends[k] + over + 1)

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.outer.span(self.source(a)[0], self.source(b - 1)[1])


class _Wide:
    """Characters of `width` bytes each."""

    def __init__(self, outer, begin: int, width: int):
        self.outer, self.begin, self.width = outer, begin, width

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.outer.span(self.begin + a * self.width, self.begin + b * self.width)


class _Layer:
    """Bytes and the map of their ranges to the text. `good` tells that they are readable text or hold a whole stream."""

    def __init__(self, data: bytes, where):
        self.data, self.where, self.good = data, where, False

    def within(self, make, *args):
        """The map of a layer inside; a fixed range stays what it is."""
        return self.where if isinstance(self.where, _Fixed) else make(self.where, *args)


def _pieces(layer: _Layer, a: int, b: int, pattern: re.Pattern, decode) -> _Layer:
    """Bytes a to b of the layer with each match of the pattern replaced by what it stands for, so that each keeps its context."""
    data = layer.data if (a, b) == (0, len(layer.data)) else layer.data[a:b]
    if isinstance(layer.where, _Fixed):
        return _Layer(pattern.sub(decode, data), layer.where)
    starts, ends, places, sizes = (array("q") for _ in range(4))
    grown = 0

    def replace(m: re.Match) -> bytes:
        nonlocal grown
        got = decode(m)
        starts.append(a + m.start())
        ends.append(a + m.end())
        places.append(m.start() + grown)
        sizes.append(len(got))
        grown += len(got) - (m.end() - m.start())
        return got

    return _Layer(pattern.sub(replace, data), _Replaced(layer.where, a, starts, ends, places, sizes))


def _escaped(m: re.Match) -> bytes:
    if m.group(1):  # a surrogate pair
        code = 0x10000 + (int(m.group(1), 16) - 0xD800 << 10) + int(m.group(2), 16) - 0xDC00
    else:
        code = int(next(g for g in m.groups() if g), 10 if m.group(8) else 16)
    return chr(code).encode("utf-8", "surrogatepass") if code < 0x110000 else m.group()


def _run_layers(layer: _Layer, a: int, b: int) -> Iterator[_Layer]:
    """The base64 run at a to b, lines joined, decoded; shifted by what it may be glued to, as a path, until that makes sense."""
    starts, before, chars = [], [], []
    total = 0
    for x in _CHARS.finditer(layer.data, a, b):
        starts.append(x.start())
        before.append(total)
        chars.append(x.group())
        total += len(chars[-1])
    run = b"".join(chars).translate(_STANDARD)
    del chars
    for skip in range(4):
        size = total - skip
        size -= size % 4 == 1
        raw = binascii.a2b_base64(run[skip : skip + size] + b"=" * (-size % 4))
        inner = _Layer(raw, layer.within(_Decoded, starts, before, skip, size, b))
        del raw
        yield inner
        if inner.good:
            return


def _unwrapped(layer: _Layer) -> Iterator[tuple[_Layer, bool, bool]]:
    """(layer, whether it is a whole compressed stream, whether it is over the limit) of the layers one step inside.

    Percent and character encodings are text: in bytes that are no clean text, only long readable stretches are
    decoded, each alone, as a compressed stream holds such characters by chance.
    """
    data = layer.data
    text = None
    for cues, pattern, decode in (((b"%",), _PERCENT, lambda m: bytes([int(m.group()[1:], 16)])), ((b"\\", b"&#"), _ESCAPE, _escaped)):
        if any(c in data for c in cues) and pattern.search(data):
            text = _clean(data) if text is None else text
            if text:
                yield _pieces(layer, 0, len(data), pattern, decode), False, False
            else:
                yield from ((_pieces(layer, m.start(), m.end(), pattern, decode), False, False) for m in _READABLE.finditer(data) if pattern.search(data, m.start(), m.end()))
    joined = 0
    for m in _BASE64.finditer(data):
        yield from ((x, False, False) for x in _run_layers(layer, m.start(), m.end()))
        if m.start() >= joined and data[m.end() : m.end() + 1] in (b"\r", b"\n") and (lines := _WRAPPED.match(data, m.start())):
            joined = lines.end()
            yield from ((x, False, False) for x in _run_layers(layer, m.start(), joined))


def _opened(layer: _Layer, limit: int) -> Iterator[tuple[_Layer, bool, bool]]:
    """As `_unwrapped`, the compressed streams and wide characters in bytes that came out of base64 or a stream."""
    data, at = layer.data, 0
    while m := _MAGIC.search(data, at):
        at = m.start() + 1
        for content, end, well, over in _inflated(data, m.start(), m.lastindex - 1, limit):
            layer.good |= well
            yield _Layer(content, _Fixed(*layer.where.span(m.start(), end))), well, over
            content = None
            if well:
                at = end
    if b"\0" in data:
        for pattern, width, place in zip(_WIDE, (2, 2, 4, 4), (0, 1, 0, 3), strict=True):
            for m in pattern.finditer(data):
                yield _Layer(data[m.start() + place : m.end() : width], layer.within(_Wide, m.start(), width)), False, False


def spans(text: bytes | None, limit: int = LAYER_BYTES) -> tuple[list, list, int, bool]:
    """(base spans, all spans, layers opened, whether one was too large) with code point ranges of the text.

    The worklist goes depth first and takes each layer, and each part of a large one, as it comes, so only the layers
    around the current one are held.
    """
    if not text:
        return [], [], 0, False
    base = _points(text, base_spans(text))
    if b"%" not in text and b"\\" not in text and b"&#" not in text and not _BASE64.search(text):
        return base, base, 0, False
    if not _utf8(text):
        text = text.decode("utf-8", "replace").encode()
    work, seen, extra, layers, over = [_unwrapped(_Layer(text, _Points(text)))], set(), set(), 0, False
    while work:
        inner, whole, large = next(work[-1], (None, False, False))
        if inner is None:
            work.pop()
            continue
        over |= large
        mark = hashlib.blake2b(b"%d:%d:" % inner.where.span(0, len(inner.data)), digest_size=16) if inner.data else None
        if mark is None:
            continue
        mark.update(inner.data)
        if mark.digest() in seen:  # a layer that was here before: a cycle ends
            continue
        seen.add(mark.digest())
        found = _layer_spans(inner.data)
        extra.update((k, *inner.where.span(a, b)) for k, a, b in found)
        inner.good = _clean(inner.data)
        layers += bool(found) or whole or inner.good  # other bytes, as long words give, aren't one
        work.append(chain(_unwrapped(inner), _opened(inner, limit)))
        inner = None
    return base, [*base, *extra], layers, over


def _joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(found), key=lambda f: (f[1], KINDS.index(f[0]), f[2])))


def _scan(limit: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            out: list[tuple] = []
            for text in octets(batch.column("text")):
                base, every, layers, over = spans(text, limit)
                out.append((*(sum(f[0] == k for f in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), layers, over))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "unopened"])

    return run


def scan(docs: DataFrame, limit: int = LAYER_BYTES) -> DataFrame:
    """Secrets of each row of ``docs(doc_id, text)``: base counts and digest, all spans, layers opened.

    Spans are kind:start:end in code points of the text, end exclusive; one found inside a layer covers the
    encoded characters it came from (all of them for a compressed layer). n_layers counts the layers opened;
    bytes that are neither text nor a whole compressed stream are scanned too, but only count where they hold a
    secret. unopened tells that a compressed layer held more than ``limit`` bytes: it is read in parts, each
    scanned and unwrapped as a layer, and only an encoding that crosses parts by more than OVERLAP bytes may stay
    closed in part. Null texts are empty, so they have no spans; repeated rows are answered each; an empty table
    gives an empty table. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(limit), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, unopened boolean")


def _redact(it: Iterator[pa.RecordBatch], mark: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        out = []
        for text in octets(batch.column("text")):
            found = sorted((a, b) for _, a, b in spans(text, limit)[1])
            if found:
                points, made, at = text.decode("utf-8", "replace"), [], 0
                for a, b in found:
                    if b <= at:
                        continue
                    if a >= at:
                        made += [points[at:a], mark]
                    at = b
                text = "".join([*made, points[at:]]).encode()
            out.append(text)
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, "text", pa.array(out, pa.binary()).cast(pa.string()).cast(batch.schema.field(i).type))


def redact(docs: DataFrame, mark: str = "[SECRET]", limit: int = LAYER_BYTES) -> DataFrame:
    """``docs`` with each secret, decoded ones included, replaced by ``mark``; n_chars, where present, follows the text.

    Overlapping and touching-inside spans become one mark. Null texts stay null; all other columns stay as they are.
    """
    out = docs.mapInArrow(lambda it: _redact(it, mark, limit), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
