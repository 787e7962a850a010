"""Fill-in-middle transformation by displacement scatter.

The texts of a batch lie in one byte array. Two drawn cuts split a text into prefix, middle and suffix; the cuts are
scanned in code points and become byte places. A part that moves has one shift, so a difference array over the
starts of the parts holds every shift, its cumulative sum gives each byte its place in the output, and one scatter
writes the batch. Restoring finds the marks in the output, builds the difference array of the way back and gathers.

Difference arrays stay sparse; shifts of single bytes exist for BLOCK bytes at a time, so memory beyond the texts
and outputs is bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, free_name, pieces, string_array

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
WIDTH = 3  # bytes of a mark
RATE, SPM, SEED = 90, 20, 1  # of 100 texts: transformed, and of these suffix first
BLOCK = 1 << 20
FORMS = np.array(["plain", "psm", "spm"])
_LETTERS = np.frombuffer(b"PSM", np.uint8)


def _blocks(size: int, block: int) -> Iterator[tuple[int, int]]:
    return ((a, min(a + block, size)) for a in range(0, size, block))


def points_before(data: np.ndarray, at: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Code points that begin before each of the ascending byte places `at`."""
    out, seen = np.zeros(len(at), np.int64), 0
    for a, b in _blocks(len(data), block):
        count = np.cumsum((data[a:b] & 0xC0) != 0x80)
        i, j = np.searchsorted(at, [a, b], side="right")
        out[i:j] = seen + count[at[i:j] - a - 1]
        seen += int(count[-1])
    return out


def places(data: np.ndarray, rank: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Byte place at which the code point of each ascending rank begins; the end of the data beyond the last one."""
    out, seen = np.full(len(rank), len(data), np.int64), 0
    for a, b in _blocks(len(data), block):
        begin = np.flatnonzero((data[a:b] & 0xC0) != 0x80)
        i, j = np.searchsorted(rank, [seen, seen + len(begin)])
        out[i:j] = a + begin[rank[i:j] - seen]
        seen += len(begin)
    return out


def marks(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Byte places of all marks."""
    found = []
    for a, b in _blocks(len(data), block):
        part = data[a : b + WIDTH - 1]
        at = np.flatnonzero(part[: b - a] == ord("<"))
        at = at[at + 2 < len(part)]
        found.append(a + at[(part[at + 2] == ord(">")) & np.isin(part[at + 1], _LETTERS)])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _shifted(size: int, at: np.ndarray, shift: np.ndarray, block: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, place after its shift) of every byte, by blocks; part i begins at at[i] and moves by shift[i]."""
    steps = np.diff(shift, prepend=0)
    for a, b in _blocks(size, block):
        i, j = np.searchsorted(at, [a, b])
        moved = np.zeros(b - a, np.int64)
        np.add.at(moved, at[i:j] - a, steps[i:j])  # empty parts share a start, their steps add up
        moved[0] += 1 + (shift[i - 1] if i else 0) + a - 1
        moved[1:] += 1
        yield a, b, np.cumsum(moved)


def scatter(data: np.ndarray, off: np.ndarray, form: np.ndarray, first: np.ndarray, second: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(output bytes, output offsets) of texts data[off[i]:off[i + 1]] of form 0 plain, 1 psm, 2 spm, cut at bytes first and second."""
    begin, end = off[:-1], off[1:]
    lead, tail = first - begin, end - second
    out_off = np.concatenate([[0], np.cumsum(end - begin + 3 * WIDTH * (form > 0))]).astype(np.int64)
    base = out_off[:-1]
    prefix = base + np.where(form == 1, WIDTH, np.where(form == 2, 2 * WIDTH + tail, 0))
    middle = base + np.where(form > 0, 3 * WIDTH + lead + tail, lead)
    suffix = base + np.where(form == 1, 2 * WIDTH + lead, np.where(form == 2, WIDTH, second - begin))
    at = np.stack([begin, first, second], 1).ravel()
    shift = np.stack([prefix - begin, middle - first, suffix - second], 1).ravel()
    out = np.empty(out_off[-1], np.uint8)
    for a, b, to in _shifted(len(data), at, shift, block):
        out[to] = data[a:b]
    moved = form > 0
    for mark, before in ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)):
        for k in range(WIDTH):
            out[before[moved] - WIDTH + k] = mark[k]
    return out, out_off


def gather(out: np.ndarray, off: np.ndarray, formed: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text bytes, offsets, whether each could be restored) from outputs; plain ones are their own text.

    The three marks of a formed output and their order say where its parts lie. Formed outputs without exactly these
    marks can't be restored and come back empty.
    """
    begin, size = off[:-1], np.diff(off)
    found = marks(out, block)
    owner = np.searchsorted(off, found, side="right") - 1
    whole = (found + WIDTH <= off[owner + 1]) & formed[owner]  # a mark may not cross from one text to the next
    found, owner = found[whole], owner[whole]
    three = np.bincount(owner, minlength=len(size)) == 3
    found = found[three[owner]].reshape(-1, 3)
    letter = out[found + 1]
    first = np.flatnonzero(three)
    order = (found[:, 0] == begin[first]) & (letter[:, 2] == ord("M")) & (letter[:, :2].min(1) == ord("P")) & (letter[:, :2].max(1) == ord("S"))
    found, letter, who = found[order], letter[order], first[order]
    good = ~formed
    good[who] = True
    psm = letter[:, 0] == ord("P")
    piece = [(found[:, k] + WIDTH, (np.append(found, off[who + 1][:, None], axis=1))[:, k + 1]) for k in range(3)]
    lo = lambda a, b: np.where(psm, piece[a][0], piece[b][0])
    hi = lambda a, b: np.where(psm, piece[a][1], piece[b][1])
    source = np.repeat(begin[:, None], 3, axis=1)  # where prefix, middle and suffix begin in the output
    length = np.zeros((len(size), 3), np.int64)
    length[:, 0] = np.where(formed, 0, size)
    source[who] = np.stack([lo(0, 1), piece[2][0], lo(1, 0)], 1)
    length[who] = np.stack([hi(0, 1) - lo(0, 1), piece[2][1] - piece[2][0], hi(1, 0) - lo(1, 0)], 1)
    start = np.concatenate([[0], np.cumsum(length.ravel())]).astype(np.int64)
    text = np.empty(start[-1], np.uint8)
    for a, b, at in _shifted(len(text), start[:-1], source.ravel() - start[:-1], block):
        text[a:b] = out[at]
    return text, start[::3], good


def cut(data: np.ndarray, off: np.ndarray, draws: np.ndarray, rate: int = RATE, spm: int = SPM, block: int = BLOCK) -> dict[str, np.ndarray]:
    """Per text: code points n, form, the two cuts in bytes and code points, from four draws a text."""
    before = points_before(data, off, block)
    n = np.diff(before)
    held = marks(data, block)
    owner = np.searchsorted(off, held, side="right") - 1
    marked = np.zeros(len(n), bool)
    marked[owner[held + WIDTH <= off[owner + 1]]] = True
    plain = (off[1:] == off[:-1]) | marked | (draws[2] % 100 >= rate)
    form = np.where(plain, 0, np.where(draws[3] % 100 < spm, 2, 1))
    a, b = draws[0] % (n + 1), draws[1] % (n + 1)
    low, high = np.where(plain, 0, np.minimum(a, b)), np.where(plain, 0, np.maximum(a, b))
    both = places(data, np.stack([before[:-1] + low, before[:-1] + high], 1).ravel(), block).reshape(-1, 2)
    both = np.clip(both, off[:-1, None], off[1:, None])
    return {"n": n, "form": form, "low": low, "high": high, "first": both[:, 0], "second": both[:, 1]}


def _transform(text: str, draws: list[str], keep: list[str], rate: int, spm: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for piece in pieces(batch, text):
                data, off = flat(piece.column(text))
                got = cut(data, off, np.stack([piece.column(c).to_numpy() for c in draws]), rate, spm)
                out = scatter(data, off, got["form"], got["first"], got["second"])
                plain = got["form"] == 0
                counts = [pa.array(x, pa.int64(), mask=plain) for x in (got["low"], got["high"] - got["low"])]
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in keep), pa.array(got["n"], pa.int64()), pa.array(FORMS[got["form"]], pa.string()), *counts, string_array(*out)],
                    [*keep, "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def _fields(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema if f.name in names)


def draw(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned numbers below 2^32 from the hash of seed and key; a null key hashes as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """Columns of `docs`, then n, form, prefix_chars, middle_chars and output.

    `rate` of 100 texts are transformed, `spm` of 100 of these with the suffix first. Texts that are empty, null
    (taken as empty) or hold a mark stay plain. Equal keys draw alike, so repeated rows come out alike. Columns of the
    result's names are replaced; an empty table gives an empty table. Texts are read whole.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("n", "form", "prefix_chars", "middle_chars", "output") and c not in (key, text)))
    keep, names = docs.columns, []
    for column in draw(F.col(f"`{key}`"), seed):
        names.append(free_name(docs, "draw"))
        docs = docs.withColumn(names[-1], column)
    return docs.mapInArrow(_transform(text, names, keep, rate, spm), _fields(docs, keep) + "n long, form string, prefix_chars long, middle_chars long, output string")


def _restore(output: str, form: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for piece in pieces(batch, output):
                out, off = flat(piece.column(output))
                formed = np.array([f in ("psm", "spm") for f in piece.column(form).to_pylist()], bool)
                text, start, good = gather(out, off, formed)
                good &= piece.column(output).is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*piece.columns, string_array(text, start, good)], [*piece.schema.names, "restored"])

    return run


def restore(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """Columns of `rows`, then the text rebuilt from output and form alone; null where the output is null or lacks its marks.

    A column `restored` is replaced. A null form is plain.
    """
    rows = rows.drop("restored")
    return rows.mapInArrow(_restore(output, form), _fields(rows, rows.columns) + "restored string")
