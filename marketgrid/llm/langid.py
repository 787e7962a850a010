"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters are hashed into DIM places. Document frequencies come from all training texts.
The weights are trained with follow-the-regularised-leader (elastic net) on a bounded sample per language, in
rounds over fixed shards whose states are averaged; a temperature is then fitted on sampled rows that the
training left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, octets, stored

DIM, FIT_ROWS, MAX_LANGS = 1 << 16, 3000, 200
SHARDS, ROUNDS, ALPHA, BETA, L1, L2 = 8, 3, 2.0, 1.0, 1e-3, 1e-3
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, a space for everything else."""
    if not _LETTERS:
        _LETTERS.append(np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 32 for i in range(1 << 16)], np.uint32))
    return _LETTERS[0]


def grams(text: bytes | None) -> np.ndarray:
    """Hashed n-grams of the whole text, in no order; empty if it has no letter."""
    if not text:
        return np.empty(0, np.uint16)
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _letters()[np.minimum(points, 0xFFFF)]
    if (high := points > 0xFFFF).any():
        low[high] = [p if chr(p).isalpha() else 32 for p in points[high]]
    if (low == 32).all():
        return np.empty(0, np.uint16)
    space = low == 32
    low = low[~(space & np.concatenate([[True], space[:-1]]))]  # runs of spaces as one, none at the start
    low = np.concatenate([[32], low if low[-1] == 32 else np.append(low, 32)]).astype(np.uint32)
    place = lambda x: ((x * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    two = low[:-1] * np.uint32(0x01000193) ^ low[1:]
    three = two[:-1] * np.uint32(0x01000193) ^ low[2:]
    return np.concatenate([place(low), place(two + np.uint32(0x7F4A7C15)), place(three + np.uint32(0x94D049BB))])


def weighted(text: bytes | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the unit-length TF-IDF vector, with logarithmic term counts."""
    place, count = np.unique(grams(text), return_counts=True)
    value = (1 + np.log(count)) * idf[place]
    return place, (value / (np.sqrt((value * value).sum()) or 1)).astype(np.float32)


def _frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIM + 1, np.int64)  # the last place counts the documents
    for batch in batches(it):
        for text in octets(batch.column("text")):
            total[np.unique(grams(text))] += 1
            total[DIM] += 1
    place = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(total[place], pa.int64())], ["place", "n"])


def _vectors(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            found = [weighted(t, shared.value) for t in octets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("lang", "part", "turn")), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))],
                ["lang", "part", "turn", "places", "vals"],
            )

    return run


def weights(z: np.ndarray, n: np.ndarray, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """The leader of a state: zero where the L1 penalty outweighs the gradients so far."""
    return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow(z: np.ndarray, n: np.ndarray, rows: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """One pass of follow-the-regularised-leader over (class, places, values); changes the state in place."""
    for label, place, value in rows:
        at = np.append(place, DIM)  # the intercept
        x = np.append(value, 1.0)
        zs, ns = z[at], n[at]
        w = weights(zs, ns)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n[at] = ns + g * g
        z[at] = zs + g - (np.sqrt(n[at]) - np.sqrt(ns)) / ALPHA * w


def _train(shared, langs: list[str]):
    codes = {c: i for i, c in enumerate(langs)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, n = (x.astype(np.float64) for x in shared.value)
        pdf = pdf.sort_values("turn")
        follow(z, n, ((codes[c], np.asarray(p), np.asarray(v, np.float64)) for c, p, v in zip(pdf["lang"], pdf["places"], pdf["vals"], strict=True)))
        return pd.DataFrame({"z": [z.astype(np.float32).tobytes()], "n": [n.astype(np.float32).tobytes()]})

    return run


def _scores(shared, langs: list[str]):
    codes = {c: i for i, c in enumerate(langs)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches(it):
            got = [np.asarray(v, np.float64) @ w[p] + w[DIM] for p, v in zip(batch.column("places").to_pylist(), batch.column("vals").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([codes[c] for c in batch.column("lang").to_pylist()], pa.int32()), pa.array(got, pa.list_(pa.float64()))], ["label", "logits"])

    return run


def temperature(labels: np.ndarray, logits: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / math.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    a, b, ratio = math.log(0.02), math.log(50), (math.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    for _ in range(60):
        if loss(c) <= loss(d):
            b = d
        else:
            a = c
        c, d = b - ratio * (b - a), a + ratio * (b - a)
    return math.exp((a + b) / 2)


class Model:
    """Languages, inverse document frequencies, weights (place by language, the last row the intercepts), temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, w: np.ndarray, heat: float):
        self.langs, self.idf, self.w, self.heat = langs, idf, w, heat


def fit(spark: SparkSession, rows: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model | None:
    """Learn from ``rows(key, text, lang)`` with non-null languages; None where there are none.

    Document frequencies and language counts cover all rows. Of each language about ``fit_rows`` rows, all if
    there are fewer, are drawn by a hash of ``key`` for the weights and the temperature; key decides nothing else.
    More than MAX_LANGS languages are refused, since the model is held whole by each task.
    """
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return None
    langs = sorted(counts)
    total = np.zeros(DIM + 1)
    for place, n in rows.select("text").mapInArrow(_frequencies, "place long, n long").groupBy("place").agg(F.sum("n")).collect():  # a row for each hash place at most
        total[place] = n
    idf = (np.log((1 + total[DIM]) / (1 + total[:DIM])) + 1).astype(np.float32)
    share = F.coalesce(*(F.when(F.col("lang") == c, F.lit(fit_rows / n)) for c, n in counts.items()))
    draw = F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1 << 30)) / (1 << 30)
    sample = rows.where(draw < share).select("lang", "text", F.pmod(F.xxhash64("key", F.lit("part")), F.lit(SHARDS + 1)).cast("int").alias("part"), F.xxhash64("key", F.lit("turn")).alias("turn"))
    data = stored(sample.mapInArrow(_vectors(spark.sparkContext.broadcast(idf)), "lang string, part int, turn long, places array<int>, vals array<float>"))
    z, n = np.zeros((DIM + 1, len(langs)), np.float32), np.zeros((DIM + 1, len(langs)), np.float32)
    for _ in range(rounds):  # the last part is kept for the temperature
        shared = spark.sparkContext.broadcast((z, n))
        states = data.where(F.col("part") < SHARDS).groupBy("part").applyInPandas(_train(shared, langs), "z binary, n binary").collect()
        if states:
            z, n = (np.mean([np.frombuffer(s[i], np.float32).reshape(z.shape) for s in states], axis=0) for i in (0, 1))
        shared.unpersist()
    w = weights(z.astype(np.float64), n.astype(np.float64))
    kept = data.where(F.col("part") == SHARDS).mapInArrow(_scores(spark.sparkContext.broadcast(w), langs), "label int, logits array<double>").collect()
    return Model(langs, idf, w.astype(np.float32), temperature(np.array([r[0] for r in kept], int), np.array([r[1] for r in kept], float).reshape(-1, len(langs))))


def _predict(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches(it):
            names, scores = [], []
            for text in octets(batch.column("text")):
                place, value = weighted(text, model.idf) if model else ((), ())
                if not len(place):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = softmax((value @ model.w[place] + model.w[DIM]).astype(np.float64) / model.heat)
                names.append(model.langs[int(p.argmax())])
                scores.append(float(p.max()))
            rest = [i for i, c in enumerate(batch.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(batch.schema.names[i] for i in rest), "lang_pred", "score"])

    return run


def identify(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """lang_pred and its calibrated probability, after the columns of ``docs`` other than text; texts are read whole.

    Null texts and texts without a letter are `und` with score 0, as is everything where nothing was learned. Ties
    go to the first language in order. Columns of the result's names are replaced. Repeated rows are answered each; an empty table gives an empty table.
    """
    docs = docs.drop("lang_pred", "score")
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_predict(spark.sparkContext.broadcast(model)), f"{rest}, lang_pred string, score double")


def split_identify(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for all ``docs(doc_id, text, lang)``: learn where crc32(doc_id as text) mod 4 isn't 2.

    A null doc_id has no remainder: its row isn't held out and isn't learned from.
    """
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit(spark, docs.where((rest != 2) & F.col("lang").isNotNull()).select(F.col("doc_id").cast("string").alias("key"), "text", "lang"), **options)
    return identify(spark, docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text"), model)
