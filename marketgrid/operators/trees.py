"""Tree models of all refit dates at once, grown level by level on binned histograms.

One Spark job grows one level of every tree of every refit: a task reads its rows once, routes them down the trees so
far, and adds (rows, weight, gradient, curvature) by (tree, node, feature, asset, bin). The sums of a tree meet in one
task, which picks the split of each node. Only splits travel back. Forests grow all their trees side by side; boosting
needs a job for each level of each round, however many refits there are. Margins of boosted models are written beside
the rows every few rounds, so that a lost executor repeats little. Rows of a few megabytes, by count, are sent to every
task instead; the refits then grow side by side in one job, by the same sums and splits.

Bins are quantiles of rows that the first refit of an era may see; an era ends when a refit may see twice as many
dates. So no candidate threshold comes from the future.

A split asks whether a signal is at most a bound, for all rows or for the rows of one asset alone, which go left as a
whole in the last bin; the rows of other assets then go right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .walk import Refits, calendar, grouped, matrix, packed, refits, with_all

BINS = 32
ROWS = 20_000  # rows that a task treats at a time
CELLS = 1 << 21  # histogram cells that a task fills at a time
UNITS = 1 << 14  # trees that grow in one job
SMALL = 1 << 18  # histogram cells of a job that one task adds up
LOCAL = 16 << 20  # bytes of rows up to which every task gets them all
RENEW = 20  # boosting rounds after which margins are written
SEED = 20260830


@dataclass(frozen=True)
class Spec:
    """A tree model: a forest of independent trees, or boosting of `trees` rounds; `event` for the chance of a 0/1 target."""

    trees: int
    depth: int
    leaf: int
    boost: bool = False
    rate: float = 1.0
    sample: float | None = None  # share of rows a boosting round draws; forests of more trees than one draw with replacement
    event: bool = False
    roots: bool = False  # a node looks at the square root of the signals only


def regressor(name: str, prm: dict | None = None) -> Spec:
    """A registered regressor."""
    prm = prm or {}
    if name == "random_forest":
        return Spec(prm.get("n_estimators", 300), prm.get("max_depth", 4), 20)
    if name == "gradient_boosting":
        return Spec(prm.get("n_estimators", 200), prm.get("max_depth", 2), 1, True, prm.get("learning_rate", 0.02), 0.7)
    if name == "shallow_tree":
        return Spec(1, prm.get("max_depth", 3), 24)
    raise ValueError(f"unknown tree model: {name}")


def classifier(name: str) -> Spec:
    """A registered classifier."""
    if name == "random_forest":
        return Spec(300, 4, 12, event=True, roots=True)
    if name == "gradient_boosting":
        return Spec(200, 2, 1, True, 0.05, event=True)
    raise ValueError(f"unknown tree classifier: {name}")


class Trees(NamedTuple):
    """Trees side by side, nodes in heap order: splits where feature >= 0, values at the leaves."""

    feature: np.ndarray
    asset: np.ndarray  # -1: rows of all assets
    bin: np.ndarray
    value: np.ndarray

    @staticmethod
    def stumps(n: int, depth: int) -> Trees:
        shape = (n, 2 ** (depth + 1) - 1)
        return Trees(*(np.full(shape, v, np.int32) for v in (-1, -1, 0)), np.zeros(shape))


def descend(trees: Trees, codes: np.ndarray, asset: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, whether it is as deep as `levels`) of each row in each tree; trees by rows."""
    u = np.arange(len(trees.feature))[:, None]
    row = np.arange(len(codes))[None, :]
    node = np.zeros((len(u), len(codes)), np.int64)
    deep = np.ones(node.shape, bool)
    for _ in range(levels):
        f = trees.feature[u, node]
        deep &= f >= 0
        own = trees.asset[u, node]
        left = (codes[row, np.maximum(f, 0)] <= trees.bin[u, node]) & ((own < 0) | (own == asset[None, :]))
        node = np.where(f >= 0, 2 * node + np.where(left, 1, 2), node)
    return node, deep


def noise(key: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """Uniform numbers of (row key, stream), rows last; they depend on nothing else."""
    x = key[None, :].astype(np.uint64) ^ (stream[:, None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])  # of mean one


def _coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many edges lie below it."""
    return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.int64)


class _Rows:
    """A batch of rows as arrays."""

    def __init__(self, batch: pa.RecordBatch, width: int, assets: int):
        self.x, self.pos, self.y = matrix(batch.column("x"), width), batch.column("pos").to_numpy(), batch.column("y").to_numpy()
        self.key, self.own = batch.column("key").to_numpy(), batch.column("a").to_numpy().astype(np.int64) if assets > 1 else np.zeros(batch.num_rows, np.int64)


def _sums(spec: Spec, trees: Trees, level: int, rows: _Rows, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, assets: int, draw: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """(sum, tree, cell) of a few trees over a batch: rows, weight, gradient, curvature by (node, feature, asset, bin).

    `draw` numbers the trees of a forest, or the round of boosting, for their draws of rows.
    """
    nodes, width = 2**level, codes.shape[1]
    shape = nodes * width * assets * BINS
    node, deep = descend(trees, codes, rows.own, level)
    use = deep & (rows.pos[None, :] >= lo[:, None]) & (rows.pos[None, :] < hi[:, None]) & ~np.isnan(rows.y)[None, :]
    w = np.ones(use.shape)
    if spec.boost and spec.sample is not None:
        w = (noise(rows.key, draw) < spec.sample) * w
    elif not spec.boost and spec.trees > 1:
        w = np.searchsorted(_POISSON, noise(rows.key, draw), side="right").astype(float)
    if spec.boost:
        p = 1.0 / (1.0 + np.exp(-margin)) if spec.event else margin
        g, h = rows.y[None, :] - p, p * (1.0 - p) if spec.event else np.ones_like(p)
    else:
        g, h = np.broadcast_to(rows.y[None, :], use.shape), np.ones(use.shape)
    u, r = np.nonzero(use & (w > 0))
    cell = (np.arange(width)[None, :] * assets + rows.own[:, None]) * BINS + codes
    at = (((u * nodes + node[u, r] - (nodes - 1)) * (width * assets * BINS))[:, None] + cell[r]).ravel()
    values = [np.ones(len(u)), w[u, r], (w * g)[u, r], (w * h)[u, r]]
    return np.stack([np.bincount(at, np.repeat(v, width), len(trees.feature) * shape) for v in values]).reshape(4, len(trees.feature), shape)


def _histograms(shared, width: int):
    """Sums of each tree over a task's rows, only the cells that rows fall into."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = shared.value
        spec, trees, level, span, assets = job["spec"], job["trees"], job["level"], job["spans"], job["assets"]
        shape = 2**level * width * assets * BINS
        for batch in grouped(it, ROWS):
            rows = _Rows(batch, width, assets)
            margins = matrix(batch.column("margin"), job["margins"]) if spec.boost else None
            for era in np.unique(job["era"]):
                codes = _coded(rows.x, job["edges"][era])
                units = np.flatnonzero(job["era"] == era)
                step = max(CELLS // max(shape, len(rows.y) * width), 1)
                for a in range(0, len(units), step):
                    part = units[a : a + step]
                    e = job["refit"][part]
                    margin = margins[:, job["column"][part]].T + job["later"](codes, rows.own, part) if spec.boost else None
                    draw = np.full(1, job["round"]) if spec.boost else job["tree"][part]
                    sums = _sums(spec, Trees(*(v[part] for v in trees)), level, rows, codes, span.lo[e], span.hi[e], assets, draw, margin).reshape(4, -1)
                    full = np.flatnonzero(sums[0])
                    bounds = np.searchsorted(full // shape, np.arange(len(part) + 1))
                    have = np.flatnonzero(np.diff(bounds))
                    if len(have):
                        off = pa.array(np.append(bounds[have], len(full)).astype(np.int32))
                        lists = [pa.ListArray.from_arrays(off, pa.array(v)) for v in ((full % shape).astype(np.int64), *(s[full] for s in sums))]
                        yield pa.RecordBatch.from_arrays([pa.array(part[have].astype(np.int64)), *lists], ["unit", "cell", "n", "w", "g", "h"])

    return run


def best_splits(sums: np.ndarray, leaf: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(feature, asset, bin, left sums, right sums) of the best split of each node, feature -1 where none is valid.

    `sums` is (node, feature, asset, bin, 4) with rows, weight, gradient and curvature. The best split has the largest
    fall of the squared error; equal ones go to the first signal, all assets before single ones, lower bins first.
    """
    nodes, width, assets, bins, _ = sums.shape
    total = sums[:, 0].sum((1, 2))
    every = np.cumsum(sums.sum(2, keepdims=True), axis=3)
    left = every if assets == 1 else np.concatenate([every, np.cumsum(sums, axis=3)], axis=2)
    right = total[:, None, None, None, :] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 2] ** 2 / left[..., 1] + right[..., 2] ** 2 / right[..., 1] - (total[:, 2] ** 2 / total[:, 1])[:, None, None, None]
    bad = (left[..., 0] < max(leaf, 1) - 0.5) | (right[..., 0] < max(leaf, 1) - 0.5) | ~np.isfinite(gain)
    if allowed is not None:
        bad |= ~allowed[:, :, None, None]
    gain = np.where(bad, -1.0, np.round(gain, 12))
    at = gain.reshape(nodes, -1).argmax(1)
    f, a, b = np.unravel_index(at, gain.shape[1:])
    n = np.arange(nodes)
    none = gain[n, f, a, b] <= 1e-12
    return np.where(none, -1, f), a - 1, b, left[n, f, a, b], right[n, f, a, b]


_SPLITS = "unit long, node int, feature int, asset int, bin int, total array<double>, leftside array<double>, rightside array<double>"


def _splits(spec: Spec, dense: np.ndarray, level: int, width: int, assets: int, tree: int, unit: int = 0) -> list[tuple]:
    """A row for each node that rows reach: its best split, its sums and those of its two sides."""
    nodes = 2**level
    sums = np.moveaxis(dense.reshape(4, nodes, width, assets, BINS), 0, -1)
    allowed = None
    if spec.roots and width > 1:
        draw = noise(np.arange(nodes * width, dtype=np.uint64), np.array([tree * 64 + level]))[0].reshape(nodes, width)
        allowed = draw.argsort(1).argsort(1) < max(int(np.sqrt(width)), 1)
    f, a, b, left, right = best_splits(sums, spec.leaf, allowed)
    total = sums[:, 0].sum((1, 2))
    return [(unit, v, int(f[v]), int(a[v]), int(b[v]), total[v].tolist(), left[v].tolist(), right[v].tolist()) for v in range(nodes) if total[v, 0] > 0]


def _choose(shared, width: int):
    """Splits of the trees whose sums arrive, tree after tree; only one tree's sums are held."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = shared.value
        spec, level, assets = job["spec"], job["level"], job["assets"]
        done = lambda unit, dense: _splits(spec, dense, level, width, assets, 0 if spec.boost else int(job["tree"][unit]), unit)
        out, held, dense = [], None, None
        for batch in it:
            for row in range(batch.num_rows):
                unit = batch.column("unit")[row].as_py()
                if unit != held:
                    if held is not None:
                        out += done(held, dense)
                    held, dense = unit, np.zeros((4, 2**level * width * assets * BINS))
                cell = batch.column("cell")[row].values.to_numpy()
                for k, c in enumerate(("n", "w", "g", "h")):
                    dense[k, cell] += batch.column(c)[row].values.to_numpy()
        if held is not None:
            out += done(held, dense)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 3]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(8)], [f.split()[0] for f in _SPLITS.split(", ")])

    return run


class _Later:
    """Margins that the trees of rounds since the last writing add: units by rows."""

    def __init__(self, rounds: list[Trees], rate: float, depth: int):
        self.rounds, self.rate, self.depth = rounds, rate, depth

    def __call__(self, codes: np.ndarray, own: np.ndarray, part: np.ndarray) -> np.ndarray:
        out = np.zeros((len(part), len(codes)))
        for trees in self.rounds:
            these = Trees(*(v[part] for v in trees))
            node, _ = descend(these, codes, own, self.depth)
            out += self.rate * these.value[np.arange(len(part))[:, None], node]
        return out


def _value(sums) -> float:
    """Leaf value from (rows, weight, gradient, curvature)."""
    return sums[2] / sums[3] if sums[3] > 1e-150 else 0.0


def _place(trees: Trees, level: int, found: list[tuple]) -> bool:
    """Put the splits of a level into the trees; whether there are any."""
    for unit, node, feature, asset, bound, total, left, right in found:
        at = 2**level - 1 + node
        if level == 0:
            trees.value[unit, 0] = _value(total)
        if feature >= 0:
            trees.feature[unit, at], trees.asset[unit, at], trees.bin[unit, at] = feature, asset, bound
            trees.value[unit, 2 * at + 1], trees.value[unit, 2 * at + 2] = _value(left), _value(right)
    return any(r[2] >= 0 for r in found)


def grow(rows: DataFrame, job: dict, width: int) -> Trees:
    """Grow one tree for each unit of a job, a Spark job a level."""
    context, spec = rows.sparkSession.sparkContext, job["spec"]
    trees = Trees.stumps(len(job["refit"]), spec.depth)
    for level in range(spec.depth):
        shared = context.broadcast(job | {"trees": trees, "level": level})
        cells = rows.mapInArrow(_histograms(shared, width), "unit long, cell array<long>, n array<double>, w array<double>, g array<double>, h array<double>")
        dealt = cells.repartition("unit") if len(job["refit"]) * 2**level * width * job["assets"] * BINS > SMALL else cells.repartition(1)
        found = dealt.sortWithinPartitions("unit").mapInArrow(_choose(shared, width), _SPLITS).collect()  # a short row a node
        shared.unpersist()
        if not _place(trees, level, [tuple(r) for r in found]):
            break
    return trees


def _served(span: Refits, pos: np.ndarray) -> np.ndarray:
    """Refit in force at each position, -1 before the first."""
    return np.searchsorted(span.at, pos, side="right") - 1


def _forest_sums(shared, width: int):
    """Sum of tree values of each row under the refit in force."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = shared.value
        trees, span = job["trees"], job["spans"]
        for batch in grouped(it, ROWS):
            x, pos = matrix(batch.column("x"), width), batch.column("pos").to_numpy()
            own = batch.column("a").to_numpy().astype(np.int64) if job["assets"] > 1 else np.zeros(batch.num_rows, np.int64)
            at, total = _served(span, pos), np.full(batch.num_rows, np.nan)
            for e in np.unique(job["refit"]):
                mine = np.flatnonzero(at == e)
                units = np.flatnonzero(job["refit"] == e)
                if len(mine) and len(units):
                    codes, value = _coded(x[mine], job["edges"][job["era"][units[0]]]), np.zeros(len(mine))
                    for a in range(0, len(units), max(CELLS // len(mine), 1)):
                        these = Trees(*(v[units[a : a + max(CELLS // len(mine), 1)]] for v in trees))
                        node, _ = descend(these, codes, own[mine], job["spec"].depth)
                        value += these.value[np.arange(len(node))[:, None], node].sum(0)
                    total[mine] = value
            have = np.flatnonzero(~np.isnan(total))
            took = pa.array(have)
            yield pa.RecordBatch.from_arrays([batch.column("asset").take(took), batch.column("d").take(took), pa.array(total[have])], ["asset", "d", "s"])

    return run


def _margins(shared, width: int):
    """Rows with their margins brought up to date."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = shared.value
        for batch in grouped(it, ROWS):
            x = matrix(batch.column("x"), width)
            own = batch.column("a").to_numpy().astype(np.int64) if job["assets"] > 1 else np.zeros(batch.num_rows, np.int64)
            margin = matrix(batch.column("margin"), job["margins"]).copy()
            for era in np.unique(job["era"]):
                units = np.flatnonzero(job["era"] == era)
                margin[:, job["column"][units]] += job["later"](_coded(x, job["edges"][era]), own, units).T
            off = np.arange(0, margin.size + 1, margin.shape[1], dtype=np.int32)
            new = pa.ListArray.from_arrays(pa.array(off), pa.array(margin.ravel()))
            yield pa.RecordBatch.from_arrays([new if c == "margin" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return run


def _eras(rows: DataFrame, span: Refits, width: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """(era of each refit, edges of each era by feature); one short row an era reaches the driver."""
    era, start = np.zeros(len(span.at), int), []
    for k, hi in enumerate(span.hi):
        if not start or hi >= 2 * max(span.hi[start[-1]], 1):
            start.append(k)
        era[k] = len(start) - 1
    steps = [i / BINS for i in range(1, BINS)]
    edges = []
    for k in start:
        known = rows.filter((F.col("pos") < int(span.hi[k])) & ~F.isnan("y"))
        r = known.agg(*(F.percentile_approx(F.col("x")[c], steps, 100_000) for c in range(width))).first()
        edges.append([np.unique(np.array(q, float)) if q is not None else np.empty(0) for q in r])
    return era, edges


def _init(rows: DataFrame, span: Refits, event: bool, min_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a refit has enough rows and, for events, both classes; mean of the target; rows) of each refit."""
    days = rows.filter(~F.isnan("y")).groupBy("pos").agg(F.count("*"), F.sum("y")).orderBy("pos").collect()
    pos = np.array([r[0] for r in days], np.int64)
    total = np.vstack([np.zeros(2), np.cumsum(np.array([r[1:] for r in days], float).reshape(-1, 2), axis=0)])
    n, s = (total[np.searchsorted(pos, span.hi)] - total[np.searchsorted(pos, span.lo)]).T
    enough = n >= max(min_rows, 1)
    return enough & ((0 < s) & (s < n) if event else True), np.divide(s, n, out=np.zeros_like(s), where=n > 0), n


def _whole(shared, width: int):
    """All of a refit's trees on rows that the task holds whole; (asset, d, spec, value) of the rows it serves."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = shared.value
        span, assets = job["spans"], job["assets"]
        batch = job["rows"]
        rows = _Rows(batch, width, assets)
        for unit in it:
            for name, k in zip(unit.column("spec").to_pylist(), unit.column("k").to_pylist(), strict=True):
                spec, start = job["specs"][name], job["start"][name][k]
                codes = _coded(rows.x, job["edges"][job["era"][k]])
                lo, hi = span.lo[k : k + 1], span.hi[k : k + 1]
                value = np.full(len(rows.y), start)
                at_once = 1 if spec.boost else max(CELLS // max(2 ** (spec.depth - 1) * width * assets * BINS, len(rows.y) * width), 1)
                for a in range(0, spec.trees, at_once):
                    draw = np.arange(a, min(a + at_once, spec.trees)) + SEED
                    trees = Trees.stumps(len(draw), spec.depth)
                    for level in range(spec.depth):
                        sums = _sums(spec, trees, level, rows, codes, np.repeat(lo, len(draw)), np.repeat(hi, len(draw)), assets, draw, value[None, :] if spec.boost else None)
                        if not _place(trees, level, [s for u in range(len(draw)) for s in _splits(spec, sums[:, u], level, width, assets, 0 if spec.boost else int(draw[u]), u)]):
                            break
                    node, _ = descend(trees, codes, rows.own, spec.depth)
                    value += trees.value[np.arange(len(draw))[:, None], node].sum(0) * (spec.rate if spec.boost else 1.0 / spec.trees)
                if spec.boost and spec.event:
                    value = 1.0 / (1.0 + np.exp(-value))
                mine = pa.array(np.flatnonzero((rows.pos >= span.at[k]) & (rows.pos < span.until[k])))
                yield pa.RecordBatch.from_arrays([batch.column("asset").take(mine), batch.column("d").take(mine), pa.array([name] * len(mine), pa.string()), pa.array(value).take(mine)], ["asset", "d", "spec", "value"])

    return run


def fit_predict(rows: DataFrame, specs: list[tuple[str, Spec]], span: Refits, assets: int, width: int, min_rows: int) -> DataFrame:
    """(asset, d, spec, value) for the rows that a refit with enough training rows serves.

    `rows` is (asset, a, d, pos, y, x, key): asset number, position, features, and a key for the random draws.
    """
    spark, parts = rows.sparkSession, []
    era, edges = _eras(rows, span, width)
    base = {"spans": span, "edges": edges, "assets": assets, "era": era}
    small = rows.count() * 8 * (width + 8) <= LOCAL
    units, starts = [], {}
    for name, spec in specs:
        good, mean, n = _init(rows, span, spec.event, min_rows)
        live = np.flatnonzero(good)
        if spec.event:
            flat = [(name, int(span.at[k]), int(span.until[k]), float(mean[k])) for k in np.flatnonzero(~good & (n >= max(min_rows, 1)))]
            one = spark.createDataFrame(flat, "spec string, at long, until long, value double")
            parts.append(rows.join(one, (F.col("pos") >= F.col("at")) & (F.col("pos") < F.col("until"))).select("asset", "d", "spec", "value"))
        with np.errstate(divide="ignore", invalid="ignore"):
            starts[name] = (np.log(mean / (1 - mean)) if spec.event else mean) if spec.boost else np.zeros(len(mean))
        if small:
            units += [(name, int(k)) for k in live]
        elif len(live):
            parts.append((_boosted if spec.boost else _forest)(rows, name, spec, base, live, starts[name], width))
    if units:
        held = pa.Table.from_batches(rows.toArrow().to_batches()).combine_chunks().to_batches()[0]
        shared = spark.sparkContext.broadcast(base | {"rows": held, "specs": dict(specs), "start": starts})
        dealt = spark.createDataFrame(units, "spec string, k int").repartition(min(len(units), 4 * spark.sparkContext.defaultParallelism))
        parts.append(stored(dealt.mapInArrow(_whole(shared, width), rows.select("asset", "d").schema.add("spec", "string").add("value", "double"))))
    return _union(parts) if parts else rows.select("asset", "d", F.lit("").alias("spec"), F.lit(0.0).alias("value")).limit(0)


def _forest(rows: DataFrame, name: str, spec: Spec, base: dict, live: np.ndarray, start: np.ndarray, width: int) -> DataFrame:
    """Values of a forest; its trees grow in a job a level for about UNITS of them."""
    sums, per = [], max(UNITS // len(live), 1)
    for a in range(0, spec.trees, per):
        tree = np.arange(a, min(a + per, spec.trees))
        refit = np.repeat(live, len(tree))
        job = base | {"spec": spec, "refit": refit, "tree": np.tile(tree, len(live)) + SEED, "era": base["era"][refit]}
        shared = rows.sparkSession.sparkContext.broadcast(job | {"trees": grow(rows, job, width)})
        sums.append(rows.mapInArrow(_forest_sums(shared, width), rows.select("asset", "d").schema.add("s", "double")))
    total = stored(sums[0]) if len(sums) == 1 else stored(_union(sums).groupBy("asset", "d").agg(F.sum("s").alias("s")))
    return total.select("asset", "d", F.lit(name).alias("spec"), (F.col("s") / spec.trees).alias("value"))


def _boosted(rows: DataFrame, name: str, spec: Spec, base: dict, live: np.ndarray, start: np.ndarray, width: int) -> DataFrame:
    """Values of boosting, a job a level and round for all refits."""
    spark = rows.sparkSession
    state = stored(rows.withColumn("margin", F.array(*(F.lit(float(v)) for v in start[live]))))
    job = base | {"spec": spec, "refit": live, "era": base["era"][live], "column": np.arange(len(live)), "margins": len(live)}
    rounds: list[Trees] = []
    for turn in range(spec.trees):
        rounds.append(grow(state, job | {"round": SEED + turn, "later": _Later(rounds, spec.rate, spec.depth)}, width))
        if len(rounds) == RENEW or turn == spec.trees - 1:
            shared = spark.sparkContext.broadcast(job | {"later": _Later(rounds, spec.rate, spec.depth)})
            state, rounds = stored(state.mapInArrow(_margins(shared, width), state.schema)), []
    serving = spark.createDataFrame([(int(base["spans"].at[k]), int(base["spans"].until[k]), c) for c, k in enumerate(live)], "at long, until long, column int")
    mine = state.join(serving, (F.col("pos") >= F.col("at")) & (F.col("pos") < F.col("until")))
    value = F.element_at("margin", F.col("column") + 1)
    return mine.select("asset", "d", F.lit(name).alias("spec"), (1.0 / (1.0 + F.exp(-value)) if spec.event else value).alias("value"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rows(wide: DataFrame, cal: DataFrame, features: list[str], d: str, numbered: bool) -> tuple[DataFrame, int]:
    """Rows as `fit_predict` reads them, and the number of assets."""
    rows = packed(wide, cal, features, d).withColumnRenamed(d, "d").withColumn("key", F.xxhash64("asset", "d"))
    rows = rows.withColumn("y", F.coalesce("y", F.lit(float("nan"))))
    if not numbered:
        return stored(rows.withColumn("a", F.lit(0))), 1
    names = [r[0] for r in wide.select("asset").distinct().orderBy("asset").collect()]  # a name an asset
    code = wide.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], wide.select("asset").schema.add("a", "integer"))
    return stored(rows.join(code, "asset")), len(names)


def walk_forward_trees(wide: DataFrame, features: list[str], specs: list[tuple[str, str, dict | None]], min_train: int = 180, refit_every: int = 12,
                       horizon: int = 1, embargo: int = 12, d: str = "d") -> DataFrame:
    """(asset, d, spec, forecast) of tree models fitted at each refit date with purged training rows.

    `wide` is (asset, d, y, features...), `specs` lists (name, model, parameters). A model pools all assets and sees
    each signal of all assets and of each asset alone. Rows that lack a feature train nothing and get a null forecast.
    """
    cal = calendar(wide, d)
    first = min_train + horizon + embargo
    span = refits(cal.count(), first, refit_every, horizon + embargo)
    if not len(span.at):
        return wide.select("asset", d, F.lit("").alias("spec"), F.lit(0.0).alias("forecast")).limit(0)
    rows, assets = _rows(wide, cal, features, d, True)
    got = fit_predict(rows, [(n, regressor(m, p)) for n, m, p in specs], span, assets, len(features), min_train // 2)
    every = [with_all(wide, cal, first, got.filter(F.col("spec") == n).select("asset", F.col("d").alias(d), F.col("value").alias("forecast")), ["asset", d], d).withColumn("spec", F.lit(n)) for n, *_ in specs]
    return _union(every).select("asset", d, "spec", "forecast")


def walk_forward_events(wide: DataFrame, features: list[str], model: str, min_train: int = 120, window: int | None = None, refit_every: int = 1, d: str = "d") -> DataFrame:
    """(asset, d, p): the chance of the event from a tree classifier refitted at each refit date, pooled over assets.

    Training sets of one class predict their rate, those of fewer than half of `min_train` rows nothing.
    """
    cal = calendar(wide, d)
    span = refits(cal.count(), min_train, refit_every, 0, window)
    if not len(span.at):
        return wide.select("asset", d).withColumn("p", F.lit(0.0)).limit(0)
    rows, assets = _rows(wide, cal, features, d, False)
    got = fit_predict(rows, [(model, classifier(model))], span, assets, len(features), min_train // 2)
    return with_all(wide, cal, min_train, got.select("asset", F.col("d").alias(d), F.col("value").alias("p")), ["asset", d], d).select("asset", d, "p")
