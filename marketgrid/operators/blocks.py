"""Large symmetric matrices as stored square blocks: products, solves, equal risk and leading eigenvalues.

A block of the upper triangle is one row. A product with a few vectors is one job: each task multiplies its blocks and
adds up by block row, so a task holds one block and the vectors. Vectors (one number an asset) live on the driver, as in
other iterative solvers on Spark; matrices never leave the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import stored

SIDE = 512
_PART = "k long, b long, x array<double>"


def _multiply(shared, side: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in it:
            for r in range(batch.num_rows):
                k, bi, bj = (batch.column(c)[r].as_py() for c in ("k", "bi", "bj"))
                x = vectors.get(k)
                if x is None:
                    continue
                left, right = x[bi * side : (bi + 1) * side], x[bj * side : (bj + 1) * side]
                a = np.zeros((side, side))
                a.ravel()[batch.column("cell")[r].values.to_numpy()] = batch.column("v")[r].values.to_numpy()
                a = a[: len(left), : len(right)]
                if bi == bj:
                    a = a + a.T - np.diag(np.diag(a))
                parts = [(bi, a @ right)] if bi == bj else [(bi, a @ right), (bj, a.T @ left)]
                for b, y in parts:
                    old = sums.get((k, b))
                    sums[k, b] = y if old is None else old + y
        yield _rows(sums)

    return run


def _rows(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int64()), pa.array([b for _, b in sums], pa.int64()), pa.array([y.ravel().tolist() for y in sums.values()], pa.list_(pa.float64()))], ["k", "b", "x"])


def _add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in it:
        for r in range(batch.num_rows):
            at, y = (batch.column("k")[r].as_py(), batch.column("b")[r].as_py()), batch.column("x")[r].values.to_numpy()
            sums[at] = sums[at] + y if at in sums else y.copy()
    yield _rows(sums)


class Blocks:
    """Matrices of all keys of `pairs(keys, i, j, value)`, an upper triangle with its diagonal; absent pairs are zero."""

    def __init__(self, pairs: DataFrame, keys: list[str], value: str = "s", side: int = SIDE):
        self.spark, self.keys, self.side = pairs.sparkSession, keys, side
        pairs = stored(pairs.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col(value).cast("double").alias("v")))
        own = pairs.filter("i = j").select(*keys, F.col("i").alias("asset"), F.col("v").alias("_v"))
        own = own.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy("asset")) - 1)
        ids = own.select(*keys).distinct()
        ids = stored(ids.withColumn("_k", F.row_number().over(Window.orderBy(*keys)).cast("long") - 1))  # a row a matrix
        self.place = stored(own.join(ids, keys))
        rows = self.place.select("_k", "_p", "_v").collect()  # a number an asset
        n: dict[int, int] = {}
        for k, p, _ in rows:
            n[k] = max(n.get(k, 0), p + 1)
        self.diagonal = {k: np.zeros(m) for k, m in n.items()}
        for k, p, v in rows:
            self.diagonal[k][p] = v
        at = lambda c: self.place.select(*keys, "_k", F.col("asset").alias(c), F.col("_p").alias(f"_p{c}"))
        cells = pairs.join(at("i"), [*keys, "i"]).join(at("j").drop("_k"), [*keys, "j"])
        block = lambda c: F.floor(F.col(c) / side)
        one = F.struct(((F.col("_pi") % side) * side + F.col("_pj") % side).cast("int").alias("cell"), "v")
        grid = cells.groupBy(F.col("_k").alias("k"), block("_pi").alias("bi"), block("_pj").alias("bj")).agg(F.collect_list(one).alias("c"))  # side x side cells at most
        self.blocks = stored(grid.select("k", "bi", "bj", F.col("c.cell").alias("cell"), F.col("c.v").alias("v")))

    def dot(self, vectors: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Product of each key's matrix with its columns (assets by columns), for the keys given."""
        shaped = {k: x.reshape(len(x), -1) for k, x in vectors.items()}
        shared = self.spark.sparkContext.broadcast(shaped)
        parts = self.blocks.mapInArrow(_multiply(shared, self.side), _PART).repartition("k", "b").mapInArrow(_add, _PART).collect()  # a number an asset and column
        shared.unpersist()
        out = {k: np.zeros_like(x) for k, x in shaped.items()}
        for k, b, x in parts:
            out[k][b * self.side : (b + 1) * self.side] = np.array(x).reshape(-1, shaped[k].shape[1])
        return {k: out[k].reshape(vectors[k].shape) for k in vectors}

    def solve(self, right: dict[int, np.ndarray], extra: dict[int, np.ndarray] | None = None, tol: float = 1e-13, most: int = 1000) -> dict[int, np.ndarray]:
        """x with (matrix + diag(extra)) x = right, by conjugate gradients with the diagonal as preconditioner."""
        add = extra or {k: np.zeros(len(b)) for k, b in right.items()}
        scale = {k: 1.0 / np.maximum(self.diagonal[k] + add[k], 1e-300) for k in right}
        x = {k: np.zeros(len(b)) for k, b in right.items()}
        r = {k: b.copy() for k, b in right.items()}
        p = {k: scale[k] * r[k] for k in right}
        rz = {k: float(r[k] @ p[k]) for k in right}
        stop = {k: tol * tol * v for k, v in rz.items()}
        live = [k for k in right if rz[k] > 0]
        for _ in range(most):
            if not live:
                break
            q = self.dot({k: p[k] for k in live})
            for k in list(live):
                q[k] = q[k] + add[k] * p[k]
                curve = float(p[k] @ q[k])
                if curve <= 0:
                    live.remove(k)
                    continue
                step = rz[k] / curve
                x[k] += step * p[k]
                r[k] -= step * q[k]
                z = scale[k] * r[k]
                new = float(r[k] @ z)
                p[k] = z + (new / rz[k]) * p[k]
                rz[k] = new
                if new <= stop[k]:
                    live.remove(k)
        return x

    def erc(self, tol: float = 1e-12, most: int = 60) -> dict[int, np.ndarray]:
        """Equal risk contributions: Newton steps on y'Sy/2 - sum(log y)/n, each solved by conjugate gradients."""
        scale = {k: float(d.mean()) for k, d in self.diagonal.items()}
        y = {k: 1.0 / np.sqrt(np.maximum(d / scale[k], 1e-9)) for k, d in self.diagonal.items() if np.isfinite(scale[k]) and scale[k] > 0}
        live = list(y)
        for _ in range(most):
            sy = {k: v / scale[k] for k, v in self.dot({k: y[k] for k in live}).items()} if live else {}
            live = [k for k in live if np.abs(y[k] * sy[k] * len(y[k]) - 1.0).max() > tol * len(y[k])]
            if not live:
                break
            grad = {k: sy[k] - 1.0 / (len(y[k]) * y[k]) for k in live}
            step = self.solve({k: -grad[k] * scale[k] for k in live}, {k: scale[k] / (len(y[k]) * y[k] ** 2) for k in live}, 1e-10)
            sd = {k: v / scale[k] for k, v in self.dot(step).items()}
            for k in live:
                t, n = 1.0, len(y[k])
                value = lambda u: 0.5 * (y[k] @ sy[k] + 2 * u * (y[k] @ sd[k]) + u * u * (step[k] @ sd[k])) - np.log(y[k] + u * step[k]).sum() / n  # noqa: B023, E731
                now, slope = 0.5 * y[k] @ sy[k] - np.log(y[k]).sum() / n, grad[k] @ step[k]
                while t > 1e-12 and ((y[k] + t * step[k]).min() <= 0 or value(t) > now + 1e-4 * t * slope + 1e-14 * abs(now)):
                    t /= 2
                y[k] = y[k] + t * step[k]
        out = {k: np.full(len(d), 1.0 / len(d)) for k, d in self.diagonal.items()}
        return out | {k: v / v.sum() for k, v in y.items()}

    def leading(self, count: int = 10, tol: float = 1e-10, most: int = 600, seed: int = 0) -> dict[int, np.ndarray]:
        """The largest eigenvalues by a randomised block Krylov basis, grown until their residuals are below `tol` of the first."""
        rng = np.random.default_rng(seed)
        basis, image, out = {}, {}, {}
        new = {k: np.linalg.qr(rng.standard_normal((len(d), min(count + 8, len(d)))))[0] for k, d in self.diagonal.items()}
        while new:
            product = self.dot(new)
            for k in list(new):
                basis[k] = np.column_stack([basis[k], new[k]]) if k in basis else new[k]
                image[k] = np.column_stack([image[k], product[k]]) if k in image else product[k]
                small = basis[k].T @ image[k]
                value, vector = np.linalg.eigh((small + small.T) / 2)
                top = np.argsort(-value)[:count]
                off = np.linalg.norm(image[k] @ vector[:, top] - (basis[k] @ vector[:, top]) * value[top], axis=0)
                out[k] = value[top]
                fresh = product[k] - basis[k] @ (basis[k].T @ product[k])
                fresh -= basis[k] @ (basis[k].T @ fresh)
                q, r = np.linalg.qr(fresh)
                q = q[:, np.abs(np.diag(r)) > 1e-12 * max(abs(value).max(), 1e-300)]
                if off.max() <= tol * abs(value).max() or basis[k].shape[1] >= min(most, len(basis[k])) or not q.shape[1]:
                    del new[k]
                else:
                    new[k] = q[:, : len(basis[k]) - basis[k].shape[1]]
        return out

    def table(self, values: dict[int, np.ndarray], name: str = "w") -> DataFrame:
        """(keys, asset, value) of one number an asset."""
        flat = [(k, p, float(x)) for k, v in values.items() for p, x in enumerate(v)]
        schema = T.StructType([T.StructField("_k", T.LongType()), T.StructField("_p", T.IntegerType()), T.StructField(name, T.DoubleType())])
        return self.place.select(*self.keys, "_k", "asset", "_p").join(self.spark.createDataFrame(flat, schema), ["_k", "_p"]).select(*self.keys, "asset", name)
