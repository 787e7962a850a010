"""Penalised logistic regressions of all refit dates at once, by a batched Newton method.

One Spark job is one iteration of every refit that hasn't converged. A task reads its rows once and forms, for each
refit that trains on them, loss, gradient and Hessian by matrix products; sums meet by refit, where the small system is
solved and the next point proposed. Rows are never grouped or copied by refit, and only points travel: one short vector
a refit. L1 penalties are proximal steps on the same small matrices. Every 16th refit is solved first and its
solution starts its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .walk import Refits, calendar, matrix, packed, refits, with_all

# fixed values: inverse penalty on the summed loss, and the kind of penalty
LOGITS = {"logit": (1.0, "l2"), "logit_l1": (0.1, "l1")}
COARSE = 16
BLOCK = 256  # refits whose scores of a batch are held at a time
PLACES = 1 << 22  # numbers in the Hessians of the refits that one job treats
TOL = 1e-10
_STATE = "k long, done boolean, objective double, point array<double>, step array<double>, size double"


def _partials(shared, width: int):
    """Sums of loss, gradient and Hessian (upper triangle) of (1, x) over a task's rows, per refit."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, lo, hi, coef = shared.value
        i, j = np.triu_indices(width + 1)
        loss, grad, hess = np.zeros(len(k)), np.zeros((len(k), width + 1)), np.zeros((len(k), len(i)))
        seen = np.zeros(len(k), bool)
        for batch in it:
            x = np.column_stack([np.ones(batch.num_rows), matrix(batch.column("x"), width)])
            pos, y = batch.column("pos").to_numpy(), batch.column("y").to_numpy()
            pairs = x[:, i] * x[:, j]
            for a in range(0, len(k), BLOCK):
                at = slice(a, a + BLOCK)
                use = (pos[:, None] >= lo[at]) & (pos[:, None] < hi[at])
                score = x @ coef[at].T
                p = 1.0 / (1.0 + np.exp(-np.clip(score, -700, 700)))
                loss[at] += np.where(use, np.logaddexp(0.0, score) - y[:, None] * score, 0.0).sum(0)
                grad[at] += np.where(use, p - y[:, None], 0.0).T @ x
                hess[at] += np.where(use, p * (1.0 - p), 0.0).T @ pairs
                seen[at] |= use.any(0)
        if seen.any():
            rows = [pa.array(v[seen].tolist(), t) for v, t in ((k, pa.int64()), (loss, pa.float64()), (grad, pa.list_(pa.float64())), (hess, pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(rows, ["k", "loss", "grad", "hess"])

    return run


def to_raw(mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """The matrix that takes (1, x) to (1, standardised x); its transpose takes coefficients back."""
    t = np.diag(np.concatenate([[1.0], 1.0 / sd]))
    t[1:, 0] = -mean / sd
    return t


def descent(point: np.ndarray, grad: np.ndarray, hess: np.ndarray, penalty: float, kind: str) -> tuple[np.ndarray, float, float]:
    """(direction, expected slope, distance from the optimality conditions) of the penalised mean loss at a point."""
    free = np.concatenate([[0.0], np.full(len(point) - 1, penalty)])  # the intercept is never penalised
    if kind == "l2":
        g = grad + free * point
        step = -np.linalg.lstsq(hess + np.diag(free), g, rcond=None)[0]
        return step, float(g @ step), float(np.abs(g).max())
    off = np.where(point != 0, np.abs(grad + free * np.sign(point)), np.maximum(np.abs(grad) - free, 0.0)).max()
    new = point.copy()
    for _ in range(500):
        move = 0.0
        for n in range(len(new)):
            if hess[n, n] <= 0:
                continue
            rest = hess[n, n] * new[n] - grad[n] - hess[n] @ (new - point)
            value = np.sign(rest) * max(abs(rest) - free[n], 0.0) / hess[n, n]
            move, new[n] = max(move, abs(value - new[n])), value
        if move < 1e-13:
            break
    step = new - point
    return step, float(grad @ step + free @ (np.abs(new) - np.abs(point))), float(off)


def _steps(shared, width: int, kind: str):
    """From the sums of a refit to its next state: accept the proposed point or halve the step towards it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = shared.value
        sums: dict[int, list] = {}
        for batch in it:
            parts = zip(batch.column("k").to_pylist(), batch.column("loss").to_pylist(), matrix(batch.column("grad"), width + 1), matrix(batch.column("hess"), (width + 1) * (width + 2) // 2), strict=True)
            for k, loss, grad, hess in parts:
                old = sums.get(k)
                sums[k] = [loss, grad.copy(), hess.copy()] if old is None else [old[0] + loss, old[1] + grad, old[2] + hess]
        out = []
        i, j = np.triu_indices(width + 1)
        for k, (loss, grad, hess) in sums.items():
            s = states[k]
            t, n = to_raw(s["mean"], s["sd"]), s["n"]
            proposed = s["point"] + s["size"] * s["step"]
            w = proposed[1:]
            value = loss / n + s["penalty"] * (0.5 * float(w @ w) if kind == "l2" else float(np.abs(w).sum()))
            noise = 1e-13 * max(abs(s["objective"]), 1.0) if np.isfinite(s["objective"]) else 0.0  # close to the end, falls are below rounding
            if value <= s["objective"] + 1e-4 * s["size"] * s["slope"] + noise or s["size"] < 1e-8:
                full = np.zeros((width + 1, width + 1))
                full[i, j] = full[j, i] = hess
                step, slope, off = descent(proposed, t @ grad / n, t @ full @ t.T / n, s["penalty"], kind)
                out.append((k, off < TOL or s["size"] < 1e-8, value, proposed.tolist(), [slope, *step.tolist()], 1.0))
            else:
                out.append((k, False, s["objective"], s["point"].tolist(), [s["slope"], *s["step"].tolist()], s["size"] / 2))
        names = [f.split()[0] for f in _STATE.split(", ")]
        types = [pa.int64(), pa.bool_(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], types[c]) for c in range(6)], names)

    return run


def _newton(rows: DataFrame, spans: Refits, width: int, todo: list[int], states: dict[int, dict], kind: str, most: int = 100) -> None:
    """Iterate the states of the refits in `todo` to convergence, one job an iteration for all of them."""
    context = rows.sparkSession.sparkContext
    per_job = max(PLACES // ((width + 1) * (width + 2) // 2), 1)
    for a in range(0, len(todo), per_job):
        live = todo[a : a + per_job]
        for _ in range(most):
            coef = np.array([to_raw(states[k]["mean"], states[k]["sd"]).T @ (states[k]["point"] + states[k]["size"] * states[k]["step"]) for k in live])
            ids = np.array(live, np.int64)
            points = context.broadcast((ids, spans.lo[ids], spans.hi[ids], coef))
            before = context.broadcast({k: states[k] for k in live})
            found = rows.mapInArrow(_partials(points, width), "k long, loss double, grad array<double>, hess array<double>")
            for r in found.repartition("k").mapInArrow(_steps(before, width, kind), _STATE).collect():  # a short vector a refit
                s = states[r.k]
                s["done"], s["objective"], s["point"], s["size"] = r.done, r.objective, np.array(r.point), r.size
                s["slope"], s["step"] = r.step[0], np.array(r.step[1:])
            points.unpersist()
            before.unpersist()
            live = [k for k in live if not states[k]["done"]]
            if not live:
                break


def fits(rows: DataFrame, spans: Refits, features: list[str], model: str, min_rows: int, ddof: int = 1) -> list[dict]:
    """One entry a refit: n, events, rate, and where both classes occur point (intercept first), mean and sd by feature.

    The point belongs to features standardised over the training rows. Refits with fewer than `min_rows` rows are left
    out. `rows` is (pos, y, x) with known y. Sums by date reach the driver, one short row a date.
    """
    inverse, kind = LOGITS[model]
    width = len(features)
    sums = [F.count("*").alias("n"), F.sum("y").alias("events")]
    sums += [F.sum(F.col("x")[c]).alias(f"a{c}") for c in range(width)] + [F.sum(F.col("x")[c] * F.col("x")[c]).alias(f"b{c}") for c in range(width)]
    days = rows.groupBy("pos").agg(*sums).orderBy("pos").collect()
    if not days:
        return []
    pos = np.array([r.pos for r in days])
    total = np.vstack([np.zeros(2 + 2 * width), np.cumsum(np.array([tuple(r)[1:] for r in days], float), axis=0)])
    out, states = [], {}
    for k in range(len(spans.at)):
        n, events, *rest = total[np.searchsorted(pos, spans.hi[k])] - total[np.searchsorted(pos, spans.lo[k])]
        if n < max(min_rows, 1):
            continue
        fit = {"k": k, "n": int(n), "events": float(events), "rate": float(events / n), "point": None, "mean": None, "sd": None}
        out.append(fit)
        if 0 < events < n:
            mean = np.array(rest[:width]) / n
            sd = np.sqrt(np.maximum(np.array(rest[width:]) / n - mean * mean, 0.0) * n / max(n - ddof, 1))
            start = np.zeros(width + 1)
            start[0] = np.log(events / (n - events))
            states[k] = {"n": n, "mean": mean, "sd": np.where(sd > 1e-9, sd, 1.0), "penalty": 1.0 / (inverse * n), "point": start, "step": np.zeros(width + 1), "slope": 0.0,
                         "size": 1.0, "objective": np.inf, "done": False}
    coarse = [k for n, k in enumerate(sorted(states)) if n % COARSE == 0]
    _newton(rows, spans, width, coarse, states, kind)
    fine = [k for k in sorted(states) if not states[k]["done"] and k not in set(coarse)]
    for k in fine:
        near = states[coarse[int(np.searchsorted(coarse, k)) - 1]]
        raw = to_raw(near["mean"], near["sd"]).T @ near["point"]
        states[k]["point"] = np.linalg.solve(to_raw(states[k]["mean"], states[k]["sd"]).T, raw)
    _newton(rows, spans, width, fine, states, kind)
    for fit in out:
        s = states.get(fit["k"])
        if s is not None:
            fit |= {"point": s["point"], "mean": s["mean"], "sd": s["sd"]}
    return out


def walk_forward_logit(wide: DataFrame, features: list[str], model: str = "logit", min_train: int = 120, window: int | None = None, refit_every: int = 1, d: str = "d",
                       ddof: int = 1) -> tuple[DataFrame, DataFrame]:
    """(probabilities, fits) of one logistic regression a refit date over all assets.

    Probabilities are (asset, d, p) for every row from the first refit on; fits are (fit date, n, events, intercept, and
    an array of (feature, beta, mean, sd)), beta on features standardised over the training rows by their sample
    deviation, or with ddof 0 by that of the population. A training set of one class predicts its rate and has no
    betas; one of fewer than half of `min_train` rows predicts nothing. Rows that lack a feature train nothing and have
    a null probability; so have rows without a refit.
    """
    spark = wide.sparkSession
    wide = wide.select("asset", d, "y", *(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in features))
    cal = calendar(wide, d)
    spans = refits(cal.count(), min_train, refit_every, 0, window)
    m = wide.agg(*(F.avg(c) for c in features), *(F.stddev_pop(c) for c in features)).first()
    mid = np.array([x if x is not None else 0.0 for x in m[: len(features)]])
    unit = np.array([x if x else 1.0 for x in m[len(features) :]])  # sums of squares stay well conditioned about the overall mean
    scaled = wide.select("asset", d, "y", *(((F.col(c) - float(a)) / float(b)).alias(c) for c, a, b in zip(features, mid, unit)))
    rows = stored(packed(scaled, cal, features, d))
    found = fits(rows.filter("y is not null"), spans, features, model, min_train // 2, ddof)
    line = lambda f: to_raw(f["mean"], f["sd"]).T @ f["point"]
    terms = [(int(spans.at[f["k"]]), int(spans.until[f["k"]]), f["rate"], *((float(line(f)[0]), line(f)[1:].tolist()) if f["point"] is not None else (None, None))) for f in found]
    use = spark.createDataFrame(terms, "at long, until long, rate double, base double, coef array<double>")
    days = cal.join(use, (F.col("pos") >= F.col("at")) & (F.col("pos") < F.col("until"))).select(d, "rate", "base", "coef")  # a row a date
    score = F.col("base") + F.aggregate(F.zip_with("coef", "x", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    p = F.when(F.col("base").isNull(), F.col("rate")).otherwise(1.0 / (1.0 + F.exp(-score)))
    probs = with_all(wide, cal, min_train, rows.select("asset", d, "x").join(days, d).select("asset", d, p.alias("p")), ["asset", d], d)
    told = [(int(spans.at[f["k"]]), f["n"], f["events"], *((float(f["point"][0]), [(c, float(b), float(a * u + o), float(s * u)) for c, b, a, s, u, o in zip(features, f["point"][1:], f["mean"], f["sd"], unit, mid)])
                                                          if f["point"] is not None else (None, None))) for f in found]
    every = spark.createDataFrame(told, "pos long, n long, events double, intercept double, terms array<struct<feature:string,beta:double,mean:double,sd:double>>")
    return probs.select("asset", d, "p"), every.join(cal, "pos").select(F.col(d).alias("fit"), "n", "events", "intercept", "terms")
