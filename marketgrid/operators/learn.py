"""Walk-forward models.

Linear models need only the Gram matrix of (signals, target) over the training rows. Those matrices come from
the same mergeable pair sums as covariances, with one series per signal, so every refit of every asset is one
aggregation followed by a small solve; no training rows are collected. Logistic regressions (`logit`) and trees
(`trees`) of all refits are solved together, one pooled model per refit date over all assets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import win
from .covariance import calendar, chunks, epoch_sums, pair_sums, series_means
from .logit import LOGITS, walk_forward_logit
from .trees import walk_forward_events, walk_forward_trees

__all__ = ["CLASSIFIERS", "GRIDS", "LOGITS", "MODELS", "linear_coefficients", "linear_forecasts", "solve_linear", "walk_forward_classifier", "walk_forward_logit", "walk_forward_trees"]

TARGET = "\x01target"  # sorts before every signal name

# fixed values: parameter grids of the study
GRIDS = {
    "elastic_net": [{"alpha": 0.1, "l1_ratio": 0.5}, {"alpha": 0.1, "l1_ratio": 0.9}, {"alpha": 1.0, "l1_ratio": 0.5}, {"alpha": 1.0, "l1_ratio": 0.9}],
    "ridge": [{"alpha": 10.0}, {"alpha": 100.0}, {"alpha": 1000.0}],
    "random_forest": [{"max_depth": 2, "n_estimators": 150}, {"max_depth": 3, "n_estimators": 150}],
    "gradient_boosting": [{"max_depth": 1, "learning_rate": 0.01, "n_estimators": 100}, {"max_depth": 1, "learning_rate": 0.05, "n_estimators": 100}],
}


def solve_linear(gram: np.ndarray, cross: np.ndarray, n: float, model: str, prm: dict) -> np.ndarray:
    """Coefficients on standardised inputs; `gram` and `cross` are the means of products.

    ridge minimises |y - Xb|^2 + alpha |b|^2; elastic_net |y - Xb|^2 / 2n + alpha (l1 |b|_1 + (1 - l1) |b|^2 / 2).
    """
    k = len(cross)
    if model == "ridge":
        return np.linalg.solve(gram + prm["alpha"] / n * np.eye(k), cross)
    if model == "elastic_net":
        l1, l2 = prm["alpha"] * prm["l1_ratio"], prm["alpha"] * (1.0 - prm["l1_ratio"])
        b = np.zeros(k)
        for _ in range(5000):
            move = 0.0
            for i in range(k):
                rest = cross[i] - gram[i] @ b + gram[i, i] * b[i]
                new = np.sign(rest) * max(abs(rest) - l1, 0.0) / (gram[i, i] + l2)
                move = max(move, abs(new - b[i]))
                b[i] = new
            if move < 1e-12:
                break
        return b
    raise ValueError(f"unknown linear model: {model}")


def linear_coefficients(panel: DataFrame, target: DataFrame, specs: list[tuple[str, str, dict]], min_train: int, refit_every: int,
                        horizon: int = 1, embargo: int = 12, max_features: int = 60, asset: str = "asset", d: str = "d") -> DataFrame:
    """Coefficients per (asset, spec, fit date, signal) from purged expanding windows.

    `panel` is (asset, signal, d, x), `target` is (asset, d, y), `specs` lists (name, model, parameters). A fit
    at row p trains on complete rows before p - horizon - embargo. The output carries what scoring needs:
    coefficient, centre and scale of the signal, mean and sd of the target.
    """
    y = target.select(asset, F.lit(TARGET).alias("series"), d, F.col("y").alias("x"))
    rows = panel.select(asset, F.col("signal").alias("series"), d, "x").unionByName(y)
    cal = calendar(rows, [asset], d)
    known = rows.filter("x is not null")
    width = rows.groupBy(asset, "series").agg(F.lit(1).alias("_o")).groupBy(asset).agg(F.count("*").alias("_w"))
    full = known.groupBy(asset, d).agg(F.count("*").alias("_k")).join(width, asset).filter("_k = _w").select(asset, d)
    train = known.join(full, [asset, d], "left_semi")
    due = (F.col("rn") >= min_train) & ((F.col("rn") - min_train) % refit_every == 0)
    ch = chunks(cal, [asset], due, None, d)
    ch = ch.withColumn("fit", F.lead(d, horizon + embargo).over(win([asset], d)))
    sums = pair_sums(train.join(ch.select(asset, d, "chunk"), [asset, d]), [asset], "series", d, "x", chunk=F.col("chunk"), order=2)
    ep = epoch_sums(sums, ch, [asset], d=d).join(ch.filter("due and fit is not null").select(asset, d, "fit"), [asset, d])
    centre = series_means(train, [asset], "series").select(asset, F.col("series").alias("i"), "_c")
    ep = ep.join(centre, [asset, "i"], "left")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["i"]) | set(pdf["j"]))
        pos = {k: m for m, k in enumerate(names)}
        p = len(names)
        i, j = pdf["i"].map(pos).to_numpy(), pdf["j"].map(pos).to_numpy()
        n = float(pdf["n"].max())
        out = []
        if n >= min_train // 2 and names[0] == TARGET:
            mean = np.zeros(p)
            shift = np.zeros(p)
            own = i == j
            mean[i[own]] = pdf["s10"].to_numpy()[own] / n
            shift[i[own]] = pdf["_c"].to_numpy()[own]
            c = np.zeros((p, p))
            c[i, j] = c[j, i] = pdf["s11"].to_numpy() / n
            c -= np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(c), 0.0))
            y_sd = sd[0] * np.sqrt(n / (n - 1.0))
            y_sd = y_sd if y_sd > 1e-12 else 1.0
            with np.errstate(divide="ignore", invalid="ignore"):
                strength = np.abs(c[0, 1:] / (sd[0] * sd[1:]))
            order = np.argsort(-np.nan_to_num(strength, nan=-1.0), kind="stable")[:max_features] + 1
            scale = np.where(sd[order] > 0, sd[order], 1.0)
            gram = c[np.ix_(order, order)] / np.outer(scale, scale)
            cross = c[order, 0] / (scale * y_sd)
            for name, model, prm in specs:
                b = solve_linear(gram, cross, n, model, prm)
                out.append(pd.DataFrame({"spec": name, "signal": [names[k] for k in order], "b": b, "mx": mean[order] + shift[order], "sx": scale,
                                         "y_mu": mean[0] + shift[0], "y_sd": y_sd, "n_features": len(order)}))
        cols = ["spec", "signal", "b", "mx", "sx", "y_mu", "y_sd", "n_features"]
        res = pd.concat(out) if out else pd.DataFrame(columns=cols)
        res[asset], res["fit"] = pdf[asset].iloc[0], pdf["fit"].iloc[0]
        return res[[asset, "fit", *cols]]

    kind = panel.schema[asset].dataType.simpleString()
    return ep.groupBy(asset, "fit").applyInPandas(
        fit, f"{asset} {kind}, fit date, spec string, signal string, b double, mx double, sx double, y_mu double, y_sd double, n_features int")


def linear_forecasts(panel: DataFrame, coefs: DataFrame, asset: str = "asset", d: str = "d") -> DataFrame:
    """Score each row with the latest fit at or before it; rows that lack a used signal get no forecast."""
    fits = coefs.select(asset, "fit").distinct()
    days = panel.select(asset, d).distinct()
    u = days.withColumn("fit", F.lit(None).cast("date")).withColumn("_l", F.lit(1)).unionByName(fits.select(asset, F.col("fit").alias(d), "fit").withColumn("_l", F.lit(0)))
    live = u.withColumn("fit", F.last("fit", ignorenulls=True).over(Window.partitionBy(asset).orderBy(d, "_l").rowsBetween(Window.unboundedPreceding, 0)))
    live = live.filter("_l = 1 and fit is not null").select(asset, d, "fit")
    j = panel.join(live, [asset, d]).join(coefs, [asset, "fit", "signal"])
    part = F.col("b") * (F.col("x") - F.col("mx")) / F.col("sx")
    g = j.groupBy(asset, "spec", d).agg(F.sum(part).alias("_z"), F.count("x").alias("_k"), F.first("n_features").alias("_n"), F.first("y_mu").alias("_m"), F.first("y_sd").alias("_s"))
    return g.filter("_k = _n").select(asset, "spec", d, (F.col("_z") * F.col("_s") + F.col("_m")).alias("forecast"))


MODELS = ("elastic_net", "ridge", "random_forest", "gradient_boosting", "shallow_tree")
CLASSIFIERS = ("logit", "logit_l1", "random_forest", "gradient_boosting")


def walk_forward_classifier(wide: DataFrame, features: list[str], model: str = "logit", min_train: int = 120, window: int | None = None,
                            refit_every: int = 1, d: str = "d", ddof: int = 1) -> DataFrame:
    """Probability of the event from expanding or rolling fits on the rows before each refit date; (asset, d, p).

    A training set with one class predicts its base rate; one with fewer than half of `min_train` rows predicts
    nothing. Rows that lack a feature train nothing and get a null probability. A window counts dates; `ddof` is that of
    the deviations by which the logits standardise.
    """
    if model in LOGITS:
        return walk_forward_logit(wide, features, model, min_train, window, refit_every, d, ddof)[0]
    return walk_forward_events(wide, features, model, min_train, window, refit_every, d)
