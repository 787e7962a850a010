"""Principal components, forward-rate factors and curve fits: small solves over aggregated or per-panel data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.expr import div, finite, win
from .covariance import cov_of, pair_sums, total
from .curves import bond_excess_returns, forward_rates, pack
from .dates import month_end

# fixed values: indicator blocks and their transforms
GROWTH_BLOCK = {"INDPRO": "yoy", "PAYEMS": "yoy", "UNRATE": "neg_diff12", "HOUST": "yoy", "PERMIT": "yoy", "MANEMP": "yoy", "AWHMAN": "diff12",
                "TCU": "diff12", "UMCSENT": "yoy", "DSPIC96": "yoy"}
PRICE_BLOCK = {"CPIAUCSL": "yoy", "CPILFESL": "yoy", "PPIACO": "yoy", "PCEPI": "yoy", "PCEPILFE": "yoy", "AHETPI": "yoy", "CPIENGSL": "yoy", "CPIUFDSL": "yoy"}


def block_panel(series: DataFrame, specs: DataFrame, by: list[str], x: str = "x", lag: int = 1) -> DataFrame:
    """Month-end indicator panel: each series transformed as its spec says, then lagged one month; (by, series, d, x).

    `specs` is (series, how) with how in yoy, diff12, neg_diff12.
    """
    keys = [*by, "series"]
    m = series.filter(F.col(x).isNotNull()).groupBy(*keys, month_end().alias("d")).agg(F.max_by(x, "d").alias("x"))
    m = m.join(specs, "series")
    w = win(keys)
    base = F.lag("x", 12).over(w)
    tr = F.when(F.col("how") == "yoy", div("x", base) - 1.0).when(F.col("how") == "diff12", F.col("x") - base).when(F.col("how") == "neg_diff12", base - F.col("x"))
    return m.withColumn("_t", tr).select(*keys, "d", F.lag("_t", lag).over(w).alias("x"))


def _pairs(cells: str) -> Column:
    """Every (i, j, xi, xj) with i at or before j of a date's sorted (series, x) cells."""
    n = F.size(cells)
    line = lambda p: F.transform(F.slice(cells, p + 1, n - p), lambda q: F.struct(F.get(cells, p)["series"].alias("i"), q["series"].alias("j"), F.get(cells, p)["x"].alias("xi"), q["x"].alias("xj")))
    return F.explode(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), line)))


def _centred(panel: DataFrame, by: list[str]) -> DataFrame:
    """Known cells about each series' overall mean, which keeps running sums well conditioned and changes no score."""
    known = panel.filter(F.col("x").isNotNull()).select(*by, "series", "d", "x")
    mean = known.groupBy(*by, "series").agg(F.avg("x").alias("_c"))
    return known.join(mean, [*by, "series"]).select(*by, "series", "d", (F.col("x") - F.col("_c")).alias("x"))


def _recursive_moments(panel: DataFrame, by: list[str], min_obs: int, coverage: float, min_cols: int) -> DataFrame:
    """(by, d, n, cells) per date: the covariances of its covered series over the complete dates so far.

    A series is covered where it is known on at least `coverage` of the dates so far. Only a few distinct sets of
    series are ever covered, so each set gets its own running pair sums over its complete dates, and every date
    reads the sums of its set. cells hold (i, j, covariance, mean of i, i on the last complete date).
    """
    dates = panel.select(*by, "d").distinct().withColumn("pos", F.row_number().over(win(by)) - 1)
    x = _centred(panel, by)
    names = x.select(*by, "series").distinct()
    grid = dates.join(names, by).join(x, [*by, "series", "d"], "left")
    seen = F.count("x").over(win([*by, "series"]).rowsBetween(Window.unboundedPreceding, 0))
    held = grid.withColumn("_s", F.when(seen / (F.col("pos") + 1) >= coverage, F.col("series"))).groupBy(*by, "d", "pos").agg(F.sort_array(F.collect_list("_s")).alias("cols"))
    due = held.filter((F.col("pos") >= min_obs) & (F.size("cols") >= min_cols))
    sets = due.select(*by, "cols").distinct()
    cells = x.join(sets.select(*by, "cols", F.explode("cols").alias("series")), [*by, "series"])
    whole = cells.groupBy(*by, "cols", "d").agg(F.sort_array(F.collect_list(F.struct("series", "x"))).alias("_v")).filter(F.size("_v") == F.size("cols"))
    run = win([*by, "cols", "i", "j"]).rowsBetween(Window.unboundedPreceding, 0)
    p = whole.withColumn("_p", _pairs("_v")).select(*by, "cols", "d", "_p.*")
    sums = p.select(*by, "cols", "d", "i", "j", F.col("xi").alias("last"), F.count(F.lit(1)).over(run).alias("n"), F.sum("xi").over(run).alias("si"), F.sum("xj").over(run).alias("sj"), F.sum(F.col("xi") * F.col("xj")).over(run).alias("sij"))
    s = (F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)
    done = sums.filter(F.col("n") >= min_obs).groupBy(*by, "cols", "d", "n").agg(F.collect_list(F.struct("i", "j", s.alias("s"), (F.col("si") / F.col("n")).alias("mi"), "last")).alias("cells"))
    # each date takes its set's latest complete date: one sort of both kinds of rows
    none = F.lit(None)
    both = done.select(*by, "cols", "d", "n", "cells", F.lit(0).alias("_due")).unionByName(due.select(*by, "cols", "d", none.cast("long").alias("n"), none.cast(done.schema["cells"].dataType).alias("cells"), F.lit(1).alias("_due")))
    back = Window.partitionBy(*by, "cols").orderBy("d", "_due").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("n", F.last("n", ignorenulls=True).over(back)).withColumn("cells", F.last("cells", ignorenulls=True).over(back))
    return filled.filter("_due = 1 and cells is not null").select(*by, "d", "n", "cells")


def _eigen(cells, min_cols: int):
    """(names, shares descending, vectors in columns, standardised last row) of one date's moments, or None."""
    names = sorted({r["i"] for r in cells})
    at = {k: m for m, k in enumerate(names)}
    cov, mean, last = np.zeros((len(names), len(names))), np.zeros(len(names)), np.zeros(len(names))
    for r in cells:
        i, j = at[r["i"]], at[r["j"]]
        cov[i, j] = cov[j, i] = r["s"]
        if i == j:
            mean[i], last[i] = r["mi"], r["last"]
    live = np.diag(cov) > 1e-24
    if live.sum() < min_cols:
        return None
    sd = np.sqrt(np.diag(cov)[live])
    vals, vecs = np.linalg.eigh(cov[np.ix_(live, live)] / np.outer(sd, sd))
    return np.array(names)[live], vals[::-1], vecs[:, ::-1], (last[live] - mean[live]) / sd


def _score(load: np.ndarray, value: float, z: np.ndarray, n: int) -> float:
    """The last row on a component, in units of the component's own deviation, which its eigenvalue gives."""
    return float(z @ load / (np.sqrt(max(value, 0.0) * (n - 1) / n) + 1e-12))


def _per_date(moments: DataFrame, by: list[str], fields: list[str], solve) -> DataFrame:
    """One small eigenproblem per row; `solve(cells, n)` gives the fields or None."""
    keys = [*by, "d"]
    schema = T.StructType([moments.schema[k] for k in keys] + [T.StructField(k, T.DoubleType()) for k in fields])

    def run(batches):
        for pdf in batches:
            rows = [(*k, *v) for *k, n, cells in pdf[[*keys, "n", "cells"]].itertuples(index=False) if (v := solve(cells, n)) is not None]
            yield pd.DataFrame(rows, columns=[*keys, *fields])

    return moments.mapInPandas(run, schema)


def recursive_pc1(panel: DataFrame, by: list[str], min_obs: int = 60, coverage: float = 0.6) -> DataFrame:
    """Per date, the last score of the first component of the history so far, in units of its own sd; (by, d, score)."""

    def solve(cells, n):
        e = _eigen(cells, 2)
        if e is None:
            return None
        _, vals, vecs, z = e
        load = vecs[:, 0]
        return (_score(load if load.sum() >= 0 else -load, vals[0], z, n),)

    return _per_date(_recursive_moments(panel, by, min_obs, coverage, 2), by, ["score"], solve)


def recursive_pc12(panel: DataFrame, by: list[str], growth: list[str], prices: list[str], min_obs: int = 60, coverage: float = 0.6) -> DataFrame:
    """Two joint components per date, named after the block that carries more of their loadings; none when both land on one block."""

    def solve(cells, n):
        e = _eigen(cells, 4)
        if e is None:
            return None
        names, vals, vecs, z = e
        sides = {"growth": np.isin(names, growth), "inflation": np.isin(names, prices)}
        score = {}
        for load, value in zip(vecs[:, :2].T, vals[:2], strict=True):
            heavy = {k: np.abs(load[m]).sum() for k, m in sides.items()}
            side = "growth" if heavy["growth"] > heavy["inflation"] else "inflation"
            flip = -1.0 if load[sides[side]].sum() < 0 else 1.0
            score[side] = _score(flip * load, value, z, n)
        return (score["growth"], score["inflation"], float(vals[:2].sum() / vals.sum())) if len(score) == 2 else None

    return _per_date(_recursive_moments(panel, by, min_obs, coverage, 4), by, ["growth", "inflation", "explained"], solve)


def variance_explained(panel: DataFrame, by: list[str]) -> DataFrame:
    """Full-sample shares of the first two components of each standardised block, complete rows."""
    x = _centred(panel, by)
    width = panel.select(*by, "series").distinct().groupBy(*by).agg(F.count("*").alias("n_series"))
    rows = x.groupBy(*by, "d").agg(F.sort_array(F.collect_list(F.struct("series", "x"))).alias("_v")).join(width, by).filter(F.size("_v") == F.col("n_series"))
    p = rows.withColumn("_p", _pairs("_v")).select(*by, "n_series", "_p.*")
    sums = p.groupBy(*by, "n_series", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("xi", "xj").alias("s"))
    cells = sums.groupBy(*by, "n_series", "n").agg(F.collect_list(F.struct("i", "j", "s", F.lit(0.0).alias("mi"), F.lit(0.0).alias("last"))).alias("cells"))
    schema = T.StructType([panel.schema[k] for k in by] + [T.StructField("n_series", T.LongType()), T.StructField("n_months", T.LongType()), T.StructField("pc1_share", T.DoubleType()), T.StructField("pc2_share", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            out = []
            for *k, series, n, cell in pdf[[*by, "n_series", "n", "cells"]].itertuples(index=False):
                if (e := _eigen(cell, 2)) is not None:
                    out.append((*k, series, n, e[1][0] / e[1].sum(), e[1][1] / e[1].sum()))
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return cells.mapInPandas(run, schema)


# ---- forward-rate factor ----


def _cp_inputs(curve: DataFrame, maturities, horizon: int) -> DataFrame:
    """(curve, d, array of the five forwards, mean excess return)."""
    f = forward_rates(curve).groupBy("curve", "d").agg(F.array_sort(F.collect_list(F.struct("n", "f"))).alias("_f")).select("curve", "d", F.col("_f.f").alias("f"))
    y = bond_excess_returns(curve, maturities, horizon).groupBy("curve", "d").agg(F.avg("rx").alias("y"))
    return f.join(y, ["curve", "d"])


def _moment_columns(over=None) -> list[Column]:
    """Running or total sums for the regression on the five forwards: count, sums, products."""
    wrap = (lambda e: e.over(over)) if over is not None else (lambda e: e)
    ok = F.col("y").isNotNull()
    v = [F.when(ok, F.col("f")[k]) for k in range(5)] + [F.when(ok, F.col("y"))]
    out = [wrap(F.count(v[5])).cast("double").alias("n")]
    out += [wrap(F.sum(e)).alias(f"s{k}") for k, e in enumerate(v)]
    out += [wrap(F.sum(v[a] * v[b])).alias(f"p{a}{b}") for a in range(6) for b in range(a, 6)]
    return out


def _solve_moments(pdf: pd.DataFrame) -> np.ndarray:
    """Intercept and slopes per row of moment sums; all rows solved in one batched call."""
    n = pdf["n"].to_numpy()[:, None]
    s = pdf[[f"s{k}" for k in range(6)]].to_numpy() / n
    c = np.empty((len(pdf), 6, 6))
    for a in range(6):
        for b in range(a, 6):
            c[:, a, b] = c[:, b, a] = pdf[f"p{a}{b}"].to_numpy() / n[:, 0] - s[:, a] * s[:, b]
    slope = np.einsum("rij,rj->ri", np.linalg.pinv(c[:, :5, :5]), c[:, :5, 5])
    return np.column_stack([s[:, 5] - np.einsum("ri,ri->r", slope, s[:, :5]), slope])


def cp_factor(curve: DataFrame, maturities=(2, 3, 4, 5), horizon: int = 12) -> tuple[DataFrame, DataFrame]:
    """In-sample single factor: (curve, d, factor) and (curve, gamma, r2)."""
    x = _cp_inputs(curve, maturities, horizon)
    m = x.groupBy("curve").agg(*_moment_columns(), F.var_pop("y").alias("vy"))
    schema = T.StructType([x.schema["curve"], T.StructField("gamma", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"curve": pdf["curve"], "gamma": list(_solve_moments(pdf))})

    gamma = m.mapInPandas(run, schema)
    scored = x.join(gamma, "curve")
    fit = F.col("gamma")[0] + sum((F.col("gamma")[k + 1] * F.col("f")[k] for k in range(5)), F.lit(0.0))
    scored = scored.withColumn("factor", fit)
    used = F.col("y").isNotNull()
    r2 = scored.filter(used).groupBy("curve").agg((1.0 - F.avg(F.pow(F.col("y") - F.col("factor"), 2)) / F.var_pop("y")).alias("r2"))
    return scored.select("curve", "d", "factor"), gamma.join(r2, "curve")


def cp_factor_expanding(curve: DataFrame, maturities=(2, 3, 4, 5), horizon: int = 12, min_obs: int = 120) -> DataFrame:
    """The factor with coefficients from outcomes already realised: rows before i - horizon, at least `min_obs`.

    Running sums give every date's moments in one pass; the 6x6 systems are solved in Arrow batches.
    """
    x = _cp_inputs(curve, maturities, horizon)
    w = Window.partitionBy("curve").orderBy("d")
    past = w.rowsBetween(Window.unboundedPreceding, -(horizon + 1))
    m = x.select("curve", "d", "f", "y", (F.row_number().over(w) - 1).alias("rn")).select("curve", "d", "f", "rn", *_moment_columns(past))
    m = m.filter((F.col("n") >= min_obs) & (F.col("rn") >= min_obs)).drop("rn")
    schema = T.StructType([x.schema["curve"], x.schema["d"], T.StructField("factor", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                g = _solve_moments(pdf)
                f = np.stack(pdf["f"].to_numpy())
                yield pd.DataFrame({"curve": pdf["curve"], "d": pdf["d"], "factor": g[:, 0] + np.einsum("ri,ri->r", g[:, 1:], f)})

    return m.mapInPandas(run, schema)


# ---- curve components ----


def curve_pca(curve: DataFrame, n_components: int = 3, zero: str = "zero") -> tuple[DataFrame, DataFrame]:
    """Components of the changes of zero rates: loadings (curve, pc, tenor, loading, share) and scores (curve, d, pc, score).

    The covariance of tenors comes from pair sums; one small eigenproblem per curve; scores are a sum over tenors.
    """
    w = Window.partitionBy("curve", "tenor").orderBy("d")
    ch = curve.select("curve", "d", "tenor", (F.col(zero) - F.lag(zero).over(w)).alias("x")).filter("x is not null")
    ch = ch.withColumn("asset", F.format_string("%012.6f", "tenor"))
    cov = total(pair_sums(ch, ["curve"], order=2), ["curve"]).select("curve", "i", "j", cov_of().alias("s"))

    def eigen(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["i"]) | set(pdf["j"]))
        pos = {k: n for n, k in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        a, b = pdf["i"].map(pos), pdf["j"].map(pos)
        m[a, b] = m[b, a] = pdf["s"]
        vals, vecs = np.linalg.eigh(m)
        ten = np.array([float(k) for k in names])
        out = []
        for k in range(n_components):
            v = vecs[:, -1 - k]
            # level up on average, slope up at the long end, curvature up at the median tenor
            anchor = v.mean() if k == 0 else v[-1] if k == 1 else v[np.argmin(np.abs(ten - np.median(ten)))] if k == 2 else 1.0
            out.append(pd.DataFrame({"curve": pdf["curve"].iloc[0], "pc": k + 1, "tenor": ten, "loading": v * (-1.0 if anchor < 0 else 1.0), "share": vals[-1 - k] / vals.sum()}))
        return pd.concat(out)

    load = cov.groupBy("curve").applyInPandas(eigen, "curve string, pc int, tenor double, loading double, share double")
    mean = ch.groupBy("curve", "tenor").agg(F.avg("x").alias("_m"))
    # loadings carry the tenor through its name, so join on the rounded value
    key = F.round("tenor", 6).alias("_k")
    cx = ch.join(mean, ["curve", "tenor"]).select("curve", "d", key, (F.col("x") - F.col("_m")).alias("_x"))
    scores = cx.join(load.select("curve", "pc", key, "loading"), ["curve", "_k"]).groupBy("curve", "d", "pc").agg(F.sum(F.col("_x") * F.col("loading")).alias("score"))
    return load, scores


# fixed values: economic bounds on the four coefficients, in percent
BETA_LOW, BETA_HIGH = (0.0, -20.0, -30.0, -30.0), (20.0, 20.0, 30.0, 30.0)


def _boxed(gram: np.ndarray, cross: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least squares in a box, many small systems at once, by primal active sets from a feasible start.

    The coefficients off the box are solved exactly; a step that would leave it stops at its first wall, which becomes
    active; a full step gives up the active wall whose gradient points inside the most, or ends.
    """
    x, todo = start.copy(), np.arange(len(start))
    fixed = (x <= lo) | (x >= hi)
    for _ in range(40):
        g, k, v, held = gram[todo], cross[todo], x[todo], fixed[todo]
        right = np.where(held, v, k - np.einsum("gij,gj->gi", g, np.where(held, v, 0.0)))
        only = np.where(~held[:, :, None] & ~held[:, None, :], g, np.eye(4) * held[:, :, None])
        goal = (np.linalg.pinv(only, hermitian=True) @ right[..., None])[..., 0]
        move = np.where(held, 0.0, goal - v)
        wall = np.where(move < 0, lo, hi)
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(move != 0, (wall - v) / move, np.inf)
        far = np.minimum(room.min(axis=1), 1.0)
        hit = (room <= far[:, None]) & (far[:, None] < 1.0)
        v = np.where(hit, wall, np.clip(v + far[:, None] * move, lo, hi))
        slope = k - np.einsum("gij,gj->gi", g, v)
        inward = np.where(held & (far[:, None] >= 1.0), np.where(v <= lo, slope, -slope), 0.0)
        worst = inward.argmax(axis=1)
        loose = inward[np.arange(len(v)), worst] > 1e-12
        held = held | hit
        held[np.flatnonzero(loose), worst[loose]] = False
        x[todo], fixed[todo] = v, held
        todo = todo[loose | (far < 1.0)]
        if not len(todo):
            break
    return x


def _bounded_fit(basis: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Box-bounded least squares for stacks of bases (dates, grid, tenors, 4) on curves (dates, tenors).

    Gives coefficients (dates, grid, 4) and squared errors (dates, grid). Unbounded solutions inside the box stand;
    the rest are solved by active sets.
    """
    lo, hi = np.array(BETA_LOW), np.array(BETA_HIGH)
    gram = np.swapaxes(basis, -1, -2) @ basis
    cross = (np.swapaxes(basis, -1, -2) @ y[:, None, :, None])[..., 0]
    b = (np.linalg.pinv(gram, hermitian=True) @ cross[..., None])[..., 0]
    out = ((b < lo) | (b > hi)).any(axis=-1)
    if out.any():
        b[out] = _boxed(gram[out], cross[out], np.clip(b[out], lo, hi), lo, hi)
    err = (((basis @ b[..., None])[..., 0] - y[:, None, :]) ** 2).sum(axis=-1)
    return b, err


def _zoomed_fit(m: np.ndarray, y: np.ndarray, levels: int, width: int) -> np.ndarray:
    """(dates, 7): the four coefficients, both decays and the rmse of curves y (dates, tenors) on tenors m.

    All dates move together: every level solves their stacked grids at once and narrows each date's own box.
    """
    low, high = np.array([0.1, 1.0]), np.array([10.0, 30.0])
    box_lo, box_hi = np.tile(low, (len(y), 1)), np.tile(high, (len(y), 1))
    steps = np.linspace(0, 1, width)
    best = np.full((len(y), 7), np.inf)
    rows = np.arange(len(y))
    for _ in range(levels):
        grid = box_lo[:, None, :] * (box_hi / box_lo)[:, None, :] ** steps[None, :, None]
        t1, t2 = np.repeat(grid[:, None, :, 0], width, 1).reshape(len(y), -1), np.repeat(grid[:, :, None, 1], width, 2).reshape(len(y), -1)
        x1, x2 = m / t1[..., None], m / t2[..., None]
        s1, s2 = (1 - np.exp(-x1)) / x1, (1 - np.exp(-x2)) / x2
        b, err = _bounded_fit(np.stack([np.ones_like(x1), s1, s1 - np.exp(-x1), s2 - np.exp(-x2)], axis=-1), y)
        err = np.where(t2 - t1 >= 0.5, err, np.inf)
        k = err.argmin(axis=1)
        found = np.column_stack([b[rows, k], t1[rows, k], t2[rows, k], err[rows, k]])
        best = np.where((found[:, 6] < best[:, 6])[:, None], found, best)
        ratio = (box_hi / box_lo) ** (1.5 / (width - 1))
        box_lo, box_hi = np.maximum(best[:, 4:6] / ratio, low), np.minimum(best[:, 4:6] * ratio, high)
    best[:, 6] = np.sqrt(best[:, 6] / len(m))
    return best


def svensson_fit_grid(curve: DataFrame, value: str = "zero", levels: int = 4, width: int = 12, min_points: int = 6, stack: int = 64) -> DataFrame:
    """Best decay pair and coefficients per curve date by a refined grid; (curve, d, beta0..3, tau1, tau2, rmse).

    Dates are independent rows; those of an Arrow batch with the same tenors are solved together, `stack` at a time.
    """
    p = pack(curve.filter(F.col(value).isNotNull()), value)
    names = ("beta0", "beta1", "beta2", "beta3", "tau1", "tau2", "rmse")
    schema = T.StructType([p.schema["curve"], p.schema["d"]] + [T.StructField(k, T.DoubleType()) for k in names])

    def run(batches):
        for pdf in batches:
            pdf = pdf[pdf["ten"].map(len) >= min_points]
            for tenors, same in pdf.groupby(pdf["ten"].map(tuple), sort=False):
                for at in range(0, len(same), stack):
                    part = same.iloc[at : at + stack]
                    fit = _zoomed_fit(np.array(tenors, float), np.array(part["ys"].tolist(), float), levels, width)
                    yield pd.DataFrame({"curve": part["curve"].to_numpy(), "d": part["d"].to_numpy(), **dict(zip(names, fit.T, strict=True))})

    return p.mapInPandas(run, schema)


# ---- adaptive window choice ----


def _ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their mean."""
    _, place, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2.0)[place]


def _trailing_ic(keys: list[str], burn_in: int, step: int, window: int, horizon: int, min_pairs: int):
    """Rank correlation of signal and forward return before each choice of one stretch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        rn, x, y = (pdf[c].to_numpy() for c in ("rn", "x", "y"))
        first = int(pdf["_b"].iloc[0]) * window
        at = np.arange(max(burn_in, first + (burn_in - first) % step), first + window, step)
        out = []
        for g in at:
            lo, hi = np.searchsorted(rn, [g - window, g - horizon])
            if hi - lo < min_pairs:
                continue
            a, b = _ranks(x[lo:hi]), _ranks(y[lo:hi])
            a, b = a - a.mean(), b - b.mean()
            size = np.sqrt((a @ a) * (b @ b))
            if size > 0:
                out.append((g, a @ b / size))
        res = pd.DataFrame(out, columns=["rn", "ic"])
        for k in keys:
            res[k] = pdf[k].iloc[0]
        return res[[*keys, "rn", "ic"]]

    return run


def adaptive_choice(cand: DataFrame, returns: DataFrame, by: list[str], burn_in: int, step: int = 21, window: int = 1260, horizon: int = 1, min_pairs: int = 252) -> DataFrame:
    """Candidate with the highest trailing rank correlation with the forward return, re-chosen every `step` rows.

    `cand` is (by, asset, d, pos, candidate, x), `returns` (by, asset, d, r). Output (by, asset, d, candidate) on every
    live date. A long history is split into stretches of `window` rows; each row goes to two of them, however many choices
    look back on it. Ties and dates without any correlation go to the first candidate.
    """
    w = win([*by, "asset"])
    f = returns.withColumn("rn", F.row_number().over(w) - 1)
    if horizon == 1:
        f = f.withColumn("fwd", F.lead("r").over(w))
    else:
        ahead = w.rowsBetween(1, horizon)
        f = f.withColumn("fwd", F.when(F.count("r").over(ahead) == horizon, F.sum("r").over(ahead)))
    j = cand.join(f.select(*by, "asset", "d", "rn", "fwd"), [*by, "asset", "d"])
    keys = [*by, "asset", "pos", "candidate"]
    # the choices of a stretch of `window` rows read that stretch and the one before
    pairs = j.select(*keys, "rn", finite("x").alias("x"), finite("fwd").alias("y")).filter("x is not null and y is not null")
    stretch = F.floor(F.col("rn") / window)
    halves = pairs.select("*", F.explode(F.array(stretch, stretch + 1)).alias("_b"))
    schema = pairs.select(*keys, "rn").schema.add("ic", "double")
    scored = halves.groupBy(*keys, "_b").applyInPandas(_trailing_ic(keys, burn_in, step, window, horizon, min_pairs), schema).withColumn("ic", F.round("ic", 12))  # below that, candidates tie
    due = j.filter((F.col("rn") >= burn_in) & ((F.col("rn") - burn_in) % step == 0)).select(*keys, "rn")
    ic = due.join(scored, [*keys, "rn"], "left")
    score = F.struct(F.coalesce(F.col("ic"), F.lit(float("-inf"))).alias("ic"), (-F.col("pos")).alias("p"), F.col("candidate"))
    pick = ic.groupBy(*by, "asset", "rn").agg(F.max(score).alias("_b")).select(*by, "asset", "rn", F.col("_b.candidate").alias("candidate"))
    live = f.filter(F.col("rn") >= burn_in).select(*by, "asset", "d", "rn")
    wide = live.join(pick, [*by, "asset", "rn"], "left")
    return wide.withColumn("candidate", F.last("candidate", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("rn")
