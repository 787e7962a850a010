"""Hierarchical risk parity from the pair table, without a matrix in any task.

Single linkage is the minimum spanning tree of the distances. Borůvka rounds find it: each component picks its least
edge, joined components become one, and between two components only the least edge stays, so the pair table shrinks by
four or more a round. The tree, one edge an asset, gives the order of the leaves. Bisection then needs sums of the pair
table by the smallest range that holds both leaves, rolled up to the ranges around it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

BITS = 48  # levels that a leaf's path may have



def _roots(keys: list[str]):
    """Component that each old component becomes part of when every one is joined along its chosen edge."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, o = pdf["c"].to_numpy(), pdf["o"].to_numpy()
        place = np.searchsorted(np.sort(c), o)
        order = np.argsort(c)
        up = order[place]  # row of the component that the edge leads to
        mutual = up[up] == np.arange(len(c))  # two that chose each other: the one with the smaller name stays
        up = np.where(mutual & (c < o), np.arange(len(c)), up)
        while True:
            far = up[up]
            if (far == up).all():
                break
            up = far
        out = pdf[[*keys, "c"]].copy()
        out["root"] = c[up]
        return out

    return run


def spanning_tree(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, w, i, j): least spanning tree of each key's complete graph `pairs(keys, i, j, w)` with i before j.

    Equal distances go by (i, j), so the tree is unique. A task of the labelling sees one row an asset.
    """
    edges = pairs.select(*keys, F.col("i").alias("a"), F.col("j").alias("b"), F.struct("w", "i", "j").alias("e"))
    tree = None
    label = pairs.select(*keys, F.col("i").alias("c"), F.col("i").alias("root")).schema
    while True:
        sides = edges.select(*keys, F.col("a").alias("c"), F.struct("e", F.col("b").alias("o")).alias("m")).unionByName(edges.select(*keys, F.col("b").alias("c"), F.struct("e", F.col("a").alias("o")).alias("m")))
        best = stored(sides.groupBy(*keys, "c").agg(F.min("m").alias("m")).select(*keys, "c", "m.e", "m.o"))
        if best.isEmpty():
            break
        chosen = best.select(*keys, "e.*").distinct()
        tree = chosen if tree is None else tree.unionByName(chosen)
        lab = stored(best.select(*keys, "c", "o").groupBy(*keys).applyInPandas(_roots(keys), label))
        to = lambda side: lab.select(*keys, F.col("c").alias(side), F.col("root").alias(f"_{side}"))
        edges = edges.join(to("a"), [*keys, "a"]).join(to("b"), [*keys, "b"]).filter("_a <> _b")
        edges = stored(edges.groupBy(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("e").alias("e")))
    return tree if tree is not None else pairs.select(*keys, "w", "i", "j").limit(0)


def bisection(n: int) -> tuple[list[list[int]], list[list[int]], list[int]]:
    """For each of n places: the starts of the ranges around it from the whole down to itself, the starts of the ranges
    beside them, and its path as bits from the top, all under halving with the smaller half on the left."""
    starts, beside, codes = [], [], []
    for p in range(n):
        a, size, own, other, code, depth = 0, n, [0], [], 0, 0
        while size > 1:
            half = size // 2
            right = p >= a + half
            other.append(a if right else a + half)
            a, size = (a + half, size - half) if right else (a, half)
            own.append(a)
            code, depth = code * 2 + right, depth + 1
        starts.append(own)
        beside.append(other)
        codes.append(code << (BITS - depth))
    return starts, beside, codes


def _leaves(keys: list[str]):
    """Order of a key's assets, the cluster formed earlier on the left, with the bisection of their places."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf.loc[pdf["j"].isna(), "i"])
        tree = pdf[pdf["j"].notna()].sort_values(["w", "i", "j"], kind="stable")
        at = {k: n for n, k in enumerate(names)}
        n = len(names)
        home, identity, after, head, tail = list(range(n)), list(range(n)), [-1] * n, list(range(n)), list(range(n))

        def find(x: int) -> int:
            while home[x] != x:
                home[x] = home[home[x]]
                x = home[x]
            return x

        fresh = n
        for i, j in zip(tree["i"], tree["j"]):
            a, b = sorted((find(at[i]), find(at[j])), key=lambda x: identity[x])
            after[tail[a]] = head[b]
            home[b], tail[a], identity[a] = a, tail[b], fresh
            fresh += 1
        order, x = [], head[find(0)]
        while x >= 0:
            order.append(x)
            x = after[x]
        starts, beside, codes = bisection(n)
        out = pd.DataFrame({"asset": [names[x] for x in order], "place": range(n), "code": codes, "starts": starts, "beside": beside})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "asset", "place", "code", "starts", "beside"]]

    return run


def hrp(cov: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, asset, w) of hierarchical risk parity on the upper triangle `cov(keys, i, j, s)` of each key's matrix."""
    cov = stored(cov.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("s").cast("double").alias("s")))
    own = stored(cov.filter("i = j").select(*keys, F.col("i").alias("asset"), F.col("s").alias("v")))
    side = lambda k: own.select(*keys, F.col("asset").alias(k), F.col("v").alias(f"v{k}"))
    full = cov.join(side("i"), [*keys, "i"]).join(side("j"), [*keys, "j"])
    rho = F.greatest(F.least(F.col("s") / F.sqrt(F.col("vi") * F.col("vj")), F.lit(1.0)), F.lit(-1.0))
    tree = spanning_tree(full.filter("i <> j").select(*keys, "i", "j", F.sqrt(F.greatest((1.0 - rho) / 2.0, F.lit(0.0))).alias("w")), keys)
    kind = cov.schema["i"].dataType.simpleString()
    rows = tree.select(*keys, "i", "j", "w").unionByName(own.select(*keys, F.col("asset").alias("i"), F.lit(None).cast(kind).alias("j"), F.lit(None).cast("double").alias("w")))
    schema = own.select(*keys, "asset").schema.add("place", "integer").add("code", "long")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    leaf = stored(rows.groupBy(*keys).applyInPandas(_leaves(keys), f"{fields}, starts array<int>, beside array<int>").join(own, [*keys, "asset"]))
    # smallest range with both leaves: as many levels as their paths agree
    end = lambda k: leaf.select(*keys, F.col("asset").alias(k), F.col("code").alias(f"c{k}"), F.col("starts").alias(f"s{k}"))
    j = full.join(end("i"), [*keys, "i"]).join(end("j").drop("sj"), [*keys, "j"])
    level = F.when(F.col("i") == F.col("j"), F.size("si") - 1).otherwise(BITS - F.length(F.bin(F.col("ci").bitwiseXOR(F.col("cj")))))
    term = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0) * F.col("s") / (F.col("vi") * F.col("vj"))
    j = j.select(*keys, level.alias("level"), "si", term.alias("x"))
    node = stored(j.groupBy(*keys, "level", F.element_at("si", F.col("level") + 1).alias("start")).agg(F.sum("x").alias("x")))
    around = node.join(leaf.select(*keys, F.col("place").alias("start"), "starts"), [*keys, "start"]).select(*keys, "x", F.posexplode(F.slice("starts", F.lit(1), F.col("level") + 1)).alias("level", "start"))
    inverse = leaf.select(*keys, (1.0 / F.col("v")).alias("q"), F.posexplode("starts").alias("level", "start")).groupBy(*keys, "level", "start").agg(F.sum("q").alias("q"))
    variance = around.groupBy(*keys, "level", "start").agg(F.sum("x").alias("x")).join(inverse, [*keys, "level", "start"])
    variance = stored(variance.select(*keys, "level", "start", (F.col("x") / (F.col("q") * F.col("q"))).alias("var")))
    step = leaf.select(*keys, "asset", F.posexplode(F.arrays_zip(F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))).alias("a"), F.col("beside").alias("b"))).alias("level", "p"))
    step = step.select(*keys, "asset", (F.col("level") + 1).alias("level"), F.col("p.a").alias("start"), F.col("p.b").alias("_b"))
    step = step.join(variance, [*keys, "level", "start"]).join(variance.select(*keys, "level", F.col("start").alias("_b"), F.col("var").alias("_var")), [*keys, "level", "_b"])
    both = F.col("var") + F.col("_var")
    share = step.groupBy(*keys, "asset").agg(F.product(F.when(both > 0, F.col("_var") / both).otherwise(0.5)).alias("w"))
    raw = own.select(*keys, "asset").join(share, [*keys, "asset"], "left").withColumn("w", F.coalesce("w", F.lit(1.0)))  # a single asset has no split
    return raw.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(*keys)))
