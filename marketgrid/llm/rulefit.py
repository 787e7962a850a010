"""Quality classifier as a sparse rule ensemble.

Statistics of a text are column expressions. Shallow trees grown on labelled rows give rules, the conjunctions along
the paths to their nodes; a lasso logistic regression over the rules as indicators keeps a few of them. The kept
rules and weights are compiled into one column expression, so scoring is a projection: no model object, no Python
worker and no shuffle.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

FIT_ROWS = 50_000  # labelled rows drawn for the fit
TREES, DEPTH, LEAST, LASSO, SEED = 20, 3, 20, 0.002, 7
CUT = 0.3  # a score from here on is predicted good

_BLANK = r"\x20\x09-\x0D"
_HEAD, _TAIL = f"(?<![^{_BLANK}])", f"(?![^{_BLANK}])"
WORD = f"[^{_BLANK}]++"
# counts of matches, stated per word
PER_WORD = {
    "caps": rf"{_HEAD}\p{{Lu}}{{2,}}+(?!\p{{L}})",
    "symbols": r"[#*$%&|<>{}\[\]\\^~=_@]",
    "bangs": r"[!?]",
    "sentences": rf"[.!?]++{_TAIL}",
    "commas": r"[,;:]",
    "bare": rf"{_HEAD}[^{_BLANK}\p{{L}}\p{{N}}]++{_TAIL}",
    "tails": rf"[^{_BLANK}\p{{L}}\p{{N}}]{{2,}}+{_TAIL}",
    "echoes": rf"{_HEAD}({WORD})[{_BLANK}]++(?=\1{_TAIL})",
    "digits": r"\p{N}",
    "upper": r"\p{Lu}",
    "lines": r"\n",
}


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, all doubles; those of a text without words are 0, null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_count(text, F.lit(WORD)).cast("double")
    share = lambda c: F.when(words > 0, c / words).otherwise(0.0)
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return {
        "words": words,
        "chars": share(F.length(text)),
        **{name: share(F.regexp_count(text, F.lit(p))) for name, p in PER_WORD.items()},
        "distinct": share(F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))))),
        "repeated_lines": F.when(F.size(lines) > 0, 1 - F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(0.0),
    }


def with_statistics(rows: DataFrame, text: str, kept: list[str], prefix: str) -> DataFrame:
    """Columns `kept` and the statistics under prefixed names; the texts go no further."""
    return rows.select(*(F.col(f"`{c}`") for c in kept), *(c.cast("double").alias(prefix + n) for n, c in statistics(F.col(f"`{text}`")).items()))


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each (statistic, above, up to) the value is above the one and not above the other."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            c = F.col(prefix + name)
            if low > -math.inf:
                out = out & (c > F.lit(low))
            if high < math.inf:
                out = out & (c <= F.lit(high))
        return out


@dataclass(frozen=True)
class Model:
    """Kept rules with their weights, and the intercept."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, prefix: str = "") -> Column:
        """The chance of a good text as an expression over the statistics."""
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            z = z + F.when(rule.column(prefix), F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _narrowed(path: tuple, name: str, low: float, high: float) -> tuple:
    bounds = dict((n, (a, b)) for n, a, b in path)
    a, b = bounds.get(name, (-math.inf, math.inf))
    bounds[name] = max(a, low), min(b, high)
    return tuple((n, *bounds[n]) for n in sorted(bounds))


def paths(printed: str, names: list[str]) -> list[Rule]:
    """The rule of every node but the roots of printed trees (`toDebugString`), each once, in order of appearance."""
    found: dict[Rule, None] = {}
    open_paths: list[tuple[int, tuple]] = []  # (depth, path) of the branches the line lies in
    for line in printed.splitlines():
        branch = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$", line)
        if not branch:
            if "Predict:" not in line:
                open_paths = []
            continue
        depth, name, value = len(branch[1]), names[int(branch[2])], float(branch[4])
        while open_paths and open_paths[-1][0] >= depth:
            open_paths.pop()
        low, high = (-math.inf, value) if branch[3] == "<=" else (value, math.inf)
        path = _narrowed(open_paths[-1][1] if open_paths else (), name, low, high)
        open_paths.append((depth, path))
        found.setdefault(Rule(path))
    return list(found)


def labels_once(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label 0.0 or 1.0): keys whose labels are null, other values or at odds teach nothing."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key)
    return rows.agg(F.min(label).alias("_a"), F.max(label).alias("_b")).where("_a = _b").select(key, F.col("_a").cast("double").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, trees: int = TREES,
        depth: int = DEPTH, lasso: float = LASSO) -> Model:
    """Learn from the documents whose key has a label.

    About `fit_rows` labelled keys, all if there are fewer, are drawn by a hash of the key; only their texts are read
    for the fit. With one class or no label at all the model is the smoothed share of good labels and has no rules.
    Repeated documents of one key all teach.
    """
    known = stored(labels_once(labels, key, label))
    total = known.count()
    if total > fit_rows:
        known = stored(known.where(F.pmod(F.xxhash64(key, F.lit("draw")), F.lit(1 << 30)) < F.lit(int((1 << 30) * fit_rows / total))))
        total = known.count()
    known = known.select(F.col(key).alias("key"), "label")
    if total <= 2 * fit_rows:  # always but for a freak draw: so many keys are small, and the texts needn't move to them
        known = F.broadcast(known)
    names, prefix = list(statistics(F.lit(""))), "s_"
    rows = stored(with_statistics(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(known, "key"), "text", ["label"], prefix))
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good in (0, n):
        return Model(math.log((good + 1) / (n - good + 1)), ())
    vectors = VectorAssembler(inputCols=[prefix + c for c in names], outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=LEAST, featureSubsetStrategy="onethird", seed=SEED).fit(vectors)
    rules = paths(forest.toDebugString, names)
    if not rules:
        return Model(math.log((good + 1) / (n - good + 1)), ())
    held = stored(rows.select("label", F.array(*(r.column(prefix).cast("double") for r in rules)).alias("held")))
    lines = held.select("label", array_to_vector("held").alias("features"))
    line = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=100).fit(lines)
    return Model(line.intercept, tuple((r, w) for r, w in zip(rules, line.coefficients.toArray().tolist(), strict=True) if w))


def classify(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """Columns of `docs` but the text, then score (0 to 1, higher is better) and predicted (1 from `cut` on, else 0).

    Texts are read whole. Null, empty and blank texts have all statistics 0 and get the score these have. Repeated
    rows are scored each; an empty table gives an empty table. Columns named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    kept, prefix = [c for c in docs.columns if c != text], "s_"
    while any(c.lower().startswith(prefix) for c in kept):
        prefix = f"_{prefix}"
    rows = with_statistics(docs, text, kept, prefix)
    return rows.select(*(F.col(f"`{c}`") for c in kept), model.score(prefix).alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def split_classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for all ``docs(doc_id, text)``; learns where crc32(doc_id as text) mod 5 isn't 0.

    A null doc_id has no remainder: its row isn't held out and isn't learned from.
    """
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit(docs, labels.where(rest != 0), **options)
    return classify(docs.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "text"), model)
