"""Information-theoretic sanitisation of personal data. DataFrame functions only.

Protected entities are the personal data that base patterns find. A term near an entity reveals it as far as
the two occur together more than by chance: their pointwise mutual information over the corpus, against the
information of the entity itself. A term with at least REVEALED of the entity's information is generalised to
its class, and one that only ever occurs in documents of the entity is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
REACH, SUPPORT, REVEALED = 60, 2, 0.8
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Kind -> (pattern, what a text must hold for a search). The patterns match where the published ones do, without
#: backtracking: a search may start in the middle of a run of characters only right after a match. Card numbers
#: ask for the least digits at once, since shorter runs fail as a whole.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@"))),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    "card": (r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12}(?:[\x20-]?[0-9])*+", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]")),
}
TERM = r"[\p{L}\p{Nd}]{3,}"
_SPAN = "struct<kind:string,start:int,stop:int,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    each = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _good(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _passes(kind: str):
    return lambda span: _good(kind, span["value"])


def located(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches: what lies between them and the matches themselves give the places by a running length."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        stop = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), stop.alias("stop"), x["match"].alias("value"))
        return F.struct(stop.alias("at"), F.when(x["match"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    return F.aggregate(F.zip_with(between, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))), start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> dict[str, Column]:
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    return {k: F.when(cue(text), F.filter(located(text, p, k), _passes(k))).otherwise(none) for k, (p, cue) in PATTERNS.items()}


def _entity(span: Column) -> Column:
    """An entity is its kind and its value without case or punctuation of numbers."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def _contexts(text: Column, spans: Column, reach: int) -> Column:
    """Entity, and up to ``reach`` code points on either side of it without the words that they cut."""

    def one(s: Column) -> Column:
        low = F.greatest(s["start"] - reach, F.lit(0))
        left, right = F.substring(text, low + 1, s["start"] - low), F.substring(text, s["stop"] + 1, F.lit(reach))
        lead = F.when(low > 0, F.length(F.regexp_extract(left, r"^[\p{L}\p{Nd}]*", 0))).otherwise(0)
        return F.struct(_entity(s).alias("entity"), (low + lead).alias("left_at"), F.substring(left, lead + 1, F.lit(reach)).alias("left"), s["stop"].alias("right_at"), right.alias("right"), (F.length(text) - s["stop"] > reach).alias("cut"))

    def whole(c: Column) -> Column:
        right = F.when(c["cut"], F.regexp_replace(c["right"], r"[\p{L}\p{Nd}]+$", "")).otherwise(c["right"])
        return F.struct(c["entity"].alias("entity"), c["left_at"].alias("left_at"), c["left"].alias("left"), c["right_at"].alias("right_at"), right.alias("right"))

    return F.transform(F.transform(spans, one), whole)


def _found(docs: DataFrame, reach: int) -> DataFrame:
    """``docs`` with rid, base (all base spans by kind, then place) and contexts."""
    safe = F.coalesce("text", F.lit(""))
    spans = base_spans(F.col("_t"))
    rows = docs.withColumn("_t", safe).withColumns({f"_{k}": c for k, c in spans.items()}).withColumn("base", F.concat(*(f"_{k}" for k in KINDS)))
    none = F.transform(F.expr(f"cast(array() as array<{_SPAN}>)"), lambda s: s)
    return rows.withColumn("contexts", _contexts(F.col("_t"), F.when(F.size("base") > 0, F.col("base")).otherwise(none), reach)).drop("_t", *(f"_{k}" for k in KINDS)).withColumn("rid", F.monotonically_increasing_id())


def _near_terms(found: DataFrame) -> DataFrame:
    """(rid, entity, term, start, stop) of each term near an entity, outside the document's base spans."""
    each = found.where(F.size("contexts") > 0).select("rid", "base", F.explode("contexts").alias("c"))
    sides = each.select("rid", "base", F.col("c.entity").alias("entity"), F.explode(F.array(*(F.struct(F.col(f"c.{s}_at").alias("at"), F.col(f"c.{s}").alias("side")) for s in ("left", "right")))).alias("x"))
    terms = sides.select("rid", "base", "entity", F.col("x.at").alias("at"), F.explode(located(F.col("x.side"), TERM, "term")).alias("s"))
    placed = terms.select("rid", "base", "entity", F.lower("s.value").alias("term"), F.col("s.value").alias("shown"), (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.stop")).alias("stop"))
    clear = ~F.exists("base", lambda b: (b["start"] < F.col("stop")) & (F.col("start") < b["stop"]))
    return placed.where(clear).drop("base")


def _disclosing(docs: DataFrame, near: DataFrame, support: int, revealed: float) -> DataFrame:
    """(entity, term, only) of the terms that reveal an entity; only: the term occurs nowhere else."""
    pairs = near.select("rid", "entity", "term").distinct()
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    # written before they are joined by their key, so that AQE can split a hot entity or term
    entities = stored(near.select("rid", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity")))
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    words = texts.select(F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+"), lambda w: F.length(w) >= 3))).alias("term"))
    terms = stored(words.groupBy("term").agg(F.count("*").alias("n_term")))
    known = together.join(entities, "entity").join(terms, "term")
    total = docs.agg(F.count("*").alias("total"))
    scored = known.withColumn("total", total.scalar())
    shared = F.log(F.col("total") * F.col("both") / (F.col("n_entity") * F.col("n_term")))
    return scored.where((F.col("n_entity") < F.col("total")) & (shared >= revealed * F.log(F.col("total") / F.col("n_entity")))).select("entity", "term", (F.col("both") == F.col("n_term")).alias("only"))


def findings(docs: DataFrame, first: str = "doc_id", reach: int = REACH, support: int = SUPPORT, revealed: float = REVEALED) -> DataFrame:
    """(doc_id, base, terms) for each row of ``docs(doc_id, text)``; ``first`` names the column to keep in place of doc_id.

    base: spans of the base patterns by kind, then place. terms: spans near an entity that reveal it, by place,
    valued [REMOVED], or by their class [NUMBER], [NAME] or [TERM]. Counts of documents cover the whole table:
    a term's over whole texts, and pairs' within ``reach`` code points; pairs in fewer than ``support`` documents
    say nothing. A term only counts where it stands near the entity it reveals, so documents without personal
    data stay as they are.

    Null texts are empty. Repeated rows count as documents of their own. An empty table gives an empty table.
    Other columns are ignored.
    """
    found = stored(_found(docs.select(first, "text"), reach).drop("text"))
    near = stored(_near_terms(found))
    told = _disclosing(docs, near, support, revealed)
    label = F.when(F.col("only"), "[REMOVED]").when(F.col("shown").rlike(r"^\p{Nd}+$"), "[NUMBER]").when(F.col("shown").rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
    hits = near.join(told, ["entity", "term"]).groupBy("rid", "start", "stop").agg(F.max(label).alias("value"))
    terms = hits.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "stop", "value"))).alias("terms"))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    return found.join(terms, "rid", "left").withColumn("terms", F.coalesce("terms", none)).drop("rid", "contexts")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans of `findings`."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with base spans replaced by their kind in brackets and revealing terms removed or generalised.

    Where spans overlap, the earlier and then the longer one is replaced and the others go with it. Null texts stay
    null; n_chars, where present, follows the text; all other columns stay as they are.
    """
    found = findings(docs.select(F.struct("*").alias("row"), "text"), "row", **options)
    order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["stop"] - a["stop"])
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    whole = F.col("row.text")

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "term", F.when(s["value"] == "[REMOVED]", "").otherwise(s["value"])).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        piece = F.substring(whole, acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(piece, mark)).alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out")))

    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(whole, acc["at"] + 1, F.length(whole)))
    text = F.when(F.size("base") + F.size("terms") > 0, F.aggregate(F.array_sort(F.concat("base", "terms"), order), start, step, done)).otherwise(whole)
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return found.select(row.alias("row")).select("row.*")
