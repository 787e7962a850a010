"""Registered queries of the text operators, each over its whole tables, with SQL checks where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, infill, langid, licenses, neardup, packing, preference, quality, ranked, rulefit, sanitise, secrets, warc
from .common import table

TOKENIZER = "byte_bpe_50k.tiktoken"  # the same vocabulary as byte_bpe_50k.json, as ranks
ADDED = "byte_bpe_50k.json"  # it alone holds the added tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"


@query(
    "op8_near_duplicates",
    rf"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
    items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 75 * (a.n + b.n - COUNT(*))),
    reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
    lowest AS (SELECT u, MIN(v) AS component_id FROM reach GROUP BY u)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM sets JOIN lowest ON u = doc_id""",
)
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


_ITEM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


@query(
    "op1_decontamination",
    rf"""
    WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ITEM_WORDS}) AS w FROM benchmark),
    wins AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
             FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item, w, least(len(w), 10) AS k FROM items WHERE len(w) > 0))),
    docs AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_ITEM_WORDS}), []) AS w FROM documents),
    grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
              FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)),
    hits AS (SELECT doc_id, i, k, item FROM grams JOIN wins USING (k, g)),
    hit AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
    seen AS (SELECT t, COUNT(*) AS n FROM (SELECT unnest(list_distinct(w)) AS t FROM docs) GROUP BY t),
    rare AS (SELECT item, t FROM (SELECT item, t, row_number() OVER (PARTITION BY item ORDER BY coalesce(n, 0), t) AS r
             FROM (SELECT DISTINCT item, unnest(w) AS t FROM items) LEFT JOIN seen USING (t)) WHERE r <= 4),
    needed AS (SELECT item, COUNT(*) AS need FROM rare GROUP BY item),
    posts AS (SELECT doc_id, item, t, p FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM docs) JOIN rare USING (t)),
    close AS (SELECT DISTINCT a.doc_id, a.item FROM posts a JOIN posts b ON a.doc_id = b.doc_id AND a.item = b.item AND b.p BETWEEN a.p AND a.p + 19 JOIN needed ON needed.item = a.item
              GROUP BY a.doc_id, a.item, a.p, need HAVING COUNT(DISTINCT b.t) = need),
    near AS (SELECT doc_id, COUNT(*) AS n_near FROM close GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
    FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)""",
)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.summary(decontam.matches(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query(
    "op3_warc",
    """
    WITH rows AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
    keyed AS (SELECT page_id, octet_length(encode(p)) AS n, sha1(p) AS h, p, MAX(page_id) OVER (PARTITION BY p) AS top FROM rows),
    bits AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(i * 5 + 1 AS INTEGER), 5) AS BIGINT)) AS v FROM keyed)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[j // 4 + 1] >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
           CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
    FROM bits""",
)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = warc.read(*warc.write(spark, pages))
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), added=packing.added_tokens(public_tokenizers.path(ADDED)))


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.split_identify(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def _vote_sql(name: str, a: str, b: str | None, good: tuple, bad: tuple) -> str:
    value = f"CAST({a} AS DOUBLE)" if b is None else f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END"
    inside = lambda r: " AND ".join(f"({value}) {o} {x}" for o, x in ((">=", r[0]), ("<=", r[1])) if x is not None)
    return f"CASE WHEN ({value}) IS NULL THEN 0 WHEN {inside(good)} THEN 1 WHEN NOT ({inside(bad)}) THEN -1 ELSE 0 END AS {name}"


_ODDS = "ln(prior / (1 - prior)) + " + " + ".join(f"CASE WHEN {r} < 0 THEN ln(g_{r} / b_{r}) WHEN {r} > 0 THEN ln((1 - g_{r}) / (1 - b_{r})) ELSE 0 END" for r in quality.NAMES)


def _estimate_sql() -> str:
    """Each round of the estimation as a row (prior, two chances a rule), from the round before."""
    start = ", ".join(f"CAST({quality.IF_GOOD[0]} AS DOUBLE) AS g_{r}, CAST({quality.IF_BAD[0]} AS DOUBLE) AS b_{r}" for r in quality.NAMES)
    out = [f"e0 AS (SELECT CAST({quality.PRIOR} AS DOUBLE) AS prior, {start})"]
    fit = lambda r, c, q, low, high: f"CASE WHEN SUM(n * {q} * abs({r})) > 0 THEN least(greatest(SUM(CASE WHEN {r} < 0 THEN n * {q} ELSE 0 END) / SUM(n * {q} * abs({r})), {low}), {high}) ELSE MAX({c}_{r}) END AS {c}_{r}"
    fits = ", ".join(f"{fit(r, 'g', 'q', *quality.IF_GOOD[1:])}, {fit(r, 'b', '(1 - q)', *quality.IF_BAD[1:])}" for r in quality.NAMES)
    for i in range(quality.ROUNDS):
        out.append(f"e{i + 1} AS MATERIALIZED (SELECT least(greatest(SUM(n * q) / SUM(n), 0.01), 0.99) AS prior, {fits} FROM (SELECT *, 1 / (1 + exp(-({_ODDS}))) AS q FROM patterns, e{i}))")
    return ",\n    ".join(out)


def _quality_sql() -> str:
    rules = ", ".join(quality.NAMES)
    return rf"""
    WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    cut AS (SELECT rid, doc_id, text, regexp_extract_all(text, {_WORDS}) AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM texts),
    triples AS (SELECT rid, i, g, COUNT(*) OVER (PARTITION BY rid, g) AS c FROM (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM cut))),
    again AS (SELECT rid, COUNT(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM triples WHERE c > 1) GROUP BY rid),
    counts AS (SELECT rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
               length(regexp_replace(text, '[^!]+', '', 'g')) AS n_shouts, length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^|]+', '', 'g')) AS n_bars,
               len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM cut LEFT JOIN again USING (rid)),
    voted AS (SELECT *, {", ".join(_vote_sql(*r) for r in quality.RULES)} FROM counts),
    patterns AS MATERIALIZED (SELECT {rules}, CAST(COUNT(*) AS DOUBLE) AS n FROM voted GROUP BY {rules}),
    {_estimate_sql()}
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 1 / (1 + exp(-({_ODDS}))) >= 0.5 AS kept
    FROM voted, e{quality.ROUNDS}"""


@query("op9_quality", _quality_sql())
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_PRIVATE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "TRUE"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(v, '.'), lambda x: CAST(x AS HUGEINT))) <= 255"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[length(d) - i] AS INT) ELSE CAST(d[length(d) - i] AS INT) * 2 - CASE WHEN d[length(d) - i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
}


def _spans_sql(source: str, text: str, pattern: str, keep: str) -> str:
    """(keep columns, v, start, stop) of all matches, from what lies between them and the matches themselves."""
    return f"""(SELECT {keep}, v, CAST(SUM(length(g) + length(v)) OVER (PARTITION BY {keep} ORDER BY i) - length(v) AS BIGINT) AS start, CAST(SUM(length(g) + length(v)) OVER (PARTITION BY {keep} ORDER BY i) AS BIGINT) AS stop
        FROM (SELECT {keep}, unnest(m) AS v, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i
              FROM (SELECT {keep}, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g FROM {source})))"""


def _sanitise_sql() -> str:
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    parts = " UNION ALL ".join(
        f"SELECT rid, {i} AS k, '{kind}' AS kind, v, start, stop FROM (SELECT *, {digits} AS d FROM {_spans_sql('texts', 'text', pattern, 'rid')}) WHERE {good}" for i, (kind, (pattern, good)) in enumerate(_PRIVATE.items())
    )
    return rf"""
    WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    base AS MATERIALIZED ({parts}),
    ctx AS (SELECT rid, row_number() OVER () AS c, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN {digits} ELSE lower(v) END AS entity, text, stop, greatest(start - {sanitise.REACH}, 0) AS low,
            substr(text, greatest(start - {sanitise.REACH}, 0) + 1, start - greatest(start - {sanitise.REACH}, 0)) AS l, substr(text, stop + 1, {sanitise.REACH}) AS r FROM base JOIN texts USING (rid)),
    sides AS (SELECT rid, c * 2 AS c, entity, low + CASE WHEN low > 0 THEN length(regexp_extract(l, '^[\p{{L}}\p{{Nd}}]*')) ELSE 0 END AS spot, CASE WHEN low > 0 THEN regexp_replace(l, '^[\p{{L}}\p{{Nd}}]*', '') ELSE l END AS side FROM ctx
              UNION ALL SELECT rid, c * 2 + 1, entity, stop, CASE WHEN length(text) - stop > {sanitise.REACH} THEN regexp_replace(r, '[\p{{L}}\p{{Nd}}]+$', '') ELSE r END FROM ctx),
    placed AS (SELECT rid, entity, lower(v) AS term, spot + start AS start, spot + stop AS stop FROM {_spans_sql('sides', 'side', sanitise.TERM, 'rid, c, entity, spot')}),
    near AS (SELECT * FROM placed p WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = p.rid AND b.start < p.stop AND p.start < b.stop)),
    together AS (SELECT entity, term, COUNT(DISTINCT rid) AS n FROM near GROUP BY entity, term HAVING COUNT(DISTINCT rid) >= {sanitise.SUPPORT}),
    entities AS (SELECT entity, COUNT(DISTINCT rid) AS n_entity FROM near GROUP BY entity),
    words AS (SELECT term, COUNT(*) AS n_term FROM (SELECT unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{Nd}}]+'), lambda w: length(w) >= 3))) AS term FROM texts) GROUP BY term),
    told AS (SELECT entity, term FROM together JOIN entities USING (entity) JOIN words USING (term), (SELECT COUNT(*) AS total FROM texts)
             WHERE n_entity < total AND ln(CAST(total * n AS DOUBLE) / (n_entity * n_term)) >= {sanitise.REVEALED} * ln(CAST(total AS DOUBLE) / n_entity)),
    terms AS (SELECT DISTINCT rid, start, stop FROM near JOIN told USING (entity, term)),
    named AS (SELECT rid, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS base, COUNT(*) FILTER (kind = 'email') AS n_email, COUNT(*) FILTER (kind = 'ip') AS n_ip,
              COUNT(*) FILTER (kind = 'card') AS n_card, COUNT(*) FILTER (kind = 'phone') AS n_phone FROM base GROUP BY rid),
    extra AS (SELECT rid, string_agg('term:' || start || ':' || stop, ',' ORDER BY start, stop) AS extra, COUNT(*) AS n_terms FROM terms GROUP BY rid)
    SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256,
           concat_ws(',', base, extra) AS spans, coalesce(n_terms, 0) AS n_terms
    FROM texts LEFT JOIN named USING (rid) LEFT JOIN extra USING (rid)"""


@query("op6_sanitisation", _sanitise_sql())
def op6_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.summary(sanitise.findings(table(spark, sf_dir, "documents")))


def _preference_sql() -> str:
    clean = lambda c, empty: f"replace(replace(coalesce({c}, '{empty}'), '<|', '< |'), '|>', '| >')"
    show = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '')"
    ends = lambda x: f"list_transform(range(1, len({x}) + 1), lambda i: list_sum(list_transform({x}[1:i], lambda t: 5 + length(t.role) + length(t.text) + 8)))"
    mask = lambda x: f"coalesce(array_to_string(list_filter(list_transform({ends(x)}, lambda e, i: CASE WHEN {x}[i].role = 'assistant' THEN CAST(e - length({x}[i].text) - 8 AS BIGINT) || ':' || CAST(e AS BIGINT) END), lambda s: s IS NOT NULL), ','), '')"
    return f"""
    WITH src AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
    answers AS (SELECT conv_id, turn, text FROM (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, coalesce(text, '') DESC) AS k FROM src WHERE role = 'assistant') WHERE k = 1),
    told AS (SELECT 2 * conv_id AS conv_id, turn, role, text FROM src UNION ALL
             SELECT 2 * s.conv_id + 1, s.turn, s.role, CASE WHEN s.role = 'assistant' AND s.turn IS NOT DISTINCT FROM a.turn AND coalesce(s.text, '') = a.text THEN coalesce(b.text, '') ELSE s.text END
             FROM src s LEFT JOIN answers a ON a.conv_id = s.conv_id LEFT JOIN answers b ON b.conv_id = xor(s.conv_id, 1)),
    convs AS (SELECT conv_id, list({{'turn': turn, 'role': {clean('role', 'unknown')}, 'text': {clean('text', '')}}} ORDER BY turn, {clean('role', 'unknown')}, {clean('text', '')}) AS t FROM told GROUP BY conv_id),
    pairs AS (SELECT DISTINCT conv_id AS pair_id, 2 * conv_id AS chosen_id, 2 * conv_id + 1 AS rejected_id FROM src),
    both_ AS (SELECT pair_id, chosen_id, rejected_id, coalesce(a.t, []) AS a, coalesce(b.t, []) AS b FROM pairs LEFT JOIN convs a ON a.conv_id = chosen_id LEFT JOIN convs b ON b.conv_id = rejected_id),
    cut AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: len(list_filter(range(1, i + 1), lambda j: a[j].role <> b[j].role OR a[j].text <> b[j].text)) = 0)) AS n FROM both_),
    parts AS (SELECT pair_id, chosen_id, rejected_id, n, a[1:n] AS p, a[n + 1:] AS c, b[n + 1:] AS r FROM cut)
    SELECT pair_id, chosen_id, rejected_id, CAST(n AS BIGINT) AS n_prompt_turns, {show('p')} AS prompt, {show('c')} AS chosen, {show('r')} AS rejected, {mask('c')} AS chosen_mask, {mask('r')} AS rejected_mask FROM parts"""


@query("op7_preference", _preference_sql())
def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(*preference.other_answers(table(spark, sf_dir, "conversations")))


def _license_sql() -> str:
    quoted = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in sorted(licenses.TEMPLATES.items()))
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')"
    grams = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"
    return f"""
    WITH docs AS (SELECT rid, doc_id, {grams} AS s FROM (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents)),
    lib AS (SELECT name, list_distinct({grams}) AS s FROM (SELECT name, {words} AS w FROM (VALUES {quoted}) AS t(name, text))),
    items AS (SELECT name, len(s) AS n, unnest(s) AS x FROM lib),
    held AS (SELECT rid, name FROM (SELECT DISTINCT rid, x FROM (SELECT rid, unnest(s) AS x FROM docs)) JOIN items USING (x) GROUP BY rid, name, n HAVING 100 * COUNT(*) >= 75 * n),
    named AS (SELECT rid, string_agg(name, ',' ORDER BY name) AS licenses FROM held GROUP BY rid)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(licenses, '') AS licenses FROM docs LEFT JOIN named USING (rid)"""


@query("op10_licenses", _license_sql())
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("n_candidates")


@query(
    "op11_infill",
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    d AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS INTEGER), 8) AS BIGINT)) AS h FROM t),
    f AS (SELECT doc_id, text, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                 CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p""",
)
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.restore(infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


@query("op12_quality_rules")
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulefit.split_classify(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op13_ranked_search",
    f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents),
    sizes AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM docs WHERE len(w) > 0),
    total AS (SELECT COUNT(*) AS big_n, CAST(SUM(n) AS BIGINT) AS big_l FROM sizes),
    posts AS (SELECT row, doc_id, n, t, COUNT(*) AS tf FROM (SELECT row, doc_id, n, unnest(w) AS t FROM sizes) GROUP BY ALL),
    weights AS (SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS weight FROM posts, total GROUP BY t, big_n),
    items AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark),
    asked AS (SELECT item, item_id, t, COUNT(*) AS c FROM (SELECT item, item_id, unnest(w) AS t FROM items) GROUP BY ALL),
    scored AS (SELECT item, item_id, row, doc_id, CAST(SUM(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
               FROM asked JOIN weights USING (t) JOIN posts USING (t), total GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20""",
)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(spark, ranked.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
