"""The queries ``opN_<name>`` over the driver's tables, with production parameters, and DuckDB SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import chat, decontaminate, divergence, html_extract, interactions, licenses, linedup, lm, neardup, packing, pii, quality, toxicity
from tracewright.llm.common import crc_mod, table

#: Where the public tokenizer files are, unless a caller names another folder.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op5_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.class_scores(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(hits)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.report(table(spark, sf_dir, "documents"), threshold=linedup.BY_LENGTH, exact_chars=1)
    return found.withColumn("line_numbers", F.array_join(F.transform("line_numbers", lambda n: n.cast("string")), ","))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


CHAT_SQL = """
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
s AS (
  SELECT conv_id, count(*) AS n,
         string_agg(chr(1) || coalesce(role, chr(2)) || chr(3) || coalesce(text, chr(2)), '' ORDER BY turn, role, text) || chr(1) AS body
  FROM d GROUP BY conv_id
),
r AS (SELECT min(conv_id) AS conv_id, n, body, count(*) AS copies FROM s GROUP BY n, body),
m AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r AS o WHERE o.n > r.n AND starts_with(o.body, r.body))),
p AS (
  SELECT d.conv_id, floor(turn / 512.0) AS block, any_value(m.n) AS n_turns, any_value(m.copies) AS n_copies,
         string_agg('<|' || regexp_replace(coalesce(role, ''), '<(\\\\*)\\|', '<\\\\\\1|', 'g') || '|>' || chr(10) || regexp_replace(coalesce(text, ''), '<(\\\\*)\\|', '<\\\\\\1|', 'g') || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM d JOIN m ON d.conv_id = m.conv_id GROUP BY d.conv_id, floor(turn / 512.0)
)
SELECT conv_id, n_turns, n_copies, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY block) - 1 AS BIGINT) AS part, rendered FROM p
"""


_BLANK = "[ \\x09-\\x0D]"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array({0}, '[ \\x09-\\x0D]+'), lambda x: x <> '')"

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_ FROM u AS a JOIN u AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * both_ >= 80 * (na + nb - both_)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""

LEAKS_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
z AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS g FROM z),
q AS (SELECT DISTINCT size FROM i),
e AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS k, w FROM d JOIN q ON len(w) >= size),
h AS (SELECT e.doc_id, e.k, e.size, i.item_id FROM e JOIN i ON e.size = i.size AND array_to_string(e.w[e.k:e.k + e.size - 1], ' ') = i.g),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def _quality_sql() -> str:
    metrics = {"mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "stop_ratio": ("n_stop", "n_words"), "run_ratio": ("n_same", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines")}
    ratios = ", ".join(f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END AS {name}" for name, (a, b) in metrics.items())
    bounds = [f"{r.metric} >= {r.low}" for r in quality.RULES if r.low is not None] + [f"{r.metric} <= {r.high}" for r in quality.RULES if r.high is not None]
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8)),
t AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, CAST(sum(least(8, coalesce(next - k, 8))) AS BIGINT) AS n FROM (SELECT *, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS next FROM t) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop, len(list_filter(list_zip(w[2:], w), lambda x: x[1] = x[2])) AS n_same FROM d LEFT JOIN c USING (doc_id)),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {ratios} FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM r
"""


DIVERGENCE_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
df AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, source, t, count(*) AS c FROM (SELECT lang, source, unnest(w) AS t FROM d) SEMI JOIN df USING (lang, t) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM df GROUP BY lang),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
l AS (SELECT lang, t, sum(c) AS c FROM c GROUP BY ALL),
m AS (SELECT lang, sum(c) AS n FROM l GROUP BY ALL),
q AS (SELECT lang, t, 1 + CAST(1000000000 AS HUGEINT) * (l.c + 5) // (m.n + 5 * v.v) AS q FROM l JOIN m USING (lang) JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, df.t, coalesce(c.c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5) // (coalesce(n.n, 0) + 5 * v.v) AS p
      FROM g JOIN df USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = df.t LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
y AS (SELECT p.lang, p.source, 'term' AS part, p.t AS item, CAST(p.p - q.q AS BIGINT) AS value FROM p JOIN q ON p.lang = q.lang AND p.t = q.t WHERE p.c > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM x UNION ALL SELECT * FROM y) QUALIFY part = 'pair' OR rank <= 50
"""


INTERACTION_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT doc_id, part, CAST(length(text) AS BIGINT) AS n, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),
k AS (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS t FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN a THEN 1 ELSE 0 END) | (CASE WHEN b THEN 2 ELSE 0 END) | (CASE WHEN c THEN 4 ELSE 0 END) | (CASE WHEN d THEN 8 ELSE 0 END) | (CASE WHEN e THEN 16 ELSE 0 END) AS mask, count(*) AS n, count(*) FILTER (q) AS good, count(*) FILTER (t) AS toxic
      FROM b LEFT JOIN k USING (doc_id) GROUP BY ALL),
o AS (SELECT '' AS filter_order, 0 AS step, 0 AS before, 0 AS bit, [''] AS path UNION ALL SELECT filter_order || l, step + 1, before | bit, v, path || [l] FROM o, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(l, v) WHERE (before | bit) & v = 0),
s AS (SELECT w.filter_order, p.step, p.before, p.bit FROM o AS w JOIN o AS p ON w.step = 5 AND p.step > 0 AND starts_with(w.filter_order, p.filter_order)),
r AS (SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS BIGINT) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    """op8 has none, as DuckDB's edit distance counts bytes, and op11's spans are beyond SQL; tests compare both with brute force."""
    return {"op2_chat_formatting": CHAT_SQL, "op4_near_duplicates": NEAR_SQL, "op6_decontamination": LEAKS_SQL, "op9_quality_rules": _quality_sql(), "op12_source_divergence": DIVERGENCE_SQL, "op13_filter_interactions": INTERACTION_SQL}
