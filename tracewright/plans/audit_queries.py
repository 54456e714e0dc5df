"""Queries of checks and profiles: recounts against a fold with planted faults, moves of files, shapes and dimensions of records,
searches that an index narrows. Each has SQL that says the outcome from the driver's tables themselves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import functions as F

from tracewright.operators import lineage, session
from tracewright.plans import profile, pruning, verify
from tracewright.plans.log_queries import EVENTS_SQL, FACTS_A_SQL, RECORDS_B, TURNS_SQL, _sql, folded_a, records_a, records_b
from tracewright.scratch import written
from tracewright.shipping import ship
from tracewright.sources import format_b

_queries: dict[str, Callable] = {}
_oracles: dict[str, str] = {}


def query(sql: str):
    def keep(f: Callable) -> Callable:
        _queries[f.__name__] = f
        _oracles[f.__name__] = sql
        return f

    return keep


def t(spark, sf_dir, name):
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- checks


@query(f"""WITH {FACTS_A_SQL}, c AS (SELECT session_id, count(*) FILTER (kind = 'command' AND text <> 'ls -l 3') AS said, count(*) FILTER (kind = 'command') AS n FROM f GROUP BY session_id)
SELECT session_id, 'commands' AS problem, CAST(said AS VARCHAR) AS ledger, CAST(n AS VARCHAR) AS recount FROM c WHERE said <> n
UNION ALL SELECT DISTINCT session_id, 'file', NULL, path FROM f WHERE kind = 'file' AND path = 'c.py' AND CAST(session_id AS BIGINT) % 2 = 1
UNION ALL SELECT DISTINCT session_id, 'file', path || '~', NULL FROM f WHERE kind = 'file' AND path = 'z1.py' UNION ALL SELECT DISTINCT session_id, 'file', NULL, path FROM f WHERE kind = 'file' AND path = 'z1.py'""")
def verify_recounts_a(spark, sf_dir):
    """The recount of format A against a fold of which a command, a file of odd sessions and a file's name were spoilt."""
    records, f = records_a(spark, sf_dir), folded_a(spark, sf_dir)
    spoilt = F.when(F.col("path") == "z1.py", "z1.py~").otherwise(F.col("path"))
    files = f.files.filter("path <> 'c.py' or cast(session_id as bigint) % 2 = 0").withColumn("path", spoilt)
    return verify.recounted(replace(f, commands=f.commands.filter("cmd <> 'ls -l 3'"), files=files), *verify.recount_a(records)).drop("source")


@query(f"""WITH {EVENTS_SQL} SELECT DISTINCT session_id, 'file' AS problem, CAST(NULL AS VARCHAR) AS ledger, '/d.py' AS recount FROM e WHERE id % {len(RECORDS_B)} = 14
UNION ALL SELECT session_id, 'failures', CAST(count(*) FILTER (id % {len(RECORDS_B)} <> 10) AS VARCHAR), CAST(count(*) AS VARCHAR) FROM e
WHERE id % {len(RECORDS_B)} = 10 OR (id % {len(RECORDS_B)} IN (8, 9) AND r3 <> 0) GROUP BY session_id HAVING count(*) FILTER (id % {len(RECORDS_B)} = 10) > 0""")
def verify_recounts_b(spark, sf_dir):
    """The recount of format B against a fold without a deleted file and without refused commands."""
    records = records_b(spark, sf_dir)
    f = session.fold(written(format_b.facts(records), "facts"))
    spoilt = replace(f, files=f.files.filter("path <> '/d.py'"), failures=f.failures.filter("key not like 'rm%'"))
    return verify.recounted(spoilt, *verify.recount_b(records)).drop("source")


@query(f"""WITH {TURNS_SQL}, s AS (SELECT session_id, CAST(session_id AS BIGINT) AS i, count(DISTINCT path) FILTER (kind = 'file') AS n FROM f GROUP BY session_id)
SELECT session_id, CASE WHEN i % 7 = 3 THEN 'no view' WHEN i % 5 = 2 THEN 'session id missing' ELSE 'other number of files' END AS problem, CAST(NULL AS BIGINT) AS turn FROM s WHERE i % 7 = 3 OR i % 5 = 2 OR i % 11 = 4
UNION ALL SELECT session_id, 'request repeated', n FROM t2 WHERE ask IS NOT NULL AND n % 3 = 1""")
def verify_rendered(spark, sf_dir):
    """Checks of rendered views, some of which are lost, empty or count other files, and of turns of which some repeat."""
    f = folded_a(spark, sf_dir)
    i = F.col("session_id").cast("bigint")
    counted = f.stats.select("source", "session_id", F.concat(F.lit("# Session "), "session_id", F.lit("\n| Activity | 1 turns · 2 commands · "), F.col("files_touched").cast("string"), F.lit(" files changed |\n")).alias("markdown"))
    made = counted.filter(i % 7 != 3)
    other = F.regexp_replace("markdown", r"(?m)^(\| Activity \|.* )\d+( files changed)", "$1 9999$2")
    made = made.withColumn("markdown", F.when(i % 5 == 2, "").when(i % 11 == 4, other).otherwise(F.col("markdown")))
    said = F.concat("ask", F.lit(" and enough words to be a block"))
    turns = f.turns.withColumn("ask", F.when(F.col("n") % 3 == 1, F.concat(said, F.lit("\n\nno\n\n "), said)).otherwise(F.col("ask")))
    return verify.rendered(made, replace(f, turns=turns)).drop("source")


# ---------------------------------------------------------------- files through moves

_MOVES = "(SELECT CAST(user_id AS VARCHAR) AS s, event_id + 1 AS w, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS a, (CAST(json_extract_string(props, '$.k') AS BIGINT) * 3 + event_id) % 7 AS b FROM events)"
LINEAGE_SQL = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY w) AS n FROM {_MOVES}),
r AS (SELECT DISTINCT s, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, list_transform(range(0, 7), lambda i: 'f' || i || '@0') AS names FROM o
  UNION ALL SELECT o.s, o.n, o.w, o.a, o.b, CASE WHEN o.a = o.b THEN names ELSE list_transform(range(0, 7), lambda i: CASE WHEN i = o.b THEN names[o.a + 1] WHEN i = o.a THEN 'f' || o.a || '@' || o.w ELSE names[i + 1] END) END
  FROM r JOIN o ON o.s = r.s AND o.n = r.n + 1)
"""


def _moves(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") + 1).cast("long").alias("at"), (k % 7).alias("a"), ((k * 3 + F.col("event_id")) % 7).alias("b"))
    path = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    return e.select("session_id", "at", path("a").alias("from_path"), path("b").alias("to_path"))


@query(LINEAGE_SQL + "SELECT s AS session_id, w AS at, 'f' || b AS path, names[b + 1] AS file FROM r WHERE n > 0")
def file_lineage(spark, sf_dir):
    """Which file the target of each of a session's moves is after it, through chains and swaps of all moves before."""
    moves = _moves(spark, sf_dir)
    return lineage.identified(moves.select("session_id", "at", F.col("to_path").alias("path")), moves, ["session_id"])


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 50 AS p FROM lineitem WHERE l_linenumber % 2 = 0), r AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 50 AS p FROM lineitem WHERE l_linenumber % 3 <> 0)
SELECT l.s AS supplier, 'p' || l.p AS path, 'left' AS side FROM l ANTI JOIN r ON l.s = r.s AND l.p = r.p UNION ALL SELECT r.s, 'p' || r.p, 'right' FROM r ANTI JOIN l ON l.s = r.s AND l.p = r.p""")
def file_set_difference(spark, sf_dir):
    """Paths that one of two sets of a key has and the other lacks."""
    i = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("path"), "l_linenumber")
    return lineage.set_difference(i.filter("l_linenumber % 2 = 0"), i.filter("l_linenumber % 3 <> 0"), ["supplier"])


# ---------------------------------------------------------------- profiles

_CASES_B = " ".join(f"WHEN {m} THEN [{', '.join(_sql(x) for x in some)}]" for m, some in enumerate(RECORDS_B))
#: The records of format B as JSON, from the events alone.
RECORDS_B_SQL = f"""{EVENTS_SQL}, g AS (SELECT session_id, id, CASE id % {len(RECORDS_B)} {_CASES_B} END AS l FROM (SELECT *, id // 64 AS number FROM e)),
j AS (SELECT session_id, id * 2 + generate_subscripts(l, 1) - 1 AS seq, CAST(unnest(l) AS JSON) AS v FROM g),
b AS (SELECT *, json_extract_string(v, '$.type') AS type, json_extract_string(v, '$.data.toolName') AS tool FROM j)"""


@query(f"""WITH {RECORDS_B_SQL}, n AS (SELECT concat_ws('|', b.type, tool) AS kind, regexp_replace(replace(t.fullkey, '"', ''), '\\[\\d+\\]', '[]', 'g') AS path,
CASE t.type WHEN 'OBJECT' THEN 'OBJECT' WHEN 'ARRAY' THEN 'ARRAY' WHEN 'VARCHAR' THEN 'STRING' WHEN 'BOOLEAN' THEN 'BOOLEAN' WHEN 'NULL' THEN 'VOID' ELSE 'NUMBER' END AS type, seq FROM b, json_tree(b.v) AS t)
SELECT kind, path, type, count(*) AS n, min(seq) AS first_seq FROM n GROUP BY ALL""")
def shape_profile(spark, sf_dir):
    """Every path and type inside the records of each kind: how often, and where first."""
    return profile.shapes(records_b(spark, sf_dir)).drop("sample")


@query(f"""WITH {RECORDS_B_SQL} SELECT type AS kind, array_to_string(list_sort(json_keys(v, '$.data')), ',') AS keys, count(*) AS n FROM b GROUP BY ALL""")
def key_shapes(spark, sf_dir):
    """The names of fields that records of each type come with."""
    return profile.key_shapes(records_b(spark, sf_dir))


def _dimension(name: str, when: str, key: str, of: str = "b") -> str:
    return f"SELECT '{name}' AS dimension, coalesce({key}, '(none)') AS key FROM {of} WHERE {when}"


_FIELDS_OF = "array_to_string(list_sort(json_keys(v, '{}')), ',')"
_DONE = "type = 'tool.execution_complete'"
_TAIL = "trim(regexp_replace(regexp_replace(right(content, 80), '\\d+', 'N', 'g'), '\\s+', ' ', 'g'))"
_MARK = "regexp_extract(content, '(?i)(<[^<>]*(?:exit code|exited)[^<>]*>)\\s*$', 1)"
DIMENSIONS_SQL = f"""WITH {RECORDS_B_SQL}, s AS (SELECT session_id, json_extract_string(v, '$.data.toolCallId') AS call, tool, json_extract_string(v, '$.data.arguments.mode') AS mode, true AS started FROM b WHERE type = 'tool.execution_start'),
c AS (SELECT v, s.tool, s.mode, s.started, json_extract_string(v, '$.data.success') = 'false' AS failed, json_extract(v, '$.data.shellExecution') IS NOT NULL AS ran, coalesce(json_extract_string(v, '$.data.result.content'), '') AS content
  FROM b LEFT JOIN s ON s.session_id = b.session_id AND s.call = json_extract_string(v, '$.data.toolCallId') WHERE {_DONE}),
a AS ({" UNION ALL ".join((
    _dimension("event type", "true", "type"), _dimension("user.message source", "type = 'user.message'", "json_extract_string(v, '$.data.source')"), _dimension("user.message delivery", "type = 'user.message'", "json_extract_string(v, '$.data.delivery')"),
    _dimension("assistant.message phase", "type = 'assistant.message'", "json_extract_string(v, '$.data.phase')"), _dimension("reasoning", "type = 'assistant.message'", "CASE WHEN json_extract_string(v, '$.data.reasoningText') <> '' THEN 'text' ELSE 'none' END"),
    _dimension("calls by tool", "type = 'tool.execution_start'", "tool"), _dimension("completion fields", _DONE, _FIELDS_OF.format("$.data")), _dimension("result fields", _DONE + " AND json_extract(v, '$.data.result') IS NOT NULL", _FIELDS_OF.format("$.data.result")),
    _dimension("error fields", _DONE + " AND json_extract(v, '$.data.error') IS NOT NULL", _FIELDS_OF.format("$.data.error")), _dimension("shell run fields", _DONE + " AND json_extract(v, '$.data.shellExecution') IS NOT NULL", _FIELDS_OF.format("$.data.shellExecution")),
    _dimension("failures by tool", "failed", "coalesce(tool, '(unknown)')", "c"), _dimension("completions without start", "started IS NULL", "'all'", "c"),
    _dimension("shell completions", "tool IN ('powershell', 'bash')", "CASE WHEN ran THEN 'with run' WHEN failed THEN 'without run, failed' ELSE 'without run' END", "c"),
    _dimension("shell endings", "tool IN ('powershell', 'bash') AND NOT ran", f"CASE WHEN {_MARK} <> '' THEN regexp_replace({_MARK}, '\\d+', 'N', 'g') ELSE 'OTHER: ' || right({_TAIL}, 40) END", "c"),
))}),
n AS (SELECT dimension, key, count(*) AS n FROM a GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS INTEGER) AS rank FROM n QUALIFY rank <= 40"""


@query(DIMENSIONS_SQL)
def dimension_counts(spark, sf_dir):
    """The frequent keys of every dimension of format B's records, exactly counted in one pass."""
    return profile.dimensions(records_b(spark, sf_dir))


# ---------------------------------------------------------------- narrowed search

SOUGHT = "released under the mit"


@query(f"SELECT doc_id FROM documents WHERE contains(lower(text), '{SOUGHT}')")
def search_narrowed(spark, sf_dir):
    """Documents that hold a text, sought only in those that have all its trigrams."""
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    wanted = sorted(pruning.trigrams(SOUGHT))
    hit = pruning.trigrams_of(d, ["doc_id"]).filter(F.col("tri").isin(wanted)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted))
    return d.join(hit, "doc_id", "left_semi").filter(F.contains(F.lower("text"), F.lit(SOUGHT))).select("doc_id")


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
