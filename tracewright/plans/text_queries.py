"""Queries of the text functions that views are made of, over documents and events, and of what search and replay read of both
formats' records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.plans.audit_queries import RECORDS_B_SQL, t
from tracewright.plans.log_queries import EVENTS_SQL, RECORDS_A, _sql, records_a, records_b
from tracewright.sources import format_a, format_b

_queries: dict[str, Callable] = {}
_oracles: dict[str, str] = {}


def query(sql: str):
    def keep(f: Callable) -> Callable:
        _queries[f.__name__] = f
        _oracles[f.__name__] = sql
        return f

    return keep


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_ONE = r"regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^ | $', '', 'g')"
_TITLE_LINE = r"coalesce(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) > 12 AND NOT regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[#<>|`*-]'))[1], text)"


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, {_TRIM.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, '> ' || replace(t, chr(10), chr(10) || '> ') AS quoted, CASE WHEN length(t) <= 300 THEN t ELSE substr(t, 1, 300) || chr(10) || chr(10) || '…[+' || (length(t) - 300) || ' chars omitted]' END AS clipped,
{_ONE.format("replace(text, '|', chr(92) || '|')")} AS cell, regexp_replace(substr({_ONE.format(_TITLE_LINE)}, 1, 70), '\s+\S*$', '') AS title,
CASE WHEN source = 'src1' THEN 'Codex' WHEN source = 'src2' THEN 'Copilot' WHEN source = 'src3' THEN 'Agent' ELSE source END AS label,
CASE WHEN source LIKE 'src1%' THEN substr('/A/Src1/' || source, 9) ELSE '/a/src2/' || source END AS path FROM d""")
def report_texts(spark, sf_dir):
    """Quotes, clipped documents, table cells, titles, labels of sources and paths below a folder, of every document."""
    d = t(spark, sf_dir, "documents").select("doc_id", "text", "source")
    named = F.when(F.col("source") == "src1", "codex").when(F.col("source") == "src2", "copilot").when(F.col("source") != "src3", F.col("source"))
    inside = F.when(F.startswith("source", F.lit("src1")), F.concat(F.lit("/A/Src1/"), "source")).otherwise(F.concat(F.lit("/a/src2/"), "source"))
    return d.select(
        "doc_id", X.blockquote(F.col("text")).alias("quoted"), X.clip_doc(F.col("text"), 300).alias("clipped"), X.cell(F.col("text")).alias("cell"), X.title_of(F.coalesce("text", F.lit(""))).alias("title"),
        X.source_label(named).alias("label"), X.relative_to(inside, "/a/src1/").alias("path"),
    )


_AT = "CAST(ts AS TIMESTAMP)"
_AGO = "CAST(floor(event_id * event_id % 300007 * 17 / 60.0 + 0.5) AS BIGINT)"
_OPEN = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END"
_SPENT = "CAST(floor(event_id * 37 % 4000000 / 1000.0 + 0.5) AS BIGINT)"


@query(f"""WITH e AS (SELECT *, {_OPEN} AS o FROM events), m AS (SELECT *, {_AGO} AS m FROM e), h AS (SELECT *, CAST(floor(m / 60.0 + 0.5) AS BIGINT) AS h FROM m)
SELECT event_id, CASE WHEN m < 60 THEN m || 'm ago' WHEN h < 48 THEN h || 'h ago' ELSE CAST(floor(h / 24.0 + 0.5) AS BIGINT) || 'd ago' END AS ago, coalesce(strftime(o, '%Y-%m-%d %H:%M'), '—') AS minute, coalesce(strftime(o, '%Y-%m-%d'), '—') AS day,
coalesce(strftime(o, '%Y-%m-%d %H:%M'), 'start') || ' → ' || CASE WHEN event_id % 5 = 0 THEN 'now' ELSE strftime({_AT}, '%Y-%m-%d %H:%M') END AS span,
CASE WHEN event_id * 37 % 4000000 = 0 THEN '' WHEN {_SPENT} < 60 THEN {_SPENT} || 's' ELSE {_SPENT} // 60 || 'm' || lpad(CAST({_SPENT} % 60 AS VARCHAR), 2, '0') || 's' END AS spent FROM h""")
def report_times(spark, sf_dir):
    """Ages, minutes, days, windows and the durations of sub-agents, of every event."""
    e = t(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    now = F.timestamp_seconds(F.lit(1_893_456_000))
    then = F.timestamp_seconds(F.lit(1_893_456_000) - F.col("event_id") * F.col("event_id") % 300_007 * 17)
    some = F.when(F.col("event_id") % 3 != 0, F.col("at"))
    until = F.when(F.col("event_id") % 5 != 0, F.col("at"))
    return e.select("event_id", X.ago(then, now).alias("ago"), X.minute(some).alias("minute"), X.day(some).alias("day"), X.window_label(some, until).alias("span"), X.minutes_seconds(F.col("event_id") * 37 % 4_000_000).alias("spent"))


# ---------------------------------------------------------------- what search and replay read

_SHOWN = ("session_id", "seq", "turn", "label", "text", "output", "stderr", "exit_text", "replayed")
_CASES_A = " ".join(f"WHEN {m} THEN {_sql(x)}" for m, x in enumerate(RECORDS_A))
_P, _I = "json_extract_string(v, '$.payload.{}')", "json_extract_string(v, '$.payload.item.{}')"
_LIST = "array_to_string(json_extract_string(v, '$.payload.{}'), chr(10))"
_TEXTS_A = ", ".join(
    f"nullif({x}, '')"
    for x in (
        _P.format("last_agent_message"), _LIST.format("content[*].text"), _LIST.format("item.content[*].text"), _I.format("query"), _I.format("text"), _I.format("stdout"), _I.format("stderr"), _I.format("aggregated_output"), _I.format("formatted_output"),
        _P.format("input"), _P.format("arguments"), _P.format("output"), _LIST.format("item.parsed_cmd[*].cmd"), "array_to_string(json_extract_string(v, '$.payload.item.command[*]'), ' ')",
        f"CASE WHEN id % {len(RECORDS_A)} = 15 THEN {_sql('z${r5}.py|1|2|b.py|--- a|+++ b|+x|-y|+|c.py')} END", "CAST(json_extract(v, '$.payload.item.arguments') AS VARCHAR)", "CAST(json_extract(v, '$.payload.item.result') AS VARCHAR)",
        f"CASE WHEN id % {len(RECORDS_A)} = 12 THEN {_sql('**Think ${k}**|more|')} END",
    )
).replace("|1|2|b.py|--- a|+++ b|+x|-y|+|c.py'", "' || replace('|1|2|b.py|--- a|+++ b|+x|-y|+|c.py', '|', chr(10))").replace("**|more|'", "**' || chr(10) || 'more' || chr(10)")


@query(f"""WITH {EVENTS_SQL}, j AS (SELECT *, CAST(CASE id % {len(RECORDS_A)} {_CASES_A} END AS JSON) AS v FROM (SELECT * REPLACE (CASE WHEN lost THEN 'null' ELSE '"' || turn || '"' END AS turn), turn AS own FROM e)),
r AS (SELECT *, json_extract_string(v, '$.type') AS type, {_P.format("type")} AS p, {_I.format("type")} AS i, coalesce({_I.format("exit_code")}, '0') AS code FROM j),
x AS (SELECT session_id, id AS seq, coalesce(nullif({_P.format("turn_id")}, ''), nullif({_P.format("internal_chat_message_metadata_passthrough.turn_id")}, ''), 'orphan-' || id) AS turn,
CASE WHEN type = 'response_item' AND p = 'message' THEN {_P.format("role")} || ' message' WHEN p = 'task_complete' THEN 'final answer'
  WHEN i = 'CommandExecution' THEN 'command (exit ' || code || '): ' || coalesce(array_to_string(nullif(json_extract_string(v, '$.payload.item.parsed_cmd[*].cmd'), []), ' ; '), array_to_string(json_extract_string(v, '$.payload.item.command[*]'), ' '))
  WHEN i = 'FileChange' THEN 'file change: z' || r5 || '.py, b.py, c.py' WHEN i = 'McpToolCall' THEN 'tool s.t' || r5 ELSE coalesce(i, p, type) END AS label, concat_ws(chr(10), {_TEXTS_A}) AS text,
coalesce({", ".join(f"nullif({_I.format(c)}, '')" for c in ("formatted_output", "aggregated_output", "stdout"))}) AS output, nullif({_I.format("stderr")}, '') AS stderr, CASE WHEN i = 'CommandExecution' THEN code END AS exit_text,
coalesce(type <> 'response_item' AND (coalesce(i, '') IN ('CommandExecution', 'FileChange', 'AgentMessage', 'UserMessage', 'McpToolCall') OR p = 'task_complete'), false) AS replayed FROM r)
SELECT {", ".join(_SHOWN)} FROM x""")
def format_a_texts(spark, sf_dir):
    """What search and replay read of format A: label, whole text, output and outcome of every record."""
    return format_a.searchable(records_a(spark, sf_dir)).select(*_SHOWN)


_D = "json_extract_string(v, '$.data.{}')"
_ARGS = "CASE WHEN json_type(v, '$.data.arguments') = 'VARCHAR' THEN json_extract_string(v, '$.data.arguments') ELSE CAST(json_extract(v, '$.data.arguments') AS VARCHAR) END"
_TEXT_B = "concat_ws(chr(10), " + ", ".join(f"nullif({x}, '')" for x in (_D.format("content"), _D.format("reasoningText"), _ARGS, _D.format("result.content"), _D.format("error.message"), _D.format("summary"), _D.format("summaryContent"), _D.format("message"))) + ")"


@query(f"""WITH {RECORDS_B_SQL}, w AS (SELECT id, coalesce(last_value(CASE WHEN id % 24 BETWEEN 1 AND 7 THEN 't' || id // 64 END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY id ROWS UNBOUNDED PRECEDING), 'session') AS now FROM e),
st AS (SELECT session_id, {_D.format("toolCallId")} AS call, tool, {_D.format("interactionId")} AS turn, {_D.format("arguments.command")} AS cmd, {_D.format("arguments.path")} AS path, {_D.format("mcpServerName")} || '.' || {_D.format("mcpToolName")} AS mcp FROM b WHERE type = 'tool.execution_start'),
c AS (SELECT b.*, w.now, st.tool AS name, st.turn AS of_call, st.cmd, st.path, st.mcp, b.type = 'tool.execution_complete' AS done, {_D.format("success")} = 'false' AS failed, {_D.format("source")} AS src
  FROM b JOIN w ON w.id = b.seq // 2 LEFT JOIN st ON st.session_id = b.session_id AND st.call = {_D.format("toolCallId")} AND b.type IN ('tool.execution_start', 'tool.execution_complete')),
k AS (SELECT *, CASE WHEN failed THEN 'blocked' ELSE coalesce({_D.format("shellExecution.exitCode")}, nullif(regexp_extract({_D.format("result.content")}, 'exit code (-?\\d+)>', 1), ''), '0') END AS code FROM c),
x AS (SELECT session_id, seq, coalesce(of_call, now) AS turn,
CASE WHEN src LIKE 'skill-%' THEN 'skill loaded: ' || substr(src, 7) WHEN type = 'user.message' AND src <> 'user' THEN 'message from ' || src WHEN type = 'user.message' THEN 'user message' WHEN type = 'assistant.message' THEN 'assistant message'
  WHEN type IN ('tool.execution_start', 'tool.execution_complete') THEN CASE WHEN name IS NULL THEN 'tool result' WHEN name IN ('bash', 'powershell') THEN 'command (exit ' || CASE WHEN done THEN code ELSE '…' END || '): ' || cmd
    WHEN name IN ('edit', 'create', 'view') THEN name || ' ' || path WHEN name = 'apply_patch' THEN name ELSE 'tool ' || coalesce(mcp, name) END
  WHEN type = 'session.compaction_complete' THEN 'checkpoint summary' WHEN type = 'session.task_complete' THEN 'final answer' ELSE type END AS label,
CASE WHEN src LIKE 'skill-%' THEN '' ELSE {_TEXT_B} END AS text, {_D.format("result.content")} AS output, CASE WHEN failed THEN {_D.format("error.message")} END AS stderr, CASE WHEN done AND name IN ('bash', 'powershell') THEN code END AS exit_text,
type IN ('user.message', 'tool.execution_complete', 'session.compaction_complete', 'session.task_complete') OR (type = 'assistant.message' AND {_TEXT_B} <> '') AS replayed FROM k)
SELECT {", ".join(_SHOWN)} FROM x""")
def format_b_texts(spark, sf_dir):
    """What search and replay read of format B."""
    return format_b.searchable(records_b(spark, sf_dir)).select(*_SHOWN)


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
