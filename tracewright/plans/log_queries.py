"""Queries that put logs of both formats, made of the driver's events, through the engine: records, facts, the fold, cards
and rollups. Each has SQL that says the outcome of every event from the events themselves."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import session
from tracewright.plans import reports
from tracewright.scratch import written
from tracewright.shipping import ship
from tracewright.sources import format_a, format_b
from tracewright.sources.logs import parsed

_META = '"internal_chat_message_metadata_passthrough":{"turn_id":${turn}}'


def _item(body: str) -> str:
    return '{"type":"event_msg","timestamp":"${ts}","payload":{"type":"item_completed","turn_id":${turn},"item":{"id":"i${id}",' + body + "}}}"


def _event(body: str) -> str:
    return '{"type":"event_msg","timestamp":"${ts}","payload":{' + body + "}}"


def _response(body: str) -> str:
    return '{"type":"response_item","timestamp":"${ts}","payload":{' + body + "," + _META + "}}"


#: A record of format A for each event, by its number modulo 28; ${k} is its k, ${turn} its turn as JSON.
RECORDS_A = (
    '{"type":"session_meta","timestamp":"${ts}","payload":{"session_id":"x","cwd":"/w/${k}","originator":"cli","cli_version":"1.${k}","context_window":${k},"base_instructions":{"provenance":{"model":"m${k}"}}}}',
    '{"type":"world_state","timestamp":"${ts}","payload":{"state":{"agents_md":{"text":"rules ${k}"}}}}',
    '{"type":"compacted","timestamp":"${ts}","payload":{"replacement_history":[{' + _META + "}]}}",
    '{"type":"token_usage_record","timestamp":"${ts}","payload":{"usage":${k}}}',
    _event('"type":"token_count","info":{"total_token_usage":{"total_tokens":${k}}}'),
    _response('"type":"message","role":"user","content":[{"text":"please do ${k}"},{"text":"  <environment_context> x"}]'),
    _response('"type":"function_call_output","name":"create_thread","output":"a<input> brief ${k} </input>b"'),
    _response('"type":"custom_tool_call","input":"tools.update_plan({plan:[{step:\\"s${k}\\", status:\'pending\'}]})"'),
    _event('"type":"task_started","turn_id":${turn}'),
    _event('"type":"task_complete","turn_id":${turn},"last_agent_message":"final ${k}","duration_ms":${id}'),
    _item('"type":"AgentMessage","phase":"commentary","content":[{"text":"note"},{"text":" ${k} "}]'),
    _item('"type":"AgentMessage","content":[{"text":"said ${k}"}]'),
    _item('"type":"Reasoning","summary_text":["**Think ${k}**",{"text":"more"},""]'),
    _item('"type":"CommandExecution","parsed_cmd":[{"cmd":"make ${r5}"},{"cmd":"x"}],"exit_code":${r3},"stderr":" boom ${k}\\n","duration":{"secs":1,"nanos":500000000}'),
    _item('"type":"CommandExecution","command":["ls","-l","${r5}"],"aggregated_output":"out","duration":12'),
    _item('"type":"FileChange","changes":{"z${r5}.py":{"type":"add","content":"1\\n2"},"b.py":{"type":"update","unified_diff":"--- a\\n+++ b\\n+x\\n-y\\n+"},"c.py":{"type":"remove"}}'),
    _item('"type":"McpToolCall","server":"s","tool":"t${r5}","arguments":{"code":"c${k}"},"result":{"isError":true},"duration":3'),
    _item('"type":"UserMessage","content":[{"text":"<in-app-browser-context>y</in-app-browser-context>## My request: do ${k}"}]'),
    _item('"type":"WebSearch","query":"q ${k}"'),
    _item('"type":"Extension","kind":"web.search","action":{"type":"search","query":"e ${k}"}'),
    _item('"type":"Extension","kind":"ext${r5}"'),
    _item('"type":"ImageView","path":"/p/${k}.png"'),
    _item('"type":"SubAgentActivity","kind":"started","agent_path":"/a/${k}","agent_thread_id":"0123456789"'),
    _item('"type":"CollabAgentToolCall","tool":"send","receiver_thread_ids":["a","b"]'),
    _item('"type":"Plan","text":"plan ${k}"'),
    _item('"type":"TodoList","items":[{"text":"one ${k}","completed":true},{"step":"two","status":"in_progress"}]'),
    _item('"type":"FunctionCallOutput","name":"send_message_to_thread"'),
    _item('"type":"ContextCompaction"'),
)


def _filled(template: str, values: dict[str, Column]) -> Column:
    parts = re.split(r"\$\{(\w+)\}", template)
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2))


def _sql(template: str) -> str:
    """A SQL expression of a template: quoted text and columns."""
    parts = re.split(r"\$\{(\w+)\}", template)
    return " || ".join(p if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p or i % 2)


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    e = ship(spark).read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    e = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), k.alias("k"))
    number = F.floor(F.col("id") / 64).cast("string")
    turn = F.when(F.col("id") % 29 == 7, "null").otherwise(F.concat(F.lit('"t'), number, F.lit('"')))
    text = lambda c: F.col(c).cast("string")
    return e, {"id": text("id"), "k": text("k"), "ts": F.col("ts"), "turn": turn, "number": number, "r5": (F.col("k") % 5).cast("string"), "r3": (F.col("k") % 3).cast("string")}


EVENTS_SQL = """e AS (SELECT *, id % 29 = 7 AS lost, CASE WHEN id % 29 = 7 THEN 'orphan-' || id ELSE 't' || id // 64 END AS turn, k % 5 AS r5, k % 3 AS r3 FROM
(SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def _as_records(df: DataFrame, source: str) -> DataFrame:
    """Rows (session_id, seq, value) as the records of a scan."""
    return parsed(df.select(F.lit(source).alias("source"), "session_id", "seq", F.lit("f").alias("file"), "value"))


def records_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = _events(spark, sf_dir)
    value = F.coalesce(*(F.when(F.col("id") % len(RECORDS_A) == m, _filled(t, v)) for m, t in enumerate(RECORDS_A)))
    return _as_records(e.select(F.col("user").alias("session_id"), F.col("id").alias("seq"), value.alias("value")), format_a.SOURCE)


FACT_FIELDS = {"kind": "VARCHAR", "turn": "VARCHAR", "text": "VARCHAR", "aux": "VARCHAR", "path": "VARCHAR", "num": "BIGINT", "exit_text": "VARCHAR", "error": "VARCHAR", "failed": "BOOLEAN", "form": "VARCHAR"}


def _fact(kind: str, own: bool = True, **fields: str) -> str:
    """A struct of a fact; texts are templates, numbers and booleans SQL."""
    values = {"kind": f"'{kind}'", "turn": "turn" if own else "NULL"}
    for name, x in fields.items():
        values[name] = x if FACT_FIELDS[name] in ("BIGINT", "BOOLEAN") else _sql(x)
    return "{" + ", ".join(f"'{c}': CAST({values.get(c, 'NULL')} AS {t})" for c, t in FACT_FIELDS.items()) + "}"


_TOUCH = _fact("touch")
#: What each record of RECORDS_A says, in order.
FACTS_A = (
    [_fact("cwd_first", False, text="/w/${k}"), _fact("originator", False, text="cli"), _fact("version", False, text="1.${k}"), _fact("model_first", False, text="m${k}"), _fact("context_window", False, num="k")],
    [_fact("instructions", False, text="rules ${k}")],
    [_fact("compaction", text="context compacted — earlier history replaced by a summary")],
    [_fact("token_record", False, text="${k}")],
    [_fact("tokens", False, aux="max", num="k")],
    [_fact("ask", text="please do ${k}", aux="append", path="user", form="response")],
    [_TOUCH, _fact("ask", text="brief ${k}", aux="if-empty", path="delegated-in"), _fact("delegation", False, aux="create_thread", text="brief ${k}")],
    [_fact("plan", False, text='[{"step":"s${k}","status":"pending"}]')],
    [_TOUCH],
    [_TOUCH, _fact("final", text="final ${k}"), _fact("duration", num="id")],
    [_TOUCH, _fact("note", text="note\n ${k}")],
    [_TOUCH, _fact("final", text="said ${k}")],
    [_TOUCH, _fact("reasoning", text="Think ${k}"), _fact("reasoning", text="more")],
    [_TOUCH, _fact("command", text="make ${r5} ; x", exit_text="${r3}", num="1500", error="boom ${k}")],
    [_TOUCH, _fact("command", text="ls -l ${r5}", exit_text="0", num="12")],
    [_TOUCH, _fact("file", path="z${r5}.py", aux="add", num="2"), _fact("file", path="b.py", aux="update", num="2"), _fact("file", path="c.py", aux="delete", num="0")],
    [_TOUCH, _fact("tool", text="s.t${r5}", aux="c${k}", failed="true", num="3")],
    [_TOUCH, _fact("ask", text="do ${k}", aux="append-keep-source", path="user", form="event")],
    [_TOUCH, _fact("search", text="q ${k}")],
    [_TOUCH, _fact("search", text="e ${k}")],
    [_TOUCH, _fact("action", aux="ext", text="ext${r5}")],
    [_TOUCH, _fact("action", aux="image", text="viewed image /p/${k}.png")],
    [_TOUCH, _fact("delegation", False, aux="started", text="/a/${k}"), _fact("action", aux="delegate", text="sub-agent started /a/${k} (thread 01234567)")],
    [_TOUCH, _fact("action", aux="delegate", text="agent coordination: send → 2 agent(s)")],
    [_TOUCH, _fact("plan_doc", False, text="plan ${k}")],
    [_TOUCH, _fact("plan", False, text='[{"step":"one ${k}","status":"completed"},{"step":"two","status":"in_progress"}]')],
    [_TOUCH, _fact("action", aux="delegate", text="send_message_to_thread → sub-agent thread")],
    [_TOUCH, _fact("compaction", text="context compacted")],
)
_CASES_A = " ".join(f"WHEN {m} THEN [{', '.join(x)}]" for m, x in enumerate(FACTS_A))
#: All facts with their place, from the events alone; the error of a command that succeeded is null.
FACTS_A_SQL = f"""{EVENTS_SQL}, g AS (SELECT session_id, id AS seq, ts, r3, CASE id % {len(FACTS_A)} {_CASES_A} END AS l FROM e),
h AS (SELECT session_id, seq, ts, r3, unnest(l) AS f, generate_subscripts(l, 1) - 1 AS sub FROM g),
f AS (SELECT session_id, seq, CAST(sub AS INTEGER) AS sub, ts, f.* REPLACE (CASE WHEN f.kind = 'command' AND f.exit_text = '0' THEN NULL ELSE f.error END AS error) FROM h)"""
_SHOWN = ", ".join(FACT_FIELDS)

_queries: dict[str, Callable] = {}
_oracles: dict[str, str] = {}


def query(sql: str):
    def keep(f: Callable) -> Callable:
        _queries[f.__name__] = f
        _oracles[f.__name__] = sql
        return f

    return keep


@query(f"WITH {FACTS_A_SQL} SELECT session_id, seq, sub, {_SHOWN} FROM f")
def format_a_facts(spark, sf_dir):
    """Every rule of format A, one record of each kind in turn."""
    facts = format_a.facts(records_a(spark, sf_dir))
    return facts.select("session_id", "seq", "sub", *("failed" if c == "failed" else c for c in FACT_FIELDS)).withColumn("failed", F.when(F.col("kind") == "tool", F.col("failed")))


def folded_a(spark: SparkSession, sf_dir: str) -> session.Sessions:
    records = records_a(spark, sf_dir)
    read = records.groupBy(*session.S).agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("ok")).alias("parse_failures"))
    return session.fold(written(format_a.facts(records), "facts"), read)


#: Twins: of a turn's asks in two forms the k-th copy in one form goes if the other has k already.
TWINS_SQL = """w AS (SELECT *, CASE WHEN turn LIKE 'orphan-%' THEN '' ELSE turn END AS b FROM f WHERE kind = 'ask' AND form IS NOT NULL),
tw AS (SELECT *, count(*) FILTER (form = 'response') OVER o AS a, count(*) FILTER (form = 'event') OVER o AS c FROM w WINDOW o AS (PARTITION BY session_id, b ORDER BY seq, sub ROWS UNBOUNDED PRECEDING)),
k AS (SELECT * EXCLUDE (b, a, c) FROM tw WHERE NOT (CASE WHEN form = 'response' THEN a <= c ELSE c <= a END) UNION ALL SELECT * FROM f WHERE NOT (kind = 'ask' AND form IS NOT NULL))"""
_SHOWN_KINDS = "('command', 'file', 'tool', 'search', 'action', 'compaction')"
TURNS_SQL = f"""{FACTS_A_SQL}, {TWINS_SQL},
a AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY seq, sub) AS place, row_number() OVER (PARTITION BY session_id, turn, aux = 'if-empty', text ORDER BY seq, sub) AS again FROM k WHERE kind = 'ask'),
asks AS (SELECT session_id, turn, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS ask, coalesce(arg_max(path, seq) FILTER (aux = 'append'), arg_min(path, seq)) AS ask_source FROM a
  WHERE (aux = 'if-empty' AND place = 1) OR (aux <> 'if-empty' AND again = 1) GROUP BY session_id, turn),
t0 AS (SELECT session_id, turn, min(seq * 16 + sub) AS first, arg_min(ts, seq * 16 + sub) AS started_at, arg_max(ts, seq * 16 + sub) AS ended_at, arg_max(text, seq) FILTER (kind = 'final') AS final, arg_max(num, seq) FILTER (kind = 'duration' AND num <> 0) AS given,
  count(*) FILTER (kind = 'note') AS notes, count(*) FILTER (kind = 'reasoning') AS thoughts, count(*) FILTER (kind IN {_SHOWN_KINDS}) AS actions FROM k WHERE turn IS NOT NULL GROUP BY session_id, turn),
t1 AS (SELECT t0.*, ask, ask_source, row_number() OVER (PARTITION BY t0.session_id ORDER BY first) AS n_raw FROM t0 LEFT JOIN asks USING (session_id, turn)),
t2 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first) AS n FROM t1 WHERE ask IS NOT NULL OR final IS NOT NULL OR notes + thoughts + actions > 0)"""


@query(f"""WITH {TURNS_SQL} SELECT session_id, turn, n, n_raw, started_at, ended_at, ask, ask_source, final, coalesce(given, nullif(epoch_ms(CAST(ended_at AS TIMESTAMP)) - epoch_ms(CAST(started_at AS TIMESTAMP)), 0)) AS duration_ms, notes, thoughts, actions FROM t2""")
def fold_turns(spark, sf_dir):
    """Turns of the fold: order, numbers before and after empty ones go, asks without twins and repeats, last final, duration."""
    t = folded_a(spark, sf_dir).turns
    size = lambda c: F.size(c).cast("long").alias({"reasoning": "thoughts"}.get(c, c))
    return t.select("session_id", "turn", F.col("n").cast("long").alias("n"), F.col("n_raw").cast("long").alias("n_raw"), "started_at", "ended_at", "ask", "ask_source", "final", "duration_ms", size("notes"), size("reasoning"), size("actions"))


_LINES_SQL = """CASE kind WHEN 'command' THEN text WHEN 'file' THEN aux || ' ' || path || ' (~' || num || ' lines)' WHEN 'tool' THEN text || ' — ' || aux WHEN 'search' THEN 'web search — "' || text || '"' ELSE text END"""


@query(f"""WITH {FACTS_A_SQL} SELECT session_id, seq, sub, turn, CASE kind WHEN 'command' THEN 'exec' WHEN 'tool' THEN 'mcp' WHEN 'action' THEN aux ELSE kind END AS kind, {_LINES_SQL} AS line, exit_text,
CASE WHEN kind IN ('command', 'tool') THEN num END AS ms, CASE WHEN exit_text <> '0' THEN error END AS error, coalesce(failed, false) AS failed FROM f WHERE kind IN {_SHOWN_KINDS}""")
def fold_actions(spark, sf_dir):
    """The timeline: a line for each command, file change, tool call, search, other action and compaction."""
    a = folded_a(spark, sf_dir).actions
    return a.select("session_id", "seq", "sub", "turn", "kind", "line", "exit_text", "ms", "error", "failed")


@query(f"""WITH {FACTS_A_SQL}, c AS (SELECT session_id, text AS item, count(*) AS a, count(*) FILTER (exit_text <> '0') AS b, min(seq) AS first_seq FROM f WHERE kind = 'command' GROUP BY ALL),
p AS (SELECT session_id, path AS item, count(*) FILTER (aux <> 'delete') AS a, count(*) FILTER (aux = 'delete') AS b, min(seq * 16 + sub) AS first_seq FROM f WHERE kind = 'file' GROUP BY session_id, path),
o AS (SELECT session_id, text AS item, count(*) AS a, 0 AS b, min(seq) AS first_seq FROM f WHERE kind = 'tool' GROUP BY session_id, text),
u AS (SELECT 'commands' AS ledger, * FROM c UNION ALL SELECT 'files', * FROM p UNION ALL SELECT 'tools', * FROM o)
SELECT ledger, session_id, item, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, row_number() OVER (PARTITION BY ledger, session_id ORDER BY a DESC, first_seq) AS rank FROM u""")
def fold_ledgers(spark, sf_dir):
    """Command, file and tool ledgers in the order in which they are listed."""
    by = reports.in_order(folded_a(spark, sf_dir))
    pick = lambda name, item, a, b: by[name].select(F.lit(name).alias("ledger"), "session_id", F.col(item).alias("item"), a.cast("long").alias("a"), b.cast("long").alias("b"), F.col("rank").cast("long").alias("rank"))
    files = pick("files", "path", F.col("n_add") + F.col("n_update"), F.col("n_delete"))
    return pick("commands", "cmd", F.col("runs"), F.col("failures")).union(files).union(pick("tools", "tool", F.col("calls"), F.lit(0)))


FAILED_SQL = """c AS (SELECT session_id, lower(text) AS key, exit_text, error, turn, seq FROM f WHERE kind = 'command'),
x AS (SELECT session_id, key, count(*) FILTER (exit_text <> '0') AS occurrences, min(seq) FILTER (exit_text <> '0') AS first_seq, arg_max(error, seq) FILTER (exit_text <> '0') AS error, arg_max(exit_text, seq) FILTER (exit_text <> '0') AS exit_text,
  arg_max(turn, seq) FILTER (exit_text <> '0') AS turn, count(*) FILTER (exit_text = '0') > 0 AS resolved FROM c GROUP BY session_id, key HAVING count(*) FILTER (exit_text <> '0') > 0)"""


@query(f"WITH {TURNS_SQL}, {FAILED_SQL} SELECT x.session_id, key, occurrences, first_seq, error, exit_text, resolved, n_raw FROM x JOIN t1 ON x.session_id = t1.session_id AND x.turn = t1.turn")
def fold_failures(spark, sf_dir):
    """Failures by command: the last one's values, the first one's place, whether it ever succeeded, and the turn's first number."""
    f = folded_a(spark, sf_dir).failures
    return f.select("session_id", "key", "occurrences", "first_seq", "error", "exit_text", "resolved", F.col("n_raw").cast("long").alias("n_raw"))


@query(f"""WITH {TURNS_SQL}, {FAILED_SQL},
n AS (SELECT session_id, count(*) AS turns FROM t2 GROUP BY session_id),
y AS (SELECT session_id, CAST(sum(occurrences) AS BIGINT) AS errors, count(*) FILTER (NOT resolved) AS outstanding FROM x GROUP BY session_id)
SELECT f.session_id, coalesce(any_value(n.turns), 0) AS turns, count(*) FILTER (kind = 'command') AS commands, count(DISTINCT text) FILTER (kind = 'command') AS unique_commands, count(DISTINCT path) FILTER (kind = 'file') AS files_touched,
coalesce(any_value(y.errors), 0) AS errors, coalesce(any_value(y.outstanding), 0) AS outstanding_errors, count(*) FILTER (kind = 'compaction') AS compactions, coalesce(max(num) FILTER (kind = 'tokens'), 0) AS total_tokens, count(DISTINCT seq) AS lines,
arg_min(text, seq) FILTER (kind = 'cwd_first') AS cwd, arg_min(text, seq) FILTER (kind = 'model_first') AS model, arg_min(text, seq) FILTER (kind = 'instructions') AS instructions, arg_max(text, seq) FILTER (kind = 'plan') AS plan, arg_max(text, seq) FILTER (kind = 'plan_doc') AS plan_doc,
arg_max(text, seq) FILTER (kind = 'token_record') AS token_record, arg_min(num, seq) FILTER (kind = 'context_window') AS context_window
FROM f LEFT JOIN n ON f.session_id = n.session_id LEFT JOIN y ON f.session_id = y.session_id GROUP BY f.session_id""")
def fold_stats(spark, sf_dir):
    """Counters and state of each session: what was first or last seen of folder, model, instructions, plans and tokens."""
    f = folded_a(spark, sf_dir)
    counts = [F.col(c).cast("long").alias(c) for c in ("turns", "commands", "unique_commands", "files_touched", "errors", "outstanding_errors", "compactions", "total_tokens", "lines")]
    state = f.state.select(*session.S, "cwd", "model", "instructions", "plan", "plan_doc", "token_record", "context_window")
    return f.stats.select(*session.S, *counts).join(state, session.S).drop("source")


@query(f"""WITH {FACTS_A_SQL}, s AS (SELECT session_id, 'search' AS what, seq, text, NULL AS more FROM f WHERE kind = 'search' UNION ALL SELECT session_id, 'delegation', seq, text, aux FROM f WHERE kind = 'delegation')
SELECT what, session_id, seq, text, more, row_number() OVER (PARTITION BY what, session_id ORDER BY seq) AS rank FROM s""")
def fold_lists(spark, sf_dir):
    """Web searches and delegations in order, repeats included."""
    by = reports.in_order(folded_a(spark, sf_dir))
    rank = F.col("rank").cast("long").alias("rank")
    found = by["searches"].select(F.lit("search").alias("what"), "session_id", "seq", F.col("query").alias("text"), F.lit(None).cast("string").alias("more"), rank)
    return found.union(by["delegations"].select(F.lit("delegation"), "session_id", "seq", "summary", F.col("kind"), rank))


# ---------------------------------------------------------------- cards and rollups


def sessions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user of the events; even users have no title."""
    e, _ = _events(spark, sf_dir)
    g = e.groupBy("user").agg(F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("bytes"))
    n = F.col("user").cast("long")
    return g.select(
        F.lit(format_a.SOURCE).alias("source"), F.col("user").alias("session_id"), F.when(n % 2 == 1, F.concat(F.lit("Session "), "user")).alias("title"), F.lit(None).cast("string").alias("cwd"), F.lit(None).cast("string").alias("model"),
        F.lit("cli").alias("originator"), "started_at", "updated_at", "bytes", F.lit(1).cast("long").alias("segments"), F.array(F.lit("f")).alias("files"), F.concat(F.lit("codex://threads/"), "user").alias("link"),
    )


def carded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, session.Sessions]:
    folded = folded_a(spark, sf_dir)
    return reports.cards(sessions_of(spark, sf_dir), folded), folded


CARDS_SQL = f"""{TURNS_SQL}, {FAILED_SQL},
se AS (SELECT session_id, min(ts) AS started_at, max(ts) AS updated_at, count(*) AS bytes FROM e GROUP BY session_id),
no AS (SELECT *, row_number() OVER (ORDER BY started_at, session_id) AS number FROM se),
st AS (SELECT session_id, arg_min(text, seq) FILTER (kind = 'cwd_first') AS cwd, arg_min(text, seq) FILTER (kind = 'model_first') AS model, arg_max(text, seq) FILTER (kind = 'plan') AS plan FROM f GROUP BY session_id),
tu AS (SELECT session_id, count(*) AS turns, arg_min(ask, n) FILTER (ask IS NOT NULL) AS first_ask, CASE WHEN count(ask) > 1 THEN arg_max(ask, n) FILTER (ask IS NOT NULL) END AS last_ask, arg_max(final, n) FILTER (final IS NOT NULL) AS last_reply FROM t2 GROUP BY session_id),
co AS (SELECT session_id, count(*) FILTER (kind = 'command') AS commands, count(DISTINCT path) FILTER (kind = 'file') AS files FROM f GROUP BY session_id),
ou AS (SELECT session_id, count(*) AS outstanding FROM x WHERE NOT resolved GROUP BY session_id),
ca AS (SELECT 'S' || number AS code, number, no.session_id, started_at, updated_at, bytes, cwd, model, plan, coalesce(turns, 0) AS turns, coalesce(commands, 0) AS commands, coalesce(files, 0) AS files, coalesce(outstanding, 0) AS outstanding, first_ask, last_ask, last_reply
  FROM no LEFT JOIN st USING (session_id) LEFT JOIN tu USING (session_id) LEFT JOIN co USING (session_id) LEFT JOIN ou USING (session_id))"""


@query(f"""WITH {CARDS_SQL} SELECT code, session_id, CASE WHEN CAST(session_id AS BIGINT) % 2 = 1 THEN 'source-index' WHEN first_ask IS NOT NULL THEN 'first-request' ELSE 'none' END AS title_source, cwd, model, started_at, updated_at, bytes, turns, commands, files, outstanding, first_ask, last_ask, last_reply,
CAST(coalesce(len(list_filter(CAST(plan AS JSON[]), lambda p: json_extract_string(p, '$.status') <> 'completed')), 0) AS BIGINT) AS open_items, CAST(coalesce(json_array_length(plan), 0) AS BIGINT) AS plan_size FROM ca""")
def session_cards(spark, sf_dir):
    """A card for each session with its code."""
    c, _ = carded(spark, sf_dir)
    long = lambda c, name: c.cast("long").alias(name)
    return c.select(
        "code", "session_id", "title_source", "cwd", "model", "started_at", "updated_at", "bytes", long(F.col("turns"), "turns"), long(F.col("commands"), "commands"), long(F.size("files_changed"), "files"), long(F.size("outstanding"), "outstanding"),
        F.col("first_ask.text").alias("first_ask"), F.col("last_ask.text").alias("last_ask"), F.col("last_reply.text").alias("last_reply"), long(F.size("open_plan"), "open_items"), long(F.col("plan_size"), "plan_size"),
    )


@query(f"""WITH {CARDS_SQL} SELECT coalesce(arg_min(cwd, number), '(unknown)') AS folder, count(*) AS n_sessions, CAST(sum(turns) AS BIGINT) AS turns, string_agg(code, ',' ORDER BY number) AS codes FROM ca GROUP BY lower(coalesce(cwd, '(unknown)'))""")
def project_folders(spark, sf_dir):
    c, _ = carded(spark, sf_dir)
    codes = F.array_join(F.transform("numbers", lambda n: F.concat(F.lit("S"), n.cast("string"))), ",")
    return reports.folder_rollup(c).select("folder", "n_sessions", F.col("turns").cast("long").alias("turns"), codes.alias("codes"))


@query(f"WITH {CARDS_SQL} SELECT path, count(DISTINCT f.session_id) AS n_sessions, count(*) AS changes FROM f WHERE kind = 'file' GROUP BY path")
def project_files(spark, sf_dir):
    c, folded = carded(spark, sf_dir)
    return reports.file_rollup(c, folded).select("path", "n_sessions", "changes")


@query(f"""WITH {CARDS_SQL} SELECT key AS cmd, count(*) AS n_sessions, CAST(sum(occurrences) AS BIGINT) AS occurrences, arg_max(error, number * 10000000 + first_seq) AS last_line FROM x JOIN no USING (session_id) WHERE NOT resolved GROUP BY key""")
def project_failures(spark, sf_dir):
    c, folded = carded(spark, sf_dir)
    return reports.failure_rollup(c, folded).select("cmd", "n_sessions", "occurrences", "last_line")


@query(f"WITH {CARDS_SQL} SELECT text AS tool, count(*) AS calls FROM f WHERE kind = 'tool' GROUP BY text")
def project_tools(spark, sf_dir):
    return reports.tool_rollup(carded(spark, sf_dir)[1]).select("tool", "calls")


@query(f"""WITH {CARDS_SQL} SELECT count(*) AS sessions, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(commands) AS BIGINT) AS commands, CAST(sum(outstanding) AS BIGINT) AS outstanding_failures, CAST(sum(bytes) AS BIGINT) AS bytes,
arg_min(started_at, number) AS started_at, max(updated_at) AS updated_at, (SELECT count(DISTINCT path) FROM f WHERE kind = 'file') AS files_changed FROM ca""")
def project_totals(spark, sf_dir):
    c, folded = carded(spark, sf_dir)
    long = lambda k: F.col(k).cast("long").alias(k)
    return reports.totals(c, folded).select(*(long(k) for k in ("sessions", "turns", "commands", "outstanding_failures", "bytes", "files_changed")), "started_at", "updated_at")


@query(f"""WITH {CARDS_SQL}, r AS (SELECT code, number, n, t2.started_at, ask, sum(CAST(floor((least(length(ask), 220) + 40) / 4.0 + 0.5) AS BIGINT)) OVER (ORDER BY t2.started_at DESC, number DESC, n DESC ROWS UNBOUNDED PRECEDING) AS used FROM t2 JOIN ca USING (session_id) WHERE ask IS NOT NULL)
SELECT code, n, started_at, ask FROM r WHERE used <= 2000""")
def project_requests(spark, sf_dir):
    """The newest requests of all sessions within 2000 tokens."""
    c, folded = carded(spark, sf_dir)
    return reports.requests(c, folded, 2000).select("code", F.col("n").cast("long").alias("n"), "started_at", "ask")


# ---------------------------------------------------------------- format B

_B = '{"type":"%s","timestamp":"${ts}","data":{%s}}'


def _start(name: str, args: str, more: str = "") -> str:
    return _B % ("tool.execution_start", f'"toolCallId":"c${{id}}","toolName":"{name}","interactionId":"t${{number}}"{more},"arguments":{args}')


def _done(body: str) -> str:
    return _B % ("tool.execution_complete", f'"toolCallId":"c${{id}}",{body}')


_SAYS = _B % ("%s", '"interactionId":"t${number}",%s')
#: One or two records of format B for each event, by its number modulo 24.
RECORDS_B = (
    (_B % ("session.start", '"sessionId":"x","context":{"cwd":"/w/${k}"},"selectedModel":"m${k}","producer":"p","copilotVersion":"9","startTime":"${ts}"'),),
    (_SAYS % ("system.message", '"content":"a<custom_instruction> rule ${k} </custom_instruction>b<custom_instruction>z</custom_instruction>"'),),
    (_SAYS % ("user.message", '"content":" ask ${k} ","attachments":[{"displayName":"f.txt"},{"path":"/g"}]'),),
    (_SAYS % ("user.message", '"content":"ask ${k}","source":"agent-x"'),),
    (_SAYS % ("user.message", '"content":"no","source":"skill-x"'),),
    (_SAYS % ("assistant.message", '"content":"said ${k}","model":"n${k}","reasoningText":"\\n first ${k}\\nsecond"'),),
    (_SAYS % ("assistant.message", '"content":"doing ${k}","toolRequests":[{"a":1}]'),),
    (_SAYS % ("assistant.message", '"content":"answer ${k}","phase":"final_answer","toolRequests":[{"a":1}]'),),
    (_start("bash", '{"command":"make ${r5}"}'), _done('"success":true,"shellExecution":{"exitCode":${r3}},"result":{"content":"out ${k}"}')),
    (_start("bash", '{"command":"ls ${r5}"}'), _done('"success":true,"result":{"content":"out\\n<exited with exit code ${r3}>"}')),
    (_start("powershell", '{"command":"rm ${r5}"}'), _done('"success":false,"error":{"message":"denied ${k}"}')),
    (_start("create", '{"path":"/f/${r5}","file_text":"1\\n2\\n3"}'), _done('"success":true')),
    (_start("edit", '{"path":"/f/${r5}","old_str":"a","new_str":"b\\nc"}'), _done('"success":true')),
    (_start("edit", '{"path":"/f/${r5}"}'), _done('"success":false,"error":{"message":"no match"}')),
    (_start("apply_patch", '"*** Begin Patch\\n*** Update File: /o.py\\n-a\\n+b\\n*** Add File: /n${r5}.py\\n+1\\n*** Delete File: /d.py\\n*** End Patch"'), _done('"success":true')),
    (_start("view", '{"path":"/v/${r5}"}'), _done('"success":true')),
    (_start("view", '{"path":"/v/${r5}"}'), _done('"success":false,"error":{"message":"gone"}')),
    (_start("web_search", '{"query":"q ${k}"}'), _done('"success":true')),
    (_start("ask_user", '{"question":"Which ${k}?"}'), _done('"success":true,"result":{"content":"blue"}')),
    (_start("report_intent", '{"intent":"x"}'), _done('"success":true')),
    (_start("grep", '{"pattern":"p${k}"}', ',"mcpServerName":"srv","mcpToolName":"grep${r5}"'), _done('"success":true')),
    (_start("skill", '{"skill":"s${r5}"}'), _done('"success":false')),
    (_done('"success":false'), _B % ("session.shutdown", '"tokenDetails":{"input":{"tokenCount":5},"output":{"tokenCount":${k}}}')),
    (_B % ("session.compaction_complete", '"preCompactionTokens":1234567,"postCompactionTokens":1000,"summaryContent":"sum ${k}"'), _B % ("session.task_complete", '"summary":"done ${k}"')),
)


def records_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = _events(spark, sf_dir)
    whole = F.coalesce(*(F.when(F.col("id") % len(RECORDS_B) == m, F.array(*(_filled(t, v) for t in ts))) for m, ts in enumerate(RECORDS_B)))
    dealt = e.repartition(4 * spark.sparkContext.defaultParallelism, "id")  # a row group of events makes a gigabyte of records
    rows = dealt.select(F.col("user").alias("session_id"), "id", F.posexplode(whole).alias("i", "value"))
    return _as_records(rows.select("session_id", (F.col("id") * 2 + F.col("i")).alias("seq"), "value"), format_b.SOURCE)


def _own(*facts: str) -> list[str]:
    return list(facts)


_MODEL = _fact("model_last", False)
#: What each record says, by event and record; a record always has the model of that moment, null where it names none. The turn
#: of events without an interaction is that of the last one seen, ``now``.
FACTS_B = (
    (_own(_fact("originator", False, text="p"), _fact("version", False, text="9"), _fact("started_at", False, text="${ts}"), _fact("cwd_last", False, text="/w/${k}"), _fact("model_last", False, text="m${k}")),),
    (_own(_MODEL, _fact("instructions", False, text="rule ${k}\n\nz")),),
    (_own(_MODEL, _fact("ask", text="ask ${k}\n\n[attached: f.txt, /g]", aux="append", path="user")),),
    (_own(_MODEL, _fact("ask", text="ask ${k}", aux="append", path="delegated-message")),),
    (_own(_MODEL),),
    (_own(_fact("model_last", False, text="n${k}"), _TOUCH, _fact("reasoning", text="first ${k}"), _fact("final", text="said ${k}", aux="demote")),),
    (_own(_MODEL, _TOUCH, _fact("note", text="doing ${k}")),),
    (_own(_MODEL, _TOUCH, _fact("final", text="answer ${k}", aux="demote")),),
    (_own(_MODEL), _own(_MODEL, _TOUCH, _fact("command", text="make ${r5}", exit_text="${r3}", error="out ${k}"))),
    (_own(_MODEL), _own(_MODEL, _TOUCH, _fact("command", text="ls ${r5}", exit_text="${r3}", error="out"))),
    (_own(_MODEL), _own(_MODEL, _TOUCH, _fact("command", text="rm ${r5}", exit_text="blocked", error="denied ${k}"))),
    (_own(_MODEL), _own(_MODEL, _TOUCH, _fact("file", path="/f/${r5}", aux="add", num="3"))),
    (_own(_MODEL), _own(_MODEL, _TOUCH, _fact("file", path="/f/${r5}", aux="update", num="2"))),
    (_own(_MODEL), _own(_MODEL, _TOUCH, _fact("action", aux="file", text="edit /f/${r5} — no match", failed="true"))),
    (_own(_MODEL), _own(_MODEL, _TOUCH, _fact("file", path="/o.py", aux="update", num="2"), _fact("file", path="/n${r5}.py", aux="add", num="1"), _fact("file", path="/d.py", aux="delete", num="0"))),
    (_own(_MODEL), _own(_MODEL, _TOUCH, _fact("read", path="/v/${r5}", aux="view"))),
    (_own(_MODEL), _own(_MODEL, _TOUCH, _fact("action", aux="read", text="view /v/${r5} — gone", failed="true"))),
    (_own(_MODEL), _own(_MODEL, _TOUCH, _fact("search", text="q ${k}"))),
    (_own(_MODEL), _own(_MODEL, _TOUCH, _fact("ask", text="**Agent asked:** Which ${k}?\n\n**User answered:** blue", aux="append-keep-source", path="user"))),
    (_own(_MODEL), _own(_MODEL, _TOUCH)),
    (_own(_MODEL), _own(_MODEL, _TOUCH, _fact("tool", text="srv.grep${r5}", aux="p${k}", failed="false"))),
    (_own(_MODEL), _own(_MODEL, _TOUCH, _fact("action", aux="skill", text="skill s${r5}", failed="true"))),
    (_own(_MODEL, _TOUCH.replace("(turn", "(now"), _fact("tool", text="unknown-tool", failed="true").replace("(turn", "(now")), _own(_MODEL, _fact("tokens", False, aux="sum", num="k + 5"))),
    (_own(_MODEL, _TOUCH.replace("(turn", "(now"), _fact("compaction", text="context compacted (1,234,567 → 1,000 tokens)").replace("(turn", "(now"), _fact("summary", False, text="sum ${k}")), _own(_MODEL, _fact("final", text="done ${k}").replace("(turn", "(now"))),
)
_CASES_B = " ".join(f"WHEN {m} THEN [{', '.join('[' + ', '.join(x) + ']' for x in facts)}]" for m, facts in enumerate(FACTS_B))
#: Records 1 to 7 open an interaction and so set that of the moment.
FACTS_B_SQL = f"""{EVENTS_SQL}, b0 AS (SELECT * REPLACE ('t' || id // 64 AS turn), coalesce(last_value(CASE WHEN id % 24 BETWEEN 1 AND 7 THEN 't' || id // 64 END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY id ROWS UNBOUNDED PRECEDING), 'session') AS now FROM e),
b1 AS (SELECT session_id, id, ts, CASE id % 24 {_CASES_B} END AS l FROM b0),
b2 AS (SELECT session_id, id, ts, unnest(l) AS m, generate_subscripts(l, 1) - 1 AS i FROM b1),
b3 AS (SELECT session_id, id * 2 + i AS seq, ts, unnest(m) AS f, generate_subscripts(m, 1) - 1 AS sub FROM b2),
f AS (SELECT session_id, seq, CAST(sub AS INTEGER) AS sub, ts, f.* FROM b3)"""


@query(f"WITH {FACTS_B_SQL} SELECT session_id, seq, sub, {_SHOWN} FROM f")
def format_b_facts(spark, sf_dir):
    """The rules of format B: turns of calls and completions, outcomes, patches, messages, state as of each record."""
    facts = format_b.facts(records_b(spark, sf_dir))
    return facts.select("session_id", "seq", "sub", *FACT_FIELDS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
