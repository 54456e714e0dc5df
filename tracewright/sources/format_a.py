"""Format A: rollout files of typed payloads. Discovery, and the rules that turn records into facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.sources.logs import exploded, fact, first_lines, full, get, lines

SOURCE = "codex"  # the name by which logs and links of this format are known
P, I = "$.payload", "$.payload.item"
_META = "internal_chat_message_metadata_passthrough"

# Fixed values of the format: kinds and heads of message parts that a tool adds around the user's words, phrases of
# review prompts that replay a transcript, and the calls that open or address another thread.
ENVELOPE_KINDS = ("plugins.recommendations", "agents_md.instructions", "environments.environment_context", "memories.instructions", "generic.developer_instructions", "multi_agent.role_instructions", "apps.instructions", "skills.instructions")
ENVELOPE_HEADS = ("<recommended_plugins>", "<environment_context>", "# AGENTS.md instructions", "<app-context>", "<user_instructions>", "<multi_agent_role>", "## Memory", "# Collaboration Mode")
REVIEW_PHRASES = ("whose request action you are assessing", "since your last approval assessment", ">>> TRANSCRIPT START", ">>> TRANSCRIPT DELTA START", "You are a security reviewer")
THREAD_CALLS = ("create_thread", "send_message_to_thread")
AMBIENT = r"(?s)<in-app-browser-context.*?</in-app-browser-context>"
REQUEST = r"(?im)^##\s*My request:\s*"
PLAN_CALL = r"(?s)update_plan\(\s*(\{.*?\})\s*\)"
_QUOTED = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
PLAN_STEP = rf"step\s*:\s*{_QUOTED}\s*,\s*status\s*:\s*{_QUOTED}"
STEPS = "array<struct<step:string,status:string>>"


def headers(spark: SparkSession, root: str, only: DataFrame | None = None) -> DataFrame:
    """A row per rollout file with an id: session_id, file, size, mtime, started_at, cwd, originator, model, and of its name
    the stamp and the id of the thread it was forked from. With ``only`` (file) just those files."""
    first = first_lines(spark, root, only=only)
    rec = F.try_parse_json("value")
    h = first.withColumn("rec", F.when(get("$.type", of=rec) == "session_meta", rec))
    part = lambda k: full(F.regexp_extract("file", rf"rollout-(.+?)-({X.UUID})(?:_({X.UUID}))?\.jsonl$", k))
    h = h.select(
        F.lit(SOURCE).alias("source"), F.lower(F.coalesce(full(get(f"{P}.session_id")), full(get(f"{P}.id")), part(2))).alias("session_id"), "file", "size", "mtime",
        get(f"{P}.timestamp").alias("started_at"), get(f"{P}.cwd").alias("cwd"), get(f"{P}.originator").alias("originator"), get(f"{P}.base_instructions.provenance.model").alias("model"),
        part(1).alias("stamp"), F.lower(part(3)).alias("fork_id"),
    )
    return h.filter("session_id is not null")


def titles(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, title) of an index of thread names; bad lines are skipped, the last line of an id wins."""
    rec = F.try_parse_json("value")
    t = lines(spark, path, recursive=False).select("line_no", F.lower(full(get("$.id", of=rec))).alias("session_id"), full(get("$.thread_name", of=rec)).alias("title"))
    return t.filter("session_id is not null").groupBy("session_id").agg(F.max_by(F.struct("title"), "line_no").alias("t")).select("session_id", "t.title")


def sessions(found: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A row per session: the newest segment gives cwd, model and originator, the oldest the start."""
    by = F.struct("mtime", "file")
    new = lambda c: F.max_by(c, by).alias(c)
    s = found.groupBy("source", "session_id").agg(
        new("cwd"), new("model"), new("originator"), F.min_by("started_at", by).alias("started_at"), F.max("mtime").alias("updated_at"),
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("segments"), F.array_sort(F.collect_list("file")).alias("files"),
    )
    s = s.join(names, "session_id", "left") if names is not None else s.withColumn("title", F.lit(None).cast("string"))
    return s.withColumn("link", F.concat(F.lit("codex://threads/"), F.col("session_id")))


def users_words(text: Column) -> Column:
    """The user's own words of a message; null for review prompts and for what is nothing but context."""
    review = F.lit(False)
    for phrase in REVIEW_PHRASES:
        review = review | F.contains(text, F.lit(phrase))
    bare = X.trim_all(F.regexp_replace(text, AMBIENT, ""))
    asked = X.trim_all(F.element_at(F.split(bare, REQUEST), -1))
    return F.when((X.trim_all(text) != "") & ~review & (F.length(asked) >= 2), asked)


def _parts(path: str) -> Column:
    return F.transform(get(path, "array<variant>"), lambda c: F.coalesce(get("$.text", of=c), F.lit("")))


def _message(path: str) -> Column:
    kinds = get(f"{path}.{_META}.content_item_kinds", "array<string>")

    def own(x: Column, i: Column) -> Column:
        kind, head = full(F.get(kinds, i)), F.regexp_replace(x, r"(?U)^\s+", "")
        envelope = F.lit(False)
        for h in ENVELOPE_HEADS:
            envelope = envelope | F.startswith(head, F.lit(h))
        return (head != "") & F.when(kind.isNotNull(), ~kind.isin(*ENVELOPE_KINDS)).otherwise(~envelope)

    return users_words(F.array_join(F.filter(_parts(f"{path}.content"), own), "\n\n"))


def command_text(path: str = I) -> Column:
    parsed = F.filter(F.transform(get(f"{path}.parsed_cmd", "array<variant>"), lambda c: get("$.cmd", of=c)), lambda c: c != "")
    return F.coalesce(full(F.array_join(parsed, " ; ")), F.array_join(get(f"{path}.command", "array<string>"), " "), get(f"{path}.command"), F.lit("(unknown command)"))


def milliseconds(path: str) -> Column:
    parts = F.coalesce(get(f"{path}.secs", "double"), F.lit(0.0)) * 1000 + F.coalesce(get(f"{path}.nanos", "double"), F.lit(0.0)) / 1e6
    return F.coalesce(get(path, "double"), F.when(get(path).isNotNull(), F.floor(parts + 0.5).cast("double"))).cast("long")


def _script_plan(script: Column) -> Column:
    """The last plan with steps among the ``update_plan`` calls of a script, as JSON."""
    quoted = lambda s: F.get(F.from_json(F.concat(F.lit('["'), F.substring(s, 2, F.length(s) - 2), F.lit('"]')), "array<string>"), F.lit(0))
    steps = lambda b: F.zip_with(F.regexp_extract_all(b, F.lit(PLAN_STEP), 1), F.regexp_extract_all(b, F.lit(PLAN_STEP), 2), lambda a, z: F.struct(quoted(a).alias("step"), quoted(z).alias("status")))
    plans = F.filter(F.transform(F.regexp_extract_all(script, F.lit(PLAN_CALL), 1), steps), lambda p: F.size(p) > 0)
    return F.when(F.contains(script, F.lit("update_plan")), F.to_json(F.try_element_at(plans, F.lit(-1))))


def _listed_plan() -> Column:
    def step(s: Column) -> Column:
        done = F.when(F.coalesce(get("$.completed", "boolean", s), F.lit(False)), "completed").otherwise("pending")
        return F.struct(F.coalesce(get("$.step", of=s), get("$.text", of=s), s.cast("string")).alias("step"), F.coalesce(get("$.status", of=s), done).alias("status"))

    items = F.coalesce(get(f"{I}.items", "array<variant>"), get(f"{I}.plan", "array<variant>"))
    return F.when(F.size(items) > 0, F.to_json(F.transform(items, step)))


def _file_changes(when: Column, turn: Column) -> Column:
    kinds = "map<string,struct<type:string,content:string,unified_diff:string,diff:string>>"
    entries = F.map_entries(F.from_json(F.get_json_object("value", f"{I}.changes"), kinds))  # a map of parsed JSON keeps its order

    def change(e: Column) -> Column:
        c = e["value"]
        verb = F.when(c["type"] == "add", "add").when(c["type"].isin("delete", "remove"), "delete").otherwise("update")
        n = F.when(c["content"].isNotNull(), X.count_lines(c["content"])).otherwise(X.diff_lines(F.coalesce(c["unified_diff"], c["diff"])))
        return fact("file", turn=turn, path=e["key"], aux=verb, num=n, quiet=False)

    return F.when(when, F.transform(entries, change))


def facts(records: DataFrame) -> DataFrame:
    """The facts of format A's records (:func:`tracewright.sources.logs.records`), one projection over all records.

    A completed item counts at its first appearance in the session. A turn without an id is a turn of its own.
    """
    from tracewright.operators.ordered import first_wins

    r = records.filter("ok")
    item = (get("$.type") == "event_msg") & (get(f"{P}.type") == "item_completed")
    r = first_wins(r.withColumn("_item", F.when(item, full(get(f"{I}.id")))), ["source", "session_id", "_item"], "seq").drop("_item")
    typ, ptype, itype = get("$.type"), get(f"{P}.type"), get(f"{I}.type")
    event, response = typ == "event_msg", typ == "response_item"
    item = event & (ptype == "item_completed")
    orphan = F.concat(F.lit("orphan-"), F.col("seq").cast("string"))
    own = F.coalesce(full(get(f"{P}.turn_id")), orphan)
    theirs = F.coalesce(full(get(f"{P}.{_META}.turn_id")), orphan)
    is_ = lambda *kinds: item & itype.isin(*kinds)
    thread_call = response & (ptype == "function_call_output") & get(f"{P}.name").isin(*THREAD_CALLS)
    given = full(X.trim_all(F.regexp_extract(get(f"{P}.output"), r"(?s)<input>(.*?)</input>", 1)))
    said = X.trim_all(F.array_join(_parts(f"{I}.content"), "\n"))
    code = F.coalesce(get(f"{I}.exit_code", "long"), F.lit(0))
    output = F.coalesce(full(X.trim_all(get(f"{I}.stderr"))), X.trim_all(F.coalesce(full(get(f"{I}.aggregated_output")), get(f"{I}.stdout"))))
    searches = (itype == "WebSearch") | (F.coalesce(get(f"{I}.kind") == "web.search", F.lit(False))) | F.coalesce(get(f"{I}.action.type") == "search", F.lit(False))
    what = F.coalesce(get(f"{I}.kind"), F.lit("activity"))
    receivers = F.coalesce(full(F.array_join(get(f"{I}.receiver_agents", "array<string>"), ", ")), F.concat(F.coalesce(F.array_size(get(f"{I}.receiver_thread_ids", "array<variant>")), F.lit(0)).cast("string"), F.lit(" agent(s)")))
    meta = typ == "session_meta"
    singles = [
        fact("cwd_first", meta, text=get(f"{P}.cwd")), fact("originator", meta, text=get(f"{P}.originator")), fact("version", meta, text=get(f"{P}.cli_version")),
        fact("model_first", meta, text=get(f"{P}.base_instructions.provenance.model")), fact("context_window", meta, num=get(f"{P}.context_window", "long")),
        fact("instructions", typ == "world_state", text=full(get(f"{P}.state.agents_md.text"))),
        fact("compaction", typ == "compacted", turn=F.coalesce(full(get(f"{P}.replacement_history[0].{_META}.turn_id")), orphan), text="context compacted — earlier history replaced by a summary"),
        fact("token_record", typ == "token_usage_record", text=F.coalesce(F.get_json_object("value", f"{P}.thread_token_usage"), F.get_json_object("value", f"{P}.usage"))),
        fact("ask", response & (ptype == "message") & (get(f"{P}.role") == "user") & _message(P).isNotNull(), turn=theirs, text=_message(P), aux="append", path="user", form="response"),
        fact("touch", thread_call, turn=theirs),
        fact("ask", thread_call & given.isNotNull(), turn=theirs, text=given, aux="if-empty", path=F.when(get(f"{P}.name") == "create_thread", "delegated-in").otherwise("delegated-message")),
        fact("delegation", thread_call, aux=get(f"{P}.name"), text=X.one_line(F.coalesce(given, get(f"{P}.output")), 160)),
        fact("plan", response & ptype.isin("custom_tool_call", "function_call"), text=_script_plan(F.coalesce(get(f"{P}.input"), get(f"{P}.arguments")))),
        fact("touch", event & ptype.isin("task_started", "task_complete", "item_completed"), turn=own),
        fact("final", event & (ptype == "task_complete"), turn=own, text=get(f"{P}.last_agent_message")),
        fact("duration", event & (ptype == "task_complete"), turn=own, num=get(f"{P}.duration_ms", "long")),
        fact("tokens", event & (ptype == "token_count"), aux="max", num=get(f"{P}.info.total_token_usage.total_tokens", "long")),
        fact("note", is_("AgentMessage") & (get(f"{I}.phase") == "commentary"), turn=own, text=full(said)),
        fact("final", is_("AgentMessage") & F.coalesce(get(f"{I}.phase") != "commentary", F.lit(True)), turn=own, text=full(said)),
        fact("command", is_("CommandExecution"), turn=own, text=command_text(), exit_text=code.cast("string"), num=milliseconds(f"{I}.duration"), error=F.when(code != 0, output), quiet=False),
        fact("tool", is_("McpToolCall"), turn=own, text=F.concat_ws(".", F.coalesce(get(f"{I}.server"), F.lit("undefined")), F.coalesce(get(f"{I}.tool"), F.lit("undefined"))), aux=F.coalesce(get(f"{I}.arguments.title"), get(f"{I}.arguments.code"), get(f"{I}.arguments.query")), failed=F.coalesce(get(f"{I}.result.isError", "boolean"), F.lit(False)), num=milliseconds(f"{I}.duration"), quiet=False),
        fact("ask", is_("UserMessage") & users_words(said).isNotNull(), turn=own, text=users_words(said), aux="append-keep-source", path="user", form="event"),
        fact("search", is_("WebSearch", "Extension") & searches, turn=own, text=F.coalesce(get(f"{I}.query"), get(f"{I}.action.query"), F.lit(""))),
        fact("action", is_("Extension") & ~searches, turn=own, aux="ext", text=F.coalesce(get(f"{I}.kind"), F.lit("extension"))),
        fact("action", is_("ImageView"), turn=own, aux="image", text=F.concat(F.lit("viewed image "), X.one_line(get(f"{I}.path"), 160))),
        fact("delegation", is_("SubAgentActivity"), aux=F.coalesce(get(f"{I}.kind"), F.lit("sub-agent")), text=F.coalesce(get(f"{I}.agent_path"), F.lit(""))),
        fact("action", is_("SubAgentActivity"), turn=own, aux="delegate", text=F.concat(F.lit("sub-agent "), what, F.lit(" "), F.coalesce(get(f"{I}.agent_path"), F.lit("")), F.lit(" (thread "), F.substring(F.coalesce(get(f"{I}.agent_thread_id"), F.lit("")), 1, 8), F.lit(")"))),
        fact("action", is_("CollabAgentToolCall"), turn=own, aux="delegate", text=F.concat(F.lit("agent coordination: "), F.coalesce(get(f"{I}.tool"), F.lit("")), F.lit(" → "), receivers)),
        fact("plan_doc", is_("Plan"), text=full(get(f"{I}.text"))),
        fact("action", is_("FunctionCallOutput") & get(f"{I}.name").isin(*THREAD_CALLS), turn=own, aux="delegate", text=F.concat(get(f"{I}.name"), F.lit(" → sub-agent thread"))),
        fact("compaction", is_("ContextCompaction"), turn=own, text="context compacted"),
        fact("plan", is_("TodoList", "PlanUpdate"), text=_listed_plan()),
    ]
    thoughts = F.filter(F.transform(get(f"{I}.summary_text", "array<variant>"), lambda s: F.coalesce(get("$.text", of=s), F.when(F.schema_of_variant(s) == "STRING", s.cast("string")))), lambda s: s != "")
    reasoning = F.when(is_("Reasoning"), F.transform(thoughts, lambda s: fact("reasoning", turn=own, text=X.trim_all(F.replace(s, F.lit("**"), F.lit(""))))))
    return exploded(r, get("$.timestamp"), singles, [reasoning, _file_changes(is_("FileChange"), own)])


def searchable(records: DataFrame) -> DataFrame:
    """(source, session_id, seq, ts, turn, label, text, stdout, stderr, exit_text): what search and replay read."""
    p, i = P, I
    pick = lambda path: full(get(path))
    listed = lambda path, key: F.array_join(F.transform(get(path, "array<variant>"), lambda c: get(f"$.{key}", of=c)), "\n")
    out_text = F.when(F.schema_of_variant(get(f"{p}.output", "variant")) == "STRING", get(f"{p}.output"))
    changes = F.array_join(F.flatten(F.transform(F.map_entries(F.from_json(F.get_json_object("value", f"{i}.changes"), "map<string,struct<content:string,unified_diff:string,diff:string>>")), lambda e: F.array(e["key"], e["value"]["content"], F.coalesce(e["value"]["unified_diff"], e["value"]["diff"])))), "\n")
    bits = [
        pick(f"{p}.last_agent_message"), full(listed(f"{p}.content", "text")), full(listed(f"{i}.content", "text")), pick(f"{i}.query"), pick(f"{i}.text"), pick(f"{i}.stdout"), pick(f"{i}.stderr"),
        pick(f"{i}.aggregated_output"), pick(f"{i}.formatted_output"), pick(f"{p}.input"), pick(f"{p}.arguments"), full(out_text), full(listed(f"{p}.output", "text")), full(listed(f"{i}.parsed_cmd", "cmd")),
        full(F.array_join(get(f"{i}.command", "array<string>"), " ")), full(changes), full(F.get_json_object("value", f"{i}.arguments")), full(F.substring(F.get_json_object("value", f"{i}.result"), 1, 20000)),
        full(F.array_join(F.transform(get(f"{i}.summary_text", "array<variant>"), lambda s: F.coalesce(get("$.text", of=s), s.cast("string"))), "\n")),
    ]
    code, itype = F.coalesce(get(f"{i}.exit_code"), F.lit("0")), get(f"{i}.type")
    label = (
        F.when((get("$.type") == "response_item") & (get(f"{p}.type") == "message"), F.concat(get(f"{p}.role"), F.lit(" message")))
        .when(get(f"{p}.type") == "task_complete", "final answer")
        .when(itype == "CommandExecution", F.concat(F.lit("command (exit "), code, F.lit("): "), X.one_line(command_text(), 120)))
        .when(itype == "FileChange", F.concat(F.lit("file change: "), F.array_join(F.json_object_keys(F.get_json_object("value", f"{i}.changes")), ", ")))
        .when(itype == "McpToolCall", F.concat(F.lit("tool "), get(f"{i}.server"), F.lit("."), get(f"{i}.tool")))
        .otherwise(F.coalesce(itype, get(f"{p}.type"), get("$.type")))
    )
    orphan = F.concat(F.lit("orphan-"), F.col("seq").cast("string"))
    turn = F.coalesce(full(get(f"{p}.turn_id")), full(get(f"{p}.{_META}.turn_id")), orphan)
    replayed = (get("$.type") != "response_item") & (itype.isin("CommandExecution", "FileChange", "AgentMessage", "UserMessage", "McpToolCall") | (get(f"{p}.type") == "task_complete"))
    return records.filter("ok").select(
        "source", "session_id", "seq", get("$.timestamp").alias("ts"), turn.alias("turn"), label.alias("label"), F.concat_ws("\n", *bits).alias("text"),
        F.coalesce(pick(f"{i}.formatted_output"), pick(f"{i}.aggregated_output"), pick(f"{i}.stdout")).alias("output"), pick(f"{i}.stderr").alias("stderr"),
        F.when(itype == "CommandExecution", code).alias("exit_text"), F.coalesce(replayed, F.lit(False)).alias("replayed"),
    )
