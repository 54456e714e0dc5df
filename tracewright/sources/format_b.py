"""Format B: event folders. Discovery, the assignment of events to turns, and the rules that turn records into facts."""

from __future__ import annotations

import json
import os
import re
import sqlite3
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import text as X
from tracewright.operators.ordered import asof_latest, carried, carry_forward, roots
from tracewright.scratch import written
from tracewright.sources.logs import SESSION, existing, exploded, fact, first_lines, full, get, listing

SOURCE = "copilot"  # the name by which logs and links of this format are known
D = "$.data"

# Fixed values of the format: its shell, editing and silent tools, and the events that open or belong to a turn.
SHELLS = ("powershell", "bash", "shell", "local_shell")
SHELL_FOLLOW_UPS = ("read_powershell", "write_powershell", "stop_powershell", "list_powershell", "read_bash", "write_bash", "stop_bash", "list_bash")
EDITS = ("edit", "str_replace", "str-replace")
SILENT = ("report_intent", "task_complete")
TURN_EVENTS = ("user.message", "assistant.turn_start", "assistant.message", "system.message")
SUBAGENT_EVENTS = ("subagent.started", "subagent.completed", "subagent.failed", "subagent.selected")
LABEL_FIELDS = ("description", "query", "url", "pattern", "path", "title", "skill", "agent_id", "shellId")

# ---------------------------------------------------------------- discovery


def _scalar(raw: str):
    raw = raw.strip()
    if raw in ("", "null", "~"):
        return None
    if raw[0] == "'" and raw[-1] == "'" and len(raw) > 1:
        return raw[1:-1].replace("''", "'")
    if raw[0] == '"' and raw[-1] == '"' and len(raw) > 1:
        try:
            return json.loads(raw)
        except ValueError:
            return raw[1:-1]
    return raw == "true" if raw in ("true", "false") else int(raw) if re.fullmatch(r"-?\d+", raw) else raw


def flat_yaml(text: str) -> dict[str, str | int | bool | None]:
    """The top-level keys of a flat YAML document with plain, quoted and block (``|``, ``>``) scalars; plain ``true``,
    ``false`` and whole numbers have their types."""
    out, rows, k = {}, (text or "").split("\n"), 0
    while k < len(rows):
        m = re.match(r"([A-Za-z_][\w-]*):(?:\s(.*)|\s*)$", rows[k].rstrip("\r"))
        k += 1
        if not m:
            continue
        value = (m[2] or "").strip()
        if re.fullmatch(r"[|>][+-]?", value):
            block = []
            while k < len(rows) and (not rows[k].strip() or rows[k][0] in " \t"):
                block.append(rows[k].strip())
                k += 1
            out[m[1]] = (" " if value[0] == ">" else "\n").join(block).strip()
        else:
            out[m[1]] = _scalar(value)
    return out


WORKSPACE = ("id", "created_at", "cwd", "name", "summary", "user_named", "client_name", "git_root", "branch", "repository")


def _as_text(value: str | int | bool | None) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


@F.pandas_udf(T.StructType([T.StructField(k, T.BooleanType() if k == "user_named" else T.StringType()) for k in WORKSPACE]))
def _workspace(texts: pd.Series) -> pd.DataFrame:
    """Texts are texts, whatever YAML takes them for; a flag is one only if it is written as one."""
    rows = [{k: (v if isinstance(v, bool) else None) if k == "user_named" else _as_text(v) for k in WORKSPACE for v in [d.get(k)]} for d in map(flat_yaml, texts)]
    return pd.DataFrame(rows, columns=list(WORKSPACE), dtype=object)


@F.pandas_udf(T.StringType())
def _todos(databases: pd.Series) -> pd.Series:
    def read(content):
        try:
            with tempfile.NamedTemporaryFile(suffix=".db") as f:  # read and gone within this row
                f.write(content)
                f.flush()
                with sqlite3.connect(f"file:{f.name}?mode=ro&immutable=1", uri=True) as db:
                    rows = db.execute("SELECT title, status FROM todos ORDER BY rowid").fetchall()
        except (sqlite3.Error, TypeError, OSError):
            return None
        state = {"done": "completed", "in_progress": "in_progress"}
        return json.dumps([{"step": f"{t} (blocked)" if s == "blocked" else t, "status": state.get(s, "pending")} for t, s in rows]) if rows else None

    return databases.map(read)


def _folder(c: str) -> Column:
    return F.regexp_replace(c, "/[^/]*$", "")


def _small_files(spark: SparkSession, root: str, name: str, only: DataFrame | None = None) -> DataFrame:
    if not existing(spark, root):
        return spark.createDataFrame([], "dir string, content binary, mtime timestamp")
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(root)
    found = found.select(_folder("_metadata.file_path").alias("dir"), "content", F.col("modificationTime").alias("mtime"))
    return found.join(only, "dir", "left_semi") if only is not None else found


def title_of_name(name: Column) -> Column:
    """The first line that opens no markup; over 100 characters it is cut at a word."""
    rows = F.filter(F.transform(F.split(name, "\n"), X.trim_all), lambda x: (x != "") & ~x.rlike(r"^[#\[<]"))
    line = F.get(rows, F.lit(0))
    return F.when(F.length(line) > 100, F.concat(F.regexp_replace(F.substring(line, 1, 100), r"\s+\S*$", ""), F.lit("…"))).otherwise(line)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(file, mtime, size) of each events.jsonl: the newest time and the whole size of the files that make its session's
    header, so that a change of any of them shows."""
    files = listing(spark, root, glob="{events.jsonl,workspace.yaml,plan.md,session.db}").withColumn("dir", _folder("file"))
    events = F.when(F.endswith("file", F.lit("/events.jsonl")), F.col("file"))
    return files.groupBy("dir").agg(F.max(events).alias("file"), F.max("mtime").alias("mtime"), F.sum("size").alias("size")).filter("file is not null").select("file", "mtime", "size")


def sessions(spark: SparkSession, root: str, only: DataFrame | None = None) -> DataFrame:
    """A row per folder with an events.jsonl: the session's header from workspace.yaml and its first record, its plan
    document and its todo list. With ``only`` (file) just the folders of those files."""
    ev = first_lines(spark, root, glob="events.jsonl", only=only).withColumn("dir", _folder("file"))
    ev = ev.filter(~F.startswith(F.element_at(F.split("dir", "/"), -1), F.lit(".")))
    rec = F.try_parse_json("value")
    ev = ev.withColumn("rec", F.when(get("$.type", of=rec) == "session.start", rec))
    wanted = only.select(_folder("file").alias("dir")) if only is not None else None
    ws = _small_files(spark, root, "workspace.yaml", wanted).select("dir", F.col("mtime").alias("ws_mtime"), _workspace(F.decode("content", "UTF-8")).alias("ws"))
    doc = _small_files(spark, root, "plan.md", wanted).select("dir", full(X.trim_all(F.decode("content", "UTF-8"))).alias("plan_doc"))
    todo = _small_files(spark, root, "session.db", wanted).select("dir", _todos("content").alias("plan"))
    j = ev.join(ws, "dir", "left").join(doc, "dir", "left").join(todo, "dir", "left")
    name = F.element_at(F.split("dir", "/"), -1)
    return j.select(
        F.lit(SOURCE).alias("source"), F.lower(F.coalesce("ws.id", get(f"{D}.sessionId"), name)).alias("session_id"), title_of_name(F.coalesce("ws.name", "ws.summary")).alias("title"),
        F.coalesce("ws.cwd", get(f"{D}.context.cwd")).alias("cwd"), get(f"{D}.selectedModel").alias("model"), F.coalesce("ws.client_name", get(f"{D}.producer")).alias("originator"),
        F.coalesce("ws.created_at", get(f"{D}.startTime")).alias("started_at"), F.greatest("mtime", F.coalesce("ws_mtime", "mtime")).alias("updated_at"), F.col("size").alias("bytes"), F.lit(1).cast("long").alias("segments"),
        "file", F.array("file").alias("files"), F.col("dir").alias("link"), F.concat(F.lit("copilot --resume "), F.lower(F.coalesce("ws.id", get(f"{D}.sessionId"), name))).alias("resume"),
        F.col("ws.git_root").alias("git_root"), F.col("ws.branch").alias("branch"), F.col("ws.repository").alias("repository"), "plan", "plan_doc", F.col("ws.user_named").alias("user_named"),
    )


# ---------------------------------------------------------------- turns


def located(records: DataFrame) -> DataFrame:
    """Records with ``interaction``, ``sub`` (of a sub-agent), ``cwd`` and the call they belong to.

    A tool call takes the interaction of its outermost parent call, so what a sub-agent does counts for the turn that
    started it; a completion takes that of its start; other events that of the last interaction seen.
    """
    # each record is parsed once for where it belongs, and written: what follows takes the columns that it needs. What is no
    # object goes after that, as a filter before it would parse once more
    r = records.withColumns({"type": F.coalesce(get("$.type"), F.lit("")), "parent": get(f"{D}.parentToolCallId"), "iid": get(f"{D}.interactionId"), "call_id": get(f"{D}.toolCallId"), "agent": get("$.agentId")})
    r = r.withColumns({c: full(F.col(c)) for c in ("parent", "iid", "agent")})
    typ, below = F.col("type"), F.col("parent").isNotNull() | F.col("agent").isNotNull()
    started, of_call = typ == "tool.execution_start", typ.isin("tool.execution_start", "tool.execution_complete", *SUBAGENT_EVENTS)
    where = F.when(typ.isin("session.start", "session.resume"), get(f"{D}.context.cwd")).when(typ == "session.context_changed", get(f"{D}.cwd"))
    mcp = F.when(full(get(f"{D}.mcpServerName")).isNotNull(), F.concat_ws(".", get(f"{D}.mcpServerName"), get(f"{D}.mcpToolName")))
    r = r.withColumns({"inner": ~of_call & below, "opens": F.when(typ.isin(*TURN_EVENTS) & ~below, F.col("iid")), "where": where, "name": F.when(started, get(f"{D}.toolName")), "mcp": F.when(started, mcp)})
    r = written(r.drop("rec"), "records").filter("ok").drop("ok")
    nested = started & F.col("parent").isNotNull()
    flat = r.filter(nested).isEmpty()
    r = carried(r, {"current": F.col("opens"), "cwd": F.col("where")}, SESSION, "seq").drop("opens", "where")
    own_turn = F.coalesce(F.when(F.col("parent").isNull(), F.col("iid")), F.col("current"))
    said = lambda turn: F.struct(F.col("call_id").alias("key"), "name", F.get_json_object("value", f"{D}.arguments").alias("args"), "mcp", turn.alias("turn"), F.col("parent").isNotNull().alias("sub"))
    key = F.when(F.col("inner"), F.coalesce("parent", "agent")).when(of_call, F.col("call_id"))
    # records without a call are dealt one by one
    keyed, keys = r.withColumn("key", key).withColumn("lone", F.when(F.col("key").isNull(), F.col("seq"))), [*SESSION, "key", "lone"]
    outer = started & F.col("key").isNotNull() & F.col("parent").isNull()
    if flat:
        r = keyed.withColumn("call", carry_forward(F.when(outer, said(own_turn)), keys, "seq"))
    else:
        each = r.filter(started).withColumn("key", F.col("call_id")).withColumn("turn", own_turn)
        above = asof_latest(r.filter(nested).select(*SESSION, "seq", F.col("parent").alias("key")), each.select(*SESSION, "seq", "key", F.col("seq").alias("up")), [*SESSION, "key"], "seq", ["up"])
        calls = roots(each.join(above.select(*SESSION, "seq", "up"), [*SESSION, "seq"], "left"), SESSION, "seq", "up", "turn").filter("parent is not null and key is not null")
        right = calls.select(*SESSION, "key", F.lit(None).cast("long").alias("lone"), "seq", said(F.col("turn")).alias("call"))
        r = asof_latest(keyed, right, keys, "seq", ["call"], own=F.when(outer, F.struct(said(own_turn).alias("call"))))
    r = r.drop("key", "lone").withColumn("rec", F.try_parse_json("value"))
    done = F.col("type") == "tool.execution_complete"
    turn = F.coalesce("call.turn", F.when(done, F.col("iid")), "current")
    sub = F.when(F.col("inner"), True).when(F.col("type") == "tool.execution_start", F.col("parent").isNotNull()).when(done, F.coalesce("call.sub", F.col("parent").isNotNull())).otherwise(False)
    return r.withColumn("interaction", turn).withColumn("sub", sub)


# ---------------------------------------------------------------- facts


def _json(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def resolve(cwd: Column, path: Column) -> Column:
    """A relative path below the folder of that moment; dots in it are resolved."""
    joined = F.concat(F.regexp_replace(cwd, r"[/\\]+$", ""), F.lit("/"), path)
    absolute = path.rlike(r"^([/\\]|[A-Za-z]:)") | cwd.isNull()
    parts = F.filter(F.split(joined, "/"), lambda p, i: (p != ".") & ((p != "") | (i == 0)))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 1), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.when(F.coalesce(absolute, F.lit(True)), path).otherwise(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def patched_files(patch: Column, cwd: Column) -> Column:
    """array<struct<verb, path, lines>> of a patch, in order; a move deletes the old path and updates the new one."""
    empty = F.array().cast("array<struct<verb:string,path:string,lines:bigint>>")
    made = lambda verb, path, n: F.struct(verb.alias("verb"), path.alias("path"), n.cast("bigint").alias("lines"))
    zero = F.lit(0)

    def step(acc: Column, line: Column) -> Column:
        head, target = F.regexp_extract(line, r"^\*\*\* (Add|Update|Delete) File: (.+?)\s*$", 1), F.regexp_extract(line, r"^\*\*\* (?:Add|Update|Delete) File: (.+?)\s*$", 1)
        moved = F.regexp_extract(line, r"^\*\*\* Move to: (.+?)\s*$", 1)
        last = F.try_element_at(acc, F.lit(-1))
        rest = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, zero))
        verb = F.when(head == "Add", "add").when(head == "Delete", "delete").otherwise("update")
        has = F.size(acc) > 0
        return (
            F.when(head != "", F.concat(acc, F.array(made(verb, target, zero))))
            .when(has & (moved != ""), F.concat(rest, F.array(made(F.lit("delete"), last["path"], last["lines"]), made(F.lit("update"), moved, zero))))
            .when(has & line.rlike("^[+-]") & ~line.rlike(r"^(\+\+\+|---)"), F.concat(rest, F.array(made(last["verb"], last["path"], last["lines"] + 1))))
            .otherwise(acc)
        )

    # only lines that matter enter the fold
    rows = F.filter(F.split(patch, "\n"), lambda x: x.rlike(r"^([+-]|\*\*\* )"))
    return F.transform(F.aggregate(rows, empty, step), lambda f: made(f["verb"], resolve(cwd, f["path"]), f["lines"]))


def facts(records: DataFrame) -> DataFrame:
    """The facts of format B's records. Events outside any interaction form the turn ``session``."""
    r = located(records)
    typ, sub, own = F.col("type"), F.col("sub"), F.coalesce("interaction", F.lit("session"))
    inside = F.col("interaction").isNotNull()
    top = ~sub
    name, args, cwd = F.col("call.name"), F.col("call.args"), F.col("cwd")
    arg = lambda k: _json(args, f"$.{k}")
    x = lambda p, kind="string": get(f"{D}.{p}", kind)
    content = F.coalesce(F.when(F.schema_of_variant(get(f"{D}.content", "variant")) == "STRING", X.trim_all(x("content"))), F.lit(""))
    attached = F.array_join(F.filter(F.transform(x("attachments", "array<variant>"), lambda a: F.coalesce(get("$.displayName", of=a), get("$.path", of=a))), lambda a: a != ""), ", ")
    asked = F.concat_ws("\n\n", full(content), F.when(F.coalesce(attached, F.lit("")) != "", F.concat(F.lit("[attached: "), attached, F.lit("]"))))
    origin = F.coalesce(x("source"), F.lit("user"))
    user = (typ == "user.message") & top & ~F.startswith(origin, F.lit("skill-")) & (asked != "")
    said = (typ == "assistant.message") & top
    final = F.coalesce(x("phase") == "final_answer", F.lit(False)) | (full(x("phase")).isNull() & (F.coalesce(F.array_size(x("toolRequests", "array<variant>")), F.lit(0)) == 0))
    blocks = F.filter(F.transform(F.regexp_extract_all(x("content"), F.lit("(?s)<custom_instruction>(.*?)</custom_instruction>"), 1), X.trim_all), lambda b: b != "")
    done = typ == "tool.execution_complete"
    failed = F.coalesce(~x("success", "boolean"), F.lit(False))
    known = done & F.col("call").isNotNull()
    result, problem = F.coalesce(x("result.content"), F.lit("")), F.coalesce(x("error.message"), F.lit("failed"))
    recorded, marked = x("shellExecution.exitCode", "long"), X.exit_code(F.coalesce(x("result.content"), F.lit("")))
    code = F.when(failed, "blocked").otherwise(F.coalesce(recorded, marked, F.lit(0)).cast("string"))
    bare = X.rtrim_all(F.regexp_replace(result, X.EXIT_MARKER, ""))
    shell, edit = name.isin(*SHELLS), name.isin(*EDITS, "create", "apply_patch")
    other = ~(shell | edit | name.isin("view", "web_search", "ask_user", "task", "skill", *SILENT))
    label = F.when(name.isin(*SHELL_FOLLOW_UPS), F.concat(F.lit("shell "), F.coalesce(arg("shellId"), F.lit("")))).otherwise(F.coalesce(*(arg(k) for k in LABEL_FIELDS)))
    patch = F.coalesce(F.when(F.startswith(args, F.lit("{")), F.coalesce(arg("input"), arg("patch"))).otherwise(args), F.lit(""))
    one = lambda verb, k: F.array(F.struct(F.lit(verb).alias("verb"), resolve(cwd, arg("path")).alias("path"), X.count_lines(arg(k)).cast("bigint").alias("lines")))
    changed = F.when(name == "create", one("add", "file_text")).when(name.isin(*EDITS), one("update", "new_str")).when(name == "apply_patch", patched_files(patch, cwd))
    starts = (typ == "tool.execution_start") & top & (name == "task")
    doing = F.concat(F.lit("sub-agent "), F.coalesce(arg("agent_type"), F.lit("agent")), F.lit(": "), X.one_line(F.coalesce(arg("name"), arg("description")), 120), F.when(arg("mode") == "background", " (background)").otherwise(""))
    ended = typ.isin("subagent.completed", "subagent.failed")
    bits = F.concat_ws(", ", F.concat(x("totalToolCalls"), F.lit(" tool calls")), full(X.minutes_seconds(x("durationMs", "double"))), F.when(typ == "subagent.failed", "failed"))
    pre, post = x("preCompactionTokens", "long"), x("postCompactionTokens", "long")
    compacted = (typ == "session.compaction_complete") & top
    sizes = F.when((pre > 0) & (post > 0), F.concat(F.lit(" ("), F.format_number(pre, 0), F.lit(" → "), F.format_number(post, 0), F.lit(" tokens)"))).otherwise("")
    question = F.coalesce(arg("message"), arg("question"), F.lit(""))
    answer = X.trim_all(F.coalesce(x("result.content"), x("error.message"), F.lit("")))
    action = lambda kind, when, text, **more: fact("action", when, turn=own, aux=kind, text=text, **more)
    opening = typ == "session.start"
    singles = [
        fact("originator", opening, text=x("producer")), fact("version", opening, text=x("copilotVersion")), fact("started_at", opening, text=x("startTime")),
        fact("cwd_last", typ.isin("session.start", "session.resume", "session.context_changed"), text=F.when(typ == "session.context_changed", x("cwd")).otherwise(x("context.cwd"))),
        fact("model_last", F.lit(True), text=F.when(opening, x("selectedModel")).when(said & (content != ""), full(x("model"))).when(typ == "session.model_change", full(x("newModel")))),
        fact("instructions", (typ == "system.message") & (F.size(blocks) > 0), text=F.array_join(blocks, "\n\n")),
        fact("ask", user, turn=own, text=asked, aux="append", path=F.when(F.startswith(origin, F.lit("agent-")), "delegated-message").otherwise("user")),
        fact("touch", said | done | compacted, turn=own),
        fact("reasoning", said & X.first_line(x("reasoningText")).isNotNull(), turn=own, text=X.first_line(x("reasoningText"))),
        fact("final", said & final & (content != ""), turn=own, text=content, aux="demote"), fact("note", said & ~final & (content != ""), turn=own, text=content),
        action("delegate", starts, doing, call=F.col("call_id")),
        fact("suffix", ended, call=F.col("call_id"), text=bits, failed=typ == "subagent.failed"),
        fact("suffix", known & (name == "task") & failed, call=F.col("call_id"), text="", failed=True),
        fact("tool", done & F.col("call").isNull(), turn=own, text="unknown-tool", failed=failed, quiet=sub),
        fact("command", known & shell, turn=own, text=F.coalesce(arg("command"), F.lit("(unknown command)")), exit_text=code, error=F.when(failed, F.coalesce(x("error.message"), result)).otherwise(bare), quiet=sub),
        action("file", known & edit & failed & top, F.concat(name, F.lit(" "), F.coalesce(arg("path"), F.lit("patch")), F.lit(" — "), X.one_line(problem, 120)), failed=True),
        action("read", known & (name == "view") & failed & top, F.concat(F.lit("view "), F.coalesce(arg("path"), F.lit("")), F.lit(" — "), X.one_line(problem, 120)), failed=True),
        fact("read", known & (name == "view") & ~failed & (arg("path") != ""), turn=own, path=arg("path"), aux="view", quiet=sub),
        fact("search", known & (name == "web_search") & top, turn=own, text=F.coalesce(arg("query"), F.lit(""))),
        fact("ask", known & (name == "ask_user") & top & (F.concat(question, answer) != ""), turn=own, aux="append-keep-source", path="user", text=F.concat(F.lit("**Agent asked:** "), question, F.lit("\n\n**User answered:** "), F.coalesce(full(answer), F.lit("(no answer)")))),
        fact("delegation", known & (name == "task"), aux=F.coalesce(arg("agent_type"), F.lit("agent")), text=X.one_line(F.coalesce(arg("name"), arg("description")), 160), error=X.one_line(result, 400)),
        action("skill", known & (name == "skill") & top, F.concat(F.lit("skill "), F.coalesce(arg("skill"), F.lit(""))), failed=failed),
        fact("tool", known & other, turn=own, text=F.coalesce(F.col("call.mcp"), name, F.lit("undefined")), aux=label, failed=failed, quiet=sub),
        fact("compaction", compacted, turn=own, text=F.concat(F.lit("context compacted"), sizes)), fact("summary", compacted & (x("summaryContent") != ""), text=x("summaryContent")),
        fact("final", (typ == "session.task_complete") & (x("summary") != ""), turn=own, text=x("summary")),
        action("abort", (typ == "abort") & inside, F.concat(F.lit("stopped: "), F.coalesce(x("reason"), F.lit("aborted")))),
        action("error", (typ == "session.error") & inside, F.concat(F.lit("error: "), X.one_line(F.coalesce(x("message"), x("errorType")), 200)), failed=True),
        action("model", (typ == "session.model_change") & inside & (x("newModel") != ""), F.concat(F.lit("model → "), x("newModel"))),
        fact("tokens", typ == "session.shutdown", aux="sum", num=F.coalesce(x("tokenDetails.input.tokenCount", "long"), F.lit(0)) + F.coalesce(x("tokenDetails.output.tokenCount", "long"), F.lit(0))),
    ]
    touched = F.filter(changed, lambda f: f["path"] != "")
    files = F.when(known & edit & ~failed, F.transform(touched, lambda f: fact("file", turn=own, path=f["path"], aux=f["verb"], num=f["lines"], quiet=sub)))
    return exploded(r, get("$.timestamp"), singles, [files])


def searchable(records: DataFrame) -> DataFrame:
    """The columns of :func:`tracewright.sources.format_a.searchable` for format B."""
    r = located(records)
    x = lambda p: get(f"{D}.{p}")
    name, arg = F.col("call.name"), lambda k: F.coalesce(_json(F.col("call.args"), f"$.{k}"), F.lit(""))
    detail = F.when(~x("result.detailedContent").eqNullSafe(x("result.content")), x("result.detailedContent"))
    text = F.concat_ws("\n", *(full(c) for c in (x("content"), x("reasoningText"), F.get_json_object("value", f"{D}.arguments"), x("result.content"), detail, x("error.message"), x("summary"), x("summaryContent"), x("message"))))
    done, failed = F.col("type") == "tool.execution_complete", F.coalesce(~get(f"{D}.success", "boolean"), F.lit(False))
    code = F.when(failed, "blocked").otherwise(F.coalesce(get(f"{D}.shellExecution.exitCode", "long"), X.exit_code(F.coalesce(x("result.content"), F.lit(""))), F.lit(0)).cast("string"))
    call = (
        F.when(F.col("call").isNull(), "tool result")
        .when(name.isin(*SHELLS), F.concat(F.lit("command (exit "), F.when(done, code).otherwise("…"), F.lit("): "), X.one_line(arg("command"), 120)))
        .when(name.isin(*EDITS, "create", "view"), F.concat(name, F.lit(" "), arg("path")))
        .when(name == "apply_patch", "apply_patch")
        .when(name == "task", F.concat(F.lit("sub-agent "), arg("agent_type"), F.lit(": "), X.one_line(F.coalesce(full(arg("name")), arg("description")), 100)))
        .otherwise(F.concat(F.lit("tool "), F.coalesce("call.mcp", "call.name", F.lit("undefined"))))
    )
    tag = F.when(F.col("sub"), " [sub-agent]").otherwise("")
    t = F.col("type")
    skill = (t == "user.message") & F.startswith(F.coalesce(x("source"), F.lit("")), F.lit("skill-"))
    label = (
        F.when(skill, F.concat(F.lit("skill loaded: "), F.substring(x("source"), 7, 1 << 20)))
        .when((t == "user.message") & (x("source") != "user"), F.concat(F.lit("message from "), x("source")))
        .when(t == "user.message", "user message").when(t == "assistant.message", F.concat(F.lit("assistant message"), tag))
        .when(t.isin("tool.execution_start", "tool.execution_complete"), F.concat(call, tag))
        .when(t == "session.compaction_complete", "checkpoint summary").when(t == "session.task_complete", "final answer").otherwise(t)
    )
    replayed = t.isin("user.message", "tool.execution_complete", "subagent.completed", "session.compaction_complete", "session.task_complete", "abort", "session.error") | ((t == "assistant.message") & (text != ""))
    return r.select(
        *SESSION, "seq", get("$.timestamp").alias("ts"), F.coalesce("interaction", F.lit("session")).alias("turn"), label.alias("label"), F.when(skill, "").otherwise(text).alias("text"),
        x("result.content").alias("output"), F.when(failed, x("error.message")).alias("stderr"), F.when(done & name.isin(*SHELLS), code).alias("exit_text"), F.coalesce(replayed, F.lit(False)).alias("replayed"),
    )
