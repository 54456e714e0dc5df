"""Hand-written logs of both formats, folded; what is expected follows from the rules of each format."""

import glob
import json
import os
import shutil
import sqlite3
from dataclasses import replace
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tracewright import cli
from tracewright.plans import pruning, reports, verify, views
from tracewright.scratch import written
from tracewright.sources import format_a, format_b, index, logs

pytestmark = pytest.mark.usefixtures("interpreted")
A_ID = "11111111-2222-3333-4444-555555555555"


def _a(kind, payload, n):
    return json.dumps({"type": kind, "timestamp": f"2025-01-01T00:00:{n:02d}.000Z", "payload": payload})

def _item(turn, n, **item):
    return _a("event_msg", {"type": "item_completed", "turn_id": turn, "item": item}, n)

def _cmd(turn, n, id_, cmd, code, **more):
    return _item(turn, n, id=id_, type="CommandExecution", parsed_cmd=[{"cmd": cmd}], exit_code=code, **more)

@pytest.fixture(scope="module")
def root_a(tmp_path_factory):
    root = tmp_path_factory.mktemp("a") / "2025" / "01"
    os.makedirs(root)
    meta = {"internal_chat_message_metadata_passthrough": {"turn_id": "t1", "content_item_kinds": [None, "apps.instructions"]}}
    rows = [
        _a("session_meta", {"session_id": A_ID.upper(), "cwd": "/home/x/Proj", "timestamp": "2025-01-01T00:00:00Z", "originator": "cli", "cli_version": "1.0", "context_window": 1000}, 0),
        _a("event_msg", {"type": "task_started", "turn_id": "t1"}, 1),
        _a("response_item", {"type": "message", "role": "user", "content": [{"text": "Please repair the failing build today"}, {"text": "dropped"}], **meta}, 2),
        _item("t1", 3, id="u1", type="UserMessage", content=[{"text": "Please repair the failing build today"}]),
        _cmd("t1", 4, "c1", "make all", 2, stderr="error: boom\n+ trace", duration={"secs": 1, "nanos": 500_000_000}),
        _cmd("t1", 5, "c1", "make all", 2, stderr="the same item again"),
        _cmd("t1", 6, "c2", "Make   ALL", 0),
        _cmd("t1", 7, "c3", "npm test", 1, aggregated_output="a\nFAILED: one\nlast words here"),
        _item("t1", 8, id="f1", type="FileChange", changes={"z.py": {"type": "add", "content": "1\n2\n3"}, "a.py": {"type": "update", "unified_diff": "--- a\n+++ b\n+x\n-y\n+"}, "b.py": {"type": "delete"}}),
        "",
        "{broken",
        "null",
        '{"type":"event_msg"} trailing',
        _item("t1", 9, id="m1", type="AgentMessage", content=[{"text": "working"}], phase="commentary"),
        _item("t1", 10, id="m2", type="AgentMessage", content=[{"text": "All done"}]),
        _item("t1", 11, id="r1", type="Reasoning", summary_text=["**Think**", {"text": "more"}, ""]),
        _item("t1", 12, id="w1", type="WebSearch", query="spark variant"),
        _item("t1", 13, id="p1", type="TodoList", items=[{"text": "one", "completed": True}, {"step": "two", "status": "in_progress"}]),
        _a("event_msg", {"type": "task_complete", "turn_id": "t1", "last_agent_message": "Final words", "duration_ms": 5000}, 14),
        _a("event_msg", {"type": "token_count", "info": {"total_token_usage": {"total_tokens": 77}}}, 15),
        _a("event_msg", {"type": "task_started", "turn_id": "empty"}, 16),
    ]
    (root / f"rollout-2025-01-01T00-00-00-{A_ID}.jsonl").write_text("\n".join(rows) + "\n")
    second = [_a("response_item", {"type": "custom_tool_call", "input": "tools.update_plan({plan:[{step:\"s \\\"1\\\"\", status:'pending'}]})"}, 20), _item(None, 21, id="x1", type="ImageView", path="/p.png"), _item(None, 22, id="x2", type="ImageView", path="/q.png")]
    (root / f"rollout-2025-01-02T00-00-00-{A_ID}.jsonl").write_text("\n".join(second) + "\n")
    return str(root.parent.parent)

def _b(kind, n, agent=None, **data):
    return json.dumps({"type": kind, "timestamp": f"2025-02-01T00:00:{n:02d}.000Z", "data": data} | ({"agentId": agent} if agent else {}))

@pytest.fixture(scope="module")
def root_b(tmp_path_factory):
    root = tmp_path_factory.mktemp("b") / "session-state"
    one = root / "abcdef12-0000-0000-0000-000000000001"
    os.makedirs(one)
    tool = lambda n, id_, name, args, **more: _b("tool.execution_start", n, toolCallId=id_, toolName=name, arguments=args, **more)
    done = lambda n, id_, **more: _b("tool.execution_complete", n, toolCallId=id_, **({"success": True} | more))
    patch = "*** Begin Patch\n*** Update File: old.py\n-a\n*** Move to: sub/../new.py\n+b\n+++ no\n+c\n*** Add File: /abs/n.py\n+1\n*** End Patch"
    rows = [
        _b("session.start", 0, sessionId="x", context={"cwd": "/w/proj"}, selectedModel="m1", producer="p", copilotVersion="9"),
        _b("system.message", 1, content="a<custom_instruction> be nice </custom_instruction>b"),
        _b("user.message", 2, content="Do the thing for me please", interactionId="i1", attachments=[{"displayName": "f.txt"}]),
        tool(3, "k1", "bash", {"command": "ls"}, interactionId="i1"), done(4, "k1", result={"content": "x\n<exited with exit code 3>"}),
        tool(5, "k2", "task", {"agent_type": "explore", "name": "look", "mode": "background"}, interactionId="i1"),
        tool(6, "k3", "view", {"path": "/w/a"}, parentToolCallId="k2"), tool(7, "k4", "bash", {"command": "pwd"}, parentToolCallId="k3"),
        _b("user.message", 8, content="next question here", interactionId="i2"),
        done(9, "k3"), done(10, "k4", shellExecution={"exitCode": 0}, result={"content": ""}),
        _b("subagent.completed", 11, toolCallId="k2", totalToolCalls=2, durationMs=61000), done(12, "k2", result={"content": "report"}),
        _b("assistant.message", 13, content="first answer", interactionId="i2", model="m2"), _b("assistant.message", 14, content="second answer", interactionId="i2", phase="final_answer"),
        tool(15, "k5", "apply_patch", patch, interactionId="i2"), done(16, "k5"),
        tool(17, "k6", "ask_user", {"question": "Which?"}, interactionId="i2"), done(18, "k6", result={"content": "blue"}),
        done(19, "nobody", success=False), tool(20, "k7", "bash", {"command": "rm"}, interactionId="i2"), done(21, "k7", success=False, error={"message": "denied"}),
        _b("session.shutdown", 22, tokenDetails={"input": {"tokenCount": 5}, "output": {"tokenCount": 6}}),
    ]
    (one / "events.jsonl").write_text("\n".join(rows) + "\n")
    (one / "workspace.yaml").write_text("id: ABCDEF12-0000-0000-0000-000000000001\ncwd: '/w/it''s'\nname: |\n  # head\n  A fine name\nuser_named: true\nbranch: \"ma\\u0069n\"\n")
    (one / "plan.md").write_text("\n the plan \n")
    db = sqlite3.connect(one / "session.db")
    db.execute("create table todos(title text, status text)")
    db.executemany("insert into todos values (?, ?)", [("a", "done"), ("b", "blocked")])
    db.commit()
    db.close()
    os.makedirs(root / ".hidden")
    (root / ".hidden" / "events.jsonl").write_text(rows[0] + "\n")
    return str(root)

@pytest.fixture(scope="module")
def everything(spark, root_a, root_b):
    sessions = written(reports.list_sessions(spark, {"codex": root_a, "copilot": root_b}))
    return sessions, reports.settled(reports.condense(spark, sessions))

def rows(df, source, *cols):
    return [tuple(r) for r in df.filter(F.col("source") == source).select(*cols).collect()]

def test_format_a(everything):
    sessions, f = everything
    s = sessions.filter("source = 'codex'").collect()
    assert len(s) == 1 and s[0]["session_id"] == A_ID and s[0]["segments"] == 2 and s[0]["link"] == f"codex://threads/{A_ID}"
    turns = f.turns.filter("source = 'codex'").orderBy("n").collect()
    assert [t["n"] for t in turns] == [1, 2, 3] and [t["n_raw"] for t in turns] == [1, 3, 4]  # the empty turn goes, those without an id stay apart
    t = turns[0]
    assert (t["ask"], t["ask_source"], t["final"], t["duration_ms"], t["notes"], t["reasoning"]) == ("Please repair the failing build today", "user", "Final words", 5000, ["working"], ["Think", "more"])
    assert [a["kind"] for a in t["actions"]] == ["exec", "exec", "exec", "file", "file", "file", "search"]
    assert [a["line"] for a in t["actions"]][3:6] == ["add z.py (~3 lines)", "update a.py (~2 lines)", "delete b.py (~0 lines)"]
    assert t["actions"][0]["ms"] == 1500 and t["actions"][0]["error"] == "error: boom\n+ trace"
    fails = {r["key"]: r for r in f.failures.filter("source = 'codex'").collect()}
    assert fails["make all"]["resolved"] and fails["make all"]["occurrences"] == 1 and not fails["npm test"]["resolved"]
    stats = f.stats.filter("source = 'codex'").first()
    assert (stats["commands"], stats["unique_commands"], stats["errors"], stats["outstanding_errors"], stats["files_touched"], stats["parse_failures"], stats["total_tokens"], stats["turns"]) == (3, 3, 2, 1, 3, 3, 77, 3)
    state = f.state.filter("source = 'codex'").first()
    assert json.loads(state["plan"]) == [{"step": 's "1"', "status": "pending"}] and state["context_window"] == 1000

def test_format_b(everything):
    sessions, f = everything
    s = sessions.filter("source = 'copilot'").collect()
    assert len(s) == 1 and (s[0]["cwd"], s[0]["title"], s[0]["branch"], s[0]["plan_doc"]) == ("/w/it's", "A fine name", "main", "the plan")
    assert json.loads(s[0]["plan"]) == [{"step": "a", "status": "completed"}, {"step": "b (blocked)", "status": "pending"}]
    turns = f.turns.filter("source = 'copilot'").orderBy("n").collect()
    assert [t["turn"] for t in turns] == ["i1", "i2"]
    first, second = turns
    assert first["ask"] == "Do the thing for me please\n\n[attached: f.txt]"
    assert [a["line"] for a in first["actions"]] == ["ls", "sub-agent explore: look (background) — 2 tool calls, 1m01s"]
    assert second["final"] == "second answer" and second["notes"] == ["first answer"]
    assert second["ask"] == "next question here\n\n**Agent asked:** Which?\n\n**User answered:** blue"
    files = {r["path"]: (r["n_add"], r["n_update"], r["n_delete"], r["lines"]) for r in f.files.filter("source = 'copilot'").collect()}
    assert files == {"/w/proj/old.py": (0, 0, 1, 1), "/w/proj/new.py": (0, 1, 0, 2), "/abs/n.py": (1, 0, 0, 1)}
    assert sorted(rows(f.commands, "copilot", "cmd", "runs", "failures")) == [("ls", 1, 1), ("pwd", 1, 0), ("rm", 1, 1)]
    assert {(r["key"], r["exit_text"]) for r in f.failures.filter("source = 'copilot'").collect()} == {("ls", "3"), ("rm", "blocked")}
    assert rows(f.reads, "copilot", "path", "reads") == [("/w/a", 1)] and rows(f.tools, "copilot", "tool", "calls") == [("unknown-tool", 1)]
    state = f.state.filter("source = 'copilot'").first()
    assert (state["model"], state["instructions"]) == ("m2", "be nice") and f.stats.filter("source = 'copilot'").first()["total_tokens"] == 11

def test_rollups_and_fit(everything):
    sessions, f = everything
    c = written(reports.cards(sessions, f))
    cards = c.orderBy("number").collect()
    assert [(r["code"], r["source"]) for r in cards] == [("S1", "codex"), ("S2", "copilot")]
    assert cards[0]["title"] == "Please repair the failing build" and cards[0]["title_source"] == "first-request" and len(cards[1]["open_plan"]) == 1
    assert {r["cmd"]: r["last_line"] for r in reports.failure_rollup(c, f).collect()}["npm test"] == "FAILED: one"
    total = reports.totals(c, f).first()
    assert total["sessions"] == 2 and total["files_changed"] == 6 and total["by_source"] == {"codex": 1, "copilot": 1}
    assert [r["folder"] for r in reports.folder_rollup(c).collect()] == ["/home/x/Proj", "/w/it's"] or len(reports.folder_rollup(c).collect()) == 2
    assert reports.file_rollup(c, f).count() == 6 and reports.tool_rollup(f).count() == 1
    assert reports.requests(c, f).count() == 3 and reports.requests(c, f, 10_000).count() == 3 and reports.requests(c, f, 10).count() == 0
    assert [f["path"] for f in cards[0]["files_changed"]] == ["z.py", "a.py", "b.py"] and [(o["cmd"], o["exit"], o["last_line"]) for o in cards[0]["outstanding"]] == [("npm test", "1", "FAILED: one")]
    assert [(t["tool"], t["calls"]) for t in cards[1]["tools"]] == [("unknown-tool", 1)] and reports.latest(c).count() == 1 and [r["code"] for r in reports.unfinished(c).collect()] == ["S2", "S1"]
    assert {r["tier"] for r in reports.fitted_cards(c, None).collect()} == {2} and [r["tier"] for r in reports.fitted_cards(c, 10).orderBy("number").collect()] == [0, 2]
    tiers = {r["n"]: r["tier"] for r in reports.fitted_turns(f, 40, 0, 1).filter("source = 'codex'").collect()}
    assert tiers[3] == 3 and set(tiers) == {1, 2, 3}
    assert all(r["tier"] == 3 for r in reports.fitted_turns(f, None).collect())
    assert reports.collapsed_actions(f.actions).count() == f.actions.count()

def test_session_views(everything, tmp_path):
    sessions, f = everything
    found = {r["source"]: r for r in views.session_views(sessions, f, None).collect()}
    a, b = found["codex"]["markdown"], found["copilot"]["markdown"]
    assert found["codex"]["name"] == f"session-view-codex-please-repair-the-failing-build-{A_ID}"
    assert "- `npm test` → exit 1\n\n  ```\n  a\n  FAILED: one\n  last words here\n  ```" in a and "_1 other command(s) failed at some point but later succeeded — treated as resolved._" in a
    assert "| File | Created | Edited | Deleted | ~Lines |" in a and "| `z.py` | 1 |  |  | 3 |" in a and "$ make all ✗\n$ Make ALL\n$ npm test ✗\n± add z.py (~3 lines)" in a
    assert "### Turn 1 — 2025-01-01 00:00 (5s)\n\n**User:**\n\n> Please repair the failing build today\n\n**Reasoning trail:** Think · more\n\n_working_" in a and "**Agent:**\n\n> Final words" in a
    assert "### Plan state at the end\n\n- [ ] a" not in b and "- [x] a\n- [ ] b (blocked)" in b and "the plan" in b and "be nice" in b and "| Resume | `copilot --resume abcdef12" in b
    assert json.loads(found["codex"]["packet"])["failures"][1]["cmd"] == "npm test"
    made = views.session_views(sessions, f, 700)
    paths = {r["session_id"]: r["packet"] for r in views.write_views(made, str(tmp_path / "out")).collect()}
    assert len(paths) == 2 and sorted(os.listdir(tmp_path / "out")) == sorted(os.path.basename(x)[:-2] + e for x in paths.values() for e in ("md", "json"))
    assert all(open(paths[r["session_id"]]).read() == r["markdown"] and json.load(open(paths[r["session_id"]][:-2] + "json"))["session_id"] == r["session_id"] for r in made.collect())
    with pytest.raises(ValueError, match="two files"):
        views.write_views(made.withColumn("name", F.lit("x")), str(tmp_path / "out"))
    listing = views.table_lines(sessions, 1)
    assert listing[0].startswith("  #   SOURCE") and listing[2] == "  …1 more" and json.loads(views.shown(sessions.filter("source = 'codex'")))["session_id"] == A_ID

def test_commands(spark, root_a, root_b, tmp_path):
    run = lambda *x: cli.run(spark, ["--codex", root_a, "--copilot", root_b, "--out", str(tmp_path), *x])
    assert "1 session(s)" in run("find", "fine")
    with pytest.raises(SystemExit, match="unbounded"):
        run("corpus")
    text = run("--stdout", "--budget", "none", "corpus", "--last", "2")
    assert text.startswith("# Corpus view — start → now") and "| Sessions | 2 (1 Codex, 1 Copilot) |" in text and "| S1 | Codex | `11111111` |" in text and "## Latest state — S" in text
    assert "- **S2** (1 of 2 open): [ ] b (blocked)" in text and "### S1 — Please repair the failing build" in text and "**Outstanding failures:** `npm test` (exit 1)" in text and text.count("- **S2** 2025-02-01") == 2
    md, data = run("corpus", "--last", "2", "--packets", "--packet-budget", "700").split("\n")
    whole = json.load(open(data))
    assert whole["totals"]["sessions"] == len(whole["sessions"]) == 2 and [c["code"] for c in whole["sessions"]] == ["S1", "S2"] and open(md).read().startswith("# Corpus view")
    assert [len(c["asks"]) for c in whole["sessions"]] == [1, 2] and len(whole["files"]) == 6 == whole["totals"]["files_changed"] and len(whole["folders"]) == 2 and whole["tools"] == [{"tool": "unknown-tool", "calls": 1}]
    assert sorted((x["cmd"], x["sessions"], x["last_line"]) for x in whole["failures"]) == [("ls", ["S2"], None), ("npm test", ["S1"], "FAILED: one"), ("rm", ["S2"], "denied")]
    assert all(os.path.getsize(c["packet"]) for c in whole["sessions"]) and "`packet` path" in open(md).read()
    with pytest.raises(SystemExit, match="Several"):
        run("view", "--recent")
    assert "1 session(s)" in run("--index", str(tmp_path / "index"), "find", "fine") and "1 session(s)" in run("--index", str(tmp_path / "index"), "--refresh", "find", "fine")
    assert run("view", "--find", "fine").endswith(".md")

def test_promises_of_the_report(spark, tmp_path):
    """Wherever the Markdown says that the JSON has more, it has all: 30 sessions of 30 folders, files and failures."""
    root = tmp_path / "codex"
    os.makedirs(root)
    for k in range(30):
        id_ = f"{k:08d}-0000-0000-0000-000000000000"
        rows = [_a("session_meta", {"session_id": id_, "cwd": f"/w/{k}"}, 0)]
        for n in range(3):
            rows += [_item(f"t{n}", 1, id=f"u{n}", type="UserMessage", content=[{"text": f"Please do job number {k} {n} " + "very " * 60}]), _cmd(f"t{n}", 2, f"c{n}", f"make {k} {n}", 1), _item(f"t{n}", 3, id=f"f{n}", type="FileChange", changes={f"/w/{k}/{n}.py": {"type": "add", "content": "1"}})]
        (root / f"rollout-2025-01-{k + 1:02d}T00-00-00-{id_}.jsonl").write_text("\n".join(rows) + "\n")
    md, data = cli.run(spark, ["--codex", str(root), "--out", str(tmp_path / "out"), "--budget", "3000", "corpus", "--last", "99"]).split("\n")
    text, whole = open(md).read(), json.load(open(data))
    for said in ("…5 more in the JSON", "…65 more in the JSON", "…80 more in the JSON", "requests; the JSON beside this file has all of them"):
        assert said in text
    assert (len(whole["folders"]), len(whole["files"]), len(whole["failures"]), sum(len(c["asks"]) for c in whole["sessions"])) == (30, 90, 90, 90)

def test_selection(spark, everything):
    sessions, _ = everything
    assert reports.resolve(sessions, "111111").count() == 1 and reports.resolve(sessions, f"codex://threads/{A_ID}").count() == 1
    assert reports.resolve(sessions, "999999") is None and reports.resolve(sessions, "no such name") is None
    folder = sessions.filter("source = 'copilot'").first()["link"].removeprefix("file:")
    assert reports.resolve(sessions, f'"{folder}/plan.md"').count() == 1 and reports.resolve(sessions, folder).count() == 1 and reports.resolve(sessions, "/elsewhere/abcdef12") is None
    with pytest.raises(ValueError, match="several"):
        reports.resolve(sessions.union(sessions.withColumn("session_id", F.concat("session_id", F.lit("x")))), "111111")
    assert [r["score"] for r in reports.find(sessions, "fine").collect()] == [2]
    assert reports.in_folder(sessions, "/W", nested=True).count() == 1 and reports.in_folder(sessions, "/w").count() == 0
    assert reports.excluding(sessions, ["/w"]).count() == 1  # the newest segment of the other names no folder, and null stays
    now = datetime(2025, 1, 3, tzinfo=timezone.utc)
    assert reports.parse_when("2d", now=now) == datetime(2025, 1, 1, tzinfo=timezone.utc) and reports.parse_when("2025-01-01", end_of_day=True) == datetime(2025, 1, 2, tzinfo=timezone.utc)
    assert reports.in_window(sessions, until=datetime(2025, 1, 15, tzinfo=timezone.utc)).count() == 1 and reports.in_window(sessions, last=1).count() == 1
    with pytest.raises(ValueError, match="unknown source"):
        reports.list_sessions(spark, {}, source="codex")

def test_search_and_replay(spark, everything):
    sessions, f = everything
    records = reports.searchable(reports.read_records(spark, sessions))
    assert [r["label"] for r in reports.search(records, "BOOM").collect()] == ["command (exit 2): make all"]
    assert {r["label"] for r in reports.search(records, "fail(ed|ing) ?build", regex=True, kind="message").collect()} == {"user message", "UserMessage"}
    hits = reports.search(records, "denied").collect()
    assert [(h["label"], h["turn"]) for h in hits] == [("command (exit blocked): rm", "i2")]
    played = reports.replay(records, f.turns, 1).filter("source = 'codex'").collect()
    assert [p["label"] for p in played][:2] == ["UserMessage", "command (exit 2): make all"]
    assert reports.replay(records, f.turns, 3).filter("source = 'codex'").count() == 0  # pictures carry nothing to replay

def test_line_numbers(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"n":{k}}}\n' + "\n" * (k % 3 == 0) for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = logs.lines(spark, str(tmp_path)).select("file", "line_no", F.get_json_object("value", "$.n").cast("int").alias("n")).orderBy("file", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["n"] for r in got] == [*range(3000), *range(3000)]

def test_index_of_headers(spark, root_a, root_b, tmp_path, monkeypatch):
    """A second listing opens no log; new, changed and lost files show; a missing folder has no sessions."""
    a, b, at = shutil.copytree(root_a, tmp_path / "a"), shutil.copytree(root_b, tmp_path / "b"), str(tmp_path / "index")
    ids = lambda **more: sorted((r["source"], r["session_id"], r["cwd"], r["segments"]) for r in reports.list_sessions(spark, {"codex": str(a), "copilot": str(b)}, index=at, **more).collect())
    want = sorted((r["source"], r["session_id"], r["cwd"], r["segments"]) for r in reports.list_sessions(spark, {"codex": str(a), "copilot": str(b)}).collect())
    assert ids() == want and len(want) == 2
    logs_ = [os.path.join(d, f) for root in (a, b) for d, _, names in os.walk(root) for f in names]
    for f in logs_:  # other bytes of the same size and time: a listing that opened a log would see them
        was = os.stat(f)
        with open(f, "r+b") as out:
            out.write(b"#" * min(was.st_size, 2000))
        os.utime(f, ns=(was.st_atime_ns, was.st_mtime_ns))
    assert ids() == want and ids(refresh=True) != want
    first, second = sorted(f for f in logs_ if "rollout" in f)
    with open(second, "w") as f:
        f.write(_a("session_meta", {"session_id": "9" * 8 + A_ID[8:], "cwd": "/new"}, 0) + "\n")
    assert ("codex", "9" * 8 + A_ID[8:], "/new", 1) in ids()
    os.remove(second)
    assert not [x for x in ids() if x[2] == "/new"]
    monkeypatch.setattr(index, "MOST_TABLES", 3)
    for k in range(6):  # commits past the one that puts the tables together again
        with open(first, "w") as f:
            f.write(_a("session_meta", {"session_id": A_ID, "cwd": f"/k{k}"}, 0) + "\n" * (k + 1))
        assert [x[2] for x in ids() if x[0] == "codex"] == [f"/k{k}"]
    kept = glob.glob(f"{at}/codex-*/data/*")
    assert len(kept) <= 2 * index.MOST_TABLES + 2 and len(glob.glob(f"{at}/codex-*/snapshots/*[0-9]")) == 2

def test_index_survives_a_crash(spark, root_a, tmp_path):
    """A table without a pointer, or a pointer that was not finished, changes nothing."""
    kept = index.HeaderIndex(spark, str(tmp_path), "x")
    read = lambda files: format_a.headers(spark, root_a, files)
    listed = logs.listing(spark, root_a)
    assert kept.headers(listed, read).count() == 2
    number, tables = kept.latest()
    os.makedirs(tmp_path / "x" / "data" / "0000000002-lost")
    (tmp_path / "x" / "snapshots" / "0000000002").write_text('{"tables": ["0000')
    assert kept.latest() == (number, tables) and kept.headers(listed, read).count() == 2
    (tmp_path / "x" / "snapshots" / "0000000002").write_text('{"tables": ["0000000002-lost"]}')
    assert kept.latest() == (number, tables)
    assert format_a.headers(spark, root_a + "/nowhere").count() == 0 and format_b.sessions(spark, root_a + "/nowhere").count() == 0

def test_heads_are_bounded(spark, tmp_path):
    """At most a MiB of a file is read, whatever its first line is."""
    (tmp_path / "a b.jsonl").write_text("\n  \n" + '{"n":"é"}\r\n' + "x" * 500_000)
    (tmp_path / "none.jsonl").write_text(" \n\n")
    (tmp_path / "empty.jsonl").write_text("")
    with open(tmp_path / "vast.jsonl", "wb") as f:
        f.write(b'{"long":"')
        f.truncate(8 << 30)  # a hole: no disk is used
    found = {os.path.basename(r["file"]).replace("%20", " "): r for r in logs.first_lines(spark, str(tmp_path)).collect()}
    assert set(found) == {"a b.jsonl", "vast.jsonl"}
    assert found["a b.jsonl"]["value"] == '{"n":"é"}' and found["a b.jsonl"]["head_bytes"] == logs.HEAD_CHUNK
    assert found["vast.jsonl"]["head_bytes"] == len(found["vast.jsonl"]["value"]) == logs.HEAD_BYTES and found["vast.jsonl"]["size"] == 8 << 30

@pytest.mark.parametrize("value", ['{"a":1}', ' {"a":[{}]} ', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}], {}', '{"a":1}} {', "null", "[]", "1", '{"a":NaN}', "{'a':1}", '{"a":1', "", '{"a":1}]', '{"a":"}]"}'])
def test_json_objects(spark, value):
    try:
        want = isinstance(json.loads(value, parse_constant=lambda c: json.loads("'")), dict)
    except ValueError:
        want = False
    assert spark.createDataFrame([(value,)], "v string").select(logs.is_json_object(F.col("v")).alias("x")).first()["x"] == want

def test_flat_yaml():
    assert format_b.flat_yaml("a: 1\nb: ~\nc: 'x''y'\nd: >\n  one\n  two\ne:\n") == {"a": 1, "b": None, "c": "x'y", "d": "one two", "e": None}

def test_recounts_agree(spark, everything):
    """Both formats' folds and views against the recount from raw records; and each kind of fault is found."""
    sessions, f = everything
    records = reports.read_records(spark, sessions)
    a, b = records.filter("source = 'codex'"), records.filter("source = 'copilot'")
    counts = [verify.recount_a(a), verify.recount_b(b, sessions)]
    both = [written(x.unionByName(y)) for x, y in zip(*counts)]
    assert verify.recounted(f, *both).collect() == []
    assert {r["session_id"]: (r["commands"], r["failures"]) for r in both[0].collect()} == {A_ID: (3, 2), "abcdef12-0000-0000-0000-000000000001": (3, 2)}
    spoilt = verify.recounted(replace(f, files=f.files.filter("path <> '/w/proj/old.py'"), failures=f.failures.filter("key <> 'npm test'")), *both)
    assert sorted((r["problem"], r["ledger"], r["recount"]) for r in spoilt.collect()) == [("failures", "1", "2"), ("file", None, "/w/proj/old.py")]
    made = written(views.session_views(sessions, f, None))
    assert verify.rendered(made, f).collect() == []
    assert {r["problem"] for r in verify.rendered(made.filter("source = 'codex'").withColumn("markdown", F.lit("x")), f).collect()} == {"session id missing", "no view"}

def test_narrowed_search(spark, everything, root_b, tmp_path):
    """The index leaves out sessions that cannot hold a text, and never one that does."""
    sessions, _ = everything
    at = pruning.SearchIndex(spark, str(tmp_path / "trigrams"))
    assert at.candidates(sessions, "denied").count() == 2  # nothing is indexed yet
    assert at.update(sessions) == 2 and at.update(sessions) == 0
    key = lambda r: (r["session_id"], r["seq"], r["label"], r["excerpt"], r["total"])
    texts = reports.searchable(reports.read_records(spark, sessions))
    for query, left in (("denied", 1), ("please", 2), ("no such text anywhere", 0)):
        assert at.candidates(sessions, query).count() == left, query
        assert list(map(key, pruning.search_all(spark, sessions, at, query).collect())) == list(map(key, reports.search(texts, query).collect()))
    changed = sessions.withColumn("updated_at", F.when(F.col("source") == "codex", F.timestamp_seconds(F.lit(9))).otherwise(F.col("updated_at")))
    assert at.candidates(changed, "no such text anywhere").count() == 1  # changed since, so it may hold anything
