"""Lineage, profiles and samples of records against plain Python models."""

import json
import random
import shutil

from pyspark.sql import functions as F

from tracewright.operators import lineage
from tracewright.plans import profile, pruning, verify
from tracewright.sources import format_a, format_b
from tracewright.sources.logs import is_json_object


def records(spark, values, source="copilot"):
    rows = [(source, "s", k, v) for k, v in enumerate(values, 1)]
    r = spark.createDataFrame(rows, "source string, session_id string, seq long, value string").withColumn("ok", is_json_object(F.col("value")))
    return r.withColumn("rec", F.when(F.col("ok"), F.try_parse_json("value")))


def test_lineage_of_random_moves(spark):
    rng, moves, refs, want = random.Random(9), [], [], {}
    for s in range(12):
        at, names = 0, {p: f"{p}@0" for p in "abcd"}
        for _ in range(rng.randrange(0, 30)):
            at += rng.randrange(1, 3)
            a, b = rng.choice("abcd"), rng.choice("abcd")
            moves.append((f"s{s}", at, a, b))
            if a != b:
                names[b], names[a] = names[a], f"{a}@{at}"
            for p in "abcde":
                refs.append((f"s{s}", at, p))
                want[f"s{s}", at, p] = names.get(p, f"{p}@0")
    m = spark.createDataFrame(moves, "session_id string, at long, from_path string, to_path string")
    r = spark.createDataFrame(refs, "session_id string, at long, path string")
    assert {(x["session_id"], x["at"], x["path"]): x["file"] for x in lineage.identified(r, m, ["session_id"]).collect()} == want
    none = m.filter("false")
    assert {x["file"] for x in lineage.identified(r.limit(5), none, ["session_id"]).collect()} == {f"{p}@0" for p in "abcde"}


def test_a_swap_is_no_new_file(spark):
    m = spark.createDataFrame([("s", 1, "a", "tmp"), ("s", 2, "b", "a"), ("s", 3, "tmp", "b")], "session_id string, at long, from_path string, to_path string")
    r = spark.createDataFrame([("s", t, p) for t in (1, 3) for p in ("a", "b", "tmp")], "session_id string, at long, path string")
    got = {(x["at"], x["path"]): x["file"] for x in lineage.identified(r, m, ["session_id"]).collect()}
    assert got == {(1, "a"): "a@1", (1, "b"): "b@0", (1, "tmp"): "a@0", (3, "a"): "b@0", (3, "b"): "a@0", (3, "tmp"): "tmp@3"}


def tree(rng, depth):
    kind = rng.randrange(3 if depth < 8 else 1)
    if kind == 1:
        return [tree(rng, depth + 1) for _ in range(rng.randrange(0, 4))]
    if kind == 2:
        return {rng.choice(["a", "b b", 'q"', "é", "Z"]): tree(rng, depth + 1) for _ in range(rng.randrange(0, 4))}
    return rng.choice([None, True, False, 3, -1.5, "", "short", 'quo"te\\', "ü" * 180, "long " * 60, "\n\t"])


def model_sample(v, depth=0):
    if isinstance(v, str):
        return v if len(v) <= 180 else v[:180] + f"…<{len(v)}ch>"
    if isinstance(v, list):
        return f"[{len(v)} items]" if depth > 4 else [model_sample(x, depth + 1) for x in v[:2]]
    if isinstance(v, dict):
        return "{…}" if depth > 5 else {k: model_sample(v[k], depth + 1) for k in sorted(v)}
    return v


def test_samples_of_random_trees(spark):
    rng = random.Random(6)
    values = [{"x": tree(rng, 1), "y": tree(rng, 1)} for _ in range(150)] + [{"deep": [[[[[[["x"]]]]]]], "o": {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}}]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, v string")
    got = {r["k"]: r["s"] for r in df.select("k", profile.sampled(F.parse_json("v")).alias("s")).collect()}
    for k, v in enumerate(values):
        assert json.loads(got[k]) == model_sample(v)
        assert list(json.loads(got[k])) == sorted(v)


def test_shapes_and_samples(spark):
    r = records(spark, ['{"type":"a","data":{"x":[1,{"y":null}],"toolName":"t"}}', '{"type":"a","data":{"x":"s","toolName":"t"}}', "no json", '{"type":"b"}'])
    got = {(x["kind"], x["path"], x["type"]): (x["n"], x["first_seq"], x["sample"]) for x in profile.shapes(r).collect()}
    assert got["a|t", "$.data.x", "ARRAY"] == (1, 1, '[1,{"y":null}]') and got["a|t", "$.data.x", "STRING"] == (1, 2, '"s"')
    assert got["a|t", "$.data.x[]", "NUMBER"][:2] == (1, 1) and got["a|t", "$.data.x[].y", "VOID"][:2] == (1, 1) and got["b", "$", "OBJECT"][:2] == (1, 4)
    assert ("a|t", "$.data.x[].y", "VOID") not in {(x["kind"], x["path"], x["type"]) for x in profile.shapes(r, depth=3).collect()}
    assert sorted(tuple(x) for x in profile.samples(r).collect()) == [("a|t", 2, '{"data":{"toolName":"t","x":[1,{"y":null}]},"type":"a"}'), ("b", 1, '{"type":"b"}')]
    assert profile.shapes(r.filter("false")).isEmpty() and profile.samples(r.filter("false")).isEmpty()
    files = spark.createDataFrame([("/r/1/a",), ("/r/1/b",), ("/r/2/b",), ("/r/2/a",), ("/r/3/a",), ("/r/3/inuse.x",)], "file string")
    assert {tuple(x) for x in profile.layouts(files).collect()} == {("a,b", 2), ("a", 1)}


def test_dimensions(spark):
    done = lambda call, **d: json.dumps({"type": "tool.execution_complete", "data": {"toolCallId": call, **d}})
    start = lambda call, tool, **a: json.dumps({"type": "tool.execution_start", "data": {"toolCallId": call, "toolName": tool, "arguments": a}})
    r = records(spark, [
        done("early", success=False), start("early", "bash"), start("a", "bash", mode="async"), done("a", success=True, result={"content": "started 12"}), start("b", "bash"), start("b", "powershell"),
        done("b", success=False, result={"content": "x <Exited with code 77>  "}), done("b", success=True, shellExecution={"exitCode": 1}, error={"message": "m", "code": 2}),
    ])
    got = {(x["dimension"], x["key"]): x["n"] for x in profile.dimensions(r).collect()}
    assert got["completions without start", "all"] == 1 and got["failures by tool", "(unknown)"] == 1 and got["failures by tool", "powershell"] == 1
    assert got["shell endings", "ASYNC: started N"] == 1 and got["shell endings", "<Exited with code N>"] == 1 and got["shell completions", "with run"] == 1
    assert got["error fields", "code,message"] == 1 and got["calls by tool", "bash"] == 3
    few = profile.dimensions(r, most=1)
    assert few.groupBy("dimension").count().filter("count > 1").isEmpty() and few.filter("dimension = 'calls by tool'").first()["key"] == "bash"


def test_repeated_blocks(spark):
    a, b = "a block of more than twenty", "another block of that length"
    cases = {f"{a}\n\n{a}": [a], f"{a}\n\n{b}\n\n{a}": [], f"{a}\n\nno\n\n {a}\n": [a], "x\n\nx": [], "": [], a: [], f"{a}\n\n{a}\n\n{a}": [a, a]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["b"] for r in df.select("t", verify.repeated_blocks(F.col("t")).alias("b")).collect()} == cases


def test_trigrams(spark):
    df = spark.createDataFrame([(1, "Abab"), (2, None), (3, "ab"), (4, "İÉé")], "k int, text string")
    got = {}
    for r in pruning.trigrams_of(df, ["k"]).collect():
        got.setdefault(r["k"], set()).add(r["tri"])
    assert got[1] == {"aba", "bab"} and 2 not in got and 3 not in got and 4 in got


def test_objects_keep_their_order_as_text(spark):
    r = records(spark, ['{"type":"token_usage_record","timestamp":"t","payload":{"thread_token_usage":{"z":1,"a":{"y":2,"b":"é"}},"usage":7}}', '{"type":"token_usage_record","payload":{"usage":7}}'], "codex")
    assert [x["text"] for x in format_a.facts(r).filter("kind = 'token_record'").orderBy("seq").collect()] == ['{"z":1,"a":{"y":2,"b":"é"}}', "7"]


def stored(spark, path, rows):
    """Records (session_id, value, ...) of format B that are read from files, and what takes these away."""
    rows = [("copilot", s, n, json.dumps(v)) for n, (s, v) in enumerate(rows)]
    spark.createDataFrame(rows, "source string, session_id string, seq long, value string").write.parquet(str(path))
    r = spark.read.parquet(str(path)).withColumn("ok", is_json_object(F.col("value")))
    return r.withColumn("rec", F.when(F.col("ok"), F.try_parse_json("value"))), lambda: shutil.rmtree(path)


def _call(name, n, kind="start", **data):
    return {"type": f"tool.execution_{'start' if kind == 'start' else 'complete'}", "data": {"toolCallId": f"c{n}", **({"toolName": name} if kind == "start" else {"success": True}), **data}}


def test_recount_reads_records_once(spark, tmp_path):
    """Changed paths lie below the folder of their time, over many folders; once the counts are made, no record is read again."""
    rows, want = [], set()
    for n in range(300):
        session, cwd = f"s{n % 2}", f"/w{n // 2 // 10}" if n >= 20 else None
        if cwd and n % 20 < 2:
            rows.append((session, {"type": "session.context_changed", "data": {"cwd": cwd}}))
        rows += [(session, _call("edit", n, arguments={"path": f"f{n % 3}"})), (session, _call("edit", n, "complete"))]
        want.add((session, f"{cwd}/f{n % 3}" if cwd else f"f{n % 3}"))
    rows += [("s1", _call("bash", 7, arguments={"command": "x"})), ("s1", _call("bash", 7, "complete", shellExecution={"exitCode": 1})), ("s1", _call("bash", 999, "complete"))]
    records, gone = stored(spark, tmp_path / "r", rows)
    counts, files = verify.recount_b(records)
    gone()
    assert {(r["session_id"], r["path"]) for r in files.collect()} == want
    assert {r["session_id"]: (r["commands"], r["failures"]) for r in counts.collect()} == {"s0": (0, 0), "s1": (1, 1)}


NESTED = [
    ("s", {"type": "user.message", "data": {"interactionId": "t1", "content": "go"}}),
    ("s", _call("task", 1, interactionId="t1", arguments={"agent_type": "x", "name": "y"})),
    ("s", {"type": "user.message", "data": {"interactionId": "t2", "content": "on"}}),
    ("s", _call("bash", 2, interactionId="u", parentToolCallId="c1", arguments={"command": "ls"})),
    ("s", _call("bash", 2, "complete", parentToolCallId="c1", result={"content": "out"})),
    ("s", _call("bash", 3, arguments={"command": "pwd"})),
    ("s", _call("bash", 3, "complete")),
    ("s", _call("bash", 1, "complete")),
    ("s", _call("bash", 9, "complete")),
    ("s", 7),
]


def test_facts_read_records_once(spark, tmp_path, interpreted):
    """Turns of nested, plain and unknown calls; once the facts are planned, no record is read again."""
    records, gone = stored(spark, tmp_path / "r", NESTED)
    facts = format_b.facts(records)
    gone()
    found = facts.filter("kind in ('command', 'tool')").select("seq", "kind", "turn", "text", "quiet").collect()
    assert {tuple(r) for r in found} == {(4, "command", "t1", "ls", True), (6, "command", "t2", "pwd", False), (8, "tool", "t2", "unknown-tool", False)}


def test_texts_read_records_once(spark, tmp_path, interpreted):
    """Labels and turns of nested, plain and unknown calls; once the texts are planned, no record is read again."""
    records, gone = stored(spark, tmp_path / "r", NESTED)
    texts = format_b.searchable(records)
    gone()
    got = {r["seq"]: (r["turn"], r["label"], r["output"]) for r in texts.filter("seq > 2").collect()}
    assert got == {
        3: ("t1", "command (exit …): ls [sub-agent]", None), 4: ("t1", "command (exit 0): ls [sub-agent]", "out"), 5: ("t2", "command (exit …): pwd", None), 6: ("t2", "command (exit 0): pwd", None),
        7: ("t1", "sub-agent x: y", None), 8: ("t2", "tool result", None),
    }
