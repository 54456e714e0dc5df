"""Checks of what the engine says about sessions: a recount from the raw records that shares no rule with the facts, and checks
of the rendered text. Each gives a row a problem; none means that all agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.operators.lineage import set_difference
from tracewright.operators.ordered import carried, carry_forward
from tracewright.operators.session import S, Sessions
from tracewright.scratch import written

# Fixed values of the formats, as the recount needs them.
_SHELLS = ("powershell", "bash", "shell", "local_shell")
_EDITS = ("edit", "str_replace", "str-replace", "create")
_PATCHED = r"(?m)^\*\*\* (?:(?:Add|Update|Delete) File|Move to): (.+?)\s*$"


def _text(path: str) -> Column:
    return F.get_json_object("value", path)


def _whole_path(cwd: Column, path: Column) -> Column:
    """``path`` below ``cwd`` unless it is absolute or no folder is known, its ``.`` and ``..`` taken out."""
    parts = F.filter(F.split(F.concat(cwd, F.lit("/"), path), "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.when(F.startswith(path, F.lit("/")) | path.rlike("^[A-Za-z]:") | cwd.isNull(), path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def recount_a(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session, commands, failures) and (session, path) of format A: completed items, each id's first only."""
    item = records.filter("ok").filter(_text("$.payload.type") == "item_completed")
    items = item.select(*S, "seq", _text("$.payload.item.id").alias("id"), _text("$.payload.item.type").alias("type"), F.coalesce(_text("$.payload.item.exit_code"), F.lit("0")).alias("code"), F.json_object_keys(_text("$.payload.item.changes")).alias("paths"))
    again = F.row_number().over(W.partitionBy(*S, "id").orderBy("seq"))
    once = items.filter("coalesce(id, '') <> ''").withColumn("k", again).filter("k = 1").drop("k").unionByName(items.filter("coalesce(id, '') = ''"))
    command = F.col("type") == "CommandExecution"
    counts = once.groupBy(*S).agg(F.count_if(command).alias("commands"), F.count_if(command & (F.col("code") != "0")).alias("failures"))
    return counts, once.filter("type = 'FileChange'").select(*S, F.explode("paths").alias("path")).distinct()


def recount_b(records: DataFrame, sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(session, commands, failures) and (session, path) of format B: completions with the last start of their call before
    them; paths below the folder of that time, at first the one of ``sessions`` (session, cwd)."""
    typ = _text("$.type")
    moved = F.when(typ.isin("session.start", "session.resume"), _text("$.data.context.cwd")).when(typ == "session.context_changed", _text("$.data.cwd"))
    begun, ended = typ == "tool.execution_start", typ == "tool.execution_complete"
    tail = F.regexp_extract(F.coalesce(_text("$.data.result.content"), F.lit("")), r"exit code (-?\d+)>\s*$", 1)
    code = F.coalesce(_text("$.data.shellExecution.exitCode"), F.nullif(tail, F.lit("")), F.lit("0"))
    refused = F.coalesce(_text("$.data.success") == "false", F.lit(False))
    start = F.struct(_text("$.data.toolName").alias("tool"), _text("$.data.arguments").alias("args"))
    # each record is read once, for the few fields that count
    r = written(records.filter("ok").select(*S, "seq", moved.alias("moved"), F.when(begun | ended, _text("$.data.toolCallId")).alias("call"), F.when(begun, start).alias("start"), F.when(ended, refused).alias("refused"), F.when(ended & ~refused, code).alias("code")), "recount")
    at = carried(r, {"cwd": F.col("moved")}, S, "seq")
    if sessions is not None:
        first = sessions.filter("cwd is not null").groupBy(*S).agg(F.any_value("cwd").alias("_first"))
        at = at.join(first, S, "left").withColumn("cwd", F.coalesce("cwd", "_first")).drop("_first")
    met = at.filter("call is not null").withColumn("s", carry_forward(F.col("start"), [*S, "call"], "seq")).filter("refused is not null and s is not null")
    shell = F.col("s.tool").isin(*_SHELLS)
    patch = F.coalesce(F.get_json_object("s.args", "$.input"), F.col("s.args"))
    one = F.get_json_object("s.args", "$.path")
    named = F.when(F.col("s.tool").isin(*_EDITS) & (one != ""), F.array(one)).when(F.col("s.tool") == "apply_patch", F.regexp_extract_all(patch, F.lit(_PATCHED), 1))
    met = written(met.select(*S, "cwd", shell.alias("shell"), (F.col("refused") | (F.col("code") != "0")).alias("failed"), F.when(~shell & ~F.col("refused"), named).alias("named")), "recount")
    counts = met.groupBy(*S).agg(F.count_if("shell").alias("commands"), F.count_if(F.col("shell") & F.col("failed")).alias("failures"))
    paths = met.select(*S, "cwd", F.explode("named").alias("path")).distinct()
    return counts, paths.select(*S, _whole_path(F.col("cwd"), F.col("path")).alias("path")).distinct()


def recounted(folded: Sessions, counts: DataFrame, files: DataFrame) -> DataFrame:
    """(session, problem, ledger, recount): where the fold's commands, failures or files are not those of a recount."""
    said = folded.commands.groupBy(*S).agg(F.sum("runs").alias("commands")).join(folded.failures.groupBy(*S).agg(F.sum("occurrences").alias("failures")), S, "full_outer")
    both = said.alias("l").join(counts.alias("r"), S, "full_outer")
    zero = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0)).cast("string")
    pairs = F.array(*(F.struct(F.lit(c).alias("problem"), zero("l", c).alias("ledger"), zero("r", c).alias("recount")) for c in ("commands", "failures")))
    unequal = both.select(*S, F.explode(pairs).alias("p")).select(*S, "p.*").filter("ledger <> recount")
    apart = set_difference(folded.files, files, S)
    paths = apart.select(*S, F.lit("file").alias("problem"), F.when(F.col("side") == "left", F.col("path")).alias("ledger"), F.when(F.col("side") == "right", F.col("path")).alias("recount"))
    return unequal.unionByName(paths)


def repeated_blocks(text: Column, least: int = 20) -> Column:
    """The blocks of a text, of more than ``least`` characters, that equal the block before them; blocks are parted by empty
    lines and trimmed, shorter ones do not count as lying between."""
    blocks = F.filter(F.transform(F.split(text, "\n\n"), lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", "")), lambda b: F.length(b) > least)
    rest = F.greatest(F.size(blocks) - 1, F.lit(0))
    with_last = F.zip_with(F.slice(blocks, 2, rest), F.slice(blocks, 1, rest), lambda a, b: F.when(a == b, a))
    return F.array_compact(with_last)


def rendered(views: DataFrame, folded: Sessions) -> DataFrame:
    """(session, problem, turn): views (session, markdown) without their session's id, sessions without a view, views whose
    table counts other files than the ledger, and turns that repeat a request."""
    counted = folded.files.groupBy(*S).agg(F.count(F.lit(1)).alias("files"))
    known = folded.stats.select(*S).join(views.select(*S, "markdown"), S, "left").join(counted, S, "left")
    said = F.regexp_extract("markdown", r"(?m)^\| Activity \|.* (\d+) files changed", 1)
    problem = F.when(F.col("markdown").isNull(), "no view").when(~F.contains("markdown", "session_id"), "session id missing").when(said != F.coalesce("files", F.lit(0)).cast("string"), "other number of files")
    whole = known.select(*S, problem.alias("problem"), F.lit(None).cast("long").alias("turn")).filter("problem is not null")
    again = folded.turns.filter(F.size(repeated_blocks(F.coalesce("ask", F.lit("")))) > 0)
    return whole.unionByName(again.select(*S, F.lit("request repeated").alias("problem"), F.col("n").cast("long").alias("turn")))
