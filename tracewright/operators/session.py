"""The fold of facts, of either format, into turns, ledgers and stats of sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.functions import text as X
from tracewright.operators import ledger
from tracewright.operators.ordered import is_twin

S = ["source", "session_id"]


@dataclass(frozen=True)
class Limits:
    """Characters kept of each text."""

    ask: int = 4000
    final: int = 3000
    note: int = 220
    error: int = 1200
    reasoning: bool = True


@dataclass
class Sessions:
    """Lazily folded sessions; every frame has source and session_id."""

    turns: DataFrame
    actions: DataFrame
    commands: DataFrame
    failures: DataFrame
    files: DataFrame
    reads: DataFrame
    tools: DataFrame
    searches: DataFrame
    delegations: DataFrame
    summaries: DataFrame
    state: DataFrame
    stats: DataFrame


def _ordered(df: DataFrame, keys: list[str], name: str, *fields: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "sub", *fields))).alias(name))


def without_twins(facts: DataFrame) -> DataFrame:
    """Facts without the second copy of messages that are logged in two forms."""
    asks = facts.filter("kind = 'ask' and form is not null")
    bucket = F.when(F.startswith("turn", F.lit("orphan-")), F.lit("")).otherwise(F.col("turn"))
    twin = is_twin(F.col("form"), "response", "event", [*S, "_bucket"], "seq", "sub")
    kept = asks.withColumn("_bucket", bucket).withColumn("_twin", twin).filter("not _twin").drop("_twin", "_bucket")
    return facts.filter("not (kind = 'ask' and form is not null)").unionByName(kept)


def asks_of(facts: DataFrame, limits: Limits) -> DataFrame:
    """(ask, ask_source) of each turn that was asked something."""
    a = facts.filter("kind = 'ask' and text <> ''").withColumn("c", X.clip(F.col("text"), limits.ask))
    turn = W.partitionBy(*S, "turn").orderBy("seq", "sub")
    a = a.withColumn("place", F.row_number().over(turn)).withColumn("idle", F.col("aux") == "if-empty").withColumn("key", X.collapse(F.col("c")))
    again = F.row_number().over(W.partitionBy(*S, "turn", "idle", "key").orderBy("seq", "sub"))
    kept = a.withColumn("again", again).filter((F.col("idle") & (F.col("place") == 1)) | (~F.col("idle") & (F.col("again") == 1)))
    at = F.struct("seq", "sub")
    g = kept.groupBy(*S, "turn").agg(
        F.array_sort(F.collect_list(F.struct("seq", "sub", "c"))).alias("texts"), F.max_by("path", F.when(F.col("aux") == "append", at)).alias("set"), F.min_by("path", at).alias("first"),
    )
    return g.select(*S, "turn", F.array_join(F.transform("texts", lambda x: x["c"]), "\n\n").alias("ask"), F.coalesce("set", "first").alias("ask_source"))


def actions_of(facts: DataFrame, limits: Limits) -> DataFrame:
    """The timeline: a row per action with its kind and line; what sub-agents did is not on it."""
    k, text = F.col("kind"), F.coalesce("text", F.lit(""))
    line = (
        F.when(k == "command", X.one_line(text, 240))
        .when(k == "file", F.concat(F.col("aux"), F.lit(" "), F.col("path"), F.lit(" (~"), F.coalesce("num", F.lit(0)).cast("string"), F.lit(" lines)")))
        .when(k == "read", F.concat_ws(" ", "aux", "path"))
        .when(k == "tool", F.concat(text, F.when(F.coalesce("aux", F.lit("")) != "", F.concat(F.lit(" — "), X.one_line(F.col("aux"), 140))).otherwise("")))
        .when(k == "search", F.concat(F.lit('web search — "'), X.one_line(text, 140), F.lit('"')))
        .otherwise(text)
    )
    kind = F.when(k == "command", "exec").when(k == "tool", "mcp").when(k == "action", F.col("aux")).otherwise(k)
    shown = facts.filter(k.isin("command", "file", "read", "tool", "search", "action", "compaction") & ~F.coalesce("quiet", F.lit(False)))
    ok = F.coalesce("exit_text", F.lit("0")) == "0"
    made = shown.select(
        *S, "turn", "seq", "sub", "ts", "call", kind.alias("kind"), line.alias("line"), F.when(k == "command", F.coalesce("exit_text", F.lit("0"))).alias("exit_text"),
        F.when(k.isin("command", "tool"), F.col("num")).alias("ms"), F.when((k == "command") & ~ok, X.clip_tail(X.trim_all(F.coalesce("error", F.lit(""))), limits.error)).alias("error"), F.coalesce("failed", F.lit(False)).alias("failed"),
    )
    late = facts.filter("kind = 'suffix'").groupBy(*S, "call").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("late"), F.max(F.coalesce("failed", F.lit(False))).alias("late_failed"))
    both = made.join(late, [*S, "call"], "left")
    tail = F.coalesce(F.array_join(F.transform("late", lambda x: F.when(x["text"] != "", F.concat(F.lit(" — "), x["text"])).otherwise("")), ""), F.lit(""))
    return both.select(*S, "turn", "seq", "sub", "ts", "kind", F.concat("line", tail).alias("line"), "exit_text", "ms", "error", (F.col("failed") | F.coalesce("late_failed", F.lit(False))).alias("failed"))


def demoted(facts: DataFrame, limits: Limits) -> DataFrame:
    """Notes from answers that a later answer of the same turn replaced, at the later one's place."""
    finals = facts.filter("kind = 'final' and text <> ''")
    before = F.lag("text").over(W.partitionBy(*S, "turn").orderBy("seq", "sub"))
    notes = finals.withColumn("_before", before).filter("aux = 'demote' and _before is not null")
    return notes.withColumn("kind", F.lit("note")).withColumn("text", X.clip(F.col("_before"), limits.final)).drop("_before")


def turns_of(facts: DataFrame, actions: DataFrame, limits: Limits) -> DataFrame:
    """A row per turn that holds anything: n, n_raw, started_at, ended_at, ask, ask_source, final, duration_ms, notes,
    reasoning, actions."""
    seq, when = F.struct("seq", "sub"), lambda kind, c: F.when((F.col("kind") == kind) & (F.col("text") != ""), c)
    notes = facts.unionByName(demoted(facts, limits))
    item = lambda kind, c: F.array_sort(F.collect_list(when(kind, F.struct("seq", "sub", c.alias("t")))))
    texts = lambda c: F.transform(c, lambda x: x["t"])
    thought = F.when((F.col("kind") == "reasoning") & F.col("text").isNotNull(), F.struct("seq", "sub", F.col("text").alias("t")))
    g = notes.filter("turn is not null").groupBy(*S, "turn").agg(
        F.min(seq).alias("first"), F.min_by("ts", seq).alias("started_at"), F.max_by("ts", F.when(F.col("ts") != "", seq)).alias("ended_at"),
        F.max_by("text", when("final", seq)).alias("final"), F.max_by("num", F.when((F.col("kind") == "duration") & (F.col("num") != 0), seq)).alias("given_ms"),
        item("note", X.one_line(F.col("text"), limits.note)).alias("notes"), F.array_sort(F.collect_list(thought)).alias("reasoning"),
    )
    does = _ordered(actions, [*S, "turn"], "actions", *(F.col(c) for c in ("kind", "line", "exit_text", "ms", "error", "failed", "ts")))
    t = g.join(asks_of(facts, limits), [*S, "turn"], "left").join(does, [*S, "turn"], "left")
    t = t.withColumn("n_raw", F.row_number().over(W.partitionBy(*S).orderBy("first")))
    thoughts = F.size("reasoning") > 0 if limits.reasoning else F.lit(False)
    t = t.filter(F.col("ask").isNotNull() | F.col("final").isNotNull() | F.col("actions").isNotNull() | (F.size("notes") > 0) | thoughts)
    n = F.row_number().over(W.partitionBy(*S).orderBy("first"))
    apart = F.unix_millis(F.try_to_timestamp("ended_at")) - F.unix_millis(F.try_to_timestamp("started_at"))
    empty = F.array().cast(dict(t.dtypes)["actions"])
    return t.select(
        *S, n.alias("n"), "n_raw", "turn", "started_at", "ended_at", "ask", "ask_source", F.when(F.col("final").isNotNull(), X.clip(F.col("final"), limits.final)).alias("final"), F.coalesce("given_ms", F.nullif(apart, F.lit(0))).alias("duration_ms"),
        texts("notes").alias("notes"), (texts("reasoning") if limits.reasoning else F.array().cast("array<string>")).alias("reasoning"), F.coalesce("actions", empty).alias("actions"),
    )


def _commands(facts: DataFrame, limits: Limits) -> DataFrame:
    ok = F.coalesce("exit_text", F.lit("0")) == "0"
    return facts.filter("kind = 'command'").select(
        *S, "turn", "seq", "ts", F.col("text").alias("cmd"), X.cmd_key(F.col("text")).alias("key"), ok.alias("ok"), F.coalesce("exit_text", F.lit("0")).alias("exit_text"),
        X.one_line(F.col("text"), 200).alias("shown"), X.clip_tail(X.trim_all(F.coalesce("error", F.lit(""))), limits.error).alias("error"),
    )


def fold(facts: DataFrame, read: DataFrame | None = None, limits: Limits = Limits()) -> Sessions:
    """Fold facts (as of :mod:`tracewright.sources`) of any number of sessions at once.

    ``read`` has (source, session_id, lines, parse_failures) of the scan. Every step groups by session and turn, path
    or command, so a project is one job and a long session spreads over tasks. Write ``facts`` first: they are read
    several times.
    """
    f = without_twins(facts)
    actions = actions_of(f, limits)
    turns = turns_of(f, actions, limits)
    runs = _commands(f, limits)
    failures = ledger.failures(runs, S, carry=("turn", "ts", "shown", "exit_text", "error"))
    numbers = f.filter("turn is not null").groupBy(*S, "turn").agg(F.min(F.struct("seq", "sub")).alias("first")).withColumn("n_raw", F.row_number().over(W.partitionBy(*S).orderBy("first")))
    failures = failures.join(numbers.select(*S, "turn", "n_raw"), [*S, "turn"], "left")
    files = ledger.files(f.filter("kind = 'file' and path <> ''").withColumnsRenamed({"aux": "verb", "num": "lines"}), S)
    reads = ledger.counted(f.filter("kind = 'read' and path <> ''"), S, "path", "reads")
    tools = ledger.counted(f.filter("kind = 'tool'").withColumnRenamed("text", "tool"), S, "tool")
    commands = ledger.commands(runs, S)
    at = F.struct("seq", "sub")
    is_ = lambda kind, c="text": F.when((F.col("kind") == kind) & F.col(c).isNotNull(), at)
    last, first = (lambda kind, c="text": F.max_by(c, is_(kind, c))), (lambda kind, c="text": F.min_by(c, is_(kind, c)))
    state = f.groupBy(*S).agg(
        F.coalesce(first("cwd_first"), last("cwd_last")).alias("cwd"), F.coalesce(last("model_last"), first("model_first")).alias("model"), first("originator").alias("originator"), first("version").alias("version"),
        first("started_at").alias("started_at"), first("instructions").alias("instructions"), last("plan").alias("plan"), last("plan_doc").alias("plan_doc"), last("token_record").alias("token_record"),
        first("context_window", "num").alias("context_window"), F.count_if(F.col("kind") == "compaction").alias("compactions"),
        F.coalesce(F.sum(F.when((F.col("kind") == "tokens") & (F.col("aux") == "sum"), F.col("num"))), F.max(F.when((F.col("kind") == "tokens") & (F.col("aux") == "max"), F.col("num"))), F.lit(0)).alias("total_tokens"),
    )
    count = lambda df, name, c=None: df.groupBy(*S).agg((F.count(F.lit(1)) if c is None else F.sum(c)).alias(name))
    stats = state.select(*S, "compactions", "total_tokens")
    for part in (count(turns, "turns"), count(commands, "commands", "runs"), count(commands, "unique_commands"), count(files, "files_touched"), count(reads, "files_read"), count(failures, "errors", "occurrences"), count(failures.filter("not resolved"), "outstanding_errors")):
        stats = stats.join(part, S, "left")
    if read is not None:
        stats = stats.join(read, S, "left")
    stats = stats.na.fill(0)
    searches = f.filter("kind = 'search'").select(*S, "seq", "ts", F.col("text").alias("query"))
    delegations = f.filter("kind = 'delegation'").select(*S, "seq", "ts", F.col("aux").alias("kind"), F.col("text").alias("summary"), F.col("error").alias("report"))
    summaries = f.filter("kind = 'summary'").select(*S, "seq", "ts", "text")
    return Sessions(turns, actions, commands, failures, files, reads, tools, searches, delegations, summaries, state, stats)


def titled(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions with their title, or one made of the first request, and where it came from."""
    first = turns.filter("ask is not null").groupBy(*S).agg(F.min_by("ask", "n").alias("_ask"))
    s = sessions.join(first, S, "left")
    source = F.when(F.col("title").isNotNull(), "source-index").when(F.col("_ask").isNotNull(), "first-request").otherwise("none")
    return s.withColumn("title_source", source).withColumn("title", F.coalesce("title", X.title_of(F.col("_ask")))).drop("_ask")
