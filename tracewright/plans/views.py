"""Views of sessions as Markdown and JSON, a row for each session, and the report over many sessions as ordered lines."""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.functions import text as X
from tracewright.operators import fit
from tracewright.operators.ordered import runs, top
from tracewright.operators.session import S, Sessions, titled
from tracewright.plans import reports
from tracewright.sources.sinks import named_files

TOOL = "python -m tracewright.cli"  # the command that views name for looking further

# Fixed values of the views: what stands before an action of each kind, and boxes of plan items. The headings, table heads and
# sentences of the functions below are fixed values too.
ICONS = {"exec": "$", "file": "±", "read": "›", "mcp": "⚙", "search": "?", "ext": "·", "image": "▣", "delegate": "→", "compaction": "✂", "skill": "★", "model": "◇", "abort": "■", "error": "!"}
BOXES = {"completed": "[x]", "in_progress": "[~]"}


def _doc(*parts: Column | str | None) -> Column:
    """Lines of text; null ones are left out."""
    return F.array_join(F.array_compact(F.array(*(F.lit(p) if p is None or isinstance(p, str) else p for p in parts))), "\n")


def _cat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _when(c: Column, *lines: Column | str) -> Column:
    return F.when(c, _doc(*lines))


def _joined(items: Column, each, sep: str = "\n") -> Column:
    return F.array_join(F.transform(items, each), sep)


def _first(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def _mapped(c: Column, values: dict[str, str], other: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[c], F.lit(other))


def _time(ts: Column) -> Column:
    return X.minute(F.try_to_timestamp(ts.cast("string")))


def _id8() -> Column:
    return F.substring("session_id", 1, 8)


def _details(summary: Column | str, body: Column, fenced: bool = False) -> list[Column | str]:
    fence = ["```"] if fenced else []
    return [_cat("<details><summary>", summary, "</summary>"), "", *fence, body, *fence, "", "</details>", ""]


def packets(sessions: DataFrame, folded: Sessions) -> DataFrame:
    """A row per session with its header, state, counts, plan and ledgers in the order in which they are listed."""
    first = F.col("first_seq").asc()
    of = reports._listed
    failures = folded.failures.select(*S, "first_seq", F.col("shown").alias("cmd"), F.col("exit_text").alias("exit"), "occurrences", "error", "resolved")
    files = of(folded.files, [F.desc(F.col("n_add") + F.col("n_update")), first, F.col("first_sub").asc()], "files_changed", "path", "n_add", "n_update", "n_delete", "lines")
    lists = (
        files, of(folded.reads, [F.desc("reads"), first], "files_read_most", "path", "reads"), of(folded.commands, [F.desc("runs"), first], "commands_run", "cmd", "runs", F.col("failures").alias("failed")),
        of(folded.tools, [F.desc("calls"), first], "tools", "tool", "calls"), of(failures, [first], "failures", "cmd", "exit", "occurrences", "error", "resolved"),
        of(folded.searches, [F.col("seq").asc()], "searches", "query"), of(folded.delegations, [F.col("seq").asc()], "delegations", "kind", "summary", "report"), of(top(folded.summaries, S, [F.desc("seq")], 1).drop("rank"), [F.desc("seq")], "summary", "ts", "text"),
    )
    t = folded.turns
    last = lambda c: F.max_by(F.struct("n", F.col("started_at").alias("ts"), F.col("ask_source").alias("source"), F.col(c).alias("text")), F.when(F.col(c).isNotNull(), F.col("n")))
    state = folded.state.select(*S, F.col("cwd").alias("_cwd"), F.col("model").alias("_model"), "instructions", F.col("plan").alias("_plan"), F.col("plan_doc").alias("_plan_doc"))
    p = titled(sessions, t).join(t.groupBy(*S).agg(last("ask").alias("last_ask"), last("final").alias("last_final")), S, "left").join(state, S, "left").join(folded.stats, S, "left")
    for more in lists:
        p = p.join(more, S, "left")
    own = lambda c, kind="string": F.col(c) if c in sessions.columns else F.lit(None).cast(kind)
    p = p.withColumns({
        "cwd": reports._either("_cwd", "cwd"), "model": reports._either("model", "_model"), "plan": F.coalesce(own("plan"), F.col("_plan")), "plan_doc": F.coalesce(own("plan_doc"), F.col("_plan_doc")),
        "resume": own("resume"), "repository": own("repository"), "branch": own("branch"),
    }).drop("_cwd", "_model", "_plan", "_plan_doc")
    for name in ("files_changed", "files_read_most", "commands_run", "tools", "failures", "searches", "delegations", "summary"):
        p = p.withColumn(name, F.coalesce(name, F.array().cast(dict(p.dtypes)[name])))
    return p.withColumn("plan", F.coalesce(F.from_json("plan", reports.format_a.STEPS), F.array().cast(reports.format_a.STEPS)))


def _spine(max_files: int) -> Column:
    label, n = X.source_label(F.col("source")), lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    dash = lambda c: F.coalesce(F.col(c), F.lit("—"))
    tick = lambda c: _cat("`", c, "`")
    some = lambda c, text: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, _cat(" · ", F.col(c), text)).otherwise("")
    asked, said = F.col("last_ask"), F.col("last_final")
    brief = F.when(F.coalesce(asked["source"], F.lit("")).isin("delegated-in", "delegated-message"), "Most recent brief handed to the agent").otherwise("Most recent request from the user")
    at = lambda x: _cat(" _(turn ", x["n"], ", ", _time(x["ts"]), ")_:")
    open_ = F.filter("failures", lambda f: ~f["resolved"])
    resolved = F.size("failures") - F.size(open_)
    error = lambda e: F.when(F.coalesce(e["error"], F.lit("")) != "", _cat("\n\n  ```\n", _joined(_last(F.split(e["error"], "\n"), 8), lambda x: F.concat(F.lit("  "), x)), "\n  ```")).otherwise("")
    failure = lambda e: _cat("- `", e["cmd"], "` → exit ", e["exit"], F.when(e["occurrences"] > 1, _cat(" (failed ", e["occurrences"], "×)")).otherwise(""), error(e))
    deleted = F.exists("files_changed", lambda f: f["n_delete"] > 0)
    number = lambda x: F.when(x > 0, x.cast("string")).otherwise("")
    row = lambda f: _cat("| `", f["path"], "` | ", number(f["n_add"]), " | ", number(f["n_update"]), " |", F.when(deleted, _cat(" ", number(f["n_delete"]), " |")).otherwise(""), " ", number(f["lines"]), " |")
    files, reads = F.col("files_changed"), F.col("files_read_most")
    few = max(10, round(max_files / 3))
    return _doc(
        _cat("# ", label, " session — ", F.coalesce("title", F.lit("untitled"))), "",
        _cat("> Condensed view of a ", label, " session, produced deterministically: text is quoted verbatim or reduced by fixed rules."),
        "> No model summarised anything here, except sections explicitly labelled as written by the agent tool itself.", "> Start at **Latest state**; read the timeline for history.", "", "| | |", "|---|---|",
        _cat("| Session | ", tick(F.col("session_id")), " (", label, ") |"), _cat("| Link | ", F.col("link"), " |"), F.when(F.col("resume").isNotNull(), _cat("| Resume | ", tick(F.col("resume")), " |")),
        _cat("| Working dir | ", tick(dash("cwd")), " |"),
        F.when(F.col("repository").isNotNull() | F.col("branch").isNotNull(), _cat("| Repository | ", F.concat_ws(", ", "repository", F.when(F.col("branch").isNotNull(), _cat("branch ", tick(F.col("branch"))))), " |")),
        _cat("| Model | ", dash("model"), " (", dash("originator"), ") |"), _cat("| Span | ", _time(F.col("started_at")), " → ", _time(F.col("updated_at")), " |"),
        _cat("| Source | ", X.human_size(F.col("bytes"), " "), ", ", n("segments"), " file(s), ", F.format_number(F.coalesce("lines", F.lit(0)), 0), " records |"),
        _cat("| Activity | ", n("turns"), " turns · ", n("commands"), " commands · ", n("files_touched"), " files changed", some("files_read", " files read"), " · ", n("outstanding_errors"), " outstanding failure(s)", some("compactions", " compaction(s)"), " |"), "",
        "## Latest state", "",
        _when(asked.isNotNull(), _cat("**", brief, "**", at(asked)), "", X.blockquote(asked["text"]), ""), _when(said.isNotNull(), _cat("**Last reply from the agent**", at(said)), "", X.blockquote(said["text"]), ""),
        _when(asked.isNull() & said.isNull(), "_No user request or final agent message was recorded._", ""),
        _when(F.size("plan") > 0, "### Plan state at the end", "", _joined(F.col("plan"), lambda x: _cat("- ", _mapped(x["status"], BOXES, "[ ]"), " ", x["step"])), ""),
        _when(F.coalesce("plan_doc", F.lit("")) != "", *_details("Plan document written during the session", X.clip_doc(F.col("plan_doc"), 6000))),
        _when(F.size(open_) > 0, "### Outstanding failures", "", "Commands that failed and were never observed to succeed afterwards. Re-verify before assuming they are fixed.", "", _joined(_last(open_, 10), failure),
              F.when(F.size(open_) > 10, _cat("- _…", F.size(open_) - 10, " further outstanding failures (full list in the JSON packet)_")), ""),
        _when(resolved > 0, _cat("_", resolved, " other command(s) failed at some point but later succeeded — treated as resolved._"), ""),
        _when(F.size(files) > 0, "## Files changed", "", F.when(deleted, "| File | Created | Edited | Deleted | ~Lines |").otherwise("| File | Created | Edited | ~Lines |"), F.when(deleted, "|---|--:|--:|--:|--:|").otherwise("|---|--:|--:|--:|"),
              _joined(_first(files, max_files), row), F.when(F.size(files) > max_files, _cat("| _…", F.size(files) - max_files, " more (full list in the JSON packet)_ | | | |", F.when(deleted, " |").otherwise(""))), ""),
        _when(F.size(reads) > 0, _cat("**Most-read files** (", F.size(reads), " distinct): ", _joined(_first(reads, few), lambda r: _cat("`", r["path"], "` ×", r["reads"]), ", "), F.when(F.size(reads) > few, ", …").otherwise("")), ""),
    )


def _reference(max_commands: int) -> Column:
    commands, told = F.col("commands_run"), F.filter("delegations", lambda d: F.coalesce(d["report"], F.lit("")) != "")
    run = lambda c: _cat(F.lpad(c["runs"].cast("string"), 4, " "), "× ", X.short_line(c["cmd"], 200), F.when(c["failed"] > 0, _cat("   (", c["failed"], " failed)")).otherwise(""))
    looked = _first(F.array_distinct(F.transform("searches", lambda s: s["query"])), 15)
    return _doc(
        "## Reference", "",
        _when(F.size(commands) > 0, *_details("Commands run (deduplicated, most frequent first)", _doc(_joined(_first(commands, max_commands), run), F.when(F.size(commands) > max_commands, _cat("… ", F.size(commands) - max_commands, " more unique commands"))), True)),
        _when(F.size("tools") > 0, _cat("**Tools used:** ", _joined(_first(F.col("tools"), 20), lambda m: _cat(m["tool"], " ×", m["calls"]), ", ")), ""),
        _when(F.size(looked) > 0, _cat("**Web searches:** ", _joined(looked, lambda q: _cat('"', X.short_line(q, 90), '"'), ", ")), ""),
        _when(F.size(told) > 0, *_details("Sub-agent reports (first lines)", _joined(_last(told, max_commands), lambda d: _cat("- **", d["kind"], ": ", d["summary"], "** — ", d["report"])))),
        _when(F.size("summary") > 0, *_details(_cat("Latest checkpoint summary (written by ", X.source_label(F.col("source")), " during the session, ", _time(F.get("summary", F.lit(0))["ts"]), ")"), X.clip_doc(F.get("summary", F.lit(0))["text"], 8000))),
        _when(F.coalesce("instructions", F.lit("")) != "", *_details("Custom instructions in force during this session", X.trim_all(F.col("instructions")), True)),
    )


def _collapsed(actions: Column) -> Column:
    """Runs of equal actions as their first, with how many there are."""
    key = lambda a: F.concat_ws("|", a["kind"], a["line"])
    marked = F.transform(actions, lambda a, i: F.struct(a.alias("a"), i.alias("i"), ((i == 0) | (key(a) != key(F.get(actions, i - 1)))).alias("new")))
    starts = F.filter(marked, lambda m: F.coalesce(m["new"], F.lit(True)))
    return F.transform(starts, lambda m, j: F.struct(m["a"].alias("a"), (F.coalesce(F.get(starts, j + 1)["i"], F.size(actions)) - m["i"]).alias("count")))


def _turn(tier: Column) -> Column:
    """A turn as one line (tier 1), abbreviated (2) or in full (3)."""
    when, took = _time(F.col("started_at")), X.duration(F.coalesce("duration_ms", F.lit(0)))
    n_commands, edits = F.size(F.filter("actions", lambda a: a["kind"] == "exec")), F.filter("actions", lambda a: a["kind"] == "file")
    counts = F.concat_ws(", ", F.when(n_commands > 0, _cat(n_commands, " cmd")), F.when(F.size(edits) > 0, _cat(F.size(edits), " file edit")))
    bits = F.concat_ws(" / ", F.concat(F.lit("asked: "), X.short_line(F.col("ask"), 150)), F.concat(F.lit("answered: "), X.short_line(F.col("final"), 150)))
    digest = _cat("- **T", F.col("n"), "** ", when, F.when(counts != "", F.concat(F.lit(" · "), counts)).otherwise(""), F.when(bits != "", F.concat(F.lit(" — "), bits)).otherwise(""))
    text = lambda c: X.blockquote(F.when(tier == 2, X.clip_doc(F.col(c), 1200)).otherwise(F.col(c)))
    label = _mapped(F.coalesce("ask_source", F.lit("user")), {"delegated-in": "Delegated brief", "delegated-message": "Message from parent agent"}, "User")
    line = lambda x: _cat(_mapped(x["a"]["kind"], ICONS, "·"), " ", x["a"]["line"], F.when(x["count"] > 1, _cat(" ×", x["count"])).otherwise(""), F.when((F.coalesce(x["a"]["exit_text"], F.lit("0")) != "0") | x["a"]["failed"], " ✗").otherwise(""))
    path = lambda a: F.regexp_extract(a["line"], r"^(?:add|update|delete) (.*) \(~\d+ lines\)$", 1)
    named = _first(F.array_distinct(F.filter(F.transform(edits, path), lambda p: p != "")), 5)
    activity = F.concat_ws("; ", F.when(n_commands > 0, _cat(n_commands, " command(s)")), F.when(F.size(edits) > 0, _cat(F.size(edits), " file change(s): ", F.array_join(named, ", "))))
    full = _doc(
        _when(F.size("reasoning") > 0, _cat("**Reasoning trail:** ", F.array_join(_first(F.array_distinct("reasoning"), 25), " · ")), ""),
        _when(F.size("notes") > 0, _joined(F.array_distinct("notes"), lambda x: _cat("_", x, "_")), ""), _when(F.size("actions") > 0, "```", _joined(_collapsed(F.col("actions")), line), "```", ""),
    )
    rest = F.nullif(F.when(tier == 3, full).otherwise(F.coalesce(_when(activity != "", _cat("_Activity: ", activity, "._"), ""), F.lit(""))), F.lit(""))
    whole = _doc(
        _cat("### Turn ", F.col("n"), " — ", when, F.when(took != "", _cat(" (", took, ")")).otherwise("")), "", _when(F.col("ask").isNotNull(), _cat("**", label, ":**"), "", text("ask"), ""), rest,
        _when(F.col("final").isNotNull(), "**Agent:**", "", text("final"), ""),
    )
    return F.when(tier == 1, digest).otherwise(whole)


def session_views(sessions: DataFrame, folded: Sessions, budget_tokens: int | None = 40_000, *, now: datetime | None = None) -> DataFrame:
    """A row per session: source, session_id, name (of its files, without ending), markdown, packet (as JSON), tokens.

    Turns are rows until the end: each is rendered by itself in the tier that the budget leaves it, runs of omitted ones
    become one line, and the lines of a session are put together last.
    """
    made = (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    caps = fit.ledger_caps(budget_tokens)
    p = packets(sessions, folded).withColumn("_spine", _spine(caps["files"])).withColumn("_reference", _reference(caps["commands"]))
    p = p.withColumn("_spine_tokens", X.tokens(F.length("_spine") + F.length("_reference") + 1))
    costed = reports.costed_turns(folded)
    g = costed.groupBy(*S).agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "cost")))).alias("x")).join(p.select(*S, "_spine_tokens"), S)
    costs = F.transform("x", lambda x: x["cost"])
    whole = F.col("_spine_tokens") + X.tokens(F.aggregate(costs, F.lit(0).cast("bigint"), lambda acc, c: acc + c[3]))
    g = g.withColumn("f", fit.plan_budget(costs, F.lit(budget_tokens), F.col("_spine_tokens"), 3)).withColumn("_whole", whole)
    tiers = g.select(*S, F.explode(F.arrays_zip(F.transform("x", lambda x: x["n"]).alias("n"), F.col("f.tiers").alias("tier"))).alias("z")).select(*S, "z.n", "z.tier")
    t = costed.drop("cost").join(tiers, [*S, "n"])
    w = W.partitionBy(*S).orderBy("n")
    t = t.withColumns({"_before": F.lag("tier").over(w), "_after": F.lead("tier").over(w), "_last": F.max("n").over(W.partitionBy(*S)), "omitted": F.col("tier") == 0})
    opens = F.when((F.col("tier") == 1) & ~F.col("_before").eqNullSafe(1), "<details><summary>Earlier turns (one line each)</summary>\n\n").otherwise("")
    closes = F.when((F.col("tier") == 1) & ~F.col("_after").eqNullSafe(1), "\n\n</details>\n").otherwise("")
    kept = t.filter("tier > 0").select(*S, "n", F.concat(opens, _turn(F.col("tier")), closes).alias("text"))
    gone = runs(t.select(*S, "n", "started_at", "omitted", "_last"), S, ["n"], "omitted").filter("omitted").groupBy(*S, "run", "_last").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("a"), F.max("n").alias("b"), F.min_by("started_at", "n").alias("t0"), F.max_by("started_at", "n").alias("t1"))
    range_ = lambda more: _cat(" turn(s) omitted** (turns ", F.col("a"), "–", F.col("b"), *more)
    earlier = _cat("> **", F.col("k"), " earlier", range_((", ", _time(F.col("t0")), " → ", _time(F.col("t1")), "). Their file changes and commands are still counted above. ")), f"Recover any of them with `{TOOL} turn ", _id8(), " <n>`.\n")
    final = _cat("> **", F.col("k"), range_(("). ",)), f"Recover with `{TOOL} turn ", _id8(), " <n>`.\n")
    lines = kept.union(gone.select(*S, F.col("b").alias("n"), F.when(F.col("b") == F.col("_last"), final).otherwise(earlier)))
    timeline = lines.groupBy(*S).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("_timeline"))
    many = lambda k: F.size(F.filter("f.tiers", lambda x: x == k)).cast("string")
    fitted = F.lit(False) if not budget_tokens else F.col("_whole") > budget_tokens
    note = _when(fitted, _cat(f"_Fitted to a ~{budget_tokens or 0:,} token budget: ", many(3), " turn(s) in full detail, ", many(2), " abbreviated, ", many(1), " reduced to one line, ", many(0), " omitted. The ", F.least(F.size("x"), F.lit(3)),
        " most recent turn(s) are always kept in full. Unabridged this would be ~", F.format_number("_whole", 0), " tokens._"), "",
        _cat(f"_Nothing is permanently lost: `{TOOL} search ", _id8(), ' "<text>"` searches the complete original transcript, including command output this packet drops._'), "")
    notes = g.select(*S, note.alias("_note"))
    v = p.join(timeline, S, "left").join(notes, S, "left")
    foot = _cat(f"_Generated {made} from ", X.human_size(F.col("bytes"), " "), " of ", X.source_label(F.col("source")), " session data. Deterministic condensation — no model in the loop._")
    text = _doc(F.col("_spine"), "## Conversation timeline", "", F.nullif(F.col("_note"), F.lit("")), F.col("_timeline"), F.col("_reference"), "---", foot)
    name = F.concat_ws("-", F.lit("session-view"), "source", X.slug(F.col("title")), F.regexp_replace("session_id", "[^0-9A-Za-z._-]", "_"))
    listed = folded.turns.groupBy(*S).agg(F.array_sort(F.collect_list(F.struct("n", *[c for c in folded.turns.columns if c not in (*S, "n")]))).alias("turn_list"))
    v = v.withColumn("markdown", text).withColumn("name", name).join(listed, S, "left")
    header = [c for c in v.columns if not c.startswith("_") and c not in ("markdown", "name")]
    return v.select(*S, "name", "markdown", F.to_json(F.struct(F.lit(made).alias("generated_at"), *header)).alias("packet"), X.tokens(F.length("markdown")).alias("tokens"))


def write_views(views: DataFrame, folder: str) -> DataFrame:
    """The views as files ``name``.md and ``name``.json of a folder that all executors reach, written by them; a row per
    session with the path of its Markdown file as ``packet``."""
    files = named_files(views.select(*S, F.col("name"), F.create_map(F.lit("md"), "markdown", F.lit("json"), "packet").alias("texts")), S, folder)
    return files.select(*S, F.element_at("paths", "md").alias("packet"))


def table_lines(sessions: DataFrame, limit: int = 20, *, now: datetime | None = None) -> list[str]:
    """A listing with fixed columns of the newest ``limit`` sessions, and how many more there are."""
    at = F.lit(now or datetime.now(timezone.utc))
    cell = lambda c, n: F.rpad(F.when(F.length(c) >= n, F.concat(F.substring(c, 1, n - 2), F.lit("… "))).otherwise(c), n, " ")
    shown = reports.newest(sessions, limit).select("source", _id8().alias("id"), X.ago(F.col("updated_at").cast("timestamp"), at).alias("ago"), X.human_size(F.col("bytes")).alias("size"), F.coalesce("title", F.lit("—")).alias("title"), F.coalesce("cwd", F.lit("—")).alias("cwd"))
    rows = shown.select(F.concat(cell(F.col("source"), 8), cell(F.col("id"), 10), cell(F.col("ago"), 10), cell(F.col("size"), 9), cell(F.col("title"), 40), "cwd").alias("line")).collect()
    if not rows:
        return ["  (no matching sessions)"]
    more = sessions.count() - len(rows)
    head = "  " + "#".ljust(4) + "SOURCE".ljust(8) + "ID".ljust(10) + "UPDATED".ljust(10) + "SIZE".ljust(9) + "TITLE".ljust(40) + "FOLDER"
    return [head, *(f"  {str(k).ljust(4)}{r['line']}" for k, r in enumerate(rows, 1)), *([f"  …{more} more"] if more else [])]


def shown(session: DataFrame) -> str:
    """One session as JSON."""
    return session.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"]


# ---------------------------------------------------------------- the report over many sessions


def _lines(df: DataFrame, section: int, order: Column, line: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), order.cast("long").alias("place"), line.alias("line"))


def report_lines(c: DataFrame, folded: Sessions, *, folder: str | None = None, window: tuple[datetime | None, datetime | None] | None = None, excluded: tuple[str, ...] = (), budget_tokens: int | None = 40_000, now: datetime | None = None) -> DataFrame:
    """(section, place, line): the report over the sessions of :func:`tracewright.plans.reports.cards`, of one folder or, without
    one, of a window over all. Sorted by section and place the lines are its text; only lists that the report cuts short
    anyway and totals are gathered, a row for each session stays a row.
    """
    spark = c.sparkSession
    literal = lambda section, *rows: spark.createDataFrame([(section, k, r) for k, r in enumerate(rows)], "section int, place long, line string")
    t = reports.totals(c, folded).first()
    time = lambda d: d.strftime("%Y-%m-%d %H:%M") if d else None
    at = lambda v: c.select(_time(F.lit(None if v is None else str(v))).alias("x")).first()["x"] if t["sessions"] else "—"
    sources = ", ".join(f"{n} {X.LABELS.get(s, s)}" for s, n in (t["by_source"] or {}).items()) or "none"
    size = spark.range(1).select(X.human_size(F.lit(t["bytes"] or 0), " ").alias("x")).first()["x"]
    folders = reports.folder_rollup(c)
    n_folders = folders.count()
    label = f"{time(window[0]) or 'start'} → {time(window[1]) or 'now'}" if window else "all sessions"
    head = [f"# Project view — {folder}" if folder else f"# Corpus view — {label}", ""]
    head += ["> Every recorded agent session for this folder, condensed deterministically. Requests and replies are quoted verbatim;" if folder else "> Every recorded agent session active in this window, across all folders, condensed deterministically. Requests and replies are quoted verbatim;"]
    head += ["> everything else is reduced by fixed rules. Session codes (S1, S2, …) are in start order and are used throughout.", "", "| | |", "|---|---|", f"| Folder | `{folder}` |" if folder else f"| Folders | {n_folders} |"]
    head += [f"| Excluded | {', '.join(f'`{e}`' for e in excluded)} |"] if excluded and not folder else []
    head += [f"| Sessions | {t['sessions']} ({sources}) |", f"| Span | {at(t['started_at'])} → {at(t['updated_at'])} |", f"| Activity | {t['turns'] or 0} turns · {t['commands'] or 0} commands · {t['files_changed'] or 0} files changed · {t['outstanding_failures'] or 0} outstanding failure(s) |", f"| Source data | {size} |", ""]
    parts = [literal(0, *head)]
    codes = lambda numbers: F.array_join(F.transform(numbers, lambda n: _cat("S", n)), ", ")
    ranked = lambda df, n: df.limit(n).withColumn("place", F.monotonically_increasing_id())  # noqa: E731  the first rows of an ordered table
    if not folder and n_folders:
        parts += [literal(1, "## Folders", "", "| Folder | Sessions | Turns |", "|---|---|--:|"), _lines(ranked(folders, 25), 2, F.col("place"), _cat("| `", X.cell(F.col("folder")), "` | ", codes(F.col("numbers")), " | ", F.col("turns"), " |"))]
        parts += [literal(3, *([f"| _…{n_folders - 25} more in the JSON_ | | |"] if n_folders > 25 else []), "")]
    row = _cat("| ", F.col("code"), " | ", X.source_label(F.col("source")), " | `", _id8(), "` | ", X.day(F.try_to_timestamp("started_at")), " | ", X.day(F.col("updated_at").cast("timestamp")), " | ", F.col("turns"), " | ", F.col("commands"), " | ", F.col("files_touched"), " | ",
               F.when(F.col("outstanding_errors") > 0, F.col("outstanding_errors").cast("string")).otherwise(""), " | ", X.cell(X.short_line(F.coalesce("title", F.lit("—")), 70)), " |")
    parts += [literal(4, "## Sessions", "", "| | Tool | Id | Started | Last active | Turns | Cmds | Files | Fails | Title |", "|---|---|---|---|---|--:|--:|--:|--:|---|"), _lines(c, 5, F.col("number"), row), literal(6, "")]
    ask, reply = F.coalesce("last_ask", "first_ask"), F.col("last_reply")
    newest = _doc(_cat("## Latest state — ", F.col("code")), "", _when(ask.isNotNull(), _cat("**Most recent request** _(", _time(ask["ts"]), ")_:"), "", X.blockquote(X.clip_doc(ask["text"], 1500)), ""),
                  _when(reply.isNotNull(), _cat("**Last reply** _(", _time(reply["ts"]), ")_:"), "", X.blockquote(X.clip_doc(reply["text"], 2000)), ""))
    parts += [_lines(reports.latest(c), 7, F.lit(0), newest)]
    items = lambda n: _joined(_first(F.col("open_plan"), n), lambda s: _cat(F.when(s["status"] == "in_progress", "[~]").otherwise("[ ]"), " ", X.short_line(s["step"], 80)), " · ")
    open_ = reports.unfinished(c)
    if not open_.isEmpty():
        line = _cat("- **", F.col("code"), "** (", F.size("open_plan"), " of ", F.col("plan_size"), " open): ", items(6), F.when(F.size("open_plan") > 6, " · …").otherwise(""))
        parts += [literal(8, "## Unfinished plan items", ""), _lines(open_, 9, -F.col("number"), line), literal(10, "")]
    by_file = folded.files.join(c.select(*S, "number"), S).groupBy("path").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    files = reports.file_rollup(c, folded)
    n_files, n_shared = files.count(), files.filter("n_sessions > 1").count()
    if n_files:
        rel = X.relative_to(F.col("path"), folder) if folder else F.col("path")
        few = ranked(reports.shared_files(files), 25).join(by_file, "path")
        parts += [literal(11, "## Files changed in more than one session" if n_shared else "## Most-changed files", "", *(["_Paths are relative to the project folder unless outside it._", ""] if folder else []), "| File | Sessions | Changes |", "|---|---|--:|")]
        parts += [_lines(few, 12, F.col("place"), _cat("| `", X.cell(rel), "` | ", codes(F.col("numbers")), " | ", F.col("changes"), " |")), literal(13, *([f"| _…{(n_shared or n_files) - 25} more in the JSON_ | | |"] if (n_shared or n_files) > 25 else []), "")]
    failures = reports.failure_rollup(c, folded)
    n_failures = failures.count()
    if n_failures:
        held = folded.failures.filter("not resolved").join(c.select(*S, "number"), S).groupBy(X.cmd_key(F.col("shown")).alias("shown_key")).agg(F.array_sort(F.collect_set("number")).alias("numbers"))
        line = _cat("- `", X.short_line(F.col("cmd"), 160), "` — ", codes(F.col("numbers")), F.when(F.col("occurrences") > 1, _cat(", failed ", F.col("occurrences"), "×")).otherwise(""), F.when(F.coalesce("last_line", F.lit("")) != "", _cat("  \n  _", X.cell(F.col("last_line")), "_")).otherwise(""))
        parts += [literal(14, "## Outstanding failures", "", "Commands that failed and were never seen to succeed later in the same session. Repeats across sessions come first.", ""), _lines(ranked(failures, 10).join(held, "shown_key"), 15, F.col("place"), line)]
        parts += [literal(16, *([f"- _…{n_failures - 10} more in the JSON_"] if n_failures > 10 else []), "")]
    made = (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    where = ["- Each session's own view is at the `packet` path on its card in the JSON"] if "packet" in c.columns else []
    foot = ["## Drill down", "", *where, f"- One session in detail: `{TOOL} view <id>`", f'- Anything said or run in a session, including output: `{TOOL} search <id> "<text>"`', f"- One turn in full: `{TOOL} turn <id> <n>`", "", "---", f"_Generated {made} from {size} of session data. Deterministic condensation — no model in the loop._"]
    spine = parts[0]
    for more in parts[1:]:
        spine = spine.union(more)
    every = reports.requests(c, folded)
    asked = every.agg(F.count(F.lit(1)).alias("n"), F.sum(F.least(F.length("ask"), F.lit(reports.ASK_CHARS)) + 40).alias("chars")).first()
    kept, left = every, None
    if budget_tokens:
        used = (spine.agg(F.sum(F.length("line") + 1).alias("n")).first()["n"] or 0) + sum(len(x) + 1 for x in foot)
        remaining = max(0, budget_tokens - used // 4)
        cards_chars = reports.card_costs(c).agg(F.sum(F.col("cost")[2]).alias("n")).first()["n"] or 0
        if (asked["chars"] or 0) // 4 + cards_chars // 4 > remaining:
            kept = reports.requests(c, folded, int(remaining * 0.4))
            spent = kept.agg(F.sum(X.tokens(F.least(F.length("ask"), F.lit(reports.ASK_CHARS)) + 40)).alias("n")).first()["n"] or 0
            left = remaining - int(spent)
    tiered = reports.fitted_cards(c, left)
    omitted = tiered.filter("tier = 0").count()
    parts = [spine, literal(17, "## Session cards", "", *([f"_{omitted} older session(s) appear only in the table above to fit the size limit. Use `{TOOL} view <id>` for any of them._", ""] if omitted else []))]
    parts += [_lines(tiered.filter("tier > 0"), 18, F.col("number"), _card(folder))]
    n_kept = kept.count()
    parts += [literal(19, "## Every request, in order", "", *([f"_Showing the {n_kept} most recent of {asked['n']} requests; the JSON beside this file has all of them._", ""] if n_kept < asked["n"] else []))]
    order = F.unix_micros(F.coalesce(F.try_to_timestamp("started_at"), F.timestamp_seconds(F.lit(0))))
    brief = F.when(F.col("ask_source") != "user", "_(brief from another agent)_ ").otherwise("")
    parts += [_lines(kept, 20, order, _cat("- **", F.col("code"), "** ", _time(F.col("started_at")), " — ", brief, X.short_line(F.col("ask"), reports.ASK_CHARS))), literal(21, "", *foot)]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out.orderBy("section", "place", "line")


def _card(folder: str | None) -> Column:
    full = F.col("tier") == 2
    cap = lambda x, n: X.blockquote(F.when(full, X.clip_doc(x, n)).otherwise(X.clip_doc(x, 300)))
    rel = lambda p: X.relative_to(p, folder) if folder else p
    files, failed, open_ = F.col("files_changed"), F.col("outstanding"), F.col("open_plan")
    more = lambda items, n: F.when(F.size(items) > n, _cat(", …", F.size(items) - n, " more")).otherwise("")
    return _doc(
        _cat("### ", F.col("code"), " — ", F.coalesce("title", F.lit("untitled"))), "",
        _cat("_", X.source_label(F.col("source")), " · `", F.col("session_id"), "` · ", _time(F.col("started_at")), " → ", _time(F.col("updated_at")), " · ", F.col("turns"), " turns · ", F.col("commands"), " commands · ", F.col("files_touched"), " files changed", F.when(F.col("cwd").isNotNull(), _cat(" · `", F.col("cwd"), "`")).otherwise(""), "_"), "",
        _when(F.col("first_ask").isNotNull(), "**Opening request:**", "", cap(F.col("first_ask.text"), 800), ""),
        _when(full & F.col("last_ask").isNotNull(), _cat("**Last request** _(", _time(F.col("last_ask.ts")), ")_:"), "", X.blockquote(X.clip_doc(F.col("last_ask.text"), 800)), ""),
        _when(F.col("last_reply").isNotNull(), "**Last reply:**", "", cap(F.col("last_reply.text"), 1200), ""),
        _when(full & (F.size(files) > 0), _cat("**Files changed:** ", _joined(_first(files, 10), lambda f: _cat("`", rel(f["path"]), "`"), ", "), more(files, 10)), ""),
        _when(full & (F.size(failed) > 0), _cat("**Outstanding failures:** ", _joined(_first(failed, 3), lambda o: _cat("`", X.short_line(o["cmd"], 100), "` (exit ", o["exit"], ")"), "; "), F.when(F.size(failed) > 3, _cat("; …", F.size(failed) - 3, " more")).otherwise("")), ""),
        _when(full & (F.size(open_) > 0), _cat("**Open plan items:** ", _joined(_first(open_, 8), lambda s: X.short_line(s["step"], 80), " · ")), ""),
    )


def report_json(c: DataFrame, folded: Sessions, *, folder: str | None = None, window: tuple[datetime | None, datetime | None] | None = None, now: datetime | None = None) -> DataFrame:
    """(section, place, text): the whole report as data, one JSON text a row: totals, then every folder, file, failure and tool
    and every card with all its requests. Sorted by section and place they are what :func:`write_report` puts together."""
    made = (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    text = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    codes = lambda numbers: F.transform(numbers, lambda n: _cat("S", n)).alias("sessions")
    since, until = (d.isoformat() if d else None for d in window or (None, None))
    head = reports.totals(c, folded).select(text(F.lit(made).alias("generated_at"), F.lit(folder).alias("folder"), F.lit(since).alias("since"), F.lit(until).alias("until"), F.struct("*").alias("totals")).alias("text"))
    number = c.select(*S, "number")
    held = folded.files.join(number, S).groupBy("path").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    failed = folded.failures.filter("not resolved").join(number, S).groupBy(X.cmd_key(F.col("shown")).alias("shown_key")).agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    by = lambda df, order, *cols: (df, order, text(*cols))
    most = F.desc("n_sessions")
    parts = {
        "folders": by(reports.folder_rollup(c), [most, F.desc("turns"), F.col("numbers")[0].asc()], "folder", codes("numbers"), "turns"),
        "files": by(reports.file_rollup(c, folded).join(held, "path"), [most, F.desc("changes"), F.col("first").asc()], "path", codes("numbers"), "changes"),
        "failures": by(reports.failure_rollup(c, folded).join(failed, "shown_key"), [most, F.desc("occurrences"), F.col("first").asc()], "cmd", codes("numbers"), "occurrences", "last_line"),
        "tools": by(reports.tool_rollup(folded), [F.desc("calls"), F.col("tool").asc()], "tool", "calls"),
        "sessions": by(c, [F.col("number").asc()], *c.columns),
    }
    rows = head.select(F.lit("").alias("section"), F.lit(0).cast("long").alias("place"), "text")
    for name, (df, order, made_of) in parts.items():
        placed = df.withColumn("_text", made_of).withColumn("_place", F.row_number().over(W.orderBy(*order)) if name != "sessions" else F.col("number"))
        rows = rows.unionByName(placed.select(F.lit(name).alias("section"), F.col("_place").cast("long").alias("place"), F.col("_text").alias("text")))
    return rows


SECTIONS = ("folders", "files", "failures", "tools", "sessions")


def write_report(lines: DataFrame, rows: DataFrame, folder: str, base: str) -> tuple[str, str]:
    """The report's lines as base.md and its data (:func:`report_json`) as base.json, one JSON object, in the driver's folder.
    Both are streamed to it."""
    os.makedirs(folder, exist_ok=True)
    paths = os.path.join(folder, f"{base}.md"), os.path.join(folder, f"{base}.json")
    with open(paths[0], "w", encoding="utf-8") as f:
        f.writelines(r["line"] + "\n" for r in lines.toLocalIterator())
    rank = F.array_position(F.array(F.lit(""), *(F.lit(x) for x in SECTIONS)), F.col("section"))
    with open(paths[1], "w", encoding="utf-8") as f:
        last = ""
        for r in rows.orderBy(rank, "place").toLocalIterator():
            if r["section"] == "":
                f.write(r["text"][:-1])
                continue
            while last != r["section"]:  # the sections before it, if they have no rows
                f.write("]" if last else "")
                last = SECTIONS[SECTIONS.index(last) + 1 if last else 0]
                f.write(f',\n"{last}": [\n')
                first = True
            f.write(("" if first else ",\n") + r["text"])
            first = False
        for name in SECTIONS[SECTIONS.index(last) + 1 if last else 0 :]:
            f.write(("]" if last else "") + f',\n"{name}": [')
            last = name
        f.write("]}\n")
    return paths
