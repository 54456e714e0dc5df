"""Sessions, projects and retrieval: selection of sessions, rollups over them, fitting, search and replay."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, fields
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.functions import text as X
from tracewright.operators import fit, session
from tracewright.operators.ordered import numbered, prefix_fit, runs
from tracewright.operators.session import S, Sessions
from tracewright.scratch import written
from tracewright.sources import format_a, format_b, logs
from tracewright.sources.index import HeaderIndex


@dataclass(frozen=True)
class Format:
    """What a log format has to give: its files, their headers, the sessions these make, and the rules for its records."""

    name: str
    header_version: int
    listed: Callable[[SparkSession, str], DataFrame]  # (file, mtime, size) below a root
    headers: Callable[[SparkSession, str, DataFrame | None], DataFrame]  # a row a file, of those given or of all
    discover: Callable[[SparkSession, str, DataFrame, str | None], DataFrame]  # sessions of headers; the last is a file of titles
    facts: Callable[[DataFrame], DataFrame]
    searchable: Callable[[DataFrame], DataFrame]


def _threads(spark: SparkSession, root: str, headers: DataFrame, titles: str | None) -> DataFrame:
    return format_a.sessions(headers, format_a.titles(spark, titles) if titles else None)


FORMATS = {
    f.name: f
    for f in (
        Format(format_a.SOURCE, 1, logs.listing, format_a.headers, _threads, format_a.facts, format_a.searchable),
        Format(format_b.SOURCE, 1, format_b.listed, format_b.sessions, lambda spark, root, headers, titles: headers.drop("file"), format_b.facts, format_b.searchable),
    )
}

# ---------------------------------------------------------------- selection


def list_sessions(spark: SparkSession, roots: dict[str, str], *, source: str | None = None, titles: str | None = None, index: str | None = None, refresh: bool = False) -> DataFrame:
    """All sessions of the log folders in ``roots`` (by source), with ``source`` only that one's. With a folder ``index``
    only logs that are new or changed since the last listing are opened, with ``refresh`` all."""
    wanted = list(roots) if source in (None, "all") else [source]
    if unknown := [s for s in wanted if s not in FORMATS or s not in roots]:
        raise ValueError(f"unknown source {unknown[0]!r}; there is {', '.join(roots)}")
    found = [FORMATS[s].discover(spark, roots[s], _headers(spark, FORMATS[s], roots[s], index, refresh), titles) for s in wanted]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def _headers(spark: SparkSession, form: Format, root: str, index: str | None, refresh: bool) -> DataFrame:
    if index is None:
        return form.headers(spark, root, None)
    kept = HeaderIndex(spark, index, f"{form.name}-{form.header_version}-{hashlib.sha256(root.encode()).hexdigest()[:16]}")
    return kept.headers(form.listed(spark, root), lambda files: form.headers(spark, root, files), refresh=refresh)


def newest(sessions: DataFrame, n: int) -> DataFrame:
    return sessions.orderBy(F.desc("updated_at"), "source", "session_id").limit(n)


def resolve(sessions: DataFrame, raw: str) -> DataFrame | None:
    """The one session named by a link, a path, a full id or six or more of its first characters; None if there is
    none, an error if there are several."""
    raw = raw.strip().strip("\"'")
    whole = re.search(X.UUID, raw)
    inside = _below_root(sessions, raw)
    if inside is not None:
        hits = inside
    elif whole:
        hits = sessions.filter(F.col("session_id") == whole[0].lower())
    elif re.fullmatch("[0-9a-fA-F-]{6,}", raw):
        hits = sessions.filter(F.startswith("session_id", F.lit(raw.lower())))
    else:
        return None
    n = len(hits.limit(2).select("session_id").collect())
    if n > 1:
        raise ValueError(f"{raw!r} names several sessions")
    return hits if n else None


def _below_root(sessions: DataFrame, raw: str) -> DataFrame | None:
    """The session of format B whose folder a path is, or lies in: the first component below the sessions' own root."""
    if "/" not in raw or "://" in raw and not raw.startswith("file:"):
        return None
    path = re.sub(r"^file:/*", "/", raw)
    folder = F.regexp_replace("link", r"^file:/*", "/")
    hits = sessions.filter((F.col("source") == format_b.SOURCE) & ((folder == path.rstrip("/")) | F.startswith(F.lit(path), F.concat(folder, F.lit("/")))))
    return hits if not hits.isEmpty() else None


def find(sessions: DataFrame, words: str) -> DataFrame:
    """Sessions whose title, folder or id hold every word; a word in the title scores 2, elsewhere 1."""
    title = F.lower(F.coalesce("title", F.lit("")))
    everything = F.lower(F.concat_ws(" ", "title", "cwd", "session_id"))
    keep, score = F.lit(True), F.lit(0)
    for w in words.lower().split():
        keep, score = keep & F.contains(everything, F.lit(w)), score + F.when(F.contains(title, F.lit(w)), 2).otherwise(1)
    return sessions.filter(keep).withColumn("score", score).orderBy(F.desc("score"), F.desc("updated_at"), "session_id")


def normal_folder(folder: str) -> str:
    """A folder as paths are compared: absolute, without slashes at the end, in lower case."""
    return (os.path.abspath(folder) if not re.match(r"[A-Za-z]:", folder) else folder).rstrip("/\\").lower()


def _below(cwd: Column, folder: str, nested: bool) -> Column:
    c, f = F.lower(F.regexp_replace(cwd, r"[\\/]+$", "")), normal_folder(folder)
    return F.coalesce((c == f) | (F.startswith(c, F.lit(f + "/")) if nested else F.lit(False)), F.lit(False))


def in_folder(sessions: DataFrame, folder: str, *, nested: bool = False, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Sessions of a folder, with ``nested`` of those below it too; ``exclude`` takes trees out again."""
    return excluding(sessions.filter(_below(F.col("cwd"), folder, nested)), exclude)


def excluding(sessions: DataFrame, folders: tuple[str, ...] | list[str]) -> DataFrame:
    for f in folders:
        sessions = sessions.filter(~_below(F.col("cwd"), f, True))
    return sessions


def parse_when(value: str, *, end_of_day: bool = False, now: datetime | None = None) -> datetime:
    """``3d`` and ``12h`` back from ``now``, an ISO time, or a day (as an upper bound its end)."""
    now = now or datetime.now(timezone.utc)
    if m := re.fullmatch(r"(\d+)([dh])", value.strip()):
        return now - timedelta(**{"days" if m[2] == "d" else "hours": int(m[1])})
    at = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return at + timedelta(days=1) if end_of_day and re.fullmatch(r"\d{4}-\d\d-\d\d", value.strip()) else at


def in_window(sessions: DataFrame, *, since: datetime | None = None, until: datetime | None = None, last: int | None = None) -> DataFrame:
    """Sessions that were active within the window, then the newest ``last`` of them."""
    updated, started = F.col("updated_at").cast("timestamp"), F.coalesce(F.try_to_timestamp("started_at"), F.col("updated_at").cast("timestamp"))
    if since:
        sessions = sessions.filter(updated >= F.lit(since))
    if until:
        sessions = sessions.filter(started <= F.lit(until))
    return newest(sessions, last) if last else sessions


# ---------------------------------------------------------------- reading


def read_records(spark: SparkSession, sessions: DataFrame) -> DataFrame:
    """The numbered records of the chosen sessions: only their files are read. The driver holds their paths."""
    files = sessions.select(*S, F.explode("files").alias("file"))
    paths = [r["file"] for r in files.select("file").distinct().collect()]
    if not paths:
        return logs.records(spark.createDataFrame([], "file string, line_no int, value string, mtime timestamp, size long"), files)
    return logs.records(logs.lines(spark, paths, glob="*", recursive=False), files)


def read_facts(records: DataFrame) -> DataFrame:
    parts = [form.facts(records.filter(F.col("source") == name)) for name, form in FORMATS.items()]
    return parts[0].unionByName(parts[1])


def condense(spark: SparkSession, sessions: DataFrame, limits: session.Limits = session.Limits()) -> Sessions:
    """Scan and fold the chosen sessions. Facts and counts of lines are written to the shared folder, the logs' text is not."""
    records = read_records(spark, sessions)
    scanned = written(records.groupBy(*S).agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("ok")).alias("parse_failures")), "lines")
    return session.fold(written(read_facts(records), "facts"), scanned, limits)


def settled(folded: Sessions) -> Sessions:
    """Every table of the fold written once, for reports that read them again and again."""
    return Sessions(*(written(getattr(folded, f.name), f.name) for f in fields(folded)))


# ---------------------------------------------------------------- rollups


def _listed(df: DataFrame, order: list[Column], name: str, *values: str | Column) -> DataFrame:
    """(session, ``name``): all rows of each session as an array in order."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*S).orderBy(*order))).select(*S, F.struct("rank", F.struct(*values).alias("x")).alias("r"))
    return ranked.groupBy(*S).agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]).alias(name))


def in_order(folded: Sessions) -> dict[str, DataFrame]:
    """The ledgers of each session as they are listed, by ``rank``: files by adds and updates, reads, commands by runs and
    tools by calls, most first; failures, searches and delegations as they came."""
    first = F.col("first_seq").asc()
    by = {
        "files": (folded.files, [F.desc(F.col("n_add") + F.col("n_update")), first, F.col("first_sub").asc()]), "reads": (folded.reads, [F.desc("reads"), first]), "commands": (folded.commands, [F.desc("runs"), first]),
        "tools": (folded.tools, [F.desc("calls"), first]), "failures": (folded.failures, [first]), "searches": (folded.searches, [F.col("seq").asc()]), "delegations": (folded.delegations, [F.col("seq").asc()]),
    }
    return {name: df.withColumn("rank", F.row_number().over(W.partitionBy(*S).orderBy(*order))) for name, (df, order) in by.items()}


def _either(a: str, b: str) -> Column:
    """In format A ``a`` where it is known, in format B ``b``."""
    return F.when(F.col("source") == format_a.SOURCE, F.coalesce(a, b)).otherwise(F.coalesce(b, a))


def cards(sessions: DataFrame, folded: Sessions) -> DataFrame:
    """A row per session, in order of start with its code S1, S2, ...: all its requests, last reply, open plan, files,
    outstanding failures with their telltale line, tools and counts. Nothing is cut."""
    t = folded.turns
    request = F.struct(F.col("started_at").alias("ts"), F.col("n").alias("turn"), F.coalesce("ask_source", F.lit("user")).alias("source"), F.col("ask").alias("text"))
    asked, replied = F.col("ask").isNotNull(), F.col("final").isNotNull()
    g = t.groupBy(*S).agg(
        F.min_by(request, F.when(asked, F.col("n"))).alias("first_ask"), F.when(F.count_if(asked) > 1, F.max_by(request, F.when(asked, F.col("n")))).alias("last_ask"),
        F.max_by(F.struct(F.col("started_at").alias("ts"), F.col("final").alias("text")), F.when(replied, F.col("n"))).alias("last_reply"),
        F.min_by("started_at", "n").alias("_first_turn"),
    )
    open_failures = folded.failures.filter("not resolved").withColumn("last_line", X.one_line(X.telltale_line(F.col("error")), 200))
    first = F.col("first_seq").asc()
    lists = (
        _listed(folded.files, [F.desc(F.col("n_add") + F.col("n_update")), first, F.col("first_sub").asc()], "files_changed", "path", "n_add", "n_update", "n_delete"),
        _listed(open_failures, [first], "outstanding", F.col("shown").alias("cmd"), F.col("exit_text").alias("exit"), "occurrences", "last_line"),
        _listed(folded.tools, [F.desc("calls"), first], "tools", "tool", "calls"),
        _listed(t.filter(asked), [F.col("n").asc()], "asks", F.col("started_at").alias("ts"), F.col("n").alias("turn"), F.coalesce("ask_source", F.lit("user")).alias("source"), F.col("ask").alias("text")),
    )
    plan = F.from_json("_plan", format_a.STEPS)
    st = folded.state.select(*S, F.col("cwd").alias("_cwd"), F.col("model").alias("_model"), F.col("plan").alias("_fact_plan"))
    c = session.titled(sessions, t).join(g, S, "left").join(st, S, "left").join(folded.stats, S, "left")
    for more in lists:
        c = c.join(more, S, "left")
    c = c.withColumn("_plan", F.coalesce("plan", "_fact_plan") if "plan" in sessions.columns else F.col("_fact_plan"))
    order = F.coalesce(F.try_to_timestamp("started_at"), F.col("updated_at").cast("timestamp"))
    c = c.join(numbered(sessions.select(*S, order.alias("_order")), S, [F.col("_order").asc_nulls_last(), F.col("source").asc(), F.col("session_id").asc()]), S)
    none = lambda name: F.coalesce(name, F.array().cast(dict(c.dtypes)[name])).alias(name)
    resume = F.col("resume") if "resume" in sessions.columns else F.lit(None).cast("string").alias("resume")
    return c.select(
        F.concat(F.lit("S"), F.col("number").cast("string")).alias("code"), "number", *S, "title", "title_source", "link", resume, _either("_cwd", "cwd").alias("cwd"), _either("model", "_model").alias("model"),
        F.coalesce("started_at", "_first_turn").alias("started_at"), "updated_at", "bytes", "first_ask", "last_ask", "last_reply", F.coalesce(F.filter(plan, lambda p: p["status"] != "completed"), F.array().cast(format_a.STEPS)).alias("open_plan"), F.coalesce(F.size(plan), F.lit(0)).alias("plan_size"),
        none("asks"), none("files_changed"), none("outstanding"), none("tools"),
        *(F.coalesce(k, F.lit(0)).alias(k) for k in ("turns", "commands", "files_touched", "files_read", "outstanding_errors", "compactions")),
    )


def folder_rollup(c: DataFrame) -> DataFrame:
    name = F.coalesce("cwd", F.lit("(unknown)"))
    g = c.groupBy(F.lower(name).alias("key")).agg(F.min_by(name, "number").alias("folder"), F.count(F.lit(1)).alias("n_sessions"), F.array_sort(F.collect_list("number")).alias("numbers"), F.sum("turns").alias("turns"))
    return g.orderBy(F.desc("n_sessions"), F.desc("turns"), F.col("numbers")[0])


def file_rollup(c: DataFrame, folded: Sessions) -> DataFrame:
    f = folded.files.join(c.select(*S, "number"), S)
    g = f.groupBy("path").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum(F.col("n_add") + F.col("n_update") + F.col("n_delete")).alias("changes"), F.min(F.struct("number", "first_seq", "first_sub")).alias("first"))
    return g.orderBy(F.desc("n_sessions"), F.desc("changes"), "first")


def failure_rollup(c: DataFrame, folded: Sessions) -> DataFrame:
    """Unresolved failures over sessions, by the normalised form of the command as shown."""
    f = folded.failures.filter("not resolved").join(c.select(*S, "number"), S)
    f = f.select("number", "first_seq", "shown", "occurrences", X.cmd_key(F.col("shown")).alias("shown_key"), X.one_line(X.telltale_line(F.col("error")), 200).alias("line"))
    at = F.struct("number", "first_seq")
    g = f.groupBy("shown_key").agg(F.min_by("shown", at).alias("cmd"), F.count(F.lit(1)).alias("n_sessions"), F.sum("occurrences").alias("occurrences"), F.max_by("line", F.when(F.col("line") != "", at)).alias("last_line"), F.min(at).alias("first"))
    return g.orderBy(F.desc("n_sessions"), F.desc("occurrences"), "first")


def tool_rollup(folded: Sessions) -> DataFrame:
    return folded.tools.groupBy("tool").agg(F.sum("calls").alias("calls")).orderBy(F.desc("calls"), "tool")


def totals(c: DataFrame, folded: Sessions) -> DataFrame:
    by = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n"))))
    sources = c.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(by.alias("by_source"))
    files = folded.files.select("path").distinct().agg(F.count(F.lit(1)).alias("files_changed"))
    t = c.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("turns").alias("turns"), F.sum("commands").alias("commands"), F.sum("outstanding_errors").alias("outstanding_failures"), F.sum("bytes").alias("bytes"),
        F.min_by("started_at", "number").alias("started_at"), F.max("updated_at").alias("updated_at"),
    )
    return t.crossJoin(sources).crossJoin(files)  # one row each


def shared_files(files: DataFrame, n: int = 25) -> DataFrame:
    """Files of more than one session, else all; the first ``n``."""
    shared = files.filter("n_sessions > 1")
    return (files if shared.isEmpty() else shared).limit(n)


def unfinished(c: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` sessions with open plan items."""
    return c.filter(F.size("open_plan") > 0).orderBy(F.desc("number")).limit(n)


def latest(c: DataFrame) -> DataFrame:
    """The session that was active last."""
    return c.orderBy(F.desc(F.col("updated_at").cast("timestamp")), "number").limit(1)


ASK_CHARS = 220


def requests(c: DataFrame, folded: Sessions, budget_tokens: int | None = None) -> DataFrame:
    """Every request of all sessions, oldest first; within a budget the newest that fit. A request costs its first
    ``ASK_CHARS`` characters and 40 more, so at least 10 tokens: only as many rows as can fit are ever sorted out."""
    asks = folded.turns.filter("ask is not null").join(c.select(*S, "number", "code"), S)
    at = F.try_to_timestamp("started_at")
    if budget_tokens is not None:
        newest_first = [at.desc_nulls_last(), F.desc("number"), F.desc("n")]
        few = asks.orderBy(*newest_first).limit(budget_tokens // 10 + 1)
        asks = prefix_fit(few, [], newest_first, X.tokens(F.least(F.length("ask"), F.lit(ASK_CHARS)) + 40), budget_tokens).drop("used")
    return asks.select("code", "number", "n", "started_at", F.coalesce("ask_source", F.lit("user")).alias("ask_source"), "ask").orderBy(at, "number", "n")


def card_costs(c: DataFrame) -> DataFrame:
    """Cards with ``cost``: characters of a card left out, abbreviated and in full."""
    chars = lambda name: F.coalesce(F.length(F.col(f"{name}.text")), F.lit(0))
    of = lambda name, most: F.least(chars(name), F.lit(most))
    many = lambda name, most, each: F.least(F.size(name), F.lit(most)) * each
    brief = 160 + of("first_ask", 300) + of("last_reply", 300)
    full = 200 + of("first_ask", 800) + of("last_ask", 800) + of("last_reply", 1200) + many("files_changed", 10, 90) + many("outstanding", 3, 220) + many("open_plan", 8, 90)
    return c.withColumn("cost", F.array(F.lit(0), brief, full).cast("array<bigint>"))


LEAST_STEP = 10  #: tokens that a card's next tier takes at least: 40 characters


def fitted_cards(c: DataFrame, budget_tokens: int | None) -> DataFrame:
    """Cards with their tier: 0 in the table only, 1 abbreviated, 2 in full. Without a budget, or where all fit, all are in
    full; else the newest is, and the others as far as the budget goes."""
    costs = card_costs(c)
    whole = None if budget_tokens is None else costs.agg(X.tokens(F.sum(F.element_at("cost", 3))).alias("n")).first()["n"] or 0
    if budget_tokens is None or whole <= budget_tokens:
        return costs.withColumn("tier", F.lit(2)).drop("cost")
    tiers = fit.fit_rows(costs.select("number", "cost"), "number", budget_tokens, guaranteed=1, n_tiers=len(fit.CARD_TIERS), least=LEAST_STEP)
    return costs.drop("cost").join(F.broadcast(tiers), "number", "left").withColumn("tier", F.coalesce("tier", F.lit(0)))  # as many as the budget pays for


# ---------------------------------------------------------------- fitting one session


def costed_turns(folded: Sessions) -> DataFrame:
    """Turns with ``cost``: their characters in each tier."""
    chars = lambda c, extra: F.aggregate(c, F.lit(0), lambda acc, x: acc + F.length(x) + extra)
    does = F.aggregate("actions", F.lit(0), lambda acc, a: acc + F.length(a["line"]) + 6 + F.coalesce(F.length(a["error"]), F.lit(0)))
    return folded.turns.withColumn("cost", fit.turn_costs(F.length("ask"), F.length("final"), chars(F.col("notes"), 4) + chars(F.col("reasoning"), 3) + does))


def fitted_turns(folded: Sessions, budget: int | None, spine_tokens: int = 0, guaranteed: int = 3) -> DataFrame:
    """Turns with the tier that the budget leaves them: 0 omit, 1 digest, 2 brief, 3 full."""
    t = costed_turns(folded)
    g = t.groupBy(*S).agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "cost")))).alias("x"))
    g = g.withColumn("f", fit.plan_budget(F.transform("x", lambda x: x["cost"]), F.lit(budget), F.lit(spine_tokens), guaranteed))
    tiers = g.select(*S, F.explode(F.arrays_zip(F.transform("x", lambda x: x["n"]).alias("n"), F.col("f.tiers").alias("tier"))).alias("z")).select(*S, "z.n", "z.tier")
    return t.drop("cost").join(tiers, [*S, "n"])


def collapsed_actions(actions: DataFrame) -> DataFrame:
    """Runs of equal actions of a turn as one: the first's fields, their number, the last error."""
    same = actions.withColumn("same", F.concat_ws("|", "kind", "line"))
    at = F.struct("seq", "sub")
    g = runs(same, [*S, "turn"], ["seq", "sub"], "same").groupBy(*S, "turn", "run", "kind", "line")
    first = [F.min_by(c, at).alias(c) for c in ("ts", "exit_text", "ms", "failed")]
    return g.agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("count"), *first, F.max_by("error", F.when(F.col("error").isNotNull(), at)).alias("error"))


# ---------------------------------------------------------------- retrieval


def searchable(records: DataFrame) -> DataFrame:
    """What search and replay read, of :func:`read_records`; written once to the shared folder."""
    parts = [form.searchable(records.filter(F.col("source") == name)) for name, form in FORMATS.items()]
    return written(parts[0].unionByName(parts[1]), "searchable")


def search(texts: DataFrame, query: str, *, regex: bool = False, kind: str | None = None, limit: int = 15, radius: int = 400) -> DataFrame:
    """Of :func:`searchable` the last ``limit`` records of each session that hold ``query`` in any case: ts, turn, label, excerpt, total."""
    found = texts.filter("text <> ''")
    if regex:
        hit = F.regexp_extract("text", f"(?i){query}", 0)
        found = found.filter(F.rlike("text", F.lit(f"(?i){query}"))).withColumn("excerpt", X.excerpt(F.col("text"), hit, radius))
    else:
        found = found.filter(F.contains(F.lower("text"), F.lit(query.lower()))).withColumn("excerpt", X.excerpt(F.col("text"), F.lit(query), radius))
    if kind:
        found = found.filter(F.contains(F.lower("label"), F.lit(kind.lower())))
    total = found.groupBy(*S).agg(F.count(F.lit(1)).alias("total"))
    last = found.withColumn("_k", F.row_number().over(W.partitionBy(*S).orderBy(F.desc("seq"))))
    last = last.filter(F.col("_k") <= limit) if limit else last
    return last.join(total, S).select(*S, "seq", "ts", "turn", "label", "excerpt", "total").orderBy(*S, "seq")


def replay(texts: DataFrame, turns: DataFrame, n: int, *, max_chars: int = 4000) -> DataFrame:
    """Turn ``n`` of each session as it was logged, output included; turns without an id can be replayed too."""
    chosen = turns.filter(F.col("n") == n).select(*S, "turn")
    cut = lambda c: F.substring(c, 1, max_chars).alias(c)
    return texts.filter("replayed").join(chosen, [*S, "turn"]).select(*S, "seq", "ts", "label", "text", cut("output"), cut("stderr"), "exit_text").orderBy(*S, "seq")
