"""The commands: list, find, here, show, view, project, corpus, search, turn. ``python -m tracewright.cli --help``"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tracewright.plans import reports, views
from tracewright.scratch import written


def budget(value: str) -> int | None:
    """A number of tokens; ``none`` and ``full`` set no limit."""
    return None if value in ("none", "full") else int(value) or None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewright", description="Sessions of coding agents from their logs.")
    p.add_argument("--codex", help="folder of rollout files"), p.add_argument("--copilot", help="folder of session folders"), p.add_argument("--titles", help="index of thread names")
    p.add_argument("--index", help="folder of the index of headers"), p.add_argument("--refresh", action="store_true", help="read every header again")
    p.add_argument("--source", default="all"), p.add_argument("--out", default="views"), p.add_argument("--stdout", action="store_true"), p.add_argument("--limit", type=int), p.add_argument("--budget", type=budget, default=40_000)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    sub.add_parser("find").add_argument("words", nargs="+")
    here = sub.add_parser("here")
    here.add_argument("folder", nargs="?", default=os.getcwd()), here.add_argument("--nested", action="store_true")
    for name in ("show", "view", "search", "turn"):
        one = sub.add_parser(name)
        one.add_argument("session", nargs="?" if name == "view" else None)
        if name == "view":
            one.add_argument("--find"), one.add_argument("--here", nargs="?", const=os.getcwd()), one.add_argument("--recent", type=int, nargs="?", const=15)
        if name == "search":
            one.add_argument("query", nargs="+"), one.add_argument("--regex", action="store_true"), one.add_argument("--kind"), one.add_argument("--context", type=int, default=400)
        elif name == "turn":
            one.add_argument("n", type=int), one.add_argument("--output", type=int, default=4000)
    for name in ("project", "corpus"):
        many = sub.add_parser(name)
        if name == "project":
            many.add_argument("folder", nargs="?", default=os.getcwd()), many.add_argument("--exact", action="store_true")
        many.add_argument("--since"), many.add_argument("--until"), many.add_argument("--last", type=int), many.add_argument("--exclude", action="append", default=[]), many.add_argument("--packets", action="store_true"), many.add_argument("--packet-budget", type=budget, default=12_000)
    return p


def _one(sessions: DataFrame, a: argparse.Namespace) -> DataFrame:
    """The session that a command names; a listing of the candidates if it fits several."""
    raw, wanted = a.session, vars(a)
    hit = reports.resolve(sessions, raw) if raw else None
    if hit is not None:
        return hit
    if wanted.get("find") or raw:
        found = reports.find(sessions, wanted.get("find") or raw).drop("score")
    elif wanted.get("here"):
        found = reports.in_folder(sessions, a.here)
    elif wanted.get("recent"):
        found = reports.newest(sessions, a.recent)
    else:
        raise SystemExit("name a session, or choose one by --find, --here or --recent")
    n = found.count()
    if n == 0:
        raise SystemExit(f"Could not identify a session from {raw or ''!r}. Try list, find or here.")
    if n > 1:
        raise SystemExit("\n".join(["Several sessions fit; name one by its id:", *views.table_lines(found, 20)]))
    return found


def _window(sessions: DataFrame, a: argparse.Namespace) -> tuple[DataFrame, tuple[datetime | None, datetime | None]]:
    since, until = (reports.parse_when(a.since) if a.since else None), (reports.parse_when(a.until, end_of_day=True) if a.until else None)
    return reports.in_window(reports.excluding(sessions, a.exclude), since=since, until=until, last=a.last), (since, until)


def run(spark: SparkSession, argv: list[str]) -> str:
    """Run a command; what it prints."""
    a = parser().parse_args(argv)
    if a.command == "corpus" and not a.since and not a.last:  # before anything is read
        raise SystemExit("corpus needs --since or --last: it spans every folder, so an unbounded run would read all history")
    roots = {k: v for k, v in (("codex", a.codex), ("copilot", a.copilot)) if v}
    sessions = reports.list_sessions(spark, roots, source=a.source, titles=a.titles, index=a.index, refresh=a.refresh)
    if a.command in ("list", "find", "here"):
        found = reports.find(sessions, " ".join(a.words)) if a.command == "find" else reports.in_folder(sessions, a.folder, nested=a.nested) if a.command == "here" else sessions
        return "\n".join([f"  {found.count()} session(s)", *views.table_lines(found, a.limit or (50 if a.command == "here" else 20))])
    if a.command in ("project", "corpus"):
        chosen, window = _window(reports.in_folder(sessions, a.folder, nested=not a.exact) if a.command == "project" else sessions, a)
        if chosen.isEmpty():
            return "  No sessions found."
        folder = os.path.abspath(a.folder) if a.command == "project" else None
        chosen = written(chosen, "chosen")
        folded = reports.settled(reports.condense(spark, chosen))
        c = written(reports.cards(chosen, folded), "cards")
        base = f"{a.command}-view-{datetime.now(timezone.utc):%Y-%m-%d-%H-%M}"
        if a.packets and not a.stdout:
            c = c.join(views.write_views(views.session_views(chosen, folded, a.packet_budget), os.path.join(a.out, f"{base}-sessions")), reports.S, "left")
        lines = views.report_lines(c, folded, folder=folder, window=None if folder else window, excluded=tuple(a.exclude), budget_tokens=a.budget)
        if a.stdout:
            return "\n".join(r["line"] for r in lines.toLocalIterator())
        return "\n".join(views.write_report(lines, views.report_json(c, folded, folder=folder, window=None if folder else window), a.out, base))
    one = _one(sessions, a)
    if a.command == "show":
        return views.shown(one)
    if a.command == "view":
        made = views.session_views(one, reports.condense(spark, one), a.budget)
        return made.first()["markdown"] if a.stdout else "\n".join(r["packet"] for r in views.write_views(made, a.out).collect())
    texts = reports.searchable(reports.read_records(spark, one))
    if a.command == "search":
        hits = reports.search(texts, " ".join(a.query), regex=a.regex, kind=a.kind, limit=15 if a.limit is None else a.limit, radius=a.context).collect()
        return "\n".join([f"  {hits[0]['total'] if hits else 0} match(es)", *(f"  ── {h['ts']}  {h['label']}\n     " + h["excerpt"].replace("\n", "\n     ") for h in hits)])
    turns = reports.condense(spark, one).turns
    if turns.filter(f"n = {a.n}").isEmpty():
        raise SystemExit(f"turn {a.n} not found (session has {turns.count()} turns)")
    played = reports.replay(texts, turns, a.n, max_chars=a.output).collect()
    return "\n".join(f"  ── {r['ts']}  {r['label']}\n     " + "\n".join(x for x in (r["text"], r["stderr"]) if x).replace("\n", "\n     ") for r in played)


if __name__ == "__main__":
    print(run(SparkSession.builder.appName("tracewright").getOrCreate(), sys.argv[1:]))
