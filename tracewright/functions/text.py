"""Text functions as Column expressions. Lengths are code points; white space is Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
# Words that name a problem, and the marker of a shell's exit status at the end of its output.
PROBLEM = r"(?i)error|fail|exception|cannot|can't|not found|not recognized|denied|fatal|refused|invalid|missing|timed? ?out"
EXIT_MARKER = r"<(?:shellId: [^<>]*? completed with|exited with) exit code (-?\d+)>\s*$"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def rtrim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return trim_all(F.regexp_replace(_text(c), r"(?U)\s+", " "))


def clip(c: Column, n: int) -> Column:
    t = rtrim_all(_text(c))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit(" …[+"), (F.length(t) - n).cast("string"), F.lit(" chars]")))


def clip_tail(c: Column, n: int) -> Column:
    t = rtrim_all(_text(c))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.lit("…["), (F.length(t) - n).cast("string"), F.lit(" earlier chars omitted]\n"), F.right(t, F.lit(n))))


def one_line(c: Column, n: int = 200) -> Column:
    return clip(collapse(c), n)


def short_line(c: Column, n: int) -> Column:
    t = collapse(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit("…")))


def clip_doc(c: Column, n: int) -> Column:
    t = trim_all(_text(c))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit("\n\n…[+"), (F.length(t) - n).cast("string"), F.lit(" chars omitted]")))


def cmd_key(c: Column) -> Column:
    """The form in which two runs count as the same command."""
    return F.lower(collapse(c))


def count_lines(c: Column) -> Column:
    return F.when(_text(c) == "", 0).otherwise(F.size(F.split(c, "\n", -1)))


def diff_lines(c: Column) -> Column:
    """Added and removed lines of a unified diff, its headers and bare signs left out."""
    return F.regexp_count(_text(c), F.lit("(?md)^[+-][^+\n-]"))


def human_size(c: Column, space: str = "") -> Column:
    fixed = lambda by, places: F.replace(F.format_number(c / by, places), F.lit(","), F.lit(""))
    return F.when(c > 1e9, F.concat(fixed(1e9, 2), F.lit(f"{space}GB"))).when(c > 1e6, F.concat(fixed(1e6, 1), F.lit(f"{space}MB"))).otherwise(
        F.concat(F.floor(c / 1024 + 0.5).cast("string"), F.lit(f"{space}KB"))
    )


def duration(ms: Column) -> Column:
    """``12s``, ``3m04s``, ``2h05m``; empty for none."""
    s = F.floor(ms / 1000 + 0.5)
    m = F.floor(s / 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(F.coalesce(ms, F.lit(0)) <= 0, F.lit(""))
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(m < 60, F.concat(m.cast("string"), F.lit("m"), two(s % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h"), two(m % 60), F.lit("m")))
    )


def minutes_seconds(ms: Column) -> Column:
    s = F.floor(ms / 1000 + 0.5)
    return F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit("")).when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(
        F.concat(F.floor(s / 60).cast("string"), F.lit("m"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s"))
    )


def ago(ts: Column, now: Column) -> Column:
    m = F.floor((F.unix_seconds(now) - F.unix_seconds(ts)) / 60 + 0.5)
    h = F.floor(m / 60 + 0.5)
    return F.when(m < 60, F.concat(m.cast("string"), F.lit("m ago"))).when(h < 48, F.concat(h.cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(h / 24 + 0.5).cast("string"), F.lit("d ago")))


def minute(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("—"))


def day(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("—"))


def uuid_in(c: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(_text(c), UUID, 0), F.lit("")))


def slug(c: Column, n: int = 50) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.substring(dashed, 1, n)
    return F.when(cut == "", F.lit("session")).otherwise(cut)


LABELS = {"codex": "Codex", "copilot": "Copilot"}  # fixed: how the formats' tools are called


def source_label(c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[c], c, F.lit("Agent"))


def window_label(since: Column, until: Column) -> Column:
    """``since`` → ``until`` of a time window; an open end is the start, or now."""
    return F.concat(F.when(since.isNull(), "start").otherwise(minute(since)), F.lit(" → "), F.when(until.isNull(), "now").otherwise(minute(until)))


def blockquote(c: Column) -> Column:
    return F.array_join(F.transform(F.split(trim_all(_text(c)), "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")


def cell(c: Column) -> Column:
    return collapse(F.replace(_text(c), F.lit("|"), F.lit("\\|")))


def first_line(c: Column, n: int = 160) -> Column:
    lines = F.filter(F.transform(F.split(_text(c), "\n"), lambda x: trim_all(F.replace(x, F.lit("**"), F.lit("")))), lambda x: x != "")
    return F.when(F.size(lines) > 0, one_line(F.get(lines, F.lit(0)), n))


def telltale_line(c: Column) -> Column:
    """The last line that names a problem, else the last line with words."""
    lines = F.filter(F.transform(F.split(_text(c), "\n"), trim_all), lambda x: x.rlike("[A-Za-z]{3}") & ~x.rlike("^[+~|]"))
    return F.coalesce(F.try_element_at(F.filter(lines, lambda x: x.rlike(PROBLEM)), F.lit(-1)), F.try_element_at(lines, F.lit(-1)), F.lit(""))


def relative_to(path: Column, folder: str) -> Column:
    base = folder.rstrip("/\\")
    inside = F.startswith(F.lower(path), F.lit(base.lower() + "/"))
    return F.when(inside, F.substring(path, len(base) + 2, 1 << 30)).otherwise(path)


def excerpt(text: Column, needle: Column, radius: int) -> Column:
    """``radius`` characters around the first hit in any case; without a hit the beginning."""
    at, size, n = F.instr(F.lower(text), F.lower(needle)), F.length(text), F.length(needle)
    start, end = F.greatest(at - 1 - radius, F.lit(0)), F.least(size, at - 1 + n + radius)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < size, "…").otherwise(""))
    return F.when(at == 0, F.substring(text, 1, 2 * radius)).otherwise(cut)


def exit_code(content: Column) -> Column:
    return F.nullif(F.regexp_extract(_text(content), EXIT_MARKER, 1), F.lit("")).cast("long")


def tokens(chars: Column) -> Column:
    """Estimated tokens: a quarter of the characters, halves upwards."""
    return F.floor(chars / 4 + 0.5)


def title_of(ask: Column, n: int = 70) -> Column:
    """The first line of over 12 characters that opens no markup, else all; cut, and without its last word."""
    good = F.filter(F.split(ask, "\n"), lambda x: (F.length(trim_all(x)) > 12) & ~trim_all(x).rlike("^[#<>|`*-]"))
    line = F.coalesce(F.get(good, F.lit(0)), ask)
    return F.regexp_replace(F.substring(collapse(line), 1, n), r"\s+\S*$", "")
