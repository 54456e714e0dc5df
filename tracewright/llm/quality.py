"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import doc_text

_BLANK = "[ \\t-\\r]+"
_BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "with", "der", "die", "und", "das", "in", "zu", "den", "von", "le", "la", "les", "de", "et", "des", "un", "une", "el", "los", "las", "que", "y", "en", "se")


@dataclass(frozen=True)
class Rule:
    """A document passes while ``low`` <= metric <= ``high``; a null bound is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Metrics are the names that :func:`measures` makes.
RULES = (
    Rule("mean word length", "mean_word_chars", 1.5, 16.0),
    Rule("symbols a word", "symbol_ratio", None, 0.1),
    Rule("stop words a word", "stop_ratio", 0.02, None),
    Rule("words equal to the one before", "run_ratio", None, 0.3),
    Rule("repeated lines a line", "dup_line_ratio", None, 0.5),
)


def measures(docs: DataFrame, *, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words and the ratios."""
    texts = doc_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    trimmed = F.btrim("text", F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    # each step refers to what the step before made several times, so that it is computed once a row
    one = texts.select("doc_id", "text", words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    two = one.select(
        "doc_id", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))).cast("long").alias("n_same_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*stop_words))).cast("long").alias("n_stop_words"), windows.alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    sorted_ = F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    three = two.withColumn("sorted", sorted_).drop("windows")
    twice = F.filter(F.transform("sorted", lambda x, j: F.when((F.get("sorted", j - 1)["h"] == x["h"]) | (F.get("sorted", j + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())
    covered = F.aggregate(
        F.array_sort(twice), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(p, acc["to"])).alias("n"), (p + WINDOW).alias("to")), lambda acc: acc["n"],
    )
    four = three.withColumn("n_repeat_words", F.when(F.size("sorted") > 0, covered).otherwise(0).cast("long")).drop("sorted")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return four.select(
        "*", ratio("word_chars", "n_words").alias("mean_word_chars"), ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_ratio"), ratio("n_same_words", "n_words").alias("run_ratio"), ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules' verdict as one expression: true while every metric is within its bounds."""
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (F.col(r.metric) >= r.low)
        if r.high is not None:
            verdict = verdict & (F.col(r.metric) <= r.high)
    return verdict


def quality(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Judge each whole text (doc_id, text) by the base rules and by the threshold table.

    Words are runs of characters other than blank and \\x09-\\x0D. Returns the measures, base_failed (fewer than
    ``min_words`` words, or more than ``max_repeat_percent`` % of them in windows of 8 words that come twice or more)
    and kept (base rules and every rule of the table passed). Null and empty texts have no words and fail. Repeated
    rows are judged one by one; an empty table gives no rows.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = measures(docs).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & compiled(rules))
