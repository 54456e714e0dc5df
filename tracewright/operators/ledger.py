"""Ledgers: commands, failures, files, reads and tools, by any grouping keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commands(df: DataFrame, keys: list[str], cmd: str = "cmd", ok: str = "ok", seq: str = "seq") -> DataFrame:
    """Runs and failures of each command as written, and when it was first seen."""
    return df.groupBy(*keys, cmd).agg(F.count(F.lit(1)).alias("runs"), F.count_if(~F.col(ok)).alias("failures"), F.min(seq).alias("first_seq"))


def failures(df: DataFrame, keys: list[str], key: str = "key", ok: str = "ok", seq: str = "seq", carry: tuple[str, ...] = (), *, strict_later: bool = False) -> DataFrame:
    """Failed commands by normalised ``key``: occurrences, the last one's ``carry`` values and resolved.

    A failure is resolved if the same key succeeded at any time; with ``strict_later`` only after its last failure. One
    group-by: map-side combined, so a hot key costs one row a task.
    """
    bad, good = ~F.col(ok), F.col(ok)
    found = df.groupBy(*keys, key).agg(
        F.count_if(bad).alias("occurrences"), F.min(F.when(bad, F.col(seq))).alias("first_seq"), F.max(F.when(bad, F.col(seq))).alias("last_seq"),
        F.max(F.when(good, F.col(seq))).alias("_good"), *(F.max_by(c, F.when(bad, F.col(seq))).alias(c) for c in carry),
    )
    done = F.coalesce(F.col("_good") > F.col("last_seq"), F.lit(False)) if strict_later else F.col("_good").isNotNull()
    return found.filter("occurrences > 0").withColumn("resolved", done).drop("_good")


def outstanding(df: DataFrame, keys: list[str], **options) -> DataFrame:
    return failures(df, keys, **options).filter(~F.col("resolved"))


def files(df: DataFrame, keys: list[str], path: str = "path", verb: str = "verb", lines: str = "lines", seq: str = "seq", ts: str = "ts") -> DataFrame:
    """Adds, updates and deletes of each path, its lines, and its first and last time; with a column ``sub``, the place
    within a record, also that of its first row."""
    count = lambda v, name: F.count_if(F.col(verb) == v).alias(name)
    return df.groupBy(*keys, path).agg(
        count("add", "n_add"), count("update", "n_update"), count("delete", "n_delete"), F.sum(lines).alias("lines"),
        F.min_by(ts, seq).alias("first_ts"), F.max_by(ts, seq).alias("last_ts"), F.min(seq).alias("first_seq"),
        *([F.min(F.struct(seq, "sub"))["sub"].alias("first_sub")] if "sub" in df.columns else []),
    )


def counted(df: DataFrame, keys: list[str], what: str, name: str = "calls", seq: str = "seq") -> DataFrame:
    return df.groupBy(*keys, what).agg(F.count(F.lit(1)).alias(name), F.min(seq).alias("first_seq"))
