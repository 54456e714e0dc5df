"""Files through their moves: every name of a file, at any time, as the one file that it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.ordered import asof_latest, roots


def _life(path: str, since: str) -> Column:
    """The name of a life of a path: which file stood there from ``since`` (null: from the beginning) on."""
    return F.concat(F.col(path), F.lit("@"), F.coalesce(F.col(since).cast("string"), F.lit("0")))


def _lives(moves: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, path, since, up): a move ends the life of both its paths. The new life of the path it goes to continues that of
    the path it leaves (``up``); the path it leaves is free, so what comes there later is another file."""
    real = moves.filter("from_path <> to_path").select(*keys, at, "from_path", "to_path")
    starts = real.select(*keys, F.col("to_path").alias("path"), F.col(at).alias("since")).union(real.select(*keys, "from_path", at))
    before = asof_latest(real.select(*keys, F.col("from_path").alias("path"), (2 * F.col(at) - 1).alias("t"), at, "to_path"), starts.select(*keys, "path", (2 * F.col("since")).alias("t"), F.col("since").alias("_since")), [*keys, "path"], "t", ["_since"])
    arrived = before.select(*keys, F.col("to_path").alias("path"), F.col(at).alias("since"), _life("path", "_since").alias("up"))
    left = real.select(*keys, F.col("from_path").alias("path"), F.col(at).alias("since"), F.lit(None).cast("string").alias("up"))
    first = left.select(*keys, "path").distinct().select(*keys, "path", F.lit(None).cast("long").alias("since"), F.lit(None).cast("string").alias("up"))
    return arrived.union(left).union(first)


def identified(refs: DataFrame, moves: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """``refs`` (keys, path, ``at``, ...) with ``file``: the name, path@time of its first life, of the file that the path was
    just after ``at``, through the ``moves`` (keys, ``at``, from_path, to_path) up to then.

    Chains and swaps of moves resolve by pointer doubling over lives, one join for each doubling, so no task walks a
    session's moves in turn. ``at`` is a whole number of at least 1; two moves of one session have different ones. A move of a
    path to itself changes nothing; a path that was never moved is path@0.
    """
    lives = _lives(moves, keys, at).withColumn("node", _life("path", "since"))
    named = roots(lives.withColumn("file", F.col("node")), keys, "node", "up", "file").select(*keys, "path", F.coalesce("since", F.lit(0)).alias("t"), "file")
    found = asof_latest(refs.withColumn("t", F.col(at)), named, [*keys, "path"], "t", ["file"])
    return found.drop("t").withColumn("file", F.coalesce("file", F.concat("path", F.lit("@0"))))


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, side): paths of one table (keys, path) that the other lacks; ``side`` is 'left' or 'right'."""
    a, b = left.select(*keys, "path").distinct().withColumn("_a", F.lit(1)), right.select(*keys, "path").distinct().withColumn("_b", F.lit(1))
    both = a.join(b, [*keys, "path"], "full_outer").filter("_a is null or _b is null")
    return both.select(*keys, "path", F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))
