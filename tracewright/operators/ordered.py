"""Operators over ordered rows: runs, pairs, as-of values, first-wins, prefix fits. All windows are partitioned by the
caller's keys, so no step needs all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.scratch import checkpointed


def first_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of rows that share ``keys`` the first; rows with a null in a key all stay."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    ranked = df.filter(whole).withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")
    return ranked.union(df.filter(~whole))


def carry_forward(value: Column, keys: list[str], *order: str) -> Column:
    """The last non-null ``value`` so far."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


SEGMENT_BITS = 24  #: of a record's place: 16 MiB of a log are one segment


def carried(df: DataFrame, values: dict[str, Column], keys: list[str], seq: str, *, bits: int = SEGMENT_BITS) -> DataFrame:
    """``df`` with the last non-null of each of ``values`` so far, as :func:`carry_forward` says it, in two levels: rows are
    dealt by ``keys`` and segment (``seq`` without its low ``bits``), and what a segment starts with comes as one more row
    before its first. One key of any number of rows is spread over all tasks, and no row is dealt twice. ``df`` is read twice:
    write it first if it takes long to make."""
    w = W.partitionBy(*keys, "_segment").orderBy(F.col(seq).asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    cut = df.withColumns({"_segment": F.shiftright(seq, bits), **{f"_{k}": v for k, v in values.items()}})
    ends = cut.groupBy(*keys, "_segment").agg(*(F.max_by(f"_{k}", F.when(F.col(f"_{k}").isNotNull(), F.col(seq))).alias(f"_{k}") for k in values))
    before = W.partitionBy(*keys).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)  # a row a segment
    starts = ends.select(*keys, "_segment", *(F.last(f"_{k}", ignorenulls=True).over(before).alias(f"_{k}") for k in values)).na.drop("all", subset=[f"_{k}" for k in values])
    both = cut.unionByName(starts.withColumn("_start", F.lit(True)), allowMissingColumns=True)
    inside = both.withColumns({k: F.last(f"_{k}", ignorenulls=True).over(w) for k in values})
    return inside.filter("_start is null").drop("_segment", "_start", *(f"_{k}" for k in values))


def is_twin(form: Column, one: str, other: str, keys: list[str], *order: str) -> Column:
    """Whether the row is the second copy of a message that is logged in two forms: its form has been seen no more often
    than the other."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    a, b = F.count_if(form == one).over(w), F.count_if(form == other).over(w)
    return F.when(form == one, a <= b).when(form == other, b <= a).otherwise(False)


def asof_latest(left: DataFrame, right: DataFrame, keys: list[str], seq: str, payload: list[str], own: Column | None = None) -> DataFrame:
    """Each left row with ``payload`` of the latest right row of the same ``keys`` at or before its ``seq`` (nulls if none).
    Where ``own``, a struct of the payload, is not null, a left row counts as a right one too, the last of its ``seq``.

    One union and one window: no row multiplies, however many rows a key has on either side.
    """
    held = F.struct(*(F.col(c) for c in payload))
    kind = right.select(held.alias("h")).schema["h"].dataType
    mine = F.lit(None) if own is None else own
    both = left.select(*keys, seq, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), mine.cast(kind).alias("_h"))
    both = both.unionByName(right.select(*keys, seq, F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_l"].dataType).alias("_l"), held.alias("_h")))
    last = F.last("_h", ignorenulls=True).over(W.partitionBy(*keys).orderBy(seq, "_side").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("_f", last).filter("_side = 1").select("_l.*", *(F.col(f"_f.{c}").alias(c) for c in payload))


def runs(df: DataFrame, keys: list[str], order: list[str], same: str) -> DataFrame:
    """``df`` with ``run``: the number, within ``keys``, of the run of consecutive equal values of ``same``."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((~F.col(same).eqNullSafe(F.lag(same).over(w))).cast("int"), F.lit(1))
    marked = df.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(new))
    return marked.withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def prefix_fit(df: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: Column | int) -> DataFrame:
    """The rows, in ``order``, before the first that would exceed ``budget``; ``used`` is the running cost."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(cost).over(w)).filter(F.col("used") <= budget)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """(keys, ``name``): the place of every row in the global order, from 1. ``keys`` name a row.

    Rows are sorted by ranges over all tasks; a row's number is its place in its task plus the counts of the tasks before,
    of which there are few. Only keys and order take part.
    """
    at = checkpointed(df.select(*keys, *(c for c in order)).orderBy(*order).select(*keys)).withColumn("_id", F.monotonically_increasing_id())
    task = F.shiftright("_id", 33)
    counts = at.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_task", F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a task
    placed = at.withColumn("_task", task).join(F.broadcast(before), "_task")
    return placed.select(*keys, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key with their ``rank`` from 1."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def stride_sample(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Every floor(n / k)-th row of each key, k of them: the same rows each time."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    numbered = df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).withColumn("_s", F.greatest(F.lit(1), F.floor(n / k)))
    return numbered.filter((F.col("_i") % F.col("_s") == 0) & (F.col("_i") / F.col("_s") < k)).drop("_i", "_s")


def roots(nodes: DataFrame, keys: list[str], node: str, parent: str, value: str, *, max_depth: int = 1 << 20) -> DataFrame:
    """``nodes`` with ``value`` taken from the root of each node's chain of parents, else the first value below it.

    Pointer doubling: the number of joins is the logarithm of the deepest chain.
    """
    at = nodes.select(*keys, node, F.col(parent).alias("_up"), F.col(value).alias("_v"))
    depth = 1
    while depth <= max_depth:
        up = at.select(*keys, F.col(node).alias("_up"), F.col("_up").alias("_up2"), F.col("_v").alias("_v2"))
        at = checkpointed(at.join(up, [*keys, "_up"], "left").select(*keys, node, F.col("_up2").alias("_up"), F.coalesce("_v2", "_v").alias("_v")))
        if at.filter("_up is not null").isEmpty():
            break
        depth *= 2
    return nodes.drop(value).join(at.select(*keys, node, F.col("_v").alias(value)), [*keys, node])
