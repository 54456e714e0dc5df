"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import drop_written, tidy, written


def _state(edges: DataFrame):
    digest = F.bit_xor(F.xxhash64("a", "b"))
    return edges.agg(F.count(F.lit(1)).alias("n"), digest.alias("h")).first()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; the component is the smallest id that can be reached.

    Every step is two group-bys and two joins over the links, written to the shared folder; the number of steps grows
    with the logarithm of the longest chain. Self-links name a component of one. No links: no rows.
    """
    pairs = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).dropna()
    alone = pairs.filter("x = y").select(F.col("x").alias("id")).distinct()
    edges = written(pairs.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
    before = _state(edges)
    while before["n"]:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(root).distinct()
        new = written(small, "links")
        drop_written(edges)
        edges, after = new, _state(new)
        tidy(links.sparkSession)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    linked = stars.union(roots)
    return linked.union(alone.join(linked, "id", "left_anti").select("id", F.col("id").alias("component")))
