"""Chat formatting: logged conversations that are a prefix of a longer one collapse into it; the rest are rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.common import named, written
from tracewright.shipping import ship

_HASH = ("h0", "h1", "h2", "h3")
_MARK, _ESCAPED = r"<(\\*)\|", r"<\\$1|"


def _element(position: Column) -> list[Column]:
    """128 bits of a turn at its position, as four numbers of 32 bits whose sums cannot overflow."""
    found = []
    for salt in (1, 2):
        h = F.xxhash64(F.lit(salt), position, F.coalesce("role", F.lit("\x02")), F.coalesce("text", F.lit("\x02")))
        found += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return [c.alias(x) for c, x in zip(found, _HASH)]


def turns_of(conversations: DataFrame, *, block_turns: int = 512) -> DataFrame:
    """Distinct turns with their block: conv_id, block, turn, role, text. Blocks of turn numbers keep a very long
    conversation in many tasks."""
    ship(conversations.sparkSession)
    c = conversations.select(named("conv_id").cast("long").alias("conv_id"), named("turn").cast("long").alias("turn"), named("role").cast("string").alias("role"), named("text").cast("string").alias("text"))
    return c.distinct().withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))).cast("long"))


def _same(a: str, b: str, *keys: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, total, h0..h3): the rolling hash of the first n turns of each conversation, and how many it has.

    A prefix's hash is the sum of its turns' hashes, each taken with its position, so it is summed within blocks and
    then over blocks, and no conversation needs to be in one task.
    """
    key = ["conv_id", "block"]
    order = W.partitionBy(*key).orderBy("turn", "role", "text")
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv_id")
    counts = turns.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    counts = counts.select(*key, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.sum("size").over(whole).alias("total"))
    ranked = turns.withColumn("rank", F.row_number().over(order))
    placed = ranked.alias("t").join(counts.alias("c"), _same("t", "c", *key)).select("t.*", F.col("c.total"), (F.col("c.before") + F.col("t.rank")).alias("n"))
    hashed = placed.select(*key, "turn", "role", "text", "n", "total", *_element(F.col("n")))
    rolling = W.partitionBy(*key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    inner = hashed.select(*key, "n", "total", *(F.sum(h).over(rolling).alias(h) for h in _HASH))
    sums = hashed.groupBy(*key).agg(*(F.sum(h).alias(h) for h in _HASH))
    base = sums.select(*key, *(F.coalesce(F.sum(h).over(earlier), F.lit(0)).alias(h) for h in _HASH))
    return inner.alias("t").join(base.alias("c"), _same("t", "c", *key)).select("t.conv_id", "t.n", "t.total", *((F.col(f"t.{h}") + F.col(f"c.{h}")).alias(h) for h in _HASH))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): the conversations that no longer one begins with; of equal ones the least id, with
    their number."""
    whole = prefixes.filter("n = total").groupBy("n", *_HASH).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inside = prefixes.filter("n < total").select("n", *_HASH).distinct()
    return whole.join(inside, ["n", *_HASH], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame, *, block_turns: int = 512) -> DataFrame:
    """Collapse cumulative snapshots of conversations (conv_id, turn, role, text) and render those that remain.

    Turns are ordered by (turn, role, text); a row repeated in all four counts once. A conversation whose turns are
    the first turns of a longer one is dropped; equal ones keep the least conv_id. Turn numbers need not start at the
    same number. Rows with a null conv_id form one conversation; null roles and texts render as empty and differ from
    empty ones in comparison; an empty table gives no rows.

    Returns conv_id, n_turns, n_copies, part, rendered: a rendered turn is ``<|role|>``, a new line, the text,
    ``<|end|>``, a new line; each part holds the turns of one block of ``block_turns`` turn numbers, in order. Within roles
    and texts ``<|`` gets a backslash between its signs, and one more if it has some, so no text forges a turn and every
    text can be read back. Turns with a null number, and with one number, are in one block.
    """
    turns = written(turns_of(conversations, block_turns=block_turns), "turns")
    kept = maximal_conversations(written(prefix_hashes(turns), "prefixes"))
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), _MARK, _ESCAPED)
    one = F.concat(F.lit("<|"), safe("t.role"), F.lit("|>\n"), safe("t.text"), F.lit("<|end|>\n"))
    both = turns.alias("t").join(kept.alias("k"), _same("t", "k", "conv_id")).select("t.*", "k.n_turns", "k.n_copies", one.alias("one"))
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 62))), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), "one")))
    parts = both.groupBy("conv_id", "n_turns", "n_copies", "block").agg(F.array_join(F.transform(listed, lambda x: x["one"]), "").alias("rendered"))
    order = W.partitionBy("conv_id").orderBy("block")
    return parts.select("conv_id", "n_turns", "n_copies", (F.row_number().over(order) - 1).cast("long").alias("part"), "rendered")
