"""How filters interact: failure masks of five filters, duplicates by partition refinement, and every order of the filters."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import drop_written, named, written
from tracewright.shipping import ship

FILTERS = "ABCDE"
_BLANKS = " \t\n\x0b\x0c\r"
#: Where the blocks of a text end, in code points; the last block is the rest.
BLOCK_ENDS = (256, 1_280, 5_376)


def _blocks(text: Column) -> list[Column]:
    starts = (0, *BLOCK_ENDS)
    parts = [F.substring(text, a + 1, b - a) for a, b in zip(starts, BLOCK_ENDS)] + [F.substring(text, starts[-1] + 1, (1 << 31) - 1)]
    return [F.xxhash64(p) for p in parts]


KEY = ["length", *(f"block_{k}" for k in range(len(BLOCK_ENDS) + 1))]


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with their text's length in code points and the hashes of its blocks, all made in one scan."""
    return docs.select("*", F.char_length("text").alias(KEY[0]), *(h.alias(name) for name, h in zip(KEY[1:], _blocks(F.col("text")))))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def failures(text: Column, words: Column) -> Column:
    """The bits of the filters A to D that a text with these words fails."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    tests = (n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 2 * F.char_length(text).cast("long"), F.rlike(text, F.lit("[#$%&*|]")))
    bits = F.lit(0)
    for k, failed in enumerate(tests):
        bits = bits + F.when(failed, 1 << k).otherwise(0)
    return bits


def repeated(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, KEY) of the rows whose text a row of smaller id has too, among ``docs`` (id, text) and their keys ``marked``.

    The table is one class at first. Each round splits the classes, by length and then by one block's hash after the other,
    and takes out the rows that are alone. A class counts its rows in the scan's tasks, and a row alone is its class's least
    and only id, so the rows leave by a join on ids: no task gets a class's rows, however many there are. The texts of what
    is left are compared whole, and all but the least id of a text are returned.
    """
    left = marked.filter("id is not null").select("id", *KEY)
    for k in range(len(KEY)):
        alone = left.groupBy(*KEY[: k + 1]).agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("id")).filter("rows = 1").select("id", *KEY[: k + 1])
        smaller = written(left.join(alone, ["id", *KEY[: k + 1]], "left_anti"), "classes")
        if k:
            drop_written(left)
        left = smaller
    rows = left.distinct()
    # texts are dealt by id whatever the number of rows left, so that nothing grows but in proportion
    texts = keyed(docs.select("id", "text")).join(rows.hint("shuffle_hash"), ["id", *KEY])
    least = texts.groupBy(*KEY, "text").agg(F.min("id").alias("id")).select("id", *KEY)
    return rows.join(least, ["id", *KEY], "left_anti")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, rows, good, toxic): rows of each source by the filters that they fail, one bit a filter.

    A label row with quality 1, or toxic 1, makes all rows of its doc_id good, or toxic.
    """
    ship(docs.sparkSession)
    texts = docs.select(named("doc_id").cast("long").alias("id"), F.coalesce(named("source").cast("string"), F.lit("")).alias("part"), F.coalesce(named("text").cast("string"), F.lit("")).alias("text"))
    split = keyed(texts).withColumn("words", words_of(F.col("text")))  # used twice, so a step of its own
    marked = written(split.select("id", "part", failures(F.col("text"), F.col("words")).alias("bits"), *KEY), "failures")
    again = repeated(texts, marked).withColumn("again", F.lit(1 << FILTERS.index("E")))
    known = labels.select(named("doc_id").cast("long").alias("id"), (named("quality") == 1).alias("q"), (named("toxic") == 1).alias("t"))
    known = known.groupBy("id").agg(F.coalesce(F.bool_or("q"), F.lit(False)).alias("q"), F.coalesce(F.bool_or("t"), F.lit(False)).alias("t")).filter("q or t")
    whole = marked.join(again, ["id", *KEY], "left").join(known, "id", "left")
    mask = F.col("bits") + F.coalesce("again", F.lit(0))
    return whole.groupBy("part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("q").alias("good"), F.count_if("t").alias("toxic"))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, filters before it as bits, its own bit) for every step of every order."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, before, bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Five filters in all 120 orders over documents (doc_id, text, source): a row for each part, order and step.

    A filter fails a text with A fewer than 200 words, B fewer distinct words than half, C more than 2 % capitals A-Z, D a
    character of ``#$%&*|``, E a text that a smaller doc_id has. Null texts and sources are read as empty; words are runs of
    characters other than blank and \\x09-\\x0D. A null doc_id neither repeats a text nor is repeated, and has no labels.
    Rows with equal id and text are no repeats of each other. Each row counts; an empty table gives no rows, a filter that
    removes nothing a row of zeros.

    Once rows are counted by mask, what a set of filters leaves is a sum over the masks that avoid it: 32 sums a part say
    everything. ``removed`` is what is left before less what is left after; ``shapley`` weighs that difference over the sets
    by the orders in which they come first.
    """
    sets, all_bits = 1 << len(FILTERS), (1 << len(FILTERS)) - 1
    by_set = masks(docs, labels).select("*", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set")).filter(F.col("mask").bitwiseAND(F.col("set")) == 0)
    sums = by_set.groupBy("part", "set").agg(*(F.sum(c).alias(c) for c in ("rows", "good", "toxic")))
    # at most one entry for each of the 32 sets; a set that leaves nothing has none
    parts = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("set", F.struct("rows", "good", "toxic")))).alias("left"))
    every = docs.select(F.coalesce(named("source").cast("string"), F.lit("")).alias("part")).distinct()
    parts = every.join(parts, "part", "left")
    left = lambda s, what="rows": F.coalesce(F.try_element_at("left", s)[what], F.lit(0))

    steps = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("before"), F.lit(bit).alias("bit")) for o, k, b, bit in orders()))
    rows = parts.select("part", "left", F.explode(steps).alias("s")).select("part", "left", "s.*")
    before, after = F.col("before"), F.col("before").bitwiseOR(F.col("bit"))
    removed = left(before) - left(after)
    failing = left(F.lit(0)) - left(F.col("bit"))
    others = F.lit(all_bits) - F.col("bit")
    worth = F.lit(0)
    for s in range(sets):
        size = s.bit_count()
        if size < len(FILTERS):
            weight = factorial(size) * factorial(len(FILTERS) - 1 - size)
            gain = left(F.lit(s)) - left(F.lit(s).bitwiseOR(F.col("bit")))
            worth = worth + F.when(F.lit(s).bitwiseAND(F.col("bit")) == 0, gain * weight).otherwise(0)
    return rows.select(
        "part", "filter_order", "step", left(after).alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"),
        (left(others) - left(F.lit(all_bits))).alias("unique_fails"), (left(before, "good") - left(after, "good")).alias("good_lost"),
        (left(before, "toxic") - left(after, "toxic")).alias("toxic_lost"), worth.cast("long").alias("shapley"),
    )
