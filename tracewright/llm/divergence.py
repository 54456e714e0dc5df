"""Divergence of sources within a language: an inverted index whose postings correct a baseline of zero counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.common import byte_table, lean, named, pieces, slices, written
from tracewright.shipping import ship

UNIT = 1_000_000_000
_TERM = byte_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122)


_ONE_DOC = 1 << 40  # a held number is occurrences in its low bits and documents above them


def term_counts(docs: DataFrame, *, most_keys: int = 400_000) -> DataFrame:
    """(lang, source, term, count, docs): how often a term stands in a group's texts, and in how many of them.

    A task adds up its rows by group and term and gives the sums out whenever it holds ``most_keys`` of them, so its memory
    does not grow with the input; Spark adds them up in one shuffle by group and term.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), sums in held.items():
                same = [pa.array([x] * len(sums), pa.string()) for x in (lang, source)]
                packed = np.fromiter(sums.values(), np.int64, len(sums))
                yield pa.RecordBatch.from_arrays([*same, pa.array(list(sums), pa.binary()).cast(pa.string()), pa.array(packed % _ONE_DOC), pa.array(packed // _ONE_DOC)], ["lang", "source", "term", "count", "docs"])
            held.clear()

        size = 0
        for part in slices(batches):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text")):
                terms: Counter = Counter()
                for words in pieces(text, _TERM):
                    terms.update(words)
                sums = held.setdefault((lang, source), {})
                size, known = size - len(sums), sums.get
                for term, n in terms.items():
                    sums[term] = known(term, 0) + n + _ONE_DOC
                size += len(sums)
                if size >= most_keys:
                    yield from out()
                    size = 0
        yield from out()

    ship(docs.sparkSession)
    each = docs.select("lang", "source", "text").mapInArrow(lean(count), "lang string, source string, term string, count long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _share(count: Column | str, n: str, v: str, smoothing: int) -> Column:
    """1 + floor(UNIT * (count + smoothing) / (n + smoothing * v)), exactly; the quotient is an integer division of decimals."""
    of = (F.lit(count) if isinstance(count, int) else F.col(count)) + F.lit(smoothing)
    total = F.col(n) + F.lit(smoothing) * F.col(v)
    return F.lit(1) + F.call_function("div", of.cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def divergence(docs: DataFrame, *, min_docs: int = 30, smoothing: int = 5, most: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source), nulls read as ''.

    A language keeps the terms that at least ``min_docs`` of its documents have: V of them, N occurrences in a group. A
    group (lang, source) gives a term the share p = 1 + floor(10**9 * (count + smoothing) / (N + smoothing * V)).

    Part ``pair``: every other source of the language with the sum of abs(p - its p) over all kept terms, largest first.
    A pair starts at V times the difference of the two shares of a zero count. A term that only one of the two has corrects
    that by an amount which its count decides alone, so these corrections come from each group's table of counts; only where
    both have the term do its postings meet, and what they emit is what the two one-sided corrections leave open.

    Part ``term``: the ``most`` kept terms whose share in the group is most above the language's. Ties go by the item's
    UTF-8 bytes. Groups without terms have pairs; a language without kept terms has pairs of value 0; a source alone in its
    language has none. Repeated rows count each; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    plain = docs.select(*(F.coalesce(named(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    by_term = W.partitionBy("lang", "term")  # a row for each source that has the term
    counts = term_counts(plain).withColumn("in_docs", F.sum("docs").over(by_term)).withColumn("in_lang", F.sum("count").over(by_term))
    kept = written(counts.filter(F.col("in_docs") >= min_docs).select("lang", "source", "term", "count", "in_lang"), "postings")

    terms = kept.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("n_lang"))
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "n_lang"])
    zero = F.when(F.col("v") > 0, _share(0, "n", "v", smoothing)).otherwise(0)
    groups = written(groups.withColumn("p0", zero), "groups")  # a row a source and language

    postings = kept.join(groups, ["lang", "source"]).withColumn("p", _share("count", "n", "v", smoothing))

    this, other = groups.select("lang", "source", "v", "p0"), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = this.join(other, "lang").filter("source <> item")
    base = pairs.select("lang", "source", "item", (F.col("v") * F.abs(F.col("p0") - F.col("q0"))).alias("value"))

    levels = postings.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    one = levels.join(other, "lang").filter("source <> item")
    change = F.sum(F.col("terms") * (F.abs(F.col("p") - F.col("q0")) - F.abs(F.col("p0") - F.col("q0"))))
    one = one.groupBy("lang", "source", "item").agg(change.alias("value"))

    left = postings.select("lang", "term", "source", "p", "p0")
    right = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    open_ = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("q0")) - F.abs(F.col("q") - F.col("p0")) + F.abs(F.col("p0") - F.col("q0"))
    met = left.join(right, ["lang", "term"]).filter("source < item").select("lang", "source", "item", open_.alias("value")).filter("value <> 0")
    both = met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = base.unionByName(one).unionByName(turned(one)).unionByName(both).unionByName(turned(both))
    pair = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    above = postings.withColumn("q", _share("in_lang", "n_lang", "v", smoothing)).filter("p > q")
    term = above.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    top = term.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).filter(F.col("rank") <= most)
    return ranked.unionByName(top)
