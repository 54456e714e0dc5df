"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage works on all that the one before kept and is written before the next begins; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontaminate, linedup, neardup, packing, toxicity
from tracewright.llm.common import table, written
from tracewright.llm.queries import tokenizer_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores 0.3 or more go."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, exactly or within edits by their length, go; so do documents of which nothing remains."""
    return linedup.without_repeats(docs, threshold=linedup.BY_LENGTH, exact_chars=1)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the least doc_id stays."""
    return neardup.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of a benchmark item go."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near-dedup", near_copies), ("decontamination", benchmark), ("packing", packed)]

#: Learned scores and tokenizers are beyond SQL; the operators' tests hold line dedup, near-dedup, decontamination and packing
#: against brute force on fixtures; the stages' own test only checks columns, counts and that no repeat or leak is left.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
