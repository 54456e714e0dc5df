"""Search over many sessions: an index of trigrams says which sessions cannot hold a text, so that their logs stay closed."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.session import S
from tracewright.plans import reports
from tracewright.shipping import ship
from tracewright.sources.logs import existing

VERSION = [*S, "updated_at"]  # a session as it was when it was indexed


def trigrams(text: str) -> set[str]:
    return {text[k : k + 3] for k in range(len(text) - 2)}


def trigrams_of(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tri): the distinct runs of three characters of the lowered texts (keys, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(trigrams(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found, pa.list_(pa.string()))], [*keys, "tris"])

    kinds = dict(texts.dtypes)
    ship(texts.sparkSession)
    rows = texts.select(*keys, F.lower("text").alias("text")).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", tris array<string>")
    return rows.select(*keys, F.explode("tris").alias("tri")).distinct()


class SearchIndex:
    """Trigrams of sessions in a folder: a table an update, and one of the sessions that it covers, written after it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, kind: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{kind}"
        return self.spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(path) if existing(self.spark, path) else self.spark.createDataFrame([], schema)

    def _keys(self, sessions: DataFrame) -> str:
        kinds = dict(sessions.dtypes)
        return ", ".join(f"{k} {kinds[k]}" for k in VERSION)

    def update(self, sessions: DataFrame) -> int:
        """Index the sessions that are new or changed since; how many that were. Only their logs are read."""
        keys = self._keys(sessions)
        new = sessions.join(self._table("covered", keys), VERSION, "left_anti")
        n = new.count()
        if n:
            texts = reports.searchable(reports.read_records(self.spark, new)).select(*S, "text")
            rows = trigrams_of(texts, S).join(new.select(*VERSION), S)
            name = uuid.uuid4().hex
            # sorted by trigram, so that a look-up reads the row groups that have it
            rows.select(*VERSION, "tri").repartitionByRange("tri").sortWithinPartitions("tri").write.option("compression", "zstd").parquet(f"{self.folder}/trigrams/{name}")
            new.select(*VERSION).write.parquet(f"{self.folder}/covered/{name}")
        return n

    def candidates(self, sessions: DataFrame, query: str) -> DataFrame:
        """The sessions that can hold ``query`` in any case: those with all its trigrams, and those that are not indexed as
        they are now. A query of less than three characters rules nothing out. No session that holds it is ever left out."""
        keys = self._keys(sessions)
        lowered = self.spark.range(1).select(F.lower(F.lit(query)).alias("q")).first()["q"]
        wanted = sorted(trigrams(lowered))
        if not wanted:
            return sessions
        tris = self._table("trigrams", keys + ", tri string").filter(F.col("tri").isin(wanted))
        hit = tris.groupBy(*VERSION).agg(F.count_distinct("tri").alias("n")).filter(F.col("n") == len(wanted)).select(*VERSION)
        covered = self._table("covered", keys).distinct()
        return sessions.join(hit, VERSION, "left_semi").unionByName(sessions.join(covered, VERSION, "left_anti"))


def search_all(spark: SparkSession, sessions: DataFrame, index: SearchIndex, query: str, **how) -> DataFrame:
    """:func:`tracewright.plans.reports.search` for a literal text over any number of sessions; only logs that can hold it are
    read."""
    return reports.search(reports.searchable(reports.read_records(spark, index.candidates(sessions, query))), query, **how)
