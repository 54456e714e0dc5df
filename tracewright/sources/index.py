"""The index of session headers: snapshots of Parquet tables, committed by a pointer, so that a listing reads changed logs only.

A folder holds ``data/`` (one table a commit) and ``snapshots/`` (one pointer a commit: the tables it consists of). A row is a
file at a commit with its header, or without one if the file has none or is gone. A pointer is written after its table, so a
listing that dies in between leaves the commit before it in force; pointers that cannot be read are passed over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.logs import existing

#: Tables of a snapshot after which the next commit writes one table of all that holds.
MOST_TABLES = 8


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    where, fs = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


class HeaderIndex:
    """Headers of the files below a root, by ``kind`` (a source and the version of its header's layout)."""

    def __init__(self, spark: SparkSession, folder: str, kind: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{kind}"

    def _pointer(self, number: int) -> str:
        return f"{self.folder}/snapshots/{number:010d}"

    def latest(self) -> tuple[int, list[str]]:
        """The number and the tables of the last commit that is whole; (0, []) without one."""
        for name in reversed(_names(self.spark, f"{self.folder}/snapshots")):
            text = "".join(r["value"] for r in self.spark.read.text(self._pointer(int(name))).collect())
            try:
                tables = json.loads(text)["tables"]
            except (ValueError, KeyError, TypeError):
                continue
            if len(existing(self.spark, [f"{self.folder}/data/{t}/_SUCCESS" for t in tables])) == len(tables):
                return int(name), tables
        return 0, []

    def _rows(self, tables: list[str]) -> DataFrame | None:
        """The newest row of each file, those of files that are gone left out."""
        if not tables:
            return None
        rows = self.spark.read.parquet(*(f"{self.folder}/data/{t}" for t in tables))
        newest = rows.groupBy("file").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "file")), "commit").alias("r")).select("file", "r.*")
        return newest.filter("not gone").select(*rows.columns)

    def headers(self, listed: DataFrame, read: Callable[[DataFrame], DataFrame], *, refresh: bool = False) -> DataFrame:
        """The headers of ``listed`` (file, mtime, size): what ``read(files)`` gives for files that are new or changed since
        the last commit, and what the index holds for the others. ``refresh`` reads every file again."""
        number, tables = self.latest()
        old = None if refresh else self._rows(tables)
        known = self.spark.createDataFrame([], "file string, mtime timestamp, size long") if old is None else old.select("file", "mtime", "size")
        now, before = listed.select("file", "mtime", "size").alias("n"), known.alias("o")
        both = now.join(before, F.col("n.file") == F.col("o.file"), "full_outer")
        same = F.col("n.mtime").eqNullSafe(F.col("o.mtime")) & F.col("n.size").eqNullSafe(F.col("o.size"))
        change = F.when(F.col("o.file").isNull(), "new").when(F.col("n.file").isNull(), "gone").when(~same, "changed")
        changes = both.select(F.coalesce("n.file", "o.file").alias("file"), "n.mtime", "n.size", change.alias("change")).filter("change is not null")
        if old is not None and changes.isEmpty():
            return self._found(old)
        fresh = changes.filter("change <> 'gone'").select("file", "mtime", "size")
        made = read(fresh)
        header = F.struct(*(F.col(c) for c in made.columns))
        delta = fresh.join(made.select("file", header.alias("header")), "file", "left").withColumn("gone", F.lit(False))
        if old is not None:
            kind = delta.schema["header"].dataType
            left = changes.filter("change = 'gone'").select("file", "mtime", "size", F.lit(None).cast(kind).alias("header"), F.lit(True).alias("gone"))
            if len(tables) >= MOST_TABLES:
                rest = old.join(changes.select("file"), "file", "left_anti")
                delta, tables = delta.unionByName(rest.select("file", "mtime", "size", "header", "gone")), []
            else:
                delta = delta.unionByName(left)
        else:
            tables = []
        return self._found(self._rows(self._commit(number + 1, tables, delta.withColumn("commit", F.lit(number + 1)))))

    def _found(self, rows: DataFrame) -> DataFrame:
        return rows.filter("header is not null").select("header.*")

    def _commit(self, number: int, tables: list[str], delta: DataFrame) -> list[str]:
        name = f"{number:010d}-{uuid.uuid4().hex}"
        delta.write.parquet(f"{self.folder}/data/{name}")
        where, fs = _fs(self.spark, self._pointer(number))
        out = fs.create(where, False)  # an error if another listing has made this commit
        out.writeBytes(json.dumps({"tables": [*tables, name]}))
        out.close()
        self._sweep(number, {*tables, name})
        return [*tables, name]

    def _sweep(self, number: int, held: set[str]) -> None:
        """Delete what only pointers before the last but one name: a reader may still be at the last."""
        for old in _names(self.spark, f"{self.folder}/snapshots"):
            if int(old) < number - 1:
                where, fs = _fs(self.spark, self._pointer(int(old)))
                fs.delete(where, False)
        for name in _names(self.spark, f"{self.folder}/data"):
            if name not in held and int(name.split("-")[0]) < number - MOST_TABLES - 1:
                where, fs = _fs(self.spark, f"{self.folder}/data/{name}")
                fs.delete(where, True)
