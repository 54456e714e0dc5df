"""Scans of JSONL event logs: lines with trustworthy numbers, strictly parsed records, and facts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.shipping import ship

SESSION = ["source", "session_id"]
FIELDS = {
    "kind": "string", "turn": "string", "text": "string", "aux": "string", "path": "string", "num": "bigint", "exit_text": "string", "error": "string",
    "failed": "boolean", "quiet": "boolean", "form": "string", "call": "string",
}
FACT = "struct<" + ",".join(f"{k}:{t}" for k, t in FIELDS.items()) + ">"
FACT_COLUMNS = [*SESSION, "seq", "sub", "ts", *FIELDS]


HEAD_BYTES, HEAD_CHUNK = 1 << 20, 1 << 16  # of a file in which its first line is looked for, read a chunk at a time


def parsed(df: DataFrame) -> DataFrame:
    """``df`` with ``ok``, whether ``value`` is one JSON object and nothing else, and ``rec``, that object. One parse by the
    variant parser serves both."""
    first = df.withColumn("rec", F.try_parse_json("value"))
    return first.withColumn("ok", is_json_object(F.col("value"), F.col("rec"))).withColumn("rec", F.when(F.col("ok"), F.col("rec")))


def is_json_object(value: Column, first: Column | None = None) -> Column:
    """Whether a text is one JSON object and nothing else; ``first`` is the text parsed as a variant, if that is at hand.

    The variant parser is strict but stops behind the first value. What follows it is found by parsing the text again inside
    an array, which only ``]`` can end early, and inside an object, which only ``}`` can.
    """
    first = F.try_parse_json(value) if first is None else first
    alone = F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1
    inside = F.size(F.json_object_keys(F.concat(F.lit('{"x":'), value, F.lit("}")))) == 1
    return F.coalesce(F.startswith(F.schema_of_variant(first), F.lit("OBJECT")) & alone & inside, F.lit(False))


def lines(spark: SparkSession, paths: list[str] | str, *, glob: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """(file, line_no, value, mtime, size): the lines of text files, blank ones left out, with numbers that rise in each
    file's order (they are not consecutive).

    No line is shuffled: a number is where its split begins plus its place among the rows of the task that scans it. A split
    that others follow has the full split size and a task of its own, so it has fewer rows than bytes and the next split's
    numbers are larger. A folder that does not exist has no lines.
    """
    reader = ship(spark).read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    there = existing(spark, paths)
    if not there:
        return spark.createDataFrame([], "file string, line_no long, value string, mtime timestamp, size long")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    raw = reader.text(there).select(
        F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + place).alias("line_no"), "value",
        F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"),
    )
    return raw.filter(F.trim("value") != "")


def existing(spark: SparkSession, paths: list[str] | str) -> list[str]:
    """The paths that exist, by whatever file system they name."""
    found = []
    for p in [paths] if isinstance(paths, str) else paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            found.append(p)
    return found


def read_head(path: str, chunk: int = HEAD_CHUNK, most: int = HEAD_BYTES) -> tuple[str | None, int]:
    """The first line of a file that is not blank, of its first ``most`` bytes, and how many bytes were read for it."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    head = b""
    with store.open_input_file(inside) as f:
        while len(head) < most:
            more = f.read(min(chunk, most - len(head)))
            head += more
            line, end, _ = head.lstrip(b" \t\r\n").partition(b"\n")
            if not more or end:
                break
    line = line.rstrip(b"\r").decode("utf-8", "replace")
    return (line if line.strip() else None), len(head)


def first_lines(spark: SparkSession, root: str, *, glob: str = "*.jsonl", only: DataFrame | None = None) -> DataFrame:
    """(file, mtime, size, value, head_bytes): the first line of every file below ``root`` that is not blank, of its first
    ``HEAD_BYTES`` at most; with ``only`` (file), of those files.

    Files are listed without their content and dealt to all tasks, which read each one's head and nothing behind it, by any
    store that Arrow can open (local, HDFS, S3, GCS, Azure).
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_head(path) for path in batch.column("file").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v for v, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], [*batch.schema.names, "value", "head_bytes"])

    files = listing(spark, root, glob=glob)
    files = files.join(only.select("file"), "file", "left_semi") if only is not None else files
    dealt = files.select("file", "mtime", "size").repartition(spark.sparkContext.defaultParallelism, "file")
    return dealt.mapInArrow(heads, "file string, mtime timestamp, size long, value string, head_bytes long").filter("value is not null")


def listing(spark: SparkSession, root: str, *, glob: str = "*.jsonl") -> DataFrame:
    """(file, mtime, size) of every file below ``root``; no content is read, and a missing folder has no files."""
    if not existing(spark, root):
        return spark.createDataFrame([], "file string, mtime timestamp, size long")
    found = ship(spark).read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def records(numbered: DataFrame, files: DataFrame) -> DataFrame:
    """(source, session_id, seq, file, value, ok, rec): the lines of each session's files, in path order, as variants.

    ``files`` has (source, session_id, file). ``seq`` is the file's rank by path, then the line. Lines that are not one
    JSON object are kept with ``ok`` false.
    """
    rank = F.dense_rank().over(W.partitionBy(*SESSION).orderBy("file"))
    placed = files.select(*SESSION, "file").distinct().withColumn("rank", rank)
    both = numbered.join(placed, "file")
    seq = F.shiftleft(F.col("rank").cast("long"), 40) + F.col("line_no")
    return parsed(both.select(*SESSION, seq.alias("seq"), "file", "value")).select(*SESSION, "seq", "file", "value", "ok", "rec")


def get(path: str, kind: str = "string", of: str | Column = "rec") -> Column:
    return F.try_variant_get(F.col(of) if isinstance(of, str) else of, path, kind)


def full(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def fact(kind: str, when: Column | None = None, **values) -> Column:
    made = F.struct(F.lit(kind).alias("kind"), *((values[k] if isinstance(values.get(k), Column) else F.lit(values.get(k))).cast(t).alias(k) for k, t in FIELDS.items() if k != "kind")).cast(FACT)
    return made if when is None else F.when(when, made)


def exploded(recs: DataFrame, ts: Column, singles: list[Column], lists: list[Column]) -> DataFrame:
    """A row per fact, ordered by (seq, sub)."""
    none = F.array().cast(f"array<{FACT}>")
    every = F.concat(F.array_compact(F.array(*singles)), *(F.coalesce(x, none) for x in lists))
    rows = recs.select(*SESSION, "seq", ts.alias("ts"), F.posexplode(every).alias("sub", "f"))
    return rows.select(*SESSION, "seq", "sub", "ts", "f.*")
