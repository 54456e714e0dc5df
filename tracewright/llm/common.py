"""What the training-data operators share: reading tables, cutting lineage, small checks."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.scratch import shared_dir

from tracewright.shipping import ship

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, by whatever path Spark can read."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here and lost executors lose nothing.

    The files go when the driver ends, or with :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewright-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _scratch:
        atexit.register(release)
    _scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete every table that :func:`written` made; frames that still read them fail afterwards."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; its cluster owns the folder
            return


def drop_written(df: DataFrame) -> None:
    """Delete the files of one frame that :func:`written` returned, when nothing lazy reads it any more."""
    for name in df.inputFiles()[:1]:
        top = next((p for _, p in _scratch if p.split("://")[-1].lstrip("/") in name.split("://")[-1]), None)
        if top:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(top)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
            _scratch[:] = [x for x in _scratch if x[1] != top]


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark deletes the shuffle files of earlier rounds of an iteration."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def doc_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string), so other columns, whatever their names, never clash."""
    ship(docs.sparkSession)
    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))


def crc_mod(col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``: the hold-out folds. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000, size: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches of at most ``rows`` rows and, but for a single longer text, ``size`` bytes of text. Spark
    itself bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, to - at)
            at = to


def lean(run: Callable) -> Callable:
    """An Arrow function whose Python worker gives back its memory when the task ends, for the stages that follow in it."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def named(column: str) -> Column:
    """A column by its exact name, whatever letters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, hash): each row as one struct beside its id and its text's hash, so that no column of it clashes with
    what is joined to it; :func:`opened` gives the rows back. Id and hash together tell documents apart where ids repeat."""
    ship(docs.sparkSession)
    return docs.select(F.struct(*(named(c) for c in docs.columns)).alias("row"), named(id_col).cast("long").alias("id"), F.xxhash64(named(text_col).cast("string")).alias("hash"))


def opened(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("row").getField(c).alias(c) for c in columns))


def byte_table(word: Callable[[int], bool]) -> bytes:
    """For ``bytes.translate``: A-Z in lower case, and a blank for every byte below 128 that is no ``word`` byte."""
    return bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or word(b) else 32 for b in range(256))


def pieces(text: pa.StringScalar, table: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text of any length, in lists: ``size`` bytes are translated and split at a time, never within a word."""
    whole = text.as_buffer()
    view, carry = memoryview(whole if whole is not None else b""), b""
    for at in range(0, len(view), size):
        part = carry + view[at : at + size].tobytes().translate(table)
        cut = len(part) if at + size >= len(view) else part.rfind(b" ") + 1
        carry = part[cut:]
        if cut:
            yield part[:cut].split()
