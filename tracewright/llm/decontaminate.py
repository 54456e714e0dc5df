"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all training windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import lean, named, opened, slices, whole_rows, written

#: A-Z become a-z, every other ASCII character that is no digit or letter a blank; bytes from 0x80 on stay.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (UTF-8) of letters, digits and anything outside ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class NgramIndex:
    """Every window of ``n`` words of the test items (all words of a shorter one), with the items that hold it.

    Words have numbers, and windows of a size are a sorted array of 64-bit hashes with the place of each in the items'
    words, about 20 bytes a word of the items besides the distinct words themselves. A hash that is found is verified:
    the words' numbers are compared.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        words, spans, at = [], {}, 0
        for item, text in items:
            found = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(n, len(found))
            if size:
                spans.setdefault(size, []).append((item, at, len(found) - size + 1))
                words.append(np.array(found, np.int32))
                at += len(found)
        self.words = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, list, np.ndarray]] = {}
        for size in sorted(spans):
            places = np.concatenate([np.arange(start, start + many, dtype=np.int32) for _, start, many in spans[size]])
            owner = np.repeat(np.arange(len(spans[size]), dtype=np.int32), [many for *_, many in spans[size]])
            hashes = self._hashes(self.words, size)[places]
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], places[order], [item for item, *_ in spans[size]], owner[order]

    @staticmethod
    def _hashes(ids: np.ndarray, size: int) -> np.ndarray:
        """A 64-bit hash of every run of ``size`` word numbers."""
        out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
        for k in range(size):
            out = (out ^ ids[k : k + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def scan(self, words: list[bytes]) -> tuple[list[int], list[int], set]:
        """Starts and ends of hit windows in word positions, and the items. A window is looked up where all its words
        are words of some item."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        starts, ends, items = [], [], set()
        outside = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, (hashes, places, names, owner) in self.windows.items():
            if size > len(words):
                break
            inside = np.flatnonzero(outside[size:] == outside[:-size])
            if not len(inside):
                continue
            here = self._hashes(ids, size)[inside]
            first, last = np.searchsorted(hashes, here, "left"), np.searchsorted(hashes, here, "right")
            for i, a, b in zip(inside[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist()):
                same = [k for k in range(a, b) if np.array_equal(self.words[places[k] : places[k] + size], ids[i : i + size])]
                if same:
                    starts.append(i)
                    ends.append(i + size)
                    items.update(names[owner[k]] for k in same)
        return starts, ends, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The test items with the block of each, and the number of blocks of about ``block_bytes``: what is broadcast at once
    is bounded however large the table is. Repeated rows count once; items with one text are dealt apart."""
    items = benchmark.select(named(id_col).cast("long").alias("item"), named(text_col).cast("string").alias("text")).filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    return items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), blocks


def _found(texts: DataFrame, items: DataFrame, block: int, n: int) -> DataFrame:
    """A row per row of ``texts`` (id, hash, text): id, hash, text, n_words, starts, ends, items, of one block of items."""
    held = texts.sparkSession.sparkContext.broadcast(NgramIndex([(r["item"], r["text"]) for r in items.filter(F.col("block") == block).select("item", "text").collect()], n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, many = held.value, pa.list_(pa.int64())
        for part in slices(batches):
            rows: list[list] = [[], [], [], []]
            for text in part.column("text").to_pylist():
                words = words_of(text)
                starts, ends, items = index.scan(words)
                for column, value in zip(rows, (len(words), starts, ends, sorted(i for i in items if i is not None))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("hash"), part.column("text"), pa.array(rows[0], pa.int64()), *(pa.array(c, many) for c in rows[1:])], ["id", "hash", "text", "n_words", "starts", "ends", "items"])

    return texts.mapInArrow(lean(scan), "id long, hash long, text string, n_words long, starts array<long>, ends array<long>, items array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20, keep_text: bool = False) -> DataFrame:
    """Scan every whole document for windows of ``n`` words of the benchmark.

    Text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. An item of fewer than
    ``n`` words is one window; an item without words, or null, none. The benchmark's size is measured first: up to
    ``block_bytes`` of text its index is broadcast whole; beyond that the documents are scanned once for each block, one
    job after the other, so a worker holds one block's index, and the few documents with hits are joined back by id and text.

    Returns a row per document: doc_id, text (null unless ``keep_text``), n_words, starts and ends (word positions of
    hit windows), items (ids with a window in the document). A null text has no words; repeated rows stay separate
    rows; an empty table on either side gives no hits.
    """
    texts = whole_rows(docs).select("id", "hash", F.col("row").getField("text").cast("string").alias("text"))
    items, blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    found = _found(texts, items, 0, n)
    if blocks > 1:
        hits = [written(_found(texts, items, k, n).filter(F.size("starts") > 0).select("id", "hash", "starts", "ends", "items").distinct(), "hits") for k in range(1, blocks)]
        every = hits[0]
        for more in hits[1:]:
            every = every.union(more)
        lists = lambda c: F.flatten(F.collect_list(c)).alias(f"more_{c}")
        more = every.groupBy("id", "hash").agg(lists("starts"), lists("ends"), lists("items")).withColumnsRenamed({"id": "more_id", "hash": "more_hash"})
        found = found.join(more, F.col("id").eqNullSafe(F.col("more_id")) & (F.col("hash") == F.col("more_hash")), "left")
        both = lambda c: F.concat(c, F.coalesce(f"more_{c}", F.array().cast("array<long>")))
        found = found.select("id", "text", "n_words", both("starts").alias("starts"), both("ends").alias("ends"), F.array_sort(F.array_distinct(both("items"))).alias("items"))
    return found.select(F.col("id").alias("doc_id"), (F.col("text") if keep_text else F.lit(None).cast("string")).alias("text"), "n_words", "starts", "ends", "items")


def _covered(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The union of the windows as disjoint word ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(hits: DataFrame) -> DataFrame:
    """A row per row of :func:`contamination`, repeated ones too: n_words, n_hit (words inside any hit window), n_items,
    items_sha256 (hex, of the item ids sorted as text and joined by commas, without null ids), contaminated. A null or empty
    text has 0 words and no hits; an empty table gives no rows."""
    last = F.array_sort(F.arrays_zip("starts", "ends"))
    merged = F.aggregate(last, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda acc, w: F.struct((acc["n"] + F.greatest(F.lit(0), w["ends"] - F.greatest(w["starts"], acc["to"]))).alias("n"), F.greatest(acc["to"], w["ends"]).alias("to")), lambda acc: acc["n"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return hits.select("doc_id", "n_words", merged.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def without_spans(hits: DataFrame) -> DataFrame:
    """(doc_id, text, n_removed) with the words of every hit window cut out of the text, blanks between them included. Texts
    without hits, null ones too, stay as they are; repeated rows are cut one by one; an empty table gives no rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, removed = [], []
            for text, starts, ends in zip(*(part.column(c).to_pylist() for c in ("text", "starts", "ends"))):
                spans = _covered(starts, ends)
                if spans:
                    at = [m.span() for m in _WORD.finditer(text)]
                    for a, b in reversed(spans):
                        text = text[: at[a][0]] + text[at[b - 1][1] :]
                texts.append(text)
                removed.append(sum(b - a for a, b in spans))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_removed"])

    return hits.select("doc_id", "text", "starts", "ends").mapInArrow(lean(cut), "doc_id long, text string, n_removed long")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns. Null texts and, where the benchmark has
    no words, all rows stay; repeated rows are judged one by one; an empty table gives no rows."""
    items, blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    rows = whole_rows(docs)
    texts = rows.select("id", "hash", F.col("row").getField("text").cast("string").alias("text"))
    for k in range(1, blocks):
        hit = written(_found(texts, items, k, n).filter(F.size("starts") > 0).select(F.col("id").alias("hit_id"), F.col("hash").alias("hit_hash")).distinct(), "hits")
        rows = rows.join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("hash") == F.col("hit_hash")), "left_anti")
    held = docs.sparkSession.sparkContext.broadcast(NgramIndex([(r["item"], r["text"]) for r in items.filter("block = 0").select("item", "text").collect()], n))

    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = held.value
        for texts in batches:
            parts = slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]))
            yield pa.array([not index.scan(words_of(t))[0] for part in parts for t in part.column("text").to_pylist()], pa.bool_())

    is_clean = F.arrow_udf(lean(clean), "boolean", F.ArrowUDFType.SCALAR_ITER)
    return opened(rows.filter(is_clean(F.col("row").getField("text").cast("string"))), docs.columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, action: str = "drop", **options) -> DataFrame:
    """Documents without contamination: ``drop`` leaves contaminated ones out and keeps all columns, ``spans`` cuts the
    hit words and gives (doc_id, text). Null and empty texts stay, repeated rows are judged one by one, and an empty table, or
    an empty benchmark, changes nothing."""
    if action == "spans":
        return without_spans(contamination(docs, benchmark, keep_text=True, **options)).drop("n_removed")
    if action != "drop":
        raise ValueError(f"action is 'drop' or 'spans', not {action!r}")
    return uncontaminated(docs, benchmark, **options)
