"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import doc_text, lean, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_CACHE_WORDS = 150_000  # words whose ids a task keeps; beyond that it starts afresh
_LONG_WORD = 64  # characters; longer words are tokenised each time and not kept


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself where it prints, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b if b in plain else next(other)) for b in range(256)}


class _Words(dict):
    """From a word without blanks to its ids as little-endian unsigned 32-bit numbers.

    Words of letters below U+0180 need only be put in lower case and merged; every other word goes through the whole
    tokenizer with its normaliser and patterns.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model
        self.letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            ids = [t.id for t in self.merges.tokenize(word.lower())]
        elif word.isalpha() and max(word) < "\u0180" and "\u0130" not in word:
            ids = [t.id for t in self.merges.tokenize(word.lower().encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        coded = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= _LONG_WORD:
            self[word] = coded
        return coded


def token_bytes(texts: pa.Array, known: _Words, eos: int) -> list[bytes]:
    """The ids of each text (null: empty), then ``eos``, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins across it, nor letters with a stop or comma behind them, and puts
    letters in lower case. So texts are split there with Arrow, each distinct word is looked up once, and the ids are
    gathered. Texts that may name a special token are tokenised as they are.
    """
    end = eos.to_bytes(4, "little")
    if len(known) > _CACHE_WORDS:
        known.clear()
    raw = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(raw), r"([a-z])([.,])(\s|$)", r"\1 \2\3"))
    words = split.flatten().dictionary_encode()
    which = words.indices.to_numpy()
    coded = [known[w] if w else b"" for w in words.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    ids, starts = np.frombuffer(b"".join(coded), "<u4"), np.concatenate(([0], np.cumsum(sizes)))
    ends = np.concatenate(([0], np.cumsum(sizes[which])))
    gathered = ids[np.repeat(starts[which] - ends[:-1], sizes[which]) + np.arange(ends[-1])]
    bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
    out = [gathered[a:b].tobytes() + end for a, b in zip(bounds[:-1], bounds[1:])]
    for i in pc.indices_nonzero(pc.match_substring(raw, "<|")).to_pylist():
        out[i] = struct.pack(f"<{len(x)}I", *x) + end if (x := known.whole.encode(raw[i].as_py(), add_special_tokens=False).ids) else end
    return out


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (piece, from, length). Pieces go, longest first, to the first bin with room, found by descending a
    tournament tree whose nodes hold the largest free capacity below. Then the emptiest bin is cut to fill what is
    free in the others, while that takes it up whole."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    leaves = 1
    while leaves < max(1, len(order)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins: list[list[tuple[int, int, int]]] = []
    for i in order:
        size, node = lengths[i], 1
        while node < leaves:
            node = 2 * node if tree[2 * node] >= size else 2 * node + 1
        at = node - leaves
        while len(bins) <= at:
            bins.append([])
        bins[at].append((i, 0, size))
        tree[node] -= size
        node //= 2
        while node:
            tree[node] = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            node //= 2
    free = [tree[leaves + b] for b in range(len(bins))]
    by_free = sorted((b for b in range(len(bins)) if free[b]), key=lambda b: free[b])  # fullest first
    room = sum(free)
    while len(by_free) > 1 and room - free[by_free[-1]] >= capacity - free[by_free[-1]]:
        last = by_free.pop()
        room -= free[last]
        for piece, start, size in bins[last]:
            while size:
                target = by_free[0]
                part = min(size, free[target])
                bins[target].append((piece, start, part))
                free[target] -= part
                room -= part
                start, size = start + part, size - part
                if not free[target]:
                    by_free.pop(0)
        bins[last] = []
    return [b for b in bins if b]


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, eos_id: int = 1, group_sequences: int = 256, seed: int = 42, carry_ids: bool = False) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    Each text is tokenised whole (null: empty) and closed by ``eos_id``. Documents longer than a sequence are cut into
    full sequences and a rest. Rests and short documents are dealt by a seeded hash of their document, full pieces by one
    of their own, to groups of about ``group_sequences`` sequences (four bytes of text are taken for a token), and each
    group is packed by itself: longest first, and a bin that is left nearly empty is cut into the gaps of the others, so a
    group wastes less than one sequence. A group of more than eight times that size is packed in parts, one after the
    other, so a task's memory is bounded however many rows fall into it.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``carry_ids`` the piece's ids (little-endian 32-bit binary). An empty text is its ``eos_id`` alone; repeated rows
    are packed as often as they come; a null doc_id is kept as null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = doc_text(docs)
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 4)).first()[0] or 0
    groups = max(1, -(-size // (4 * capacity * group_sequences)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups // 8))  # so that what a task reads does not grow
    schema = PIECES + ", group long, piece_crc32 long, ids binary"

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(tokenizer_path)
        for part in slices(batches):
            rows: list[list] = [[] for _ in range(8)]
            for doc, data in zip(part.column("doc_id").to_pylist(), token_bytes(part.column("text"), known, eos_id)):
                n, whole = len(data) // 4, zlib.crc32(data)
                for start in range(0, n, capacity):
                    piece = data[4 * start : 4 * min(n, start + capacity)]
                    own = start if n - start >= capacity else -1
                    group = zlib.crc32(b"%d:%s:%d:%d" % (seed, str(doc).encode(), whole, own)) % groups
                    for column, value in zip(rows, (doc, start, len(piece) // 4, zlib.crc32(piece), n, group, whole, piece)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:7]), pa.array(rows[7], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "group", "piece_crc32", "ids"])

    def packed(pieces: pa.Table, first: int) -> tuple[pa.RecordBatch, int]:
        pieces = pieces.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("piece_crc32", "ascending")])
        doc, start, length, total, group, ids = (pieces.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "group", "ids"))
        rows: list[list] = [[] for _ in range(8)]
        bins = first_fit_decreasing(length, capacity)
        for k, bin_ in enumerate(bins, first):
            offset = 0
            for i, a, size in bin_:
                part = ids[i][4 * a : 4 * (a + size)]
                for column, value in zip(rows, (doc[i], start[i] + a, size, zlib.crc32(part), total[i], (group[0] << 32) + k, offset, part if carry_ids else None)):
                    column.append(value)
                offset += size
        out = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:7]), pa.array(rows[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        return out, first + len(bins)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, first = [], 0, 0
        for batch in batches:
            held.append(batch)
            tokens += pc.sum(batch.column("length")).as_py() or 0
            if tokens >= 8 * capacity * group_sequences:
                out, first = packed(pa.Table.from_batches(held), first)
                held, tokens = [], 0
                yield out
        if held:
            yield packed(pa.Table.from_batches(held), first)[0]

    pieces = texts.mapInArrow(lean(tokenise), schema).repartition(tasks, "group")
    out = pieces.groupBy("group").applyInArrow(lean(fill), PIECES + ", sequence_id long, offset long, ids binary")
    return out if carry_ids else out.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves, from ``pack(..., carry_ids=True)``: sequence_id, n_tokens, ids (binary, in offset order).
    Pieces whose ids are null add nothing to ids; an empty table gives no rows."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda x: x["ids"]), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
