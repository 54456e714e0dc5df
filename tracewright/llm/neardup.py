"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import drop_written, lean, opened, slices, tidy, whole_rows, written
from tracewright.llm.graph import connected_components

SIZE = 256  # coordinates of a sketch
FINE = 2048  # of the sketch that is made only of documents whose buckets stay undecided
_KEPT_WORDS = 150_000  # whose hashes a task keeps


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def similarity_sketch(elements: np.ndarray, size: int = SIZE) -> np.ndarray:
    """``size`` coordinates (a power of two) of a set of distinct 64-bit hashes.

    In round i below ``size`` every element falls by hash into one coordinate with a value that sorts behind all
    earlier rounds; in round size + j every element falls into coordinate j. Each coordinate keeps its least value, so
    after at most 2 * size rounds all are filled, and rounds stop as soon as they are.
    """
    place_bits = size.bit_length() - 1
    value_bits = 64 - 2 * place_bits  # a key is coordinate, round, value
    places, shift = np.arange(size, dtype=np.uint64), np.uint64(64 - place_bits)
    filled, out, at = np.zeros(size, bool), np.zeros(size, np.uint64), 0
    while not filled.all():
        rounds = min(size - at, max(1, 16 * size // len(elements))) if at < size else size
        seeds = np.arange(at + 1, at + rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        hashed = _mix(elements[None, :] ^ seeds[:, None])
        if at < size:
            number = np.arange(at, at + rounds, dtype=np.uint64)[:, None] << np.uint64(value_bits)
            keys = ((hashed >> shift << shift) | number | (hashed & np.uint64((1 << value_bits) - 1))).ravel()
            keys.sort()
            where = np.searchsorted(keys, places << shift)
            first = keys[np.minimum(where, len(keys) - 1)]
            new = (first >> shift == places) & (where < len(keys)) & ~filled
            out[new] = first[new]
        else:
            new = ~filled
            out[new] = hashed.min(axis=1)[new]
        filled |= new
        at += rounds
    return out


def _one_bit(sketches: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, as rows of 64-bit numbers."""
    return np.packbits((_mix(sketches) & np.uint64(1)).astype(np.uint8), axis=1).view(">u8").astype(np.uint64).view(np.int64)


_BITS, _FINE = [f"bits{b}" for b in range(SIZE // 64)], [f"fine{b}" for b in range(FINE // 64)]


_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _word_hashes(texts: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word (A-Z in lower case) of all texts, and where each text's words begin."""
    if len(known) > _KEPT_WORDS:
        known.clear()
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    flat = split.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    hashes = np.fromiter((known[w] for w in words), np.uint64, len(words))
    return hashes[flat.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64), split.offsets.to_numpy() - split.offsets[0].as_py()


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words; of fewer words, one of them all."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total += _mix(words[k : n - size + 1 + k] ^ np.uint64(k + 1)) * _POWERS[k % 8]
    return np.unique(_mix(total + np.uint64(size)))


def _sets(part: pa.RecordBatch, shingle: int, known: dict[str, int]) -> Iterator[tuple[int, np.ndarray]]:
    """The row and the shingle hashes of every text that has words."""
    texts = pc.fill_null(part.column("text"), "")
    blank = np.asarray(pc.equal(pc.utf8_length(pc.ascii_trim_whitespace(texts)), 0))
    words, bounds = _word_hashes(texts, known)
    for i in np.flatnonzero(~blank).tolist():
        yield i, shingle_hashes(words[bounds[i] : bounds[i + 1]], shingle)


def _sketcher(shingle: int, bands: int, rows: int):
    offsets = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _POWERS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for part in slices(batches):
            n, high, low = (np.zeros(part.num_rows, np.uint64) for _ in range(3))
            sketch = np.zeros((part.num_rows, SIZE), np.uint64)
            for i, found in _sets(part, shingle, known):
                n[i], high[i], low[i] = len(found), found.sum(), (found * (found | np.uint64(1))).sum()
                sketch[i] = similarity_sketch(found)
            keys = np.repeat(offsets[None, :], part.num_rows, axis=0)
            for r in range(rows):
                keys = _mix(keys + sketch[:, r : rows * bands : rows] * _POWERS[r % 8])
            bits = _one_bit(sketch)
            lists = pa.ListArray.from_arrays(np.arange(0, bands * part.num_rows + 1, bands, dtype=np.int32), keys.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("hash"), *(pa.array(c.view(np.int64)) for c in (n, high, low)), *(pa.array(np.ascontiguousarray(c)) for c in bits.T), lists], ["id", "hash", "n", "high", "low", *_BITS, "bands"])

    return lean(run)


def _fine_sketcher(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for part in slices(batches):
            sketch = np.zeros((part.num_rows, FINE), np.uint64)
            for i, found in _sets(part, shingle, known):
                sketch[i] = similarity_sketch(found, FINE)
            yield pa.RecordBatch.from_arrays([part.column("node"), *(pa.array(np.ascontiguousarray(c)) for c in _one_bit(sketch).T)], ["node", *_FINE])

    return lean(run)


def _apart(x: str, y: str, names: list[str]) -> Column:
    """How many bits of two sketches differ."""
    return sum((F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in names), F.lit(0))


def _verifier(shingle: int, percent: int):
    def grams(text: str) -> set:
        words = text.encode().lower().split()
        return {tuple(words)} if len(words) < shingle else set(zip(*(words[k:] for k in range(shingle))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None, None, None]
        for part in slices(batches, column="text_a"):
            linked = []
            for text_a, text_b in zip(part.column("text_a").to_pylist(), part.column("text_b").to_pylist()):
                if text_a is not last[0]:
                    last[:2] = text_a, last[1] if text_a == last[0] else grams(text_a)
                if text_b is not last[2]:
                    last[2:] = text_b, last[3] if text_b == last[2] else grams(text_b)
                common = len(last[1] & last[3])
                linked.append(100 * common >= percent * (len(last[1]) + len(last[3]) - common))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return lean(run)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b, linked): the pairs of nodes with the verdict of their full sets."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    out = both.mapInArrow(_verifier(shingle, percent), "a long, b long, linked boolean")
    return out.groupBy("a", "b").agg(F.max("linked").alias("linked"))


#: Rounds in which each undecided document is tried against one centre; what they leave open is then searched whole.
STAR_ROUNDS = 3


class _Search:
    """The state of one search: the nodes (distinct sets) that share a bucket, their components, and what has been tried."""

    def __init__(self, members: DataFrame, texts: DataFrame, shingle: int, percent: int, coarse_bits: int, fine_bits: int):
        self.members, self.texts, self.verify = members, texts, lambda pairs: _verified(pairs, texts, shingle, percent)
        self.spark = members.sparkSession
        none = self.spark.range(0)
        self.component = none.select("id", F.col("id").alias("component"))
        self.tried = none.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(True).alias("linked"))
        self.shingle, self.percent, self.coarse_bits, self.fine_bits = shingle, percent, coarse_bits, fine_bits

    def close(self, x: str, y: str) -> Column:
        """Whether sizes and coarse sketches, in columns that begin with ``x`` and ``y``, allow a link."""
        sizes = F.lit(100) * F.least(f"{x}n", f"{y}n") >= F.lit(self.percent) * F.greatest(f"{x}n", f"{y}n")
        return sizes & (_apart(x, y, _BITS) <= self.coarse_bits)

    def placed(self) -> DataFrame:
        return self.members.join(self.component.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))

    def buckets(self, placed: DataFrame, round_: int) -> DataFrame:
        """Of each bucket with several components the one with most members (``top``) and a member of it, the centre."""
        by, kept = F.col("by"), ["node", "n", *_BITS]
        ranked = placed.withColumn("by", F.xxhash64("node", F.lit(round_)))
        per = ranked.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.min("by").alias("by"), *(F.min_by(c, by).alias(f"y_{c}") for c in kept))
        order = F.col("size") * F.lit(1 << 20) + F.pmod("by", F.lit(1 << 20))
        most = lambda c, name: F.max_by(c, order).alias(name)
        found = per.groupBy("key").agg(F.count(F.lit(1)).alias("several"), most("component", "top"), *(most(f"y_{c}", f"y_{c}") for c in kept))
        return found.filter("several > 1").drop("several")

    def untried(self, pairs: DataFrame) -> DataFrame:
        seen = self.tried.select("a", "b").union(self.tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return pairs.join(seen, ["a", "b"], "left_anti")

    def take(self, pairs: DataFrame) -> None:
        """Try pairs, and join the components that links connect. Only links between different components are looked at,
        as links of those components."""
        verdicts = written(self.verify(pairs), "tried")
        self.tried = self.tried.unionByName(verdicts)
        new = self.between(verdicts.filter("linked")).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        new = written(new, "edges")
        if not new.isEmpty():
            moved = connected_components(new).toDF("was", "now")
            stayed = self.component.join(moved, F.col("component") == F.col("was"), "left").select("id", F.coalesce("now", "component").alias("component"))
            later = written(stayed.union(moved.join(self.component, F.col("was") == F.col("id"), "left_anti")), "components")
            drop_written(self.component)
            self.component = later
        drop_written(new)
        tidy(self.spark)

    def between(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose nodes are in different components now, with these as ca and cb."""
        side = lambda c: self.component.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
        both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return both.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b")).filter("ca <> cb")

    def star(self, round_: int) -> None:
        """Try each member that is not in its bucket's largest component against that one's centre; of its buckets'
        centres only the likeliest, so a node has one row here however many buckets and copies it has."""
        placed = self.placed()
        met = placed.join(self.buckets(placed, round_), "key").filter((F.col("component") != F.col("top")) & self.close("", "y_"))
        best = met.groupBy("node").agg(F.min_by("y_node", _apart("", "y_", _BITS)).alias("b")).select(F.col("node").alias("a"), "b")
        self.take(self.untried(best))

    def rest(self) -> None:
        """Try all pairs of different components that share a bucket and whose sizes and both sketches allow a link.

        In each bucket the members outside its largest component meet all others; the largest one's members do not meet
        each other. A bucket is further divided by set size, in steps of the least ratio that a link allows, so that each
        meets three steps at most. Of each two components the likeliest pair is tried first, then all that are left.
        """
        placed = self.placed()
        step = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / self.percent))).cast("int")
        columns = ["key", "band", "node", "n", "component", "bands", "outside", *_BITS, *_FINE]
        open_ = written(placed.join(self.buckets(placed, STAR_ROUNDS).select("key", "top"), "key"), "open")
        fine = self.texts.join(open_.select("node").distinct(), "node", "left_semi").mapInArrow(_fine_sketcher(self.shingle), ", ".join(f"{c} long" for c in ["node", *_FINE]))
        open_ = written(open_.join(fine, "node").withColumn("outside", F.col("component") != F.col("top")).select(*columns, step.alias("step")), "open")
        x = open_.filter("outside").withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
        x = x.select("key", "step", *(F.col(c).alias(f"x_{c}") for c in columns[1:]))
        y = open_.select("key", "step", *(F.col(c).alias(f"y_{c}") for c in columns[1:]))
        far = _apart("x_", "y_", _FINE)
        near = self.close("x_", "y_") & (far <= self.fine_bits)
        earlier = F.exists(F.arrays_zip(F.slice("x_bands", 1, F.col("x_band")).alias("x"), F.slice("y_bands", 1, F.col("x_band")).alias("y")), lambda z: z["x"] == z["y"])
        once = ~F.col("y_outside") | (F.col("x_node") < F.col("y_node"))
        pairs = x.join(y, ["key", "step"]).filter((F.col("x_component") != F.col("y_component")) & once & near & ~earlier)
        components = F.least("x_component", "y_component").alias("ca"), F.greatest("x_component", "y_component").alias("cb")
        pairs = pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"), *components, far.alias("far"))
        pairs = written(pairs.distinct(), "pairs")
        likeliest = pairs.groupBy("ca", "cb").agg(F.min(F.struct("far", "a", "b")).alias("p"))
        self.take(self.untried(likeliest.select("p.a", "p.b")))
        self.take(self.untried(self.between(pairs.select("a", "b")).select("a", "b")))
        drop_written(open_)
        drop_written(pairs)


def _components(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int, coarse_bits: int, fine_bits: int) -> DataFrame:
    """A row per input row: id, hash (of the text), n, node and group (of its set; null: no words or no id), component_id."""
    texts = whole_rows(docs).select("id", "hash", F.col("row").getField("text").cast("string").alias("text"))
    schema = ", ".join(f"{c} long" for c in ["id", "hash", "n", "high", "low", *_BITS]) + ", bands array<long>"
    sketched = written(texts.select("id", "hash", "text").mapInArrow(_sketcher(shingle, bands, rows), schema), "sketches")
    sets = sketched.filter("n > 0 and id is not null").groupBy("n", "high", "low").agg(F.min(F.struct("id", "hash", *_BITS, "bands")).alias("r"))
    nodes = written(sets.select("n", "high", "low", "r.*").withColumn("node", F.monotonically_increasing_id()), "sets")
    places = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = places.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("key")
    members = written(places.join(shared, "key").join(nodes.select("node", "n", *_BITS, "bands"), "node"), "members")
    chosen = nodes.join(members.select("node").distinct(), "node", "left_semi").select("id", "hash", "node")
    candidates = written(texts.join(chosen, ["id", "hash"]).select("node", "text"), "texts")
    search = _Search(members, candidates, shingle, percent, coarse_bits, fine_bits)
    for round_ in range(STAR_ROUNDS):
        search.star(round_)
    search.rest()
    linked = nodes.select("node", "id").join(search.component.withColumnRenamed("id", "node"), "node")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    groups = linked.join(least, "component").select("node", F.col("component").alias("group"), "least")
    known = nodes.select("n", "high", "low", "node", "id").join(groups, "node", "left")
    known = known.select("n", "high", "low", "node", F.coalesce("group", "node").alias("group"), F.coalesce("least", "id").alias("least"))
    rows_ = sketched.select("id", "hash", "n", "high", "low").withColumn("n", F.when(F.col("id").isNotNull(), F.col("n")).otherwise(-F.col("n")))
    out = rows_.join(known, ["n", "high", "low"], "left")
    return out.select("id", "hash", F.abs("n").alias("n"), "node", "group", F.coalesce("least", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, coarse_bits: int = 51, fine_bits: int = 273) -> DataFrame:
    """Link documents (doc_id, text) whose sets of ``shingle``-word shingles have a Jaccard similarity of ``percent``
    or more, and give each its component.

    Equal sets (by size and 128 bits over all shingles) are collapsed first, so copies cost one row each. Sketches of the
    distinct sets go into ``bands`` bands of ``rows`` coordinates: at a similarity of 0.8 a pair shares none in 5 cases of
    10**8. Inside a band's bucket not all pairs are listed. In star rounds each member outside a bucket's largest
    component is tried against a centre of that one. Then all pairs of different components that still share a bucket are
    tried. A pair is passed over without reading its texts only if its set sizes exclude a link or its one-bit sketches
    differ too much: in more than ``coarse_bits`` of 256 (25.6 are expected at 0.8; more than 51 in about 1 case of
    10**6) or, in the last step, ``fine_bits`` of 2048 (204.8 expected; more than 273 in about 1 of 10**6). With
    ``coarse_bits=256, fine_bits=2048`` no pair is passed over for its bits; a lower ``percent`` needs higher bounds. Every
    link is confirmed on the full sets.

    Returns a row per input row: doc_id, n_shingles, component_id (the least doc_id reachable), kept (doc_id =
    component_id). Null or blank texts have no shingles and stand alone; a text of fewer words is one shingle. Rows
    that share a doc_id are linked by their texts alone, as other rows are. A row with a null doc_id is alone, its
    component null and kept true. An empty table gives no rows.
    """
    out = _components(docs, shingle, percent, bands, rows, coarse_bits, fine_bits)
    same = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", same.alias("kept"))


def one_of_each(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, coarse_bits: int = 51, fine_bits: int = 273) -> DataFrame:
    """The documents, with all their columns, without the near-duplicates that :func:`near_duplicates` finds: of each
    component one row of the least doc_id stays. Rows without words stay, but for repeats of both id and text; rows with a
    null doc_id all stay; an empty table gives no rows."""
    found = _components(docs, shingle, percent, bands, rows, coarse_bits, fine_bits).filter("id is not null")
    first = found.groupBy(F.coalesce("group", F.lit(-1)).alias("group"), F.when(F.col("group").isNull(), F.col("id")).alias("alone"), F.when(F.col("group").isNull(), F.col("hash")).alias("text"))
    keep = first.agg(F.min(F.struct("id", "hash")).alias("k")).select("k.*")
    times = found.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("times"))
    keep = written(keep.join(times, ["id", "hash"]), "kept")
    every = whole_rows(docs)
    stays = every.join(keep, ["id", "hash"])
    out = opened(stays.filter("times = 1"), docs.columns).union(opened(every.filter("id is null"), docs.columns))
    if not keep.filter("times > 1").isEmpty():  # rows that are repeated in id and text: any one of them
        out = out.union(opened(stays.filter("times > 1").groupBy("id", "hash").agg(F.first("row").alias("row")), docs.columns))
    return out
