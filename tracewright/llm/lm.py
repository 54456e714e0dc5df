"""LM scoring: Brown class-based n-grams. Exchange clustering assigns words to classes; class transitions and word
emissions give a smoothed probability of every text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import crc_mod, doc_text, lean, slices, written

_SLICE_ROWS = 1_000
_KEPT = 150_000
_hashes: dict[str, int] = {}
END = xxhash.xxh64_intdigest("</text>", seed=1)
BUCKETS = 1024  # of rare words, by their last letters


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and bucket of every token of all texts (words, A-Z in lower case, then the end), and where each text's begin."""
    if len(_hashes) > _KEPT:
        _hashes.clear()
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    flat = split.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    for w in words:
        if w not in _hashes:
            _hashes[w] = xxhash.xxh64_intdigest(w)
    ends = pc.utf8_slice_codeunits(flat.dictionary, -3).dictionary_encode()
    suffix = np.array([zlib.crc32(s.encode()) % BUCKETS for s in ends.dictionary.to_pylist()] or [0], np.int64)
    which, bounds = flat.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    hashes = np.fromiter((_hashes[w] for w in words), np.uint64, len(words))[which]
    buckets = suffix[ends.indices.to_numpy()][which]
    real = np.fromiter((w != "" for w in words), bool, len(words))[which]  # a blank text splits into one empty word
    sizes = np.add.reduceat(np.append(real, False), bounds[:-1]) * (np.diff(bounds) > 0) if len(texts) else np.zeros(0, np.int64)
    new = np.concatenate(([0], np.cumsum(sizes + 1)))
    out_hash, out_bucket = np.full(new[-1], END, np.uint64), np.zeros(new[-1], np.int64)
    body = np.ones(new[-1], bool)
    body[new[1:] - 1] = False
    out_hash[body], out_bucket[body] = hashes[real], buckets[real]
    return out_hash, out_bucket, new


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def word_counts(training: DataFrame) -> DataFrame:
    """(word, bucket, c) of every token of the training texts; a word is its 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, _SLICE_ROWS):
            hashes, buckets, _ = _tokens(part.column("text"))
            found, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(found), pa.array(buckets[first].astype(np.int32)), pa.array(counts)], ["word", "bucket", "c"])

    return training.select("text").mapInArrow(lean(run), "word long, bucket int, c long").groupBy("word", "bucket").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The frequent words: ``words`` sorted, their counts, and the type (0..) of those frequent enough for their own, else
    -1. Rare words have the type of their bucket, behind those of words; the last type is the start of a text."""

    words: np.ndarray
    counts: np.ndarray
    types: np.ndarray
    own: int

    @property
    def start(self) -> int:
        return self.own + BUCKETS

    def look_up(self, hashes: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Type of every token, and its count where the word is frequent, else -1."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        found = self.words[at] == hashes
        own = np.where(found, self.types[at], -1)
        return np.where(own >= 0, own, self.own + buckets), np.where(found, self.counts[at], -1)

    def before(self, types: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The type before each token, the start before the first of each text."""
        out = np.empty_like(types)
        out[1:] = types[:-1]
        out[bounds[:-1]] = self.start
        return out


def frequent(counts: DataFrame, total: int, own_share: int, known_share: int) -> Vocabulary:
    """Words that make up at least 1/``known_share`` of all tokens, so at most ``known_share`` of them; those of at least
    1/``own_share`` get a type of their own."""
    rows = counts.filter(F.col("c") * known_share >= total).select("word", "c").toPandas()
    words, c = rows["word"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64)
    order = np.argsort(words)
    words, c = words[order], c[order]
    own = (c * own_share >= total) | (words == END)
    types = np.where(own, np.cumsum(own) - 1, -1)
    return Vocabulary(words, c, types, int(own.sum()))


def type_bigrams(training: DataFrame, vocabulary) -> DataFrame:
    """(x, y, n): how often type y follows type x in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for part in slices(batches, _SLICE_ROWS):
            hashes, buckets, bounds = _tokens(part.column("text"))
            types, _ = v.look_up(hashes, buckets)
            pairs, counts = np.unique(v.before(types, bounds) << 20 | types, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    sums = training.select("text").mapInArrow(lean(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return sums.select(F.shiftright("pair", 20).cast("int").alias("x"), F.col("pair").bitwiseAND(F.lit((1 << 20) - 1)).cast("int").alias("y"), "n")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def best_class(own: int, out: np.ndarray, into: np.ndarray, loops: float, n: np.ndarray) -> tuple[int, float]:
    """The class that a type is best moved to, and what that adds to the log-likelihood of class bigrams.

    ``out`` and ``into`` are the type's bigram counts by class of the other type, its own ``loops`` left out; ``n`` the
    counts of class bigrams with the type where it is.
    """
    n = n.copy()
    n[own] -= out
    n[:, own] -= into
    n[own, own] -= loops
    rows, cols = n.sum(1), n.sum(0)
    fn, diagonal = _xlogx(n), np.diag(n)
    gain = (_xlogx(n + out) - fn).sum(1) + (_xlogx(n.T + into) - fn.T).sum(1)
    gain -= (_xlogx(diagonal + out) - _xlogx(diagonal)) + (_xlogx(diagonal + into) - _xlogx(diagonal))
    gain += _xlogx(diagonal + out + into + loops) - _xlogx(diagonal)
    gain -= _xlogx(rows + out.sum() + loops) - _xlogx(rows) + _xlogx(cols + into.sum() + loops) - _xlogx(cols)
    best = int(gain.argmax())
    return best, float(gain[best] - gain[own])


def exchange(bigrams: DataFrame, types: int, classes: int, rounds: int, start: int) -> np.ndarray:
    """The class of every type. Each round tries half of the types against every class, all at once from the same class
    counts, and moves those that gain; it ends early when few move. The start keeps class ``classes`` for itself."""
    pair = lambda k: F.collect_list(F.struct(F.col(k).alias("t"), "n"))
    out = bigrams.groupBy(F.col("x").alias("w")).agg(pair("y").alias("outs"))
    into = bigrams.groupBy(F.col("y").alias("w")).agg(pair("x").alias("ins"))
    near = written(out.join(into, "w", "full").repartition(F.col("w")), "neighbours")  # a row has at most one entry a type
    spark, k = bigrams.sparkSession, classes + 1
    of = np.arange(types) % classes
    of[start] = classes

    def side(lists: pa.ListArray, w: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row its neighbours' counts by class without its own loops, and the loops."""
        flat = lists.flatten()
        t, n = (flat.field(c).to_numpy() for c in ("t", "n"))
        row = np.repeat(np.arange(len(w)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        loop = t == w[row]
        sums = np.bincount(row * k + of[t], np.where(loop, 0, n), minlength=len(w) * k)
        return sums.reshape(len(w), k), np.bincount(row, np.where(loop, n, 0), minlength=len(w))

    def vectors(batches, of: np.ndarray):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                w = part.column("w").to_numpy()
                out, loops = side(part.column("outs"), w, of)
                into, same = side(part.column("ins"), w, of)
                yield w, out, into, np.maximum(loops, same)

    for round_ in range(rounds):
        held = spark.sparkContext.broadcast(of)

        def tally(batches, held=held):
            of, total = held.value, np.zeros((k, k))
            for w, out, _, loops in vectors(batches, of):
                np.add.at(total, of[w], out)
                np.add.at(total, (of[w], of[w]), loops)
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "n"])

        n = np.zeros((k, k))
        for r in near.mapInArrow(tally, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
            n[r["i"], r["j"]] = r["n"]

        def move(batches, held=held, n=n, round_=round_):
            of = held.value
            for w, outs, ins, loops in vectors(batches, of):
                moves = []
                for x, out, into, loop in zip(w.tolist(), outs, ins, loops):
                    if x != start and (x * 2654435761 >> 7) % 2 == round_ % 2:
                        best, gain = best_class(of[x], out, into, loop, n)
                        if best != of[x] and best != classes and gain > 1e-6:
                            moves.append((x, best))
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in moves], pa.int64()), pa.array([m[1] for m in moves], pa.int64())], ["w", "best"])

        moved = near.mapInArrow(move, "w long, best long").collect()
        of = of.copy()
        for r in moved:
            of[r["w"]] = r["best"]
        if len(moved) < 0.005 * types and round_:
            break
    return of


@dataclass
class ClassModel:
    """What a task needs to score texts: the vocabulary, the classes, and the parts of a token's probability."""

    vocabulary: Vocabulary
    of: np.ndarray  # class by type
    step: np.ndarray  # probability of a class after a class
    emission: np.ndarray  # probability of a type in its class
    per_half: np.ndarray  # probability of a word in its type for each (count + 0.5): by type; of own types 1 / (count + 0.5)
    tokens: int
    words: int
    mix: float

    @property
    def base_size(self) -> float:
        return self.tokens + 0.5 * (self.words + 1)


def learn(training: DataFrame, *, classes: int = 64, rounds: int = 8, own_share: int = 1 << 15, known_share: int = 1 << 19, mix: float = 0.9) -> tuple[ClassModel | None, DataFrame]:
    """The class model of the training texts, and the written table of all word counts. No texts: no model."""
    counts = written(word_counts(training), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, words = sums["n"] or 0, sums["v"]
    if not tokens:
        return None, counts
    v = frequent(counts, tokens, own_share, known_share)
    spark = training.sparkSession
    bigrams = written(type_bigrams(training, spark.sparkContext.broadcast(v)), "bigrams")
    types = v.own + BUCKETS + 1
    of = exchange(bigrams, types, classes, rounds, v.start)
    held = spark.createDataFrame([(int(t), int(c)) for t, c in enumerate(of)], "t int, c int")  # types are bounded
    by_type = np.zeros(types)
    for r in bigrams.groupBy("y").agg(F.sum("n").alias("n")).collect():
        by_type[r["y"]] = r["n"]
    n = np.zeros((classes + 1, classes + 1))
    sides = bigrams.join(F.broadcast(held.toDF("x", "cx")), "x").join(F.broadcast(held.toDF("y", "cy")), "y")
    for r in sides.groupBy("cx", "cy").agg(F.sum("n").alias("n")).collect():
        n[r["cx"], r["cy"]] = r["n"]
    step = (n + 0.1) / (n.sum(1, keepdims=True) + 0.1 * (classes + 1))
    weight = by_type + np.where(by_type > 0, 0.5, 0.01)  # most buckets of a small corpus are empty and take little
    emission = weight / np.bincount(of, weight, minlength=classes + 1)[of]
    own = v.types >= 0
    rare = counts.join(F.broadcast(_own_words(spark, v)), "word", "left_anti").groupBy("bucket").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    per_half = np.full(types, 1 / 0.5)
    per_half[v.types[own]] = 1 / (v.counts[own] + 0.5)
    for b in range(BUCKETS):
        per_half[v.own + b] = 1 / 1.0  # an empty bucket: only its unknown word, of weight 0.5 + 0.5
    for r in rare:
        per_half[v.own + r["bucket"]] = 1 / (r["n"] + 0.5 * (r["v"] + 1))
    return ClassModel(v, of, step, emission, per_half, int(tokens), int(words), mix), counts


def _own_words(spark, v: Vocabulary) -> DataFrame:
    return spark.createDataFrame([(int(w),) for w in v.words[v.types >= 0].view(np.int64)], "word long")


PARTS = "doc_id long, text_hash long, word long, tf long, texts long, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, model: ClassModel | None, counts: DataFrame, *, fold: int = 1, folds: int = 5) -> DataFrame:
    """Score every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The probability of a token is ``mix`` times that of its class after the class before, its type in the class and
    its word in the type, plus the rest times its share of all tokens. Counts of frequent words are broadcast; rare
    words, each less than one in ``known_share`` tokens, are joined with the table of counts, so no key is hot.
    """
    texts = doc_text(docs)
    if model is None:
        return _without_training(texts, fold, folds)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        base_size = m.base_size
        for part in slices(batches, _SLICE_ROWS):
            hashes, buckets, bounds = _tokens(part.column("text"))
            types, known = m.vocabulary.look_up(hashes, buckets)
            before = m.vocabulary.before(types, bounds)
            factor = m.mix * m.step[m.of[before], m.of[types]] * m.emission[types] * m.per_half[types] + (1 - m.mix) / base_size
            halves = np.where(known >= 0, np.log10(np.maximum(known, 0) + 0.5), 0.0)  # of rare words the join adds it
            begin = bounds[:-1]
            size = np.diff(bounds)
            base = np.add.reduceat(halves, begin) - size * np.log10(base_size)
            full = np.add.reduceat(halves + np.log10(factor), begin)
            sure = np.add.reduceat((known > 0).astype(np.int64), begin)
            own = np.fromiter((xxhash.xxh64_intdigest(t or "") for t in part.column("text").to_pylist()), np.uint64, part.num_rows)
            rare = np.flatnonzero(known < 0)
            doc = np.repeat(np.arange(part.num_rows), size)[rare]
            order = np.lexsort((hashes[rare], doc))
            doc, word = doc[order], hashes[rare][order]
            first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])))) if len(doc) else np.zeros(0, np.int64)
            tf = np.diff(np.append(first, len(doc)))
            ids = part.column("doc_id").take(pa.array(np.concatenate((np.arange(part.num_rows), doc[first]))))
            pad = np.zeros(len(first), np.int64)
            yield pa.RecordBatch.from_arrays([
                ids, _signed(np.concatenate((own, own[doc[first]]))), _signed(np.concatenate((own, word[first]))),
                pa.array(np.concatenate((np.zeros(part.num_rows, np.int64), tf))), pa.array(np.concatenate((np.ones(part.num_rows, np.int64), pad))),
                pa.array(np.concatenate((size, pad))), pa.array(np.concatenate((sure, pad))),
                pa.array(np.concatenate((base, pad * 0.0))), pa.array(np.concatenate((full, pad * 0.0))),
            ], ["doc_id", "text_hash", "word", "tf", "texts", "n_tokens", "n_known", "base", "score"])

    parts = texts.mapInArrow(lean(run), PARTS).join(counts.select("word", "c"), "word", "left")
    half = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    # rows that are equal in id and text meet here, count as texts, and come out as often as they went in
    sums = parts.groupBy("doc_id", "text_hash").agg(
        F.sum("texts").alias("texts"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + half).alias("base"), F.sum(F.col("score") + half).alias("score"),
    )
    whole = lambda c: F.expr(f"{c} div texts").alias(c)
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("texts")))).select(
        "doc_id", (crc_mod("doc_id", folds) == fold).alias("held_out"), whole("n_tokens"), whole("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("texts")).alias("base_score"), (F.col("score") / F.col("texts")).alias("score"),
    )


def _without_training(texts: DataFrame, fold: int, folds: int) -> DataFrame:
    """Without training tokens every token is the one unknown word, of probability 1."""
    blanks = F.lit(" \t\n\x0b\x0c\r")
    trimmed = F.btrim(F.coalesce("text", F.lit("")), blanks)
    n = F.when(trimmed == "", 1).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+")) + 1).cast("long")
    zero = F.lit(0).cast("long")
    return texts.select("doc_id", (crc_mod("doc_id", folds) == fold).alias("held_out"), n.alias("n_tokens"), zero.alias("n_known"), zero.alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))


def class_scores(docs: DataFrame, *, fold: int = 1, folds: int = 5, **options) -> DataFrame:
    """Learn from the documents whose crc32(doc_id as text) mod ``folds`` is not ``fold`` and score all of them.

    Null and empty texts are the end token alone. Repeated rows are scored, and learned, as often as they come; a null
    doc_id counts as the empty text in the fold. An empty table gives no rows. Words are told apart by 64-bit hashes.
    """
    training = docs.filter(crc_mod("doc_id", folds) != fold)
    model, counts = learn(doc_text(training), **options)
    return score(docs, model, counts, fold=fold, folds=folds)
