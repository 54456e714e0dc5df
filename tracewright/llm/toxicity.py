"""Toxicity: a weighted finite-state pattern grammar over clauses, its lexicon and weights learned from labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import crc_mod, doc_text, lean, named, slices, written

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)

#: Seed words of the grammar's classes; insults beyond these, in any language, are learned.
SEEDS = {
    INSULT: "idiot moron loser scum clown pathetic worthless stupid trash disgusting dumb imbecile idiota imbécile dummkopf".split(),
    THREAT: "kill hurt destroy punch beat shoot burn töten schlagen tuer frapper matar golpear".split(),
    TARGET: "you your yours yourself they them their he him she her these those du dich euch ihr tu toi vous te ti ustedes".split(),
    NEGATION: "not no never neither nor isn't aren't don't nicht kein keine nie pas jamais ni nunca".split(),
    REPORT: "said says wrote writes quoted quoting claimed called reported sagte sagt schrieb dit écrit dijo dice escribió".split(),
}
_LETTERS = re.compile(r"[^\W\d_]+")
_STOPS = (".", "!", "?", ";", ":")
PREFIXES = range(4, 8)  # lengths of word beginnings that can be arcs of the lexicon
FEATURES = ("strongest", "total", "clauses", "targeted", "negated", "reported", "threats")


Machine = Callable[[int, int, int], tuple[int, int]]  # (state, class, marks read) to (state, marks written)

#: What a token can be marked as: an insult, negated, reported, aimed at a target, a threat against a target.
PLAIN, NEGATED, REPORTED, TARGETED, MENACE = 1, 2, 4, 8, 16


def _insult(state: int, kind: int, marks: int) -> tuple[int, int]:
    """Marks insults, and a target that follows one in its clause."""
    return (1, marks | PLAIN) if kind == INSULT else (0, marks) if kind == END else (state, marks | (TARGETED if state and kind == TARGET else 0))


def _negation(state: int, kind: int, marks: int) -> tuple[int, int]:
    """Marks insults within three tokens after a negation; the state is how many are left."""
    left = 3 if kind == NEGATION else 0 if kind == END else max(0, state - 1)
    return left, marks | (NEGATED if state and marks & PLAIN else 0)


def _report(state: int, kind: int, marks: int) -> tuple[int, int]:
    """Marks insults after a verb of speech in the clause."""
    return (0 if kind == END else 1 if kind == REPORT else state), marks | (REPORTED if state and marks & PLAIN else 0)


def _target(state: int, kind: int, marks: int) -> tuple[int, int]:
    """Marks insults and threats after a target in the clause."""
    here = (TARGETED if marks & PLAIN else MENACE if kind == THREAT else 0) if state else 0
    return (0 if kind == END else 1 if kind == TARGET else state), marks | here


def _threat(state: int, kind: int, marks: int) -> tuple[int, int]:
    """Marks a target that follows a threat in its clause."""
    return (0 if kind == END else 1 if kind == THREAT else state), marks | (MENACE if state and kind == TARGET else 0)


def compose(machines: tuple[Machine, ...]) -> tuple[list[list[int]], list[list[int]]]:
    """The composition of transducers, each reading what the one before writes: next state and marks by state and class,
    for the states that can be reached from the start, which is 0."""
    number, todo, after, marks = {(0,) * len(machines): 0}, [(0,) * len(machines)], [], []
    while len(after) < len(todo):
        states, row, out = todo[len(after)], [], []
        for kind in range(7):
            written_, next_ = 0, []
            for machine, state in zip(machines, states):
                state, written_ = machine(state, kind, written_)
                next_.append(state)
            if tuple(next_) not in number:
                number[tuple(next_)] = len(todo)
                todo.append(tuple(next_))
            row.append(number[tuple(next_)])
            out.append(written_)
        after.append(row)
        marks.append(out)
    return after, marks


_AFTER, _MARKS = compose((_insult, _negation, _report, _target, _threat))


@dataclass
class Model:
    """Lexicon weights by word and by word beginning, and the logistic weights of the clause features."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEEDS[INSULT], 3.0))
    prefixes: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.5, 1.0, 0.5, 0.3, -0.8, -0.8, 1.0)
    bias: float = -3.0

    def symbol(self, chunk: str) -> tuple[int, float, bool]:
        """Class, insult weight and clause end of what stands between blanks."""
        kind, weight = OTHER, 0.0
        for w in _LETTERS.findall(chunk.lower()):
            found = max([self.words.get(w, 0.0), *(self.prefixes.get(w[:n], 0.0) for n in PREFIXES if n <= len(w))])
            if found > weight:
                kind, weight = INSULT, found
            elif kind == OTHER:
                kind = _CLASS.get(w, OTHER)
        return kind, weight, chunk.endswith(_STOPS)


_CLASS = {w: kind for kind, words in SEEDS.items() if kind != INSULT for w in words}


def _symbols(texts: pa.Array, model: Model, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of all texts its class, weight and clause end, and where each text's tokens begin. A line's end
    ends a clause."""
    split = pc.ascii_split_whitespace(pc.replace_substring(pc.fill_null(texts, ""), "\n", " ; "))
    flat = split.flatten().dictionary_encode()
    if len(known) > 100_000:
        known.clear()
    found = []
    for c in flat.dictionary.to_pylist():
        s = known.get(c)
        if s is None:
            s = known[c] = model.symbol(c)
        found.append(s)
    which = flat.indices.to_numpy()
    kinds, weights, ends = (np.array([x[k] for x in found], t)[which] if found else np.zeros(0, t) for k, t in enumerate((np.int8, np.float64, bool)))
    return kinds, weights, ends, split.offsets.to_numpy() - split.offsets[0].as_py()


def _features(kinds: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> list[float]:
    """The features of one text: the composed transducer runs over each clause that holds an insult or a threat."""
    hits = np.flatnonzero((kinds == INSULT) | (kinds == THREAT))
    if not len(hits):
        return [0.0] * len(FEATURES)
    stops = np.flatnonzero(ends)
    clause = np.searchsorted(stops, hits)
    strongest = total = clauses = targeted = negated = reported = threats = 0.0
    for c in dict.fromkeys(clause.tolist()):
        a, b = (stops[c - 1] + 1 if c else 0), (stops[c] + 1 if c < len(stops) else len(kinds))
        state, plain = 0, 0.0
        for kind, weight in zip(kinds[a:b].tolist(), weights[a:b].tolist()):
            mark = _MARKS[state][kind]
            state = _AFTER[state][kind]
            if not mark:
                continue
            if mark & NEGATED:
                negated += weight
            elif mark & REPORTED:
                reported += weight
            elif mark & PLAIN:
                plain += weight
                strongest = max(strongest, weight)
            targeted += bool(mark & TARGETED)
            threats += bool(mark & MENACE)
        total += plain
        clauses += plain > 0
    return [strongest, *np.log1p([total, clauses, targeted, negated, reported, threats]).tolist()]


def _scan(model: Model, texts: pa.Array, known: dict) -> np.ndarray:
    kinds, weights, ends, bounds = _symbols(texts, model, known)
    return np.array([_features(kinds[a:b], weights[a:b], ends[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]).reshape(-1, len(FEATURES))


def _known(labels: DataFrame, held_out: int) -> DataFrame:
    """(doc_id, toxic) of the labels outside the held-out fold, one a doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(crc_mod("doc_id", 4) != held_out)


def _labelled(docs: DataFrame, known: DataFrame, max_labelled: int) -> DataFrame:
    """(toxic, text) of at most ``max_labelled`` labelled rows: those whose ids hash lowest, at most half of them toxic."""
    order = F.xxhash64("doc_id")
    picked = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(max_labelled // 2) for k in (0, 1)]
    return docs.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("toxic", "text")  # ids only, at most max_labelled


def _keys(text: str) -> set[str]:
    words = set(_LETTERS.findall(text.lower()))
    return {f"w{w}" for w in words} | {f"p{w[:n]}" for w in words for n in PREFIXES if n < len(w)}


def learn(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, held_out: int = 2, min_gain: float = 30.0) -> Model:
    """Learn the lexicon and the clause weights from labels (doc_id, toxic) of rows with crc32(doc_id) mod 4 != ``held_out``.

    A word or word beginning becomes an arc if its documents are toxic so much more often that the log-likelihood
    ratio is at least ``min_gain`` and the smoothed odds at least 20 times those of all documents; the log of that
    factor is its weight. The sample's bound is ``max_labelled``; without toxic or clean labels the seeds stay.

    The sample takes its classes apart, so each row counts by its class's share of all labelled rows over its share of
    the sample: gains, weights and bias are those of all labels' rate whatever their number.
    """
    known = _known(labels, held_out)
    sample = written(_labelled(doc_text(docs), known, max_labelled), "labelled")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    model = Model()
    if not bad or not good:
        return model
    labelled = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id")  # a row per text, as in the sample
    whole = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows_share = (bad + good) / (whole[1] + whole[0])
    w_bad, w_good = whole[1] / bad * rows_share, whole[0] / good * rows_share  # both 1 where the sample is all

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            keys = list(toxic.keys() | clean.keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["key", "bad", "good"])
            toxic.clear()
            clean.clear()
            return out

        for part in slices(batches):
            for kind, text in zip(part.column("toxic").to_pylist(), part.column("text").to_pylist()):
                (toxic if kind else clean).update(_keys(text or ""))
                if len(toxic) + len(clean) > 40_000:  # what a task holds stays small; Spark adds the parts up
                    yield counted()
        yield counted()

    counts = sample.mapInArrow(lean(count), "key string, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    seen_bad, seen_good = F.col("bad") * w_bad, F.col("good") * w_good
    part, rate = seen_bad + seen_good, bad * w_bad / (bad * w_bad + good * w_good)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    gain = 2 * (term(seen_bad, part * rate) + term(seen_good, part * (1 - rate)))
    factor = F.log(((F.col("bad") + 0.5) / (bad + 1.0)) / ((F.col("good") + 0.5) / (good + 1.0)))
    for r in counts.filter((gain >= min_gain) & (factor >= float(np.log(20.0)))).select("key", factor.alias("weight")).collect():
        (model.words if r["key"][0] == "w" else model.prefixes)[r["key"][1:]] = r["weight"]

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for part in slices(batches):
            found = _scan(model, part.column("text"), known)
            yield pa.RecordBatch.from_arrays([part.column("toxic"), *(pa.array(found[:, k]) for k in range(len(FEATURES)))], ["toxic", *FEATURES])

    rows = sample.mapInArrow(lean(examine), "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    toxic = rows["toxic"].to_numpy(float)
    model.weights, model.bias = _logistic(rows[list(FEATURES)].to_numpy(), toxic, np.where(toxic == 1, w_bad, w_good))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[tuple[float, ...], float]:
    """Weights and bias of a ridge logistic regression, each row counted ``share`` times, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (share * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w[:-1].tolist()), float(w[-1])


def _probabilities(model: Model, texts: pa.Array, known: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_scan(model, texts, known) @ np.array(model.weights) + model.bias, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, score): the probability that each whole text is toxic. Null and empty texts match no clause and
    get the bias's probability; repeated rows are scored one by one; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(_probabilities(model, part.column("text"), known))], ["doc_id", "text", "score"])

    return doc_text(docs).mapInArrow(lean(run), "doc_id long, text string, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is below ``threshold``, with all their columns. Null texts are scored as empty ones;
    repeated rows are judged one by one; an empty table gives no rows."""

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict = {}
        for texts in batches:
            parts = slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]))
            yield pa.array(np.concatenate([_probabilities(model, part.column("text"), known) for part in parts] or [np.zeros(0)]))

    score_of = F.arrow_udf(lean(scored), "double", F.ArrowUDFType.SCALAR_ITER)
    return docs.filter(score_of(named("text").cast("string")) < threshold)
