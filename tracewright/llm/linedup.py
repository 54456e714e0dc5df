"""Line dedup: a segment-partition edit join in DataFrame functions only."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import tidy, whole_rows, written

_BLANKS = " \t\n\x0b\x0c\r"
#: Characters whose counts, modulo 8, a line's signature holds, sixteen in a number: an edit changes at most two, by one.
SIGNATURE = ("etaoinshrdlucmfw", "ypvbgkjqxzé,. -'")
#: Characters of a line that segments divide at most, at its beginning and end. Edits there are edits of the line, so no pair is lost.
SEGMENTED = 240


def _bounds(low: int, high: int | None, threshold: int) -> list[int]:
    """The lower bounds of the length classes from ``low`` to ``high`` - 1 characters: they grow by a fifth each, to
    ``SEGMENTED``, and none is narrower than ``threshold``, so that lines as near as that are in one class or two that follow."""
    out, size = [min(low, SEGMENTED)], float(low)
    while (size := size * 1.2) < min(SEGMENTED, high or SEGMENTED):
        if math.ceil(size) - out[-1] >= threshold:
            out.append(math.ceil(size))
    for end, own in ((SEGMENTED, not high or high > SEGMENTED), (high, False)):
        while end and len(out) > 1 and 0 <= end - out[-1] < threshold:
            out.pop()
        out += [SEGMENTED] if own and out[-1] < SEGMENTED else []
    return out


def _bound(n: Column, bounds: list[int]) -> Column:
    """The lower bound of the length class of ``n`` characters."""
    return functools.reduce(lambda found, bound: F.when(n >= bound, bound).otherwise(found), bounds[1:], F.lit(bounds[0]))


def _keyed(classes: DataFrame, low: int, high: int | None, threshold: int) -> DataFrame:
    """(h, key, own): hashes of a line's own segments (``own``), if it has ``low`` to ``high`` - 1 characters, and of the
    substrings that can equal a segment of a line that is as long or up to ``threshold`` characters shorter.

    A line has as many characters in segments as its length class has at least: the first half of the segments (and the
    middle one) divide its beginning, the others its end. With at most ``threshold`` edits there is a segment i that none
    touches, before which there are i and behind which at most ``threshold`` - i. So in the longer line it stands at most
    i places off, from the beginning, and at most ``threshold`` - i, from the end: the smaller number is tried.
    """
    parts = threshold + 1
    ending = threshold // 2 + 1  # the first segment that is placed from the end
    places = [(i, s) for i in range(parts) for s in range(-min(i, threshold - i), min(i, threshold - i) + 1)]
    n = F.col("n")
    lines = classes.filter((n >= low) & (n < high + threshold if high else F.lit(True))).select("h", "n", F.col("r.line").alias("line"))

    inside, bounds = n < high if high else F.lit(True), _bounds(low, high, threshold)
    view = lambda n, mine: F.struct(_bound(n, bounds).alias("bound"), F.lit(mine).alias("mine"))
    longer = (n - threshold >= low) & (~inside | (_bound(n - threshold, bounds) != _bound(n, bounds)))
    views = F.array(F.when(inside, view(n, True)), F.when(longer, view(n - threshold, False)))
    rows = lines.select("*", F.explode(views).alias("v")).filter("v is not null").select("h", "n", "line", "v.bound", "v.mine")
    rows = rows.withColumn("size", F.floor(F.col("bound") / parts).cast("int")).withColumn("short", F.lit(parts) - F.col("bound") % parts)

    def before(i: int) -> Column:
        """The characters in the segments before segment i."""
        return F.lit(i) * F.col("size") + F.greatest(F.lit(0), F.lit(i) - F.col("short"))

    rows = rows.withColumn("from", F.greatest(F.lit(0), n - F.col("bound") + before(ending) - (threshold - ending)))
    rows = rows.select(
        "h", "bound", "mine", "size", "short", (n - F.col("bound") - F.col("from")).alias("back"),
        F.substring("line", F.lit(1), before(ending) + threshold // 2).alias("head"), F.substring("line", F.col("from") + 1, n).alias("tail"),
    )

    def key(i: int, s: int) -> Column:
        start = F.lit(1 + s) + before(i) + (F.lit(0) if i < ending else F.col("back"))
        size = F.col("size") + F.when(F.lit(i) >= F.col("short"), 1).otherwise(0)
        return F.xxhash64(F.substring("head" if i < ending else "tail", start, size), F.lit(i), "bound", F.lit(threshold))

    keys = rows.select("h", "mine", F.posexplode(F.array(*(key(i, s) for i, s in places))).alias("place", "key"))
    first = [k for k, (_, s) in enumerate(places) if s == 0]
    return keys.select("h", "key", (F.col("mine") & F.col("place").isin(first)).alias("own"))


#: Four bits for each count modulo 8, of which as many differ between two counts as these are apart, around the circle.
_CIRCLE = (0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000)


def _signature(line: Column) -> Column:
    def packed(letters: str) -> Column:
        out, codes = F.lit(0).cast("long"), F.lit(sum(code << 4 * count for count, code in enumerate(_CIRCLE)))
        for k, letter in enumerate(letters):
            fewer = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))  # bytes need not be counted
            count = F.shiftright(fewer, len(letter.encode()) - 1).bitwiseAND(F.lit(7))
            code = F.call_function("shiftright", codes, count * 4).bitwiseAND(F.lit(15))
            out = out.bitwiseOR(F.shiftleft(code, 4 * k))
        return out

    return F.struct(*(packed(letters).alias(f"s{i}") for i, letters in enumerate(SIGNATURE)))


def _signatures_apart(a: str, b: str) -> Column:
    """By how much the counts of two signatures differ in all; counts that differ by more than 4 look nearer, never farther."""
    return sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(len(SIGNATURE))), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, wherever the optimiser puts the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Characters of the pieces that are compared whole to find where two lines part; what they leave in common is read by the masks.
_PIECES = tuple(1 << k for k in range(16, -1, -1))


def _common(x: Column, y: Column, most: Column, start) -> Column:
    """How many of ``most`` characters two lines have in common; ``start`` places a piece, by the characters before and its length."""

    def longer(found: Column, piece: Column) -> Column:
        held = lambda line: F.substring(line, start(line, found, piece), piece)
        return F.when((found + piece <= most) & (held(x) == held(y)), found + piece).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, _PIECES)), F.lit(0), longer)


def within_distance(a: Column, b: Column, threshold: int) -> Column:
    """Whether two lines are at most ``threshold`` edits apart.

    What they have in common at both ends is left out. The rest is banded and bit-parallel: for each number of errors d a
    mask holds, for the 2 * threshold + 1 prefixes of ``a`` around the diagonal, which are d or fewer edits from the
    prefix of ``b`` read so far. Reading a character, a match or a substitution keeps a prefix's place in the band, a
    character only in ``b`` moves it down one, one only in ``a`` up one.
    """
    width, full = 2 * threshold + 1, (1 << (2 * threshold + 1)) - 1
    start = F.array(*(F.lit(sum(1 << (threshold + i) for i in range(d + 1))) for d in range(threshold + 1)))

    def reached(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]

        def step(acc: Column, j: Column) -> Column:
            at = lambda i: j + (i - threshold - 1)
            equal = sum((F.when((at(i) >= 0) & (F.get(x, at(i)) == F.get(y, j - 1)), 1 << i).otherwise(0) for i in range(width)), F.lit(0))

            def with_mask(d: int, e: Column):
                before = F.get(acc, F.lit(d - 1))
                mask = F.get(acc, F.lit(d)).bitwiseAND(e).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1))
                return lambda o: F.concat(o, F.array(mask.bitwiseOR(F.shiftleft(F.get(o, F.lit(d - 1)), 1)).bitwiseAND(F.lit(full))))

            def masks(e: Column) -> Column:
                out = F.array(F.get(acc, F.lit(0)).bitwiseAND(e))
                for d in range(1, threshold + 1):
                    out = _let(out, with_mask(d, e))
                return out

            # no prefix is within reach any more: what is left of the line changes nothing
            return F.when(F.get(acc, F.lit(threshold)) == 0, acc).otherwise(_let(equal, masks))

        m, n = F.size(x), F.size(y)
        steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        last = F.get(F.aggregate(steps, start, step), F.lit(threshold))
        return F.when(F.abs(m - n) > threshold, False).otherwise(F.getbit(last, m - n + threshold) == 1)

    def middle(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        most = F.least(F.length(x), F.length(y))
        first = _common(x, y, most, lambda _, found, piece: found + 1)
        ends = lambda n: _common(x, y, most - n, lambda line, found, piece: F.length(line) - found - piece + 1)

        def chars(line: Column, n: Column, last: Column) -> Column:
            rest = F.length(line) - n - last
            return F.when(rest > 0, F.split(F.substring(line, n + 1, rest), "")).otherwise(F.array().cast("array<string>"))

        return _let(first, lambda n: _let(ends(n), lambda last: F.struct(chars(x, n, last).alias("x"), chars(y, n, last).alias("y"))))

    return _let(F.struct(a.alias("x"), b.alias("y")), lambda pair: _let(middle(pair), reached))


def trimmed(line: Column) -> Column:
    """``line`` without blanks at both ends; only lines that have some are trimmed, which is slow."""
    blank = F.lit(False)
    for c in _BLANKS:
        blank = blank | F.startswith(line, F.lit(c)) | F.endswith(line, F.lit(c))
    return F.when(blank, F.btrim(line, F.lit(_BLANKS))).otherwise(line)


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, line_no, h, check, line): the lines of ``min_chars`` or more characters, blanks at both ends
    left out, with two hashes. Id and text hash together name the document."""
    texts = whole_rows(docs).select("id", "hash", F.coalesce(F.col("row").getField("text").cast("string"), F.lit("")).alias("text"))
    split = texts.select(F.col("id").alias("doc_id"), F.col("hash").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = split.withColumn("line", trimmed(F.col("line"))).filter(F.length("line") >= min_chars)
    return lines.select("doc_id", "text_hash", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("check"), "line")


BROADCAST_LINES = 500_000  # hashes of lines that share a segment; beyond that they are joined by a shuffle

#: Edits that a line may be off, by the shorter line's characters: a word in a longer line may change altogether.
BY_LENGTH = ((24, 1), (48, 2), (96, 4))


#: Rounds in which each open line is tried against one line of its keys; what they leave open is then searched whole.
#: After a round that closes fewer than one in ``FRUITFUL`` of the lines it leaves open, there is no other.
ROUNDS, FRUITFUL = 3, 10


def _near(classes: DataFrame, steps: tuple[tuple[int, int], ...]) -> DataFrame:
    """(h): the lines within the edits that the shorter one's length allows of an earlier one; ``steps`` are (characters from, edits).

    Many variants of one line share their keys, so their pairs are not listed. In each round the earliest open line of a
    key is its centre, and every open line behind it is tried against the likeliest of its keys' centres; lines that are
    found near are closed. The lines that are still open are then tried against all earlier ones of their keys.
    """
    spark, at = classes.sparkSession, Window.partitionBy("key")  # dealt once; a semi-join would make and deal all keys twice
    ends = [low for low, _ in steps[1:]] + [None]
    found = []
    for (low, edits), high in zip(steps, ends):  # one after the other, so that no two passes' shuffles take disk at once
        shared = _keyed(classes, low, high, edits).select("*", F.max("own").over(at).alias("any"), F.min("h").over(at).alias("low"), F.max("h").over(at).alias("high"))
        found.append(written(shared.filter("any and low <> high").select("h", "key", "own"), "met"))
        tidy(spark)
    met = functools.reduce(DataFrame.union, found)
    ids = written(met.select("h").distinct(), "ids")
    n_open = ids.count()
    ids = F.broadcast(ids) if n_open <= BROADCAST_LINES else ids  # so that the other lines need no shuffle
    chosen = written(classes.join(ids, "h", "left_semi").withColumn("sig", _signature(F.col("r.line"))), "chosen")
    tidy(spark)
    place = F.struct("r.doc_id", "r.text_hash", "r.line_no").alias("place")
    rows = written(met.join(chosen.select("h", "n", "sig", place), "h"), "placed")
    none = spark.range(0)  # of the JVM's own, so that no Python worker is started
    near, tried = none.select(F.col("id").alias("h")), none.select(F.col("id").alias("h"), F.col("id").alias("a"))

    def by_length(n: Column, value) -> Column:
        """``value`` of the edits that a shorter line of ``n`` characters allows."""
        out = value(steps[0][1])
        for low, edits in steps[1:]:
            out = F.when(n >= low, value(edits)).otherwise(out)
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c: chosen.select(F.col("h").alias(c), F.col("n").alias(f"n_{c}"), F.col("r.line").alias(f"line_{c}"))
        texts = pairs.join(side("h"), "h").join(side("a"), "a")
        good = by_length(F.least("n_h", "n_a"), lambda edits: within_distance(F.col("line_h"), F.col("line_a"), edits))  # lengths and letters have passed before
        return written(texts.filter(good).select("h").distinct(), "near")

    # of two lines the shorter one's segment is met, and it is as long or up to ``allowed`` shorter
    apart, allowed = F.col("n") - F.col("a_n"), by_length(F.least("n", "a_n"), F.lit)
    fits = (F.col("own") & apart.between(-allowed, 0)) | (F.col("a_own") & apart.between(0, allowed))
    may = (F.col("a_place") < F.col("place")) & fits & (_signatures_apart("sig", "a_sig") <= 2 * allowed)
    of_a = lambda df: df.select("key", *(F.col(c).alias(f"a_{c}") for c in ("h", "own", "n", "sig", "place")))
    for _ in range(ROUNDS):
        open_ = rows.join(near, "h", "left_anti")
        centres = open_.groupBy("key", "own").agg(F.min(F.struct("place", "h", "n", "sig")).alias("c")).select("key", "own", "c.*")
        met_ = open_.join(of_a(centres), "key").filter(may)
        pairs = met_.groupBy("h").agg(F.min_by("a_h", _signatures_apart("sig", "a_sig")).alias("a")).join(tried, ["h", "a"], "left_anti")
        pairs = written(pairs, "pairs")
        found = verified(pairs)
        near, tried = near.union(found), tried.unionByName(pairs)
        tidy(spark)
        closed = found.count()
        if closed * FRUITFUL < (n_open := n_open - closed):
            break  # centres stay as they are where nothing was closed
    step = F.floor(F.col("n") / F.lit(max(edits for _, edits in steps) + 1))
    left = rows.join(near, "h", "left_anti").withColumn("step", F.explode(F.array(step - 1, step, step + 1)))
    right = of_a(rows).withColumn("step", F.floor(F.col("a_n") / F.lit(max(edits for _, edits in steps) + 1)))
    pairs = left.join(right, ["key", "step"]).filter(may).select("h", F.col("a_h").alias("a")).distinct()
    pairs = written(pairs.join(tried, ["h", "a"], "left_anti"), "pairs")
    return near.union(verified(pairs))


def repeated_lines(docs: DataFrame, *, threshold: int | tuple[tuple[int, int], ...] = 1, min_chars: int = 24, exact_chars: int | None = None) -> DataFrame:
    """(doc_id, text_hash, line_no, near): the lines that repeat an earlier one, in the order of doc_id, the text's hash
    and line_no, exactly (``near`` false) or within ``threshold`` edits (``near`` true: the line's first copy does).

    ``threshold`` is a number, or the numbers by the shorter line's length: ((characters from, edits), ...), rising; then
    ``min_chars`` is the first of these lengths. Shorter lines, of ``exact_chars`` or more characters (none if that is
    not given), are compared exactly only.

    Equal lines are collapsed first. Lines at most ``threshold`` edits apart share one of the shorter one's
    ``threshold`` + 1 segments at nearly the same place from one end, so each distinct line is found through hashes of its segments
    and of the matching substrings of others, filtered by letter counts, and verified character by character.

    Null texts have no lines, rows with a null doc_id come first, rows equal in id and text are one document, and an empty
    table gives no rows.
    """
    steps = ((min_chars, threshold),) if isinstance(threshold, int) else tuple(threshold)
    lines = lines_of(docs, steps[0][0] if exact_chars is None else min(exact_chars, steps[0][0]))
    classes = lines.groupBy("h").agg(F.min(F.struct("doc_id", "text_hash", "line_no", "check", "line")).alias("r"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("n", F.length("r.line")).sortWithinPartitions("n"), "lines")  # a pass skips the other lengths' pages
    tidy(docs.sparkSession)
    later = _near(classes, steps).distinct().withColumn("near", F.lit(True))
    heads = classes.select("h", F.col("r.doc_id").alias("first_doc"), F.col("r.text_hash").alias("first_text"), F.col("r.line_no").alias("first_line"), F.col("r.check").alias("first_check"), "copies").join(later, "h", "left").filter("near or copies > 1")
    placed = lines.select("doc_id", "text_hash", "line_no", "h", "check").join(heads, "h")
    first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_hash") == F.col("first_text")) & (F.col("line_no") == F.col("first_line"))
    same = F.col("check") == F.col("first_check")
    return placed.filter(same & (~first | F.col("near"))).select("doc_id", "text_hash", "line_no", first.alias("near"))


def _by_document(docs: DataFrame, **options) -> DataFrame:
    found = repeated_lines(docs, **options).distinct()
    return found.groupBy("doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("n_repeated"), F.count_if("near").alias("n_near"), F.array_sort(F.collect_list(F.col("line_no").cast("long"))).alias("line_numbers")
    )


def report(docs: DataFrame, **options) -> DataFrame:
    """A row per document with repeated lines: doc_id, n_repeated, n_near, and their numbers (from 0), in order. Where rows
    share a doc_id but not their text, there is a row for each text; null texts and empty tables give none."""
    return _by_document(docs, **options).drop("text_hash")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, without their repeated lines; what is left keeps its order and line ends.

    Lines that are shorter than what is compared and blank ones stay. A null text stays null. Rows equal in doc_id (also
    null) and text are one document: the same lines go from each. Where a document has an n_chars, it is counted anew. A
    document of which only blanks remain is dropped, unless nothing was taken from it; an empty table gives no rows.
    """
    found = _by_document(docs, **options).select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "line_numbers")
    rows = whole_rows(docs)
    both = rows.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("hash") == F.col("found_hash")), "left")
    whole = F.col("row").getField("text").cast("string")
    kept = F.filter(F.split(whole, "\n"), lambda x, i: ~F.array_contains("line_numbers", i.cast("long")))
    changed = both.withColumn("left_text", F.when(F.col("line_numbers").isNotNull(), F.array_join(kept, "\n")))
    changed = changed.filter(F.col("left_text").isNull() | (F.btrim("left_text", F.lit(_BLANKS)) != ""))
    new = {c: F.when(F.col("left_text").isNull(), F.col("row").getField(c)).otherwise(x) for c, x in (("text", F.col("left_text")), ("n_chars", F.length("left_text").cast("long")))}
    return changed.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
