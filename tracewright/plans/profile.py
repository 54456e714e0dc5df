"""Profiles of log records: which kinds and shapes there are, a short sample of each, and counts by many dimensions in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.operators.ordered import asof_latest
from tracewright.operators.session import S
from tracewright.sources.format_b import SHELLS, SUBAGENT_EVENTS
from tracewright.sources.logs import get

_FIELDS, _ITEMS = "map<string,variant>", "array<variant>"


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", _FIELDS)


def type_of(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID, or NUMBER."""
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(name.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN", "VOID"), name).otherwise("NUMBER")


def kind_of(rec: Column | str = "rec") -> Column:
    """What a record is: its type, and what its payload, item or tool says beside it."""
    pick = lambda path: get(path, of=rec)
    return F.concat_ws("|", pick("$.type"), F.coalesce(pick("$.payload.type"), pick("$.data.toolName")), pick("$.payload.item.type"))


def nodes(records: DataFrame, depth: int = 8) -> DataFrame:
    """(session, seq, kind, path, type, value): every value inside the records, down to ``depth`` levels, the record itself
    included. A path has a dot and name for a field, and ``[]`` for any element of an array.

    Each level is one more step of a single pass: a value stays and its children join it.
    """
    at = records.filter("ok").select(*S, "seq", kind_of().alias("kind"), F.lit("$").alias("path"), F.col("rec").alias("v"), F.lit(True).alias("new"))
    for _ in range(depth):
        node = lambda path, v: F.struct(path.alias("path"), v.alias("v"), F.lit(True).alias("new"))
        fields = F.transform(F.map_entries(_fields(F.col("v"))), lambda e: node(F.concat("path", F.lit("."), e["key"]), e["value"]))
        items = F.transform(F.try_variant_get("v", "$", _ITEMS), lambda x: node(F.concat("path", F.lit("[]")), x))
        none = F.array().cast("array<struct<path:string,v:variant,new:boolean>>")
        children = F.when(F.col("new"), F.coalesce(fields, items, none)).otherwise(none)
        itself = F.array(F.struct("path", "v", F.lit(False).alias("new")))
        at = at.select(*S, "seq", "kind", F.explode(F.concat(itself, children)).alias("x")).select(*S, "seq", "kind", "x.*")
    return at.select(*S, "seq", "kind", "path", type_of(F.col("v")).alias("type"), F.col("v").alias("value"))


def shapes(records: DataFrame, depth: int = 8) -> DataFrame:
    """(kind, path, type, n, first_seq, sample): how often a value of a type stands at a path of records of a kind, where it
    does first, and that value. Counts and firsts merge, so they are made before anything is dealt."""
    at = F.struct("seq", "session_id")
    found = nodes(records, depth).withColumn("text", F.substring(F.to_json("value"), 1, 180))
    return found.groupBy("kind", "path", "type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.min_by("text", at).alias("sample"))


def key_shapes(records: DataFrame) -> DataFrame:
    """(kind, keys, n): the sorted names of fields of format B's data, or format A's payload, by the type of record."""
    body = F.coalesce(F.try_variant_get("rec", "$.data", _FIELDS), F.try_variant_get("rec", "$.payload", _FIELDS))
    keys = F.array_join(F.array_sort(F.map_keys(body)), ",")
    return records.filter("ok").select(get("$.type").alias("kind"), F.coalesce(keys, F.lit("")).alias("keys")).groupBy("kind", "keys").agg(F.count(F.lit(1)).alias("n"))


def layouts(files: DataFrame) -> DataFrame:
    """(names, n): which files lie together in a folder, of a listing (file), and in how many folders."""
    f = files.select(F.regexp_replace("file", "/[^/]*$", "").alias("folder"), F.regexp_extract("file", "[^/]*$", 0).alias("name")).filter(~F.startswith("name", F.lit("inuse.")))
    return f.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names")).groupBy("names").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- samples


def _quoted(s: Column) -> Column:
    """A text as JSON."""
    whole = F.to_json(F.array(s))
    return F.substring(whole, 2, F.length(whole) - 2)


def sampled(v: Column, depth: int = 0, *, chars: int = 180, items: int = 2, deepest_array: int = 4, deepest_object: int = 5) -> Column:
    """A variant as short JSON: texts cut at ``chars`` with their length, the first ``items`` of an array, arrays below level
    ``deepest_array`` as their length and objects below ``deepest_object`` as an ellipsis. Fields are in the order of their
    names. The levels are nested expressions: no step leaves the JVM."""
    kind = F.substring(F.schema_of_variant(v), 1, 5)
    text, parts, fields = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", _ITEMS), _fields(v)
    inside = lambda x: sampled(x, depth + 1, chars=chars, items=items, deepest_array=deepest_array, deepest_object=deepest_object)
    if depth > deepest_array:
        array = _quoted(F.concat(F.lit("["), F.size(parts).cast("string"), F.lit(" items]")))
    else:
        array = F.concat(F.lit("["), F.array_join(F.transform(F.slice(parts, 1, items), inside), ","), F.lit("]"))
    if depth > deepest_object:
        object_ = F.lit('"{…}"')
    else:
        object_ = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), inside(e["value"]))), ","), F.lit("}"))
    cut = F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…<"), F.length(text).cast("string"), F.lit("ch>"))).otherwise(text)
    return F.when(kind == "STRIN", _quoted(cut)).when(kind == "ARRAY", array).when(kind == "OBJEC", object_).when(kind == "VOID", "null").otherwise(F.to_json(v))


def samples(records: DataFrame) -> DataFrame:
    """(kind, n, sample): of each kind of record the first one, short."""
    first = F.min_by("rec", F.struct("seq", "session_id"))
    r = records.filter("ok").select("session_id", "seq", kind_of().alias("kind"), F.to_json("rec").alias("rec"))
    return r.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), first.alias("rec")).select("kind", "n", sampled(F.parse_json("rec")).alias("sample"))


# ---------------------------------------------------------------- dimensions of format B


def _keys(path: str) -> Column:
    return F.array_join(F.array_sort(F.map_keys(F.try_variant_get("rec", path, _FIELDS))), ",")


def dimensions(records: DataFrame, most: int | None = 40) -> DataFrame:
    """(dimension, key, n, rank): counts of format B's records by sources, deliveries, phases, field names of completions and
    of their results, errors and shell runs, calls and failures by tool, kinds of notices, and endings of shell output without
    a run's record; of each dimension the ``most`` frequent keys, counted exactly, ties by key.

    One pass: a record gives an entry for each dimension it has a say in, and counts merge before they are dealt. Completions
    get their call's last start before them as of then.
    """
    typ = get("$.type")
    entry = lambda name, when, key: F.when(when, F.struct(F.lit(name).alias("dimension"), F.coalesce(key, F.lit("(none)")).alias("key")))
    d = lambda name: get(f"$.data.{name}")
    start, done = typ == "tool.execution_start", typ == "tool.execution_complete"
    said = F.coalesce(d("reasoningText"), F.lit("")) != ""
    r = records.filter("ok")
    there = lambda name: F.try_variant_get("rec", f"$.data.{name}", "variant").isNotNull()
    plain = [
        entry("event type", typ.isNotNull(), typ), entry("user.message source", typ == "user.message", d("source")), entry("user.message delivery", typ == "user.message", d("delivery")),
        entry("assistant.message phase", typ == "assistant.message", d("phase")), entry("reasoning", typ == "assistant.message", F.when(said, "text").when(there("reasoningOpaque") | there("encryptedContent"), "encrypted only").otherwise("none")),
        entry("calls by tool", start, d("toolName")), entry("completion fields", done, _keys("$.data")), entry("result fields", done & there("result"), _keys("$.data.result")),
        entry("error fields", done & there("error"), F.coalesce(_keys("$.data.error"), F.lit("string"))), entry("shell run fields", done & there("shellExecution"), _keys("$.data.shellExecution")),
        entry("notification kind", typ == "system.notification", d("kind.type")), entry("info type", typ == "session.info", d("infoType")), entry("sub-agent event", typ.isin(*SUBAGENT_EVENTS), typ),
    ]
    simple = r.select(F.explode(F.array_compact(F.array(*plain))).alias("e")).select("e.*")

    calls = r.filter(start).select(*S, d("toolCallId").alias("call"), "seq", d("toolName").alias("tool"), d("arguments.mode").alias("mode"), F.lit(True).alias("started"))
    content = F.coalesce(d("result.content"), F.lit(""))
    ends = r.filter(done).select(*S, d("toolCallId").alias("call"), "seq", (d("success") == "false").alias("failed"), there("shellExecution").alias("ran"), content.alias("content"))
    ended = asof_latest(ends, calls, [*S, "call"], "seq", ["tool", "mode", "started"])
    masked = lambda c: F.regexp_replace(c, r"\d+", "N")
    last = lambda c, n: F.when(F.length(c) > n, F.substring(c, -n, n)).otherwise(c)
    tail = F.trim(F.regexp_replace(masked(last(F.col("content"), 80)), r"\s+", " "))
    mark = F.regexp_extract("content", r"(?i)(<[^<>]*(?:exit code|exited)[^<>]*>)\s*$", 1)
    ending = F.when(mark != "", masked(mark)).when(F.col("mode") == "async", F.concat(F.lit("ASYNC: "), last(tail, 50))).otherwise(F.concat(F.lit("OTHER: "), last(tail, 40)))
    shell = F.col("tool").isin(*SHELLS)
    of_calls = [
        entry("failures by tool", F.col("failed"), F.coalesce("tool", F.lit("(unknown)"))), entry("completions without start", F.col("started").isNull(), F.lit("all")),
        entry("shell completions", shell, F.when(F.col("ran"), "with run").when(F.col("failed"), "without run, failed").otherwise("without run")), entry("shell endings", shell & ~F.col("ran"), ending),
    ]
    timed = ended.select(F.explode(F.array_compact(F.array(*of_calls))).alias("e")).select("e.*")
    n = simple.unionByName(timed).groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"))
    ranked = n.withColumn("rank", F.row_number().over(W.partitionBy("dimension").orderBy(F.desc("n"), "key")))
    return ranked.filter(F.col("rank") <= most) if most else ranked
