"""Queries over the driver's tables: the engine's operators on data that DuckDB can check, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.functions import text as X
from tracewright.operators import fit, ledger, ordered, session
from tracewright.plans import reports
from tracewright.scratch import written
from tracewright.shipping import ship
from tracewright.sources import logs

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable) -> Callable:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _k(c: str = "props"):
    return F.get_json_object(c, "$.k").cast("long")


def event_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands of a user: error fails, purchase succeeds; the command is the k of its props."""
    e = t(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase"))
    return e.select("user_id", _k().alias("key"), (F.col("event_type") == "purchase").alias("ok"), F.col("event_id").alias("seq"), "value")


K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
CMD_SQL = f"c AS (SELECT user_id, {K_SQL} AS key, event_type = 'purchase' AS ok, event_id AS seq, value FROM events WHERE event_type IN ('error', 'purchase'))"


# ---------------------------------------------------------------- sessions and their selection


@query("SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id")
def session_index(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).cast("long").alias("chars"), F.max_by("text", "turn").alias("last_text"))


def parts_as_sessions(spark, sf_dir) -> DataFrame:
    """Parts as sessions: the name is the title, the brand the folder, the type the id."""
    p = t(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("cwd"), F.col("p_type").alias("session_id"), F.timestamp_seconds("p_partkey").alias("updated_at"))


@query("""SELECT p_partkey, CAST((CASE WHEN contains(lower(p_name), 'red') THEN 2 ELSE 1 END) + (CASE WHEN contains(lower(p_name), 'o') THEN 2 ELSE 1 END) AS BIGINT) AS score
FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'red') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'o')""")
def find_words(spark, sf_dir):
    return reports.find(parts_as_sessions(spark, sf_dir), "red o").select("p_partkey", F.col("score").cast("long").alias("score"))


@query("SELECT '00c0ffee' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS session_id, c_name FROM customer WHERE c_custkey = 7")
def prefix_resolve(spark, sf_dir):
    """The one session that twelve and more characters of an id name."""
    c = t(spark, sf_dir, "customer")
    ids = F.concat(F.lit("00c0ffee"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    return reports.resolve(c.select(F.lit("codex").alias("source"), ids.alias("session_id"), F.lit("x").alias("link"), "c_name"), "'00C0FFEE000000000007'").select("session_id", "c_name")


@query("""WITH s AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id)
SELECT user_id, epoch_us(a) AS started_us, epoch_us(b) AS updated_us FROM s WHERE b >= TIMESTAMP '2024-01-03' AND a <= TIMESTAMP '2024-01-20' ORDER BY b DESC, user_id LIMIT 40""")
def time_window_last_n(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("updated_at"))
    s = s.select(F.lit("x").alias("source"), F.col("user_id").alias("session_id"), "a", F.col("a").cast("string").alias("started_at"), "updated_at")
    at = lambda day: reports.parse_when(day)
    kept = reports.in_window(s, since=at("2024-01-03"), until=at("2024-01-20"), last=40)
    return kept.select(F.col("session_id").alias("user_id"), F.unix_micros("a").alias("started_us"), F.unix_micros("updated_at").alias("updated_us"))


PATH_SQL = "regexp_replace(url, '^[a-z]+://[^/]*', '')"


def pages_as_sessions(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("cwd"))


@query(f"SELECT page_id, url FROM pages WHERE NOT (lower({PATH_SQL}) = '/en' OR starts_with(lower({PATH_SQL}), '/en/'))")
def exclude_tree(spark, sf_dir):
    return reports.excluding(pages_as_sessions(spark, sf_dir), ["/EN/"]).select("page_id", "url")


@query(f"SELECT page_id, url FROM pages WHERE lower({PATH_SQL}) = '/fr' OR starts_with(lower({PATH_SQL}), '/fr/')")
def inside_folder(spark, sf_dir):
    return reports.in_folder(pages_as_sessions(spark, sf_dir), "/fr", nested=True).select("page_id", "url")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i % greatest(1, n // 5) = 0 AND i // greatest(1, n // 5) < 5")
def stride_sample(spark, sf_dir):
    return ordered.stride_sample(t(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], ["event_id"], 5)


# ---------------------------------------------------------------- turns


def conversation_facts(spark, sf_dir) -> DataFrame:
    """Messages as facts: a user's opens a turn and is asked, an assistant's is a final that demotes the one before."""
    c = t(spark, sf_dir, "conversations").withColumn("text", F.trim("text"))
    opened = F.count_if(F.col("role") == "user").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    user, says = F.col("role") == "user", F.col("role") == "assistant"
    values = {
        "kind": F.when(user, "ask").when(says, "final").otherwise("note"), "turn": opened.cast("string"), "text": F.col("text"), "aux": F.when(user, "append").when(says, "demote"), "path": F.when(user, F.lit("user")),
        "num": F.lit(None).cast("long"), "failed": F.lit(None).cast("boolean"), "quiet": F.lit(None).cast("boolean"),
    }
    kept = [values.get(k, F.lit(None).cast("string")).alias(k) for k in logs.FIELDS]
    return c.select(F.lit("x").alias("source"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("seq"), F.lit(0).alias("sub"), F.lit("2024-01-01T00:00:00Z").alias("ts"), *kept)


MESSAGES_SQL = """m AS (SELECT conv_id, turn, role, trim(text) AS text, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS raw FROM conversations)"""


@query(f"""WITH {MESSAGES_SQL}, a AS (SELECT conv_id, raw, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS ask FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, raw, regexp_replace(text, '\\s+', ' ', 'g') ORDER BY turn) AS k FROM m WHERE role = 'user' AND text <> '') WHERE k = 1 GROUP BY conv_id, raw),
g AS (SELECT conv_id, raw, min(turn) AS first, arg_max(text, turn) FILTER (role = 'assistant' AND text <> '') AS final, greatest(count(*) FILTER (role = 'assistant' AND text <> '') - 1, 0) + count(*) FILTER (role NOT IN ('user', 'assistant') AND text <> '') AS notes FROM m GROUP BY conv_id, raw)
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(raw AS VARCHAR) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS n, CASE WHEN length(ask) <= 4000 THEN ask END AS ask, CASE WHEN length(final) <= 3000 THEN final END AS final, CAST(notes AS BIGINT) AS notes
FROM g LEFT JOIN a USING (conv_id, raw) WHERE ask IS NOT NULL OR final IS NOT NULL OR notes > 0""")
def session_turns(spark, sf_dir):
    """Conversations through the fold: asks, the last final, and notes of finals that a later one replaced. Clipped texts,
    whose form clip_functions checks, are left out."""
    turns = session.fold(written(conversation_facts(spark, sf_dir), "facts")).turns
    whole = lambda c, n: F.when(~F.contains(F.col(c), F.lit("…[+")), F.col(c)).alias(c)
    return turns.select("session_id", "turn", F.col("n").cast("long").alias("n"), whole("ask", 4000), whole("final", 3000), F.size("notes").cast("long").alias("notes"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts) AS asks FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS k FROM events) WHERE k = 1 GROUP BY user_id")
def ask_dedupe(spark, sf_dir):
    first = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_type"))), lambda x: x["event_type"]), ",").alias("asks"))


@query(f"WITH {MESSAGES_SQL}, d AS (SELECT conv_id, turn, raw, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS demoted FROM m WHERE role = 'assistant' AND text <> '') SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, demoted AS text FROM d WHERE length(demoted) <= 3000")
def demoted_finals(spark, sf_dir):
    """Answers that a later one of the same turn replaced, at that one's place; a conversation is one turn here."""
    return session.demoted(conversation_facts(spark, sf_dir).withColumn("turn", F.lit("1")), session.Limits()).filter("not contains(text, '…[+')").select("session_id", "seq", "text")


def searchable(spark, sf_dir) -> DataFrame:
    """Messages as searched and replayed records."""
    f = conversation_facts(spark, sf_dir)
    none = F.lit(None).cast("string")
    return f.select("source", "session_id", "seq", "ts", "turn", F.concat("kind", F.lit(" message")).alias("label"), "text", F.col("text").alias("output"), none.alias("stderr"), none.alias("exit_text"), (F.col("kind") != "note").alias("replayed"))


@query(f"WITH {MESSAGES_SQL} SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, text, substr(text, 1, 30) AS output FROM m WHERE raw = 2 AND role IN ('user', 'assistant')")
def turn_replay(spark, sf_dir):
    """The second turn of every conversation as it was logged, output cut."""
    turns = session.fold(written(conversation_facts(spark, sf_dir), "facts")).turns
    second = turns.withColumn("n", F.col("turn").cast("int"))  # by the number that the SQL has
    return reports.replay(searchable(spark, sf_dir), second, 2, max_chars=30).select("session_id", "seq", "text", "output")


# ---------------------------------------------------------------- ledgers


@query(f"SELECT user_id, event_type || ' ' || {K_SQL} AS cmd, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failures, min(event_id) AS first_seq FROM events GROUP BY user_id, cmd")
def command_ledger(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", F.concat_ws(" ", "event_type", _k().cast("string")).alias("cmd"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("seq"))
    return ledger.commands(e, ["user_id"])


FAILURES_SQL = """f AS (SELECT user_id, key, count(*) FILTER (NOT ok) AS occurrences, min(seq) FILTER (NOT ok) AS first_seq, max(seq) FILTER (NOT ok) AS last_seq,
arg_max(value, seq) FILTER (NOT ok) AS value, max(seq) FILTER (ok) AS good FROM c GROUP BY user_id, key)"""


@query(f"WITH {CMD_SQL}, {FAILURES_SQL} SELECT user_id, key, occurrences, first_seq, last_seq, value FROM f WHERE occurrences > 0 AND good IS NULL")
def outstanding_failures(spark, sf_dir):
    return ledger.outstanding(event_commands(spark, sf_dir), ["user_id"], carry=("value",)).drop("resolved")


@query(f"WITH {CMD_SQL}, {FAILURES_SQL} SELECT user_id, key, occurrences, first_seq, last_seq, coalesce(good > last_seq, false) AS resolved FROM f WHERE occurrences > 0")
def resolved_strict_later(spark, sf_dir):
    return ledger.failures(event_commands(spark, sf_dir), ["user_id"], strict_later=True)


@query("""SELECT l_partkey, count(*) FILTER (l_returnflag = 'A') AS n_add, count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS n_update, count(*) FILTER (l_returnflag = 'R') AS n_delete,
CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines, epoch_us(min(l_shipdate)) AS first_us, epoch_us(max(l_shipdate)) AS last_us FROM lineitem GROUP BY l_partkey""")
def file_change_ledger(spark, sf_dir):
    verb = F.when(F.col("l_returnflag") == "A", "add").when(F.col("l_returnflag") == "R", "delete").otherwise("update")
    li = t(spark, sf_dir, "lineitem").select("l_partkey", verb.alias("verb"), F.col("l_quantity").cast("long").alias("lines"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts"))
    return ledger.files(li, [], path="l_partkey", seq="ts").select("l_partkey", "n_add", "n_update", "n_delete", "lines", F.col("first_ts").alias("first_us"), F.col("last_ts").alias("last_us"))


@query("SELECT user_id, props, count(*) AS reads, min(event_id) AS first_seq FROM events WHERE event_type = 'view' GROUP BY user_id, props")
def read_ledger(spark, sf_dir):
    v = t(spark, sf_dir, "events").filter("event_type = 'view'").withColumnRenamed("event_id", "seq")
    return ledger.counted(v, ["user_id"], "props", "reads")


# ---------------------------------------------------------------- ordered rows


@query("""WITH w AS (SELECT event_id, user_id, event_type, count(*) FILTER (event_type = 'click') OVER o AS a, count(*) FILTER (event_type = 'view') OVER o AS b FROM events WHERE event_type IN ('click', 'view') WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, event_type FROM w WHERE NOT (CASE WHEN event_type = 'click' THEN a <= b ELSE b <= a END)""")
def twin_dedupe(spark, sf_dir):
    e = t(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    return e.withColumn("twin", ordered.is_twin(F.col("event_type"), "click", "view", ["user_id"], "ts", "event_id")).filter("not twin").select("event_id", "user_id", "event_type")


@query("SELECT user_id, props, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def item_first_wins(spark, sf_dir):
    return ordered.first_wins(t(spark, sf_dir, "events"), ["user_id", "props"], "ts", "event_id").select("user_id", "props", "event_id", "event_type")


@query("""SELECT p.event_id, p.user_id, s.event_id AS start_id, s.value AS start_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.event_id >= s.event_id""")
def asof_tool_start(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "event_id")
    right = e.filter("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("start_id"), F.col("value").alias("start_value"))
    return ordered.asof_latest(left, right, ["user_id"], "event_id", ["start_id", "start_value"])


@query("SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS held FROM events")
def carry_forward(spark, sf_dir):
    value = F.when(F.col("event_type").isin("signup", "purchase"), F.col("value"))
    return t(spark, sf_dir, "events").select("event_id", ordered.carry_forward(value, ["user_id"], "ts", "event_id").alias("held"))


@query("""WITH RECURSIVE n AS (SELECT CAST(event_id AS BIGINT) AS id, CAST(CASE WHEN event_id % 64 = 0 THEN NULL ELSE event_id // 2 END AS BIGINT) AS parent, value FROM events),
r AS (SELECT id, value AS root_value FROM n WHERE parent IS NULL OR parent = id UNION ALL SELECT n.id, r.root_value FROM n JOIN r ON n.parent = r.id AND n.id <> r.id WHERE n.parent IS NOT NULL)
SELECT id, root_value FROM r""")
def call_tree(spark, sf_dir):
    """All events as calls whose parent is half their number; each call's value is its root's."""
    e = t(spark, sf_dir, "events")
    n = e.select(F.lit(1).alias("s"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 64 != 0, F.floor(F.col("event_id") / 2)).alias("parent"), F.col("value").alias("root_value"))
    return ordered.roots(n, ["s"], "id", "parent", "root_value").select("id", "root_value")


RUNS_SQL = """m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER o AND row_number() OVER o > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m)"""


@query(f"WITH {RUNS_SQL} SELECT user_id, run, event_type, count(*) AS n, min(event_id) AS first_id, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM r GROUP BY user_id, run, event_type")
def run_length_collapse(spark, sf_dir):
    r = ordered.runs(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return r.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"))


@query("""WITH m AS (SELECT conv_id, turn, role = 'user' AS low, CASE WHEN (role = 'user') IS NOT DISTINCT FROM lag(role = 'user') OVER o AND row_number() OVER o > 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT conv_id, min(turn) AS from_turn, max(turn) AS to_turn, CASE WHEN count(*) = 1 THEN 'Turn ' || min(turn) ELSE 'Turns ' || min(turn) || '-' || max(turn) END AS label FROM r WHERE low GROUP BY conv_id, run""")
def omitted_ranges(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").withColumn("low", F.col("role") == "user")
    return omitted(c, ["conv_id"], "turn", "low").select("conv_id", "from_turn", "to_turn", "label")


def omitted(df: DataFrame, keys: list[str], n: str, low: str) -> DataFrame:
    """Ranges of consecutive rows for which ``low`` holds, with a label."""
    g = ordered.runs(df, keys, [n], low).filter(low).groupBy(*keys, "run").agg(F.min(n).alias("from_turn"), F.max(n).alias("to_turn"), F.count(F.lit(1)).alias("size"))
    a, b = F.col("from_turn").cast("string"), F.col("to_turn").cast("string")
    return g.withColumn("label", F.when(F.col("size") == 1, F.concat(F.lit("Turn "), a)).otherwise(F.concat(F.lit("Turns "), a, F.lit("-"), b)))


@query("""WITH u AS (SELECT conv_id, turn, sum(length(text) + 40) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM u WHERE used <= 600""")
def request_prefix_fit(spark, sf_dir):
    u = t(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.length("text").alias("chars"))
    return ordered.prefix_fit(u, ["conv_id"], [F.desc("turn")], F.col("chars") + 40, 600).select("conv_id", "turn", F.col("used").cast("long").alias("used"))


FIT_SQL = """WITH RECURSIVE l AS (SELECT conv_id, turn, length(text) AS n, turn % 2 = 0 AS asked FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN asked THEN n ELSE 0 END AS a, CASE WHEN asked THEN 0 ELSE coalesce(n, 0) END AS f FROM l),
k AS (SELECT conv_id, turn, [0, 60 + least(coalesce(a, 0), 140) + least(f, 140), 180 + least(coalesce(a, 0), 1200) + least(f, 1200), 80 + coalesce(a, 0) + f] AS cost FROM x),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, cost DESC) - 1 AS i FROM k),
s AS (SELECT conv_id, count(*) AS n, 40 + CAST(floor(sum(cost[4]) / 4.0 + 0.5) AS BIGINT) AS whole, 40 + CAST(floor(max(cost[4]) FILTER (i = 0) / 4.0 + 0.5) AS BIGINT) AS used FROM c GROUP BY conv_id),
r AS (SELECT conv_id, n, 0 AS step, used, list_transform(range(0, n), lambda i: CASE WHEN i = 0 THEN 3 ELSE 0 END) AS tiers FROM s WHERE whole > 300
  UNION ALL SELECT conv_id, n, step + 1, CASE WHEN take THEN used + d ELSE used END, CASE WHEN take THEN list_concat(list_concat(tiers[1:i], [rank]), tiers[i + 2:n]) ELSE tiers END
  FROM (SELECT *, tiers[i + 1] < rank AND used + d <= 300 AS take FROM (SELECT r.*, c.i, CAST(step // n + 1 AS INTEGER) AS rank, CAST(floor((cost[step // n + 2] - cost[tiers[c.i + 1] + 1]) / 4.0 + 0.5) AS BIGINT) AS d
    FROM r JOIN c ON r.conv_id = c.conv_id AND c.i = r.step % r.n WHERE step < 3 * n))),
e AS (SELECT conv_id, used, tiers FROM r WHERE step = 3 * n UNION ALL SELECT conv_id, whole, list_transform(range(0, n), lambda i: 3) FROM s WHERE whole <= 300)
SELECT c.conv_id, e.used, c.turn, CAST(e.tiers[c.i + 1] AS INTEGER) AS tier FROM c JOIN e ON c.conv_id = e.conv_id"""


@query(FIT_SQL)
def tier_fit(spark, sf_dir):
    """The tier of every turn of each conversation within 300 tokens."""
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    user = F.col("turn") % 2 == 0
    cost = fit.turn_costs(F.when(user, F.col("chars")), F.when(~user, F.col("chars")), F.lit(20))
    sessions = c.withColumn("cost", cost).groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("turn", "cost")))).alias("x"))
    fitted = sessions.withColumn("f", fit.plan_budget(F.transform("x", lambda x: x["cost"]), F.lit(300), F.lit(40), 1))
    zipped = F.arrays_zip(F.transform("x", lambda x: x["turn"]).alias("turn"), F.col("f.tiers").alias("tier"))
    return fitted.select("conv_id", F.col("f.used").alias("used"), F.explode(zipped).alias("z")).select("conv_id", "used", "z.turn", "z.tier")


CARD_FIT_SQL = """WITH RECURSIVE c AS (SELECT c_custkey AS number, [0, 160 + c_custkey * 37 % 300, 500 + c_custkey * 91 % 3000] AS cost, row_number() OVER (ORDER BY c_custkey DESC) AS i FROM customer),
z AS (SELECT count(*) AS n, {first} AS used FROM c WHERE i = 1),
a AS (SELECT 1 AS i, (SELECT used FROM z) AS used, 2 AS tier UNION ALL SELECT c.i, CASE WHEN a.used + d <= 5000 THEN a.used + d ELSE a.used END, CASE WHEN a.used + d <= 5000 THEN 1 ELSE 0 END FROM a JOIN (SELECT *, {brief} AS d FROM c) AS c ON c.i = a.i + 1),
b AS (SELECT 1 AS i, (SELECT used FROM a ORDER BY i DESC LIMIT 1) AS used, 2 AS tier UNION ALL SELECT x.i, CASE WHEN b.used + d <= 5000 THEN b.used + d ELSE b.used END, CASE WHEN b.used + d <= 5000 THEN 2 ELSE x.tier END
  FROM b JOIN (SELECT c.i, a.tier, CAST(floor((cost[3] - cost[a.tier + 1]) / 4.0 + 0.5) AS BIGINT) AS d FROM c JOIN a ON a.i = c.i) AS x ON x.i = b.i + 1)
SELECT number, CAST(b.tier AS INTEGER) AS tier FROM c JOIN b ON b.i = c.i WHERE b.tier > 0""".format(first="any_value(CAST(floor(cost[3] / 4.0 + 0.5) AS BIGINT))", brief="CAST(floor(cost[2] / 4.0 + 0.5) AS BIGINT)")


@query(CARD_FIT_SQL)
def card_fit(spark, sf_dir):
    """Which of all customers, the newest first, are raised within 5000 tokens: a fit over rows that never meet in one task."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("number"), F.col("c_custkey").alias("n"))
    costs = c.select("number", F.array(F.lit(0), 160 + F.col("n") * 37 % 300, 500 + F.col("n") * 91 % 3000).cast("array<bigint>").alias("cost"))
    return fit.fit_rows(costs, "number", 5000, guaranteed=1, n_tiers=3, least=10)


# ---------------------------------------------------------------- rollups


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def session_codes(spark, sf_dir):
    """Numbers in a global order, without a task that sees all rows."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return ordered.numbered(o, ["o_orderkey"], [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()])


@query("""SELECT l_partkey, count(DISTINCT l_suppkey) AS sessions, count(*) AS changes FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1 ORDER BY sessions DESC, changes DESC, l_partkey LIMIT 25""")
def file_rollup_shared(spark, sf_dir):
    pairs = t(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    g = pairs.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("changes")).filter("sessions > 1")
    return g.orderBy(F.desc("sessions"), F.desc("changes"), "l_partkey").limit(25)


@query("""SELECT o_custkey, count(*) AS plan_size, count(*) FILTER (o_orderstatus <> 'F') AS open_items, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus <> 'F') AS last_open FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus <> 'F') > 0""")
def plan_open_items(spark, sf_dir):
    open_ = F.col("o_orderstatus") != "F"
    g = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("plan_size"), F.count_if(open_).alias("open_items"), F.max_by("o_orderpriority", F.when(open_, F.col("o_orderkey"))).alias("last_open"))
    return g.filter("open_items > 0")


# ---------------------------------------------------------------- scalars

_RT = r"regexp_replace({0}, '\s+$', '')"
_CO = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_CUT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE substr({0}, 1, {1}) || {2} END"


@query(f"""WITH d AS (SELECT doc_id, {_RT.format("text")} AS r, {_CO.format("text")} AS o, lower({_CO.format("text")}) AS k FROM documents)
SELECT doc_id, {_CUT.format("r", 60, "' …[+' || (length(r) - 60) || ' chars]'")} AS clipped,
CASE WHEN length(r) <= 60 THEN r ELSE '…[' || (length(r) - 60) || ' earlier chars omitted]' || chr(10) || right(r, 60) END AS tail,
{_CUT.format("o", 80, "' …[+' || (length(o) - 80) || ' chars]'")} AS one_line, md5(k) AS key_md5, {_CUT.format("o", 40, "'…'")} AS short, CAST(floor(length(r) / 4.0 + 0.5) AS BIGINT) AS tokens FROM d""")
def clip_functions(spark, sf_dir):
    c = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", X.clip(c, 60).alias("clipped"), X.clip_tail(c, 60).alias("tail"), X.one_line(c, 80).alias("one_line"), F.md5(X.cmd_key(c)).alias("key_md5"), X.short_line(c, 40).alias("short"), X.tokens(F.length(X.rtrim_all(c))).cast("long").alias("tokens"))


@query(r"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: regexp_matches(x, '[A-Za-z]{3}') AND NOT regexp_matches(x, '^[+~|]')) AS l FROM documents)
SELECT doc_id, coalesce(list_filter(l, lambda x: regexp_matches(x, '(?i)error|fail|exception|cannot|can''t|not found|not recognized|denied|fatal|refused|invalid|missing|timed? ?out'))[-1], l[-1], '') AS telltale FROM d""")
def telltale_line(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.telltale_line(F.col("text")).alias("telltale"))


@query(r"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE CAST(len(string_split(text, chr(10))) AS INTEGER) END AS n_lines,
CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^[+-][^+-]'))) AS INTEGER) AS n_diff FROM documents""")
def diff_and_line_counts(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.count_lines(F.col("text")).cast("int").alias("n_lines"), X.diff_lines(F.col("text")).cast("int").alias("n_diff"))


@query("""SELECT o_orderkey, CASE WHEN x > 1e9 THEN printf('%.2f GB', x / 1e9) WHEN x > 1e6 THEN printf('%.1f MB', x / 1e6) ELSE CAST(floor(x / 1024 + 0.5) AS BIGINT) || ' KB' END AS size,
CASE WHEN ms <= 0 THEN '' WHEN s < 60 THEN s || 's' WHEN m < 60 THEN m || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE (m // 60) || 'h' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || 'm' END AS took
FROM (SELECT *, s // 60 AS m FROM (SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) * 7919 AS x, o_orderkey * 997 % 20000000 AS ms, CAST(floor(o_orderkey * 997 % 20000000 / 1000.0 + 0.5) AS BIGINT) AS s FROM orders))""")
def size_and_duration_format(spark, sf_dir):
    x, ms = F.col("o_orderkey").cast("double") * 7919, F.col("o_orderkey") * 997 % 20000000
    return t(spark, sf_dir, "orders").select("o_orderkey", X.human_size(x, " ").alias("size"), X.duration(ms).alias("took"))


@query(r"""WITH s AS (SELECT page_id, url, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS d FROM pages)
SELECT page_id, CASE WHEN d = '' THEN 'session' ELSE substr(d, 1, 50) END AS slug,
'0a1b2c3d-0000-4abc-8def-' || lpad(CAST(page_id AS VARCHAR), 12, '0') AS id, CAST(page_id % 7 AS BIGINT) AS code FROM s""")
def slug_uuid_exit(spark, sf_dir):
    made = F.concat(F.lit("codex://threads/0A1B2C3D-0000-4ABC-8DEF-"), F.lpad(F.col("page_id").cast("string"), 12, "0"))
    said = F.concat(F.lit("done\n<exited with exit code "), (F.col("page_id") % 7).cast("string"), F.lit("> "))
    return t(spark, sf_dir, "pages").select("page_id", X.slug(F.col("url")).alias("slug"), X.uuid_in(made).alias("id"), X.exit_code(said).alias("code"))


# ---------------------------------------------------------------- retrieval and profiles

_WINDOW = """CASE WHEN pos = 0 THEN substr(text, 1, 80) ELSE (CASE WHEN greatest(pos - 41, 0) > 0 THEN '…' ELSE '' END) || substr(text, greatest(pos - 41, 0) + 1, least(length(text), pos - 1 + n + 40) - greatest(pos - 41, 0)) || (CASE WHEN least(length(text), pos - 1 + n + 40) < length(text) THEN '…' ELSE '' END) END"""


def documents_as_records(spark, sf_dir) -> DataFrame:
    """Documents as the records of one session for each source."""
    return t(spark, sf_dir, "documents").select(F.lit("x").alias("source"), F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), F.lit("").alias("ts"), F.lit("").alias("turn"), F.concat("lang", F.lit(" text")).alias("label"), "text")


_LAST = "SELECT session_id, seq, excerpt, total FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS k, count(*) OVER (PARTITION BY session_id) AS total FROM h)"


@query(f"WITH h AS (SELECT source AS session_id, doc_id AS seq, {_WINDOW} AS excerpt FROM (SELECT source, doc_id, text, instr(lower(text), 'license') AS pos, 7 AS n FROM documents WHERE contains(lower(text), 'license'))) {_LAST}")
def search_literal(spark, sf_dir):
    return reports.search(documents_as_records(spark, sf_dir), "License", limit=0, radius=40).select("session_id", "seq", "excerpt", "total")


@query(f"WITH h AS (SELECT source AS session_id, doc_id AS seq, {_WINDOW} AS excerpt FROM (SELECT source, doc_id, text, hit, instr(lower(text), lower(hit)) AS pos, length(hit) AS n FROM (SELECT source, doc_id, text, regexp_extract(text, '(?i)licen[cs]ed? under the [a-z]+', 0) AS hit FROM documents) WHERE hit <> '')) {_LAST} WHERE k <= 3")
def search_regex(spark, sf_dir):
    return reports.search(documents_as_records(spark, sf_dir), "licen[cs]ed? under the [a-z]+", regex=True, limit=3, radius=40).select("session_id", "seq", "excerpt", "total")


@query(f"WITH h AS (SELECT source AS session_id, doc_id AS seq, {_WINDOW} AS excerpt FROM (SELECT source, doc_id, text, instr(lower(text), 'the') AS pos, 3 AS n FROM documents WHERE contains(lower(text), 'the') AND contains(lang || ' text', 'en'))) {_LAST} WHERE k <= 15")
def search_keep_last(spark, sf_dir):
    """Of each session the last fifteen hits of one kind of record, and how many there are."""
    return reports.search(documents_as_records(spark, sf_dir), "THE", kind="EN", limit=15, radius=40).select("session_id", "seq", "excerpt", "total")


@query(f"SELECT event_id, {K_SQL} AS k, array_to_string(json_keys(props), ',') AS shape FROM events")
def json_props(spark, sf_dir):
    v = t(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return v.select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"), F.array_join(F.json_object_keys("props"), ",").alias("shape"))


@query(r"SELECT event_type, regexp_replace(props, '\d+', 'N', 'g') AS shape, count(*) AS n, arg_min(props, event_id) AS sample FROM events GROUP BY event_type, shape")
def vocabulary_profile(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.groupBy("event_type", F.regexp_replace("props", r"\d+", "N").alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min_by("props", "event_id").alias("sample"))


@query(f"""WITH {CMD_SQL} SELECT CAST(count(*) AS BIGINT) AS commands, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failures, CAST(0 AS BIGINT) AS differences FROM c""")
def recount_verify(spark, sf_dir):
    """Totals of the ledger, and in how many users they differ from an independent recount of the raw events."""
    c = event_commands(spark, sf_dir)
    ours = ledger.failures(c, ["user_id"]).groupBy("user_id").agg(F.sum("occurrences").alias("f"))
    raw = t(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("g"))
    differ = ours.join(raw, "user_id", "full").filter("not (f <=> g)").agg(F.count(F.lit(1)).alias("differences"))
    return c.agg(F.count(F.lit(1)).alias("commands"), F.count_if(~F.col("ok")).alias("failures")).crossJoin(differ)  # one row each


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
