"""Every query over the driver's tables against its SQL in DuckDB, and the operators against plain Python models."""

import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.operators import fit, ordered
from tracewright.plans import audit_queries, log_queries, table_queries, text_queries

pytestmark = pytest.mark.usefixtures("interpreted")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(df):
    return sorted(tuple("-" if pd.isna(x) else f"{x:.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


_PLANS = (table_queries, log_queries, audit_queries, text_queries)
QUERIES, SQL = ({k: v for p in _PLANS for k, v in of(p).items()} for of in (lambda p: p.queries(), lambda p: p.oracle_sql()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


def model_fit(costs, budget, base, guaranteed, n_tiers):
    """costs newest first."""
    est = lambda x: int((x / 4 + 0.5) // 1)
    tiers = [n_tiers - 1 if k < guaranteed else 0 for k in range(len(costs))]
    used = base + sum(est(c[-1]) for c in costs[:guaranteed])
    for rank in range(1, n_tiers):
        for k, c in enumerate(costs):
            delta = est(c[rank] - c[tiers[k]])
            if tiers[k] < rank and used + delta <= budget:
                tiers[k], used = rank, used + delta
    return used, tiers


def test_tier_fit(spark):
    rng = random.Random(3)
    cases = [([[0, *sorted(rng.randrange(0, 900) for _ in range(2)), rng.randrange(0, 2000)] for _ in range(rng.randrange(0, 9))], rng.randrange(0, 900)) for _ in range(200)]
    df = spark.createDataFrame([(k, c, b) for k, (c, b) in enumerate(cases)], "k int, costs array<array<bigint>>, budget bigint")
    rows = df.select("k", fit.fit_tiers(F.col("costs"), F.col("budget"), F.lit(10), 2, 4).alias("f")).collect()
    for r in rows:
        costs, budget = cases[r["k"]]
        assert (r["f"]["used"], r["f"]["tiers"]) == model_fit(costs, budget, 10, 2, 4)


def test_fit_of_rows(spark):
    rng = random.Random(4)
    for n, budget, guaranteed in ((0, 50, 1), (1, 0, 1), (40, 600, 1), (300, 900, 3), (300, 20, 0), (500, 30_000, 2)):
        costs = [[0, a, a + b] for a, b in ((rng.randrange(40, 900), rng.choice((40, 41, 400, 4000))) for _ in range(n))]
        rows = spark.createDataFrame([(n - k, c) for k, c in enumerate(costs)], "number long, cost array<bigint>").repartition(7)
        got = {r["number"]: r["tier"] for r in fit.fit_rows(rows, "number", budget, guaranteed=guaranteed, n_tiers=3, least=10).collect()}
        assert [got.get(n - k, 0) for k in range(n)] == model_fit(costs, budget, 0, guaranteed, 3)[1]


def test_fit_of_a_million(spark):
    """Rows in any number, and one long array: both in near-linear time."""
    import numpy as np

    cost = F.array(F.lit(0), 60 + F.pmod(F.xxhash64("id"), F.lit(500)), 600 + F.pmod(F.xxhash64("id"), F.lit(5000)))
    rows = spark.range(1_000_000).select(F.col("id").alias("number"), cost.cast("array<bigint>").alias("cost"))
    began = time.perf_counter()
    got = {r["number"]: r["tier"] for r in fit.fit_rows(rows, "number", 40_000, guaranteed=1, n_tiers=3, least=10).collect()}
    assert time.perf_counter() - began < 60
    costs = np.array([r["cost"] for r in rows.orderBy(F.desc("number")).limit(100_000).collect()])
    began = time.perf_counter()
    _, tiers = fit.greedy(costs, 40_000, 0, 1)
    assert time.perf_counter() - began < 5 and {999_999 - k: v for k, v in enumerate(tiers.tolist()) if v} == {k: v for k, v in got.items() if k > 900_000 - 1}


def test_carried_over_segments(spark):
    """The same as one window, for keys of any length; one key's rows lie in many tasks."""
    at = F.xxhash64("id")
    df = spark.range(60_000).select((F.col("id") % 100 % 7 % 3).alias("key"), F.col("id").alias("seq"), F.when(at % 50 == 0, at).alias("x"), F.when(at % 9001 == 0, F.lit("y")).alias("y"))
    want = df.select("key", "seq", ordered.carry_forward(F.col("x"), ["key"], "seq").alias("a"), ordered.carry_forward(F.col("y"), ["key"], "seq").alias("b"))
    got = ordered.carried(df, {"a": F.col("x"), "b": F.col("y")}, ["key"], "seq", bits=9)
    assert got.columns == ["key", "seq", "x", "y", "a", "b"] and got.select(*want.columns).exceptAll(want).isEmpty() and got.count() == 60_000
    one = ordered.carried(df.withColumn("key", F.lit(1)), {"a": F.col("x")}, ["key"], "seq", bits=9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [r["count"] for r in one.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 8 and max(rows) < 20_000


def test_texts(spark):
    row = spark.range(1).select(
        X.clip(F.lit("abcdef  "), 3).alias("a"), X.clip_tail(F.lit("abcdef"), 2).alias("b"), X.one_line(F.lit(" a \n  b "), 10).alias("c"), X.telltale_line(F.lit("+ x error\nno such word\nlast one")).alias("d"),
        X.human_size(F.lit(1536)).alias("e"), X.duration(F.lit(61_000)).alias("f"), X.ago(F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(7200))).alias("g"), X.blockquote(F.lit(" a\nb ")).alias("h"),
        X.cell(F.lit("a|b")).alias("i"), X.first_line(F.lit("\n ** x**y")).alias("j"), X.relative_to(F.lit("/A/b/c"), "/a").alias("k"), X.title_of(F.lit("# head\nplease fix the broken thing")).alias("l"), X.clip(F.lit(None), 3).alias("m"),
        X.clip_doc(F.lit("abcd"), 2).alias("n"), X.tokens(F.lit(-2)).alias("o"),
    ).first()
    assert tuple(row) == ("abc …[+3 chars]", "…[4 earlier chars omitted]\nef", "a b", "last one", "2KB", "1m01s", "2h ago", "> a\n> b", "a\\|b", "xy", "b/c", "please fix the broken", "", "ab\n\n…[+2 chars omitted]", 0)


def test_roots(spark):
    nodes = [(1, 1, None, "a"), (1, 2, 1, "b"), (1, 3, 2, "c"), (1, 4, 3, None), (1, 5, None, None), (1, 6, 5, "f"), (1, 7, 6, "g")]
    got = ordered.roots(spark.createDataFrame(nodes, "s int, id int, up int, v string"), ["s"], "id", "up", "v").collect()
    assert {r["id"]: r["v"] for r in got} == {1: "a", 2: "a", 3: "a", 4: "a", 5: None, 6: "f", 7: "f"}
