"""Fitting to a token budget: greedy tiers with carried state, of one session's turns or of any number of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import tokens

TURN_TIERS = ("omit", "digest", "brief", "full")
CARD_TIERS = ("omit", "brief", "full")


def turn_costs(ask: Column, final: Column, rest: Column) -> Column:
    """Characters of a turn in each tier; ``rest`` are those of notes, reasoning and actions with their overheads."""
    a, f = F.coalesce(ask, F.lit(0)), F.coalesce(final, F.lit(0))
    return F.array(F.lit(0), 60 + F.least(a, F.lit(140)) + F.least(f, F.lit(140)), 180 + F.least(a, F.lit(1200)) + F.least(f, F.lit(1200)), 60 + a + f + rest).cast("array<bigint>")


def greedy(costs: np.ndarray, budget: int, base: int, guaranteed: int) -> tuple[int, np.ndarray]:
    """Of a row of costs for each item, newest first: the tokens used and the tiers, one step for each item and tier."""
    n, n_tiers = costs.shape
    tiers = np.zeros(n, np.int32)
    tiers[:guaranteed] = n_tiers - 1
    used = base + int(((costs[:guaranteed, -1] + 2) // 4).sum())
    for rank in range(1, n_tiers):
        lower = np.flatnonzero(tiers < rank)
        deltas = (costs[lower, rank] - costs[lower, tiers[lower]] + 2) // 4
        for k, delta in zip(lower.tolist(), deltas.tolist()):
            if used + delta <= budget:
                tiers[k], used = rank, used + delta
    return used, tiers


FITTED = T.StructType([T.StructField("used", T.LongType()), T.StructField("tiers", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(FITTED)
def _greedy(flat: pd.Series, budget: pd.Series, base: pd.Series, guaranteed: pd.Series, n_tiers: pd.Series) -> pd.DataFrame:
    made = [greedy(np.asarray(c, np.int64).reshape(-1, n), int(b), int(s), int(g)) for c, b, s, g, n in zip(flat, budget, base, guaranteed, n_tiers)]
    return pd.DataFrame({"used": [u for u, _ in made], "tiers": [t.tolist() for _, t in made]})


def fit_tiers(costs: Column, budget: Column, base: Column, guaranteed: int, n_tiers: int) -> Column:
    """struct(used, tiers) for ``costs``: newest first, of each item its cost by tier, lowest tier first.

    The newest ``guaranteed`` items get the top tier whatever it costs. Then for each tier, lowest first, every item
    from the newest is raised to it if the budget still holds; one that does not fit is skipped and the next is tried.
    One array is one session's turns; for rows of any number there is :func:`fit_rows`.
    """
    none = F.coalesce(F.flatten(costs), F.array().cast("array<bigint>"))
    return _greedy(none, F.coalesce(budget.cast("bigint"), F.lit(0)), base.cast("bigint"), F.lit(guaranteed), F.lit(n_tiers))


def fit_rows(rows: DataFrame, key: str, budget: int, *, guaranteed: int, n_tiers: int, least: int) -> DataFrame:
    """(``key``, tier) of the rows that are raised above tier 0: :func:`fit_tiers` over rows (``key``, cost), the largest key
    the newest, without bringing them together.

    Only rows whose next step fits into what is left can be raised, and of those the first always is. So the newest few of
    them are fetched, as many as could be raised if each took ``least`` tokens, which every step does; the steps are decided
    on the driver, and the next few are asked for with what is left then. What the driver holds is bounded by the budget.
    """
    spark, top = rows.sparkSession, n_tiers - 1
    cost = lambda rank: F.element_at("cost", F.lit(rank + 1) if isinstance(rank, int) else rank + 1)
    newest = rows.orderBy(F.desc(key)).limit(guaranteed).select(key, tokens(cost(top)).cast("bigint").alias("d")).collect()
    held, used = {r[key]: top for r in newest}, sum(r["d"] for r in newest)
    for rank in range(1, n_tiers):
        tiers = spark.createDataFrame(list(held.items()), f"{key} {dict(rows.dtypes)[key]}, now int")
        now = F.coalesce("now", F.lit(0))
        steps = rows.join(F.broadcast(tiers), key, "left").filter(now < rank).select(key, tokens(cost(rank) - cost(now)).cast("bigint").alias("d"))
        after = None
        while budget - used >= least:
            fits = steps.filter((F.col("d") <= budget - used) & (F.lit(True) if after is None else F.col(key) < after))
            few = (budget - used) // least + 1
            found = fits.orderBy(F.desc(key)).limit(few).collect()
            for r in found:
                if used + r["d"] <= budget:
                    held[r[key]], used = rank, used + r["d"]
            if len(found) < few:
                break
            after = found[-1][key]
    return spark.createDataFrame(list(held.items()), f"{key} {dict(rows.dtypes)[key]}, tier int")


def plan_budget(costs: Column, budget: Column, spine: Column, guaranteed: int = 3) -> Column:
    """:func:`fit_tiers` of turns, all full where that fits or no budget is given."""
    full = spine.cast("bigint") + tokens(F.aggregate(costs, F.lit(0).cast("bigint"), lambda acc, c: acc + c[3])).cast("bigint")
    all_full = F.struct(full.alias("used"), F.transform(costs, lambda _: F.lit(3)).alias("tiers"))
    return F.when(F.coalesce(budget, F.lit(0)) == 0, all_full).when(full <= budget, all_full).otherwise(fit_tiers(costs, budget, spine, guaranteed, 4))


def ledger_caps(budget: int | None) -> dict[str, int]:
    """How many ledger rows a report of that budget lists."""
    if not budget:
        return {"files": 5000, "commands": 5000}
    share = max(3000, round(0.25 * budget))
    return {"files": max(20, share // 40), "commands": max(15, share // 60)}
