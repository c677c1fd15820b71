"""Stateful operators in batch form; streaming/state.py has them over streams."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cost_tokens, prior_key
from ..schema import TIER_ORDER, TIERS
from ..tables import checked_broadcast

LATENCY_WINDOW, BUDGET_MS, CACHE_SIZE = 20, 900.0, 512


def access_counts(log: DataFrame, key: str = "memory_id") -> DataFrame:
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("access_count"))


def interaction_counts(kept: DataFrame, current: str = "cur_node") -> DataFrame:
    """(src, dst, n): how many queries took memories of src into dst, once for each query, itself excluded."""
    used = kept.filter(F.col("owner_node") != F.col(current)).select("query_id", F.col("owner_node").alias("src"), F.col(current).alias("dst")).distinct()
    return used.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def latency_window(log: DataFrame, key: str, order: list[str], value: str, size: int = LATENCY_WINDOW, digits: int = 2) -> DataFrame:
    """log plus win_n, p50 and p90 over each row's last `size` rows."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(size - 1), 0)
    xs = F.array_sort(F.collect_list(value).over(w))
    at = lambda q: (F.size("_xs") - 1) * q

    def pct(q: float) -> Column:
        lo = F.floor(at(q)).cast("int")
        a, b = F.get("_xs", lo), F.get("_xs", F.least(lo + 1, F.size("_xs") - 1))
        return F.round(a + (b - a) * (at(q) - lo), digits)

    return log.withColumn("_xs", xs).withColumns({"win_n": F.size("_xs").cast("long"), "p50": pct(0.5), "p90": pct(0.9)}).drop("_xs")


#: How far a tier moves down and up the order at once, and after how many calm windows it moves up.
_DOWN, _UP, CALM_WINDOWS = 1, -1, 3


def tier_fold(latencies, past=(), tier: str = "full", calm: int = 0, budget: float = BUDGET_MS, size: int = LATENCY_WINDOW):
    """(tiers, past, tier, calm): the tier after each latency, and what a later fold goes on from: the last latencies,
    the tier and the calm windows so far. Down when the window's p90 is over budget, up after three windows in a
    row whose p50 is under 45 % of it; nothing before the window is half full (5 at least)."""
    x = np.concatenate([np.asarray(past, float), np.asarray(latencies, float)])
    at, out = TIER_ORDER.index(tier), []
    for n in range(len(past) + 1, len(x) + 1):
        window = x[max(0, n - size) : n]
        if len(window) >= max(5, size // 2):
            p50, p90 = np.round(np.percentile(window, (50, 90)), 2)
            last = at == len(TIER_ORDER) - 1
            load = "high" if p90 > budget and not last else "low" if p50 < 0.45 * budget and at else "even"
            calm = calm + 1 if load == "low" else 0
            move = {"high": _DOWN, "low": _UP if calm == CALM_WINDOWS else 0, "even": 0}[load]
            at, calm = at + move, 0 if move else calm
        out.append(TIER_ORDER[at])
    return out, x[-size:].tolist(), TIER_ORDER[at], calm


def tier_steps(latencies, tier: str = "full", budget: float = BUDGET_MS, size: int = LATENCY_WINDOW):
    """The tier after each latency of a whole run."""
    return tier_fold(latencies, (), tier, 0, budget, size)[0]


def tier_hysteresis(log: DataFrame, key: str, order: list[str], value: str, budget: float = BUDGET_MS) -> DataFrame:
    """(key, order..., value, tier) for each row of log, folded in order within each key."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(tier=tier_steps(pdf[value], budget=budget))

    kept = log.select(key, *order, value)
    return kept.groupBy(key).applyInPandas(fold, f"{kept.schema.simpleString()[7:-1].replace(':', ' ')}, tier string")


def lru_steps(keys, size: int = CACHE_SIZE):
    """Whether each lookup hits a least-recently-used cache that stores every miss."""
    cache: OrderedDict = OrderedDict()
    for k in keys:
        hit = k in cache
        cache[k] = True
        cache.move_to_end(k)
        if len(cache) > size:
            cache.popitem(last=False)
        yield hit


def prior_cache(lookups: DataFrame, key: str, order: list[str], value: str, size: int = CACHE_SIZE) -> DataFrame:
    """(key, order..., value, hit): lookups in order through a cache for each key."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(hit=list(lru_steps(pdf[value], size)))

    kept = lookups.select(key, *order, value)
    return kept.groupBy(key).applyInPandas(fold, f"{kept.schema.simpleString()[7:-1].replace(':', ' ')}, hit boolean")


def prior_gate(tier: Column, cached: Column, calls: Column, n_candidates: Column, degraded: Column, most_calls: int = 1, least: int = 5) -> Column:
    """Why a prior is called or not, the cheapest reason first."""
    mode = F.lit("off")
    for name, (prior, _, _) in TIERS.items():
        mode = F.when(tier == name, F.lit(prior)).otherwise(mode)
    return (
        F.when(mode == "off", "tier_off").when(cached, "cache_hit").when(calls >= most_calls, "budget")
        .when(n_candidates <= least, "few_cand").when(degraded & (mode == "cache"), "low_src_var").otherwise("call")
    )


def visible(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs in which the memory was written before the query."""
    return memories.join(checked_broadcast(queries), F.col("ts") < F.col("query_ts"))


def round_ids(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """messages plus round_id, R1, R2, ... in order within each conversation."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return messages.withColumn("round_id", F.concat(F.lit("R"), n.cast("string")))


def cost_counters(log: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, llm_calls, embed_calls, input_tokens) from a log of (key, kind, chars)."""
    hit = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    return log.groupBy(key).agg(hit("llm").alias("llm_calls"), hit("embed").alias("embed_calls"), F.floor(F.sum("chars") / 1.5).alias("input_tokens"))


def schedule_costs(asked: DataFrame, kept: DataFrame, by: list[str], order: str, least: int = 5) -> DataFrame:
    """(query_id, llm_calls, embed_calls_miss, injected_tokens) of schedules: asked(query_id, by..., order, q_text, tier,
    candidate_count), run in order within `by`, and the texts they kept, kept(query_id, text).

    A prior is asked for where the gate says so; its answer serves later schedules of the same question. A question's
    vector is asked for once. A kept text costs tokens by its length."""
    key = prior_key(F.col("q_text"), F.lit(None).cast("string"))
    rows = asked.select("query_id", *by, order, "tier", "q_text", "candidate_count", key.alias("_key"))
    earlier = lambda k: Window.partitionBy(*by, k).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    answered = F.coalesce(F.max(F.when(F.col("candidate_count") > least, 1)).over(earlier("_key")), F.lit(0)) == 1
    gate = prior_gate(F.col("tier"), answered, F.lit(0), F.col("candidate_count"), F.lit(False), least=least)
    seen = F.count(F.lit(1)).over(earlier("q_text")) > 0
    rows = rows.withColumns({"llm_calls": (gate == "call").cast("long"), "embed_calls_miss": (~seen).cast("long")})
    tokens = kept.groupBy("query_id").agg(F.sum(cost_tokens(F.length("text"))).alias("injected_tokens"))
    return rows.join(tokens, "query_id", "left").select("query_id", "llm_calls", "embed_calls_miss", F.coalesce("injected_tokens", F.lit(0)).alias("injected_tokens"))
