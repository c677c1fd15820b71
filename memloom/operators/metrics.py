"""Ranking metrics, aggregates, diagnostics and significance."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from hashlib import md5
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED, N_BOOT = 20261008, 10_000


class OfTopic(NamedTuple):
    """A query's relevant memories as all of its topic but itself: queries(query_id, owner_node) and
    pool(memory_id, owner_node), whose pairs are never formed."""

    queries: DataFrame
    pool: DataFrame


def relevant_among(relevant: DataFrame | OfTopic, rows: DataFrame) -> DataFrame:
    """The distinct pairs (query_id, memory_id) of relevant, at least those that rows(query_id, memory_id) hold."""
    if not isinstance(relevant, OfTopic):
        return relevant.select("query_id", "memory_id").distinct()
    some = rows.select("query_id", "memory_id").distinct().join(relevant.queries.distinct(), "query_id")
    return some.join(relevant.pool.distinct(), ["memory_id", "owner_node"]).filter("memory_id != query_id").select("query_id", "memory_id").distinct()


def relevant_counts(relevant: DataFrame | OfTopic) -> DataFrame:
    """(query_id, n_relevant) of the queries that have relevant memories."""
    if not isinstance(relevant, OfTopic):
        return relevant.select("query_id", "memory_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    size = relevant.pool.groupBy("owner_node").agg(F.count_distinct("memory_id").alias("_n"))
    asked = relevant.queries.distinct()
    itself = relevant.pool.distinct().withColumnRenamed("memory_id", "query_id").withColumn("_own", F.lit(1))
    n = asked.join(size, "owner_node").join(itself, ["query_id", "owner_node"], "left")
    return n.groupBy("query_id").agg(F.sum(F.col("_n") - F.coalesce("_own", F.lit(0))).alias("n_relevant")).filter("n_relevant > 0")


def judged(kept: DataFrame, relevant: DataFrame | OfTopic) -> DataFrame:
    """kept(query_id, memory_id, pick_rank) plus hit, by relevant(query_id, memory_id)."""
    r = relevant_among(relevant, kept).withColumn("hit", F.lit(1))
    return kept.join(r, ["query_id", "memory_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def ranking_metrics(kept: DataFrame, relevant: DataFrame | OfTopic, k: int, queries: DataFrame) -> DataFrame:
    """One row for each query: n_relevant, n_kept, n_hit, recall, ceiling, recall_norm, precision, first_rank,
    mrr and ndcg. A query without relevant or kept rows has 0; ndcg caps k and its ideal by the kept rows."""
    n_rel = relevant_counts(relevant)
    gain = F.col("hit") / F.log2(F.col("pick_rank") + 1.0)
    per = judged(kept, relevant).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_kept"), F.sum("hit").alias("n_hit"), F.min(F.when(F.col("hit") == 1, F.col("pick_rank"))).alias("first_rank"), F.sum(F.when(F.col("pick_rank") <= k, gain)).alias("dcg")
    )
    out = queries.select("query_id").join(n_rel, "query_id", "left").join(per, "query_id", "left").fillna(0, ["n_relevant", "n_kept", "n_hit", "dcg"])
    ideal_n = F.least(F.col("n_relevant"), F.lit(k), F.col("n_kept")).cast("int")
    ideal = F.when(ideal_n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(ideal_n, F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))).otherwise(F.lit(0.0))
    out = out.withColumn("recall", F.when(F.col("n_relevant") > 0, F.col("n_hit") / F.col("n_relevant")).otherwise(F.lit(0.0)))
    out = out.withColumn("ceiling", F.when(F.col("n_relevant") > 0, F.least(F.lit(1.0), k / F.col("n_relevant"))).otherwise(F.lit(0.0)))
    out = out.withColumn("recall_norm", F.when(F.col("ceiling") > 0, F.col("recall") / F.col("ceiling")).otherwise(F.lit(0.0)))
    out = out.withColumn("precision", F.when(F.col("n_kept") > 0, F.col("n_hit") / F.col("n_kept")).otherwise(F.lit(0.0)))
    out = out.withColumn("mrr", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))
    return out.withColumn("ndcg", F.when(ideal > 0, F.col("dcg") / ideal).otherwise(F.lit(0.0))).drop("dcg")


def source_hit_rate(kept: DataFrame, relevant_sources: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, source_hit): the share of labelled sources among the kept rows' owners; null without labels."""
    own = kept.select("query_id", "owner_node").distinct().withColumn("_h", F.lit(1.0))
    per = relevant_sources.select("query_id", "owner_node").distinct().join(own, ["query_id", "owner_node"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_h", F.lit(0.0))).alias("source_hit"))
    return queries.select("query_id").join(per, "query_id", "left")


def multi_source_ratio(kept: DataFrame) -> DataFrame:
    """(query_id, multi_source_ratio): 1 less the largest source's share of the kept rows."""
    per = kept.groupBy("query_id", "owner_node").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("query_id").agg((1 - F.max("n") / F.sum("n")).alias("multi_source_ratio"))


def cross_source_relevance(kept: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, cross_source_relevance): the mean source score over kept rows whose owner is a source."""
    s = sources.select("query_id", F.col("node_id").alias("owner_node"), "src_score")
    return kept.join(s, ["query_id", "owner_node"]).groupBy("query_id").agg(F.avg("src_score").alias("cross_source_relevance"))


def percentiles(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """p50 and p90 (linear), max and n by keys."""
    return df.groupBy(*keys).agg(F.round(F.percentile(value, F.lit(0.5)), 2).alias("p50"), F.round(F.percentile(value, F.lit(0.9)), 2).alias("p90"), F.round(F.max(value), 2).alias("max"), F.count(F.lit(1)).alias("n"))


def group_aggregate(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Means of the measures by keys, without nulls and NaN, and n."""
    clean = lambda m: F.avg(F.when(~F.isnan(F.col(m)), F.col(m)))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(clean(m), 6).alias(f"avg_{m}") for m in measures])


def scene_aggregate(rows: DataFrame, measures: list[str]) -> DataFrame:
    """Means by group and by (group, scene) in one pass; scene null is the whole group."""
    clean = lambda m: F.avg(F.when(~F.isnan(F.col(m)), F.col(m)))
    cube = rows.withColumn("scene", F.coalesce("scene", F.lit("fact"))).groupingSets([["group"], ["group", "scene"]], "group", "scene")
    return cube.agg(F.count(F.lit(1)).alias("n"), *[F.round(clean(m), 6).alias(f"avg_{m}") for m in measures])


def dedup_rate(before: Column, after: Column) -> Column:
    """The share of rows that deduplication took away."""
    return F.when(before > 0, F.round(F.greatest(F.lit(0), before - after) / before, 6)).otherwise(F.lit(0.0))


def candidate_hit_rate(candidates: DataFrame, relevant: DataFrame | OfTopic, queries: DataFrame) -> DataFrame:
    """(query_id, cand_hit_rate): the share of relevant memories among the candidates; 0 without any."""
    found = candidates.select("query_id", "memory_id").distinct().join(relevant_among(relevant, candidates), ["query_id", "memory_id"], "left_semi")
    per = relevant_counts(relevant).join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")), "query_id").select("query_id", (F.col("_n") / F.col("n_relevant")).alias("cand_hit_rate"))
    return queries.select("query_id").join(per, "query_id", "left").fillna(0.0, ["cand_hit_rate"])


# The measures of an episode that a group's summary averages, those it also averages over the
# episodes with several relevant sources, and the places they are rounded to.
MEASURES = (
    "recall_kept", "ceiling", "recall_norm", "cand_hit_rate", "mrr", "ndcg_at_k", "source_hit_rate", "multi_source_ratio",
    "cross_source_relevance", "dedup_rate", "candidate_count", "scope_size", "kept", "injected_tokens", "llm_calls", "embed_calls_miss", "latency_ms",
)
MULTI = ("multi_source_ratio", "recall_kept", "source_hit_rate")
PLACES = 4


def summarise(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A group's summary: n_episodes, n_multi_source_episodes, avg_<measure>, avg_<measure>_multi, p50 and p90 of
    the latency, n_relevant_mean and n_sources_mean. Rows hold MEASURES (absent ones are left out of the
    result), n_relevant, n_sources and n_relevant_sources; nulls and NaN are left out of a mean, which is 0
    without values but for source_hit_rate, where it is null."""
    has = [m for m in MEASURES if m in rows.columns]
    value = lambda m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))
    mean = lambda x, m: F.avg(x) if m == "source_hit_rate" else F.coalesce(F.avg(x), F.lit(0.0))
    multi = F.col("n_relevant_sources") >= 2
    out = [F.count(F.lit(1)).alias("n_episodes"), F.count_if(multi).alias("n_multi_source_episodes")]
    out += [F.round(mean(value(m), m), PLACES).alias(f"avg_{m}") for m in has]
    out += [F.round(F.coalesce(F.avg(F.when(multi, value(m))), F.lit(0.0)), PLACES).alias(f"avg_{m}_multi") for m in MULTI if m in has]
    if "latency_ms" in has:
        # in binary arithmetic, as SQL: a median of two values of two places is a half more often than not
        out += [(F.floor(F.percentile("latency_ms", F.lit(q)) * 100 + 0.5) / 100).alias(f"p{int(100 * q)}_latency_ms") for q in (0.5, 0.9)]
    out += [F.round(F.avg(c), PLACES).alias(f"{c}_mean") for c in ("n_relevant", "n_sources") if c in rows.columns]
    return rows.groupBy(*keys).agg(*out)


# What the groups' summaries must show. Name, group, other group (or none), measure, bound, how
# the difference compares with it, and whether it is rounded to PLACES before.
CRITERIA = (
    ("structure_recall", "graph_g4", "graph_g2", "avg_recall_kept", 0.0, ">", False),
    ("structure_source_hit", "graph_g4", "graph_g2", "avg_source_hit_rate", 0.0, ">", False),
    ("attribution_recall_norm", "graph_g4", "graph_g1", "avg_recall_norm", 0.05, ">=", True),
    ("source_selection_hit", "graph_g4", "graph_g3", "avg_source_hit_rate", 0.08, ">=", True),
    ("scheduling_recall", "graph_g1", "graph_g0", "avg_recall_kept", 0.0, ">", True),
    ("speed_p90", "graph_g4", None, "p90_latency_ms", 1000.0, "<", False),
    ("multi_source", "graph_g4", None, "avg_multi_source_ratio_multi", 0.3, ">", False),
)


def judge(summaries: DataFrame) -> DataFrame:
    """(criterion, value, pass) from summaries(group, ...) as summarise gives them; nulls where a group or a
    measure is missing. One aggregate over the summaries."""
    name, diffs = [], []
    for criterion, g, other, measure, *_ in CRITERIA:
        pick = lambda x, m=measure: F.max(F.when(F.col("group") == x, F.col(m)))
        diffs.append((pick(g) - pick(other) if other else pick(g)).cast("double").alias(criterion))
        name.append(criterion)
    long = summaries.agg(*diffs).unpivot([], name, "criterion", "raw")
    passed = F.lit(None).cast("boolean")
    for criterion, _, _, _, bound, how, first in CRITERIA:
        v = F.round("raw", PLACES) if first else F.col("raw")
        passed = F.when(F.col("criterion") == criterion, {">": v > bound, ">=": v >= bound, "<": v < bound}[how]).otherwise(passed)
    return long.select("criterion", F.round("raw", PLACES).alias("value"), passed.alias("pass"))


def flat_metrics(kept: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, recall, precision, rank) of flat episodes: recall is 1 only if every relevant memory is kept;
    rank is that of the first relevant one, null without."""
    need = relevant.select("query_id", "memory_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("_need"))
    per = judged(kept, relevant).groupBy("query_id").agg(F.sum("hit").alias("_hit"), F.avg("hit").alias("precision"), F.min(F.when(F.col("hit") == 1, F.col("pick_rank"))).alias("rank"))
    out = queries.select("query_id").join(need, "query_id", "left").join(per, "query_id", "left")
    all_in = F.when(F.col("_need") > 0, F.when(F.coalesce("_hit", F.lit(0)) >= F.col("_need"), 1.0).otherwise(0.0)).otherwise(F.lit(0.0))
    return out.select("query_id", all_in.alias("recall"), F.coalesce("precision", F.lit(0.0)).alias("precision"), "rank")


def flat_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means of flat metrics by keys; the mean rank is over episodes that have one."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("recall", "precision", "rank")])


def episode_diagnosis(selected: DataFrame, relevant: DataFrame | OfTopic) -> DataFrame:
    """One row for each candidate of selected (a selector's result with bar): its scores, whether it is
    relevant and kept, and by how much it clears the bar."""
    r = relevant_among(relevant, selected).withColumn("relevant", F.lit(True))
    out = selected.join(r, ["query_id", "memory_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    return out.withColumn("margin", F.round(F.col("final") - F.col("bar"), 6))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def paired(rows: DataFrame, a: str, b: str, measure: str) -> DataFrame:
    """(episode_id, diff) of the episodes that both groups have; the last row of an episode counts."""
    x, y = (rows.filter(F.col("group") == g).select("episode_id", F.coalesce(measure, F.lit(0.0)).alias(n)) for g, n in ((a, "_a"), (b, "_b")))
    return x.join(y, "episode_id").select("episode_id", (F.col("_a") - F.col("_b")).alias("diff"))


def paired_stats(diffs: DataFrame) -> DataFrame:
    sd = F.coalesce(F.stddev_samp("diff"), F.lit(0.0))
    return diffs.agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("delta"), sd.alias("sd"), F.when(sd > 1e-12, F.avg("diff") / sd).otherwise(F.lit(0.0)).alias("cohens_d"))


def _draws(seed: int, n: int, times: int):
    """The first `times` runs of n numbers that the standard generator's randrange(n) gives, from blocks of its 32-bit
    words: the leading bits of each, and what is n or more is drawn again. One run is held."""
    _, state, _ = random.Random(seed).getstate()
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    shift, held = np.uint64(32 - n.bit_length()), np.zeros(0, np.int64)
    for _ in range(times):
        got, have = [held], len(held)
        while have < n:
            some = words.random_raw(max(256, n - have)) >> shift
            got.append(some[some < n].astype(np.int64))
            have += len(got[-1])
        every = np.concatenate(got)
        yield every[:n]
        held = every[n:]


def bootstrap(diffs: list[float], n_boot: int = N_BOOT, seed: int = SEED) -> tuple[float, float, float]:
    """(low, high, two-sided p) of the mean of paired differences: the 2.5 and 97.5 % order statistics of
    resampled means, and twice the smaller share of them on either side of zero. The draws are those of the
    standard generator, one after another; the memory is that of one."""
    x = np.asarray(diffs, float)
    if x.size < 2:
        only = float(x.sum())
        return only, only, 1.0
    total = np.array([np.cumsum(x[picks])[-1] for picks in _draws(seed, x.size, n_boot)])
    means = np.sort(total / x.size)
    up_to_zero, below_zero = np.searchsorted(means, 0.0, "right"), np.searchsorted(means, 0.0, "left")
    tail = min(up_to_zero, n_boot - below_zero)
    low, high = means[[int(0.025 * n_boot), min(n_boot - 1, int(0.975 * n_boot))]]
    return float(low), float(high), min(1.0, float(2 * tail / n_boot))


def paired_bootstrap(diffs: DataFrame, keys: list[str], n_boot: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """keys plus delta, ci_low, ci_high, p, cohens_d and n of diffs(keys, episode_id, diff). Comparisons run
    in parallel; a comparison's episodes stand in one task, some numbers each, since the draws depend on their order."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("episode_id")["diff"].tolist()
        lo, hi, p = bootstrap(d, n_boot, seed)
        mean = sum(d) / len(d)
        sd = (sum((x - mean) ** 2 for x in d) / (len(d) - 1)) ** 0.5 if len(d) > 1 else 0.0
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "delta": mean, "ci_low": lo, "ci_high": hi, "p": p, "cohens_d": mean / sd if sd > 1e-12 else 0.0, "n": len(d)}])

    kinds = dict(diffs.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", delta double, ci_low double, ci_high double, p double, cohens_d double, n long"
    return diffs.groupBy(*keys).applyInPandas(run, schema)


#: Draws that one digest serves, 32 bits each; how often a row is drawn is Poisson(1), up to 11 times.
LANES = 4
POISSON = [int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(11)]


#: Episodes whose draws a task holds at once; comparisons whose sums it holds before it gives them out.
HELD_EPISODES, HELD_KEYS = 128, 64


def _sums_of_draws(rows: DataFrame, keys: list[str], n_boot: int, seed: int) -> DataFrame:
    """keys plus s and n, arrays over the draws, of parts of rows(keys, episode_id, diff). An episode's rows stand in one
    task, so that its digests are made once for all comparisons; a task adds up its rows by matrix products."""
    n_blocks = -(-n_boot // LANES)
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("n", T.ArrayType(T.LongType()))])
    heads = [f"{seed}:{b}:".encode() for b in range(n_blocks)]
    bounds = np.array(POISSON, np.uint64)

    def taken(episode: str | None) -> np.ndarray:
        names = [h[:-1] for h in heads] if episode is None else [h + tail for tail in (episode.encode(),) for h in heads]
        u = np.frombuffer(b"".join([md5(x, usedforsecurity=False).digest() for x in names]), ">u4")[:n_boot]
        return np.searchsorted(bounds, u.astype(np.uint64), "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            cols = [pa.array([k[i] for k in sums], f.type) for i, f in enumerate(fields)]
            both = [pa.array([v[i].tolist() for v in sums.values()], pa.list_(t)) for i, t in enumerate((pa.float64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*cols, *both], names=schema.names)

        for b in batches:
            fields = list(b.schema)[: len(keys)]
            for at in range(0, b.num_rows, HELD_EPISODES):
                part = b.slice(at, HELD_EPISODES)
                episodes = part.column(len(keys)).to_pylist()
                place = {e: i for i, e in enumerate(dict.fromkeys(episodes))}
                w = np.array([taken(e) for e in place], float)
                row = np.array([place[e] for e in episodes])
                diff = part.column(len(keys) + 1).to_numpy(zero_copy_only=False)
                of: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(*(part.column(c).to_pylist() for c in range(len(keys))), strict=True)):
                    of.setdefault(key, []).append(i)
                for key, i in of.items():
                    if key not in sums:
                        if len(sums) >= HELD_KEYS:
                            yield out()
                            sums.clear()
                        sums[key] = [np.zeros(n_boot), np.zeros(n_boot, np.int64)]
                    sums[key][0] += diff[i] @ w[row[i]]
                    sums[key][1] += w[row[i]].sum(0).astype(np.int64)
        if sums:
            yield out()

    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, 16)
    dealt = rows.select(*keys, F.col("episode_id").cast("string").alias("episode_id"), "diff").repartition(tasks, "episode_id").sortWithinPartitions("episode_id")
    return dealt.mapInArrow(run, schema)


def hashed_bootstrap(diffs: DataFrame, keys: list[str], n_boot: int = N_BOOT, seed: int = SEED, digits: int = 9) -> DataFrame:
    """keys plus delta, ci_low, ci_high, p and n of diffs(keys, episode_id, diff), at any number of episodes.

    How often draw b takes an episode is Poisson(1), told by a digest of (seed, b, episode_id) alone: tasks add up
    the draws of the rows they hold, in any order, and only n_boot sums a comparison move. A draw's mean is over
    what it takes, 0 if that is nothing, rounded. The interval's ends and p are those of bootstrap(); a comparison
    of one episode is its own interval. Null diffs count as 0."""
    rows = diffs.select(*keys, "episode_id", F.coalesce("diff", F.lit(0.0)).alias("diff"))
    sums = _sums_of_draws(rows, keys, n_boot, seed)
    each = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(n_boot - 1)).alias("draw"), F.col("s"), F.col("n")))
    sums = sums.select(*keys, each.alias("d")).groupBy(*keys, "d.draw").agg(F.sum("d.s").alias("s"), F.sum("d.n").alias("n"))
    means = sums.select(*keys, F.round(F.coalesce(F.when(F.col("n") > 0, F.col("s") / F.col("n")), F.lit(0.0)), digits).alias("mean"))
    ordered = F.array_sort(F.collect_list("mean"))  # n_boot of them
    tail = F.least(F.count_if(F.col("mean") <= 0), F.count_if(F.col("mean") >= 0))
    ends = means.groupBy(*keys).agg(ordered.alias("m"), F.least(F.lit(1.0), 2 * tail / n_boot).alias("p"))
    ends = ends.select(*keys, F.get("m", F.lit(int(0.025 * n_boot))).alias("low"), F.get("m", F.lit(min(n_boot - 1, int(0.975 * n_boot)))).alias("high"), "p")
    stats = rows.groupBy(*keys).agg(F.round(F.avg("diff"), digits).alias("delta"), F.count(F.lit(1)).alias("n"))
    one = F.col("n") < 2
    out = stats.join(ends, keys)
    return out.select(*keys, "delta", F.when(one, F.col("delta")).otherwise(F.col("low")).alias("ci_low"), F.when(one, F.col("delta")).otherwise(F.col("high")).alias("ci_high"), F.when(one, F.lit(1.0)).otherwise(F.col("p")).alias("p"), "n")


def dim_diagnostics(scored: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, min, max, mean, std, n_unique) of score columns."""
    long = scored.select(*dims).unpivot([], dims, "dim", "value")
    return long.groupBy("dim").agg(F.round(F.min("value"), 6).alias("min"), F.round(F.max("value"), 6).alias("max"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.count_distinct(F.round("value", 6)).alias("n_unique"))


def rank_curve(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """(k, coverage): the share of rows of ranks(rank) with rank <= k; null ranks are never covered."""
    return ranks.agg(*[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(str(k)) for k in ks]).unpivot([], [str(k) for k in ks], "k", "coverage").select(F.col("k").cast("long").alias("k"), F.round("coverage", 6).alias("coverage"))


# Upper ends of the rank buckets.
BUCKETS = (1, 3, 5, 10, 20, 50)


def rank_bucket(rank: Column) -> Column:
    out, low = F.lit(f">{BUCKETS[-1]}"), 1
    names = []
    for hi in BUCKETS:
        names.append((hi, str(hi) if hi == low else f"{low}-{hi}"))
        low = hi + 1
    for hi, name in reversed(names):
        out = F.when(rank <= hi, F.lit(name)).otherwise(out)
    return out
