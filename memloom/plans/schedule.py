"""One schedule for all queries at once: source selection, recall, scoring, selection."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, retrieval, scoring, selection, stage_a, state
from ..operators.weights import PRESETS as WEIGHTS
from ..schema import TIERS
from ..tables import materialize
from .plugins import Callback, Embedding, Weight
from .presets import SchedulingConfig


def recall(cfg: SchedulingConfig, queries: DataFrame, pool: DataFrame, sources: DataFrame | None, k: int) -> DataFrame:
    """Candidates: exact similarity within the sources' scope, or the configured retriever on the whole pool."""
    if sources is not None:
        return retrieval.scoped_recall(queries, pool, sources, k, cfg.graph.fallback_all, cfg.graph.include_self)
    found = retrieval.get_retriever(cfg.retriever)(queries, pool, k)
    if "emb" not in found.columns:  # lexical recall returns keys and scores
        found = found.join(pool.drop("seq", "text"), "memory_id").join(queries.drop("q_text"), "query_id")
    return found


def select(cfg: SchedulingConfig, scored: DataFrame) -> DataFrame:
    if cfg.selector == "full":
        return selection.select_threshold(scored, cfg.threshold, cfg.max_shared)
    if cfg.selector == "cascade":
        return selection.select_cascade(scored, cfg.top_k, cfg.task_filter, cfg.version_filter, cfg.version_cos)
    return selection.SELECTORS[cfg.selector](scored, cfg.top_k)


def schedule(
    cfg: SchedulingConfig, queries: DataFrame, pool: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None,
    oracle: DataFrame | None = None, callbacks: tuple[Callback, ...] = (), embed: Embedding | None = None, weight: Weight | None = None,
    shared: dict | None = None,
) -> DataFrame:
    """One row for each (query_id, memory_id) candidate with its scores, kept and pick_rank.

    An explicit candidate cap or lambda precedes the tier's. Scores are rounded before they rank. oracle
    (query_id, node_id) takes the place of Stage A's choice: the labelled sources, each with score 1.
    Callbacks get each stage's lazy result as it is planned. embed gives queries and memories their vectors, from
    their texts. weight gives queries their own weights where the tier's gate lets a prior be asked for (not in
    the fast tier, nor for few candidates); it is asked once for all of them. shared holds candidates by what they
    depend on, written, for schedules of the same tables one after another.
    """
    if embed:
        queries, pool = queries.withColumn("q_emb", embed(F.col("q_text"))), pool.withColumn("emb", embed(F.col("text")))
    g, sources, lam = cfg.graph, None, None
    _, cap, tier_lam = TIERS[cfg.tier]
    k = cfg.candidates if cfg.candidates != SchedulingConfig.candidates else cap

    def tell(stage: str, df: DataFrame) -> DataFrame:
        for f in callbacks:
            f(stage, df)
        return df

    if oracle is not None:
        sources = oracle.select("query_id", "node_id").distinct().withColumns({"src_score": F.lit(1.0), "quota": F.lit(0).cast("long")})
    elif g.enabled:
        if len(g.strength_weights) > 1:
            edges = graph.multifactor_strength(graph.edge_factors(nodes, edges), g.strength_weights, g.strength_alpha)
        lam = g.lam if g.lam != type(g).lam else tier_lam
        sources = stage_a.select_sources(queries, nodes, edges, g.quota_mode, cfg.top_k, g.source_topk, lam, g.tau, g.depth, g.semantic_source_topk, g.full_cover, g.rel_var_threshold, g.min_quota)
        queries = stage_a.folded(queries, nodes)
    if sources is not None:
        sources = tell("sources", materialize(sources))  # some rows a query, read by three steps
    if shared is None:
        cand = recall(cfg, queries, pool, sources, k)
    else:  # quotas and bonuses come after recall
        key = repr((replace(g, quota_mode="none", mu=0.0, min_quota=0), g.enabled and lam, cfg.retriever, k, oracle is not None))
        if key not in shared:
            shared[key] = materialize(recall(cfg, queries, pool, sources, k))
        cand = shared[key]
    cand = tell("candidates", cand)
    weights = WEIGHTS.get(cfg.weight, WEIGHTS["full"])
    if weight:
        cand = cand.join(asked_weights(cfg, queries, cand, weight), "query_id", "left")
        weights = {d: F.coalesce(F.col("_weights")[d], F.lit(float(x))) for d, x in weights.items()}
    options = {"parity": cfg.parity} if cfg.attention == "full" else {"floor": cfg.semantic_floor} if cfg.attention in ("normalized", "adaptive_gated") else {}
    scored = scoring.SCORERS[cfg.attention](cand, weights=weights, enabled=cfg.enabled_dims, **options)
    if sources is not None:
        scored = scoring.add_source_bonus(scored, sources, g.mu if g.quota_mode != "none" else 0.0)
        quota = sources.select("query_id", F.col("node_id").alias("owner_node"), "quota")
        scored = scored.join(quota, ["query_id", "owner_node"], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
    else:
        scored = scored.withColumn("quota", F.lit(0))
    scored = tell("scored", scored.withColumn("final", F.round("final", retrieval.DIGITS)))
    return tell("selected", select(cfg, scored.drop("_weights")))


def asked_weights(cfg: SchedulingConfig, queries: DataFrame, cand: DataFrame, weight: Weight) -> DataFrame:
    """(query_id, _weights) of the queries for which the gate lets a prior be asked for."""
    n = cand.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    gate = state.prior_gate(F.lit(cfg.tier), F.lit(False), F.lit(0), F.col("n"), F.lit(False), cfg.llm_calls)
    asked = queries.join(n.filter(gate == "call").select("query_id"), "query_id", "left_semi")
    return materialize(weight(asked).select("query_id", F.col("weights").alias("_weights")))


def warm_up(cfg: SchedulingConfig, past: DataFrame, pool: DataFrame, nodes: DataFrame, edges: DataFrame, hours: float = 1.0) -> DataFrame:
    """edges after a schedule of past queries, taken as asked `hours` before now: interactions raised by what they
    took from each source, strengths made anew from all factors."""
    earlier = past.withColumn("now", F.col("now") - 3600.0 * hours)
    kept = schedule(cfg, earlier, pool, nodes, edges).filter("kept")
    used = state.interaction_counts(kept)
    bumped = edges.join(used, ["src", "dst"], "left").withColumn("interactions", F.col("interactions") + F.coalesce("n", F.lit(0))).drop("n")
    return graph.multifactor_strength(graph.edge_factors(nodes, bumped), cfg.graph.strength_weights, cfg.graph.strength_alpha)


def smoke(cfg: SchedulingConfig, queries: DataFrame, pool: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, n_candidates, n_kept, best) of a schedule of the first n queries."""
    first = materialize(queries.orderBy("query_id").limit(n))
    rows = schedule(cfg, first, pool, nodes, edges)
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("kept").alias("n_kept"), F.max("final").alias("best"))


def ablation(presets: dict[str, SchedulingConfig], queries, pool, nodes, edges) -> DataFrame:
    """The kept rows of every preset, as one frame with a column group. The tables are written once, and so are the
    candidates of presets that differ only in what comes after recall."""
    queries, pool, nodes, edges = (d if d is None else materialize(d) for d in (queries, pool, nodes, edges))
    out, shared = None, {}
    for name, cfg in presets.items():
        rows = schedule(cfg, queries, pool, nodes, edges, shared=shared).filter("kept").select(F.lit(name).alias("group"), "query_id", "memory_id", "owner_node", "final", "pick_rank")
        out = rows if out is None else out.unionByName(rows)
    return out
