"""Stage A: the upstream sources of each query's current node.

queries: query_id, cur_node, q_emb; nodes: node_id, emb, root_id, version, created_at; edges: src, dst,
type, strength, status (optional: all active). Nodes and edges are one row for each topic or link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..tables import checked_broadcast
from . import graph

TOPK, TAU, LAMBDA, MIN_QUOTA, VARIANCE_FLOOR = 3, 0.5, 0.7, 1, 0.02


def _batch():
    return Window.partitionBy("query_id")


def folded(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """queries with cur_node replaced by the primary version of its root."""
    fold = graph.version_fold(nodes).select(F.col("node_id").alias("cur_node"), "primary_id")
    return queries.join(fold, "cur_node", "left").withColumn("cur_node", F.coalesce("primary_id", "cur_node")).drop("primary_id")


def neighbourhood(queries: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 1, strength_min: float = 0.0, types=None) -> DataFrame:
    """(query_id, node_id, strength) of the sources upstream of each query's node, itself excluded."""
    up = graph.neighbours(edges, depth, strength_min, types, direction="in").select(F.col("node_id").alias("cur_node"), F.col("other_id").alias("node_id"), "strength")
    return queries.select("query_id", "cur_node").join(up, "cur_node").filter("cur_node != node_id").select("query_id", "node_id", "strength")


def manual_sources(wanted: DataFrame, near: DataFrame, nodes: DataFrame) -> DataFrame:
    """wanted(query_id, node_id, position) where the node exists, with the neighbourhood's strength or 0;
    repeats keep their first position."""
    first = wanted.groupBy("query_id", "node_id").agg(F.min("position").alias("position"))
    known = first.join(nodes.select("node_id"), "node_id", "left_semi")
    return known.join(near, ["query_id", "node_id"], "left").withColumn("strength", F.coalesce("strength", F.lit(0.0)))


def semantic_expansion(queries: DataFrame, nodes: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id, strength 0): the k nodes most similar to the query that are neither its own nor near."""
    every = queries.select("query_id", "cur_node", "q_emb").join(checked_broadcast(nodes.select("node_id", "emb"))).filter("node_id != cur_node")
    rest = every.join(near, ["query_id", "node_id"], "left_anti").withColumn("rel", F.round(cosine(F.col("q_emb"), F.col("emb")), 9))
    ranked = rest.withColumn("_r", F.row_number().over(_batch().orderBy(F.desc("rel"), "node_id")))
    return ranked.filter(F.col("_r") <= k).select("query_id", "node_id", F.lit(0.0).alias("strength"), "rel")


def relevance(queries: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """sources plus rel, the cosine of query and node (0 if either vector is missing)."""
    s = sources.join(nodes.select("node_id", "emb"), "node_id", "left").join(queries.select("query_id", "q_emb"), "query_id")
    return s.withColumn("rel", F.round(cosine(F.col("q_emb"), F.col("emb")), 9)).drop("emb", "q_emb")


def source_scores(sources: DataFrame, lam: float = LAMBDA, variance_floor: float = VARIANCE_FLOOR) -> DataFrame:
    """sources(query_id, node_id, strength, rel) plus lambda_eff and src_score; relevances that hardly vary
    within a query (a single one never does) leave the strength alone."""
    var = F.coalesce(F.var_samp("rel").over(_batch()), F.lit(0.0))
    lam_eff = F.when(var < variance_floor, F.lit(1.0)).otherwise(F.lit(float(lam)))
    return sources.withColumn("lambda_eff", lam_eff).withColumn("src_score", F.round(F.col("lambda_eff") * F.col("strength") + (1 - F.col("lambda_eff")) * F.col("rel"), 9))


def source_topk(scored: DataFrame, k: int = TOPK, full_cover: int = 0) -> DataFrame:
    """The k best sources of each query, with source_rank; 0 keeps all, full_cover raises the cap."""
    ranked = scored.withColumn("source_rank", F.row_number().over(_batch().orderBy(F.desc("src_score"), "node_id")).cast("long"))
    return ranked.filter(F.col("source_rank") <= max(k, full_cover)) if k > 0 else ranked


def softmax_weights(kept: DataFrame, tau: float = TAU) -> DataFrame:
    x = F.col("src_score") / tau
    e = F.exp(x - F.max(x).over(_batch()))
    return kept.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(_batch())).drop("_e")


def deal(rows: DataFrame, gap, down, up, position: str = "source_rank", key: str = "query_id") -> DataFrame:
    """rows with quota changed so that each key's quotas move by gap (a column, the same for a key's rows).

    Every quota offers numbered units: down(quota) and up(quota) are arrays of structs that say when a
    unit is taken off or put on. The first |gap| units of a key, by that struct and then by position, are
    dealt. A key's sources are few, and so are its units.
    """
    rows = rows.withColumn("_gap", gap)
    units = F.when(F.col("_gap") < 0, down).otherwise(up)
    offered = rows.filter("_gap != 0").select(key, position, "_gap", F.explode(units).alias("_u"))
    dealt = offered.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_u", position))).filter(F.col("_n") <= F.abs("_gap"))
    moved = dealt.groupBy(key, position).agg(F.sum(F.signum("_gap")).cast("long").alias("_moved"))
    out = rows.join(moved, [key, position], "left")
    return out.withColumn("quota", F.col("quota") + F.coalesce("_moved", F.lit(0))).drop("_gap", "_moved")


def _units(n, first, second):
    """Structs (first(t), second) for t = 0 .. n - 1."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), lambda t: F.struct(first(t).cast("double").alias("when"), second.cast("double").alias("tie")))).otherwise(
        F.array().cast("array<struct<when:double,tie:double>>"))


def hard_quota(kept: DataFrame, k: int, least: int = MIN_QUOTA, uniform: bool = False) -> DataFrame:
    """kept(query_id, node_id, source_rank, weight) plus quota: whole numbers of at least `least` that add up
    to max(k, n * least).

    Shares are rounded half to even; what is over or short is dealt in rounds of one each, the largest
    quota first, ties by rank, and never below least.
    """
    w = F.lit(1.0) / F.count(F.lit(1)).over(_batch()) if uniform else F.col("weight")
    goal = F.greatest(F.lit(k), F.count(F.lit(1)).over(_batch()) * least)
    rows = kept.withColumn("quota", F.greatest(F.lit(least), F.bround(goal * w, 0)).cast("long"))
    short = (goal - F.sum("quota").over(_batch())).cast("long")
    largest = -F.col("quota")
    return deal(rows, short, _units(F.col("quota") - least, lambda t: t, largest), _units(F.col("_gap"), lambda t: t, largest))


def level_quota(kept: DataFrame, k: int) -> DataFrame:
    """kept(query_id, node_id, source_rank, weight) plus quota: shares of k of at least 1, scaled back to k and
    rounded; then the largest gives, or the smallest takes, one at a time, ties by rank."""
    rows = kept.withColumn("_raw", F.greatest(F.lit(1), F.bround(k * F.col("weight"), 0)))
    rows = rows.withColumn("quota", F.greatest(F.lit(1), F.bround(k * F.col("_raw") / F.sum("_raw").over(_batch()), 0)).cast("long")).drop("_raw")
    short = (F.lit(k) - F.sum("quota").over(_batch())).cast("long")
    q, zero = F.col("quota"), F.lit(0)
    # the unit at height h goes when h is the greatest left, and comes when h is the least
    return deal(rows, short, _units(q, lambda t: t - q, zero), _units(F.col("_gap"), lambda t: q + t, zero))


def select_sources(queries, nodes, edges, mode: str = "soft_bias", k: int = 10, topk: int = TOPK, lam: float = LAMBDA, tau: float = TAU, depth: int = 1, semantic_k: int = 0, full_cover: int = 0, variance_floor: float = VARIANCE_FLOOR, min_quota: int = MIN_QUOTA) -> DataFrame:
    """(query_id, node_id, strength, rel, lambda_eff, src_score, source_rank, weight, quota): Stage A as a whole."""
    q = folded(queries, nodes)
    near = neighbourhood(q, nodes, edges, depth)
    sources = near
    if semantic_k:
        sources = near.unionByName(semantic_expansion(q, nodes, near, semantic_k).drop("rel"))
    scored = source_scores(relevance(q, nodes, sources), lam, variance_floor)
    kept = softmax_weights(source_topk(scored, topk, full_cover), tau)
    if mode in ("strength", "uniform"):
        return hard_quota(kept, k, min_quota, mode == "uniform").withColumn("quota", F.greatest(F.col("quota"), F.lit(1).cast("long")))
    return kept.withColumn("quota", F.lit(0).cast("long"))
