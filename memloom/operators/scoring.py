"""Scoring of candidate batches: rows of (query_id, memory_id) with the inputs of the four dimensions.

Inputs: q_emb and emb, or cos; vector_score, bm25_score; ts, now; access_count; q_task, task_tag.
Batch statistics are windows over query_id, so all of a batch's work shares one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..schema import DEFAULT_WEIGHTS, DIMS

STD_EPS, SEMANTIC_FLOOR, ADAPTIVE_K = 1e-9, 0.5, 2.0


def _batch():
    return Window.partitionBy("query_id")

RAW = [f"{d}_score" for d in DIMS]


def raw_scores(df: DataFrame, decay: Column | float = S.TIME_DECAY) -> DataFrame:
    """df plus time_score, semantic_score, frequency_score and task_score."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(0.0)
    sem = S.semantic_from_cosine(F.col("cos"), has("vector_score"), has("bm25_score")) if "cos" in df.columns else S.semantic_score(F.col("q_emb"), F.col("emb"), has("vector_score"), has("bm25_score"))
    return df.withColumns({
        "time_score": S.time_score(F.col("now"), F.col("ts"), decay), "semantic_score": sem,
        "frequency_score": S.frequency_score(F.col("access_count")), "task_score": S.task_score(F.col("q_task"), F.col("task_tag")),
    })


def _final(df: DataFrame, weights: dict, scores: dict[str, Column] | None = None) -> DataFrame:
    scores = scores or {d: F.col(f"{d}_score") for d in DIMS}
    return df.withColumn("final", S.final_score(scores, weights))


def score_full(df: DataFrame, weights=None, enabled: tuple[str, ...] = (), parity: bool = False) -> DataFrame:
    """Each row by itself. parity=True ignores the mask in final, as the original's coordinator does."""
    w = dict(weights or DEFAULT_WEIGHTS)
    return _final(raw_scores(df), w if parity else S.masked(w, enabled))


def score_noop(df: DataFrame, **_) -> DataFrame:
    """Every score a quarter."""
    return df.withColumns({c: F.lit(0.25) for c in RAW} | {"final": F.lit(0.25)})


def gate(df: DataFrame, weights=None, enabled: tuple[str, ...] = (), floor: float = SEMANTIC_FLOOR) -> DataFrame:
    """df plus eff_<dim>: the weights of dimensions that vary within the batch, renormalised, with the
    semantic one raised to floor at the others' cost. If no weight is left, the varying dimensions share
    equally, or all four if none varies; a semantic dimension that does not vary is not revived."""
    w = S.masked(dict(weights or DEFAULT_WEIGHTS), enabled)
    on = enabled or DIMS
    df = df.withColumns({f"_alive_{d}": (F.coalesce(F.stddev_samp(f"{d}_score").over(_batch()), F.lit(0.0)) > STD_EPS) & F.lit(d in on) for d in DIMS})
    alive = {d: F.col(f"_alive_{d}").cast("double") for d in DIMS}
    total = sum((alive[d] * w[d] for d in DIMS[1:]), alive[DIMS[0]] * w[DIMS[0]])
    count = sum((alive[d] for d in DIMS[1:]), alive[DIMS[0]])
    df = df.withColumns({"_total": total, "_count": count})
    eff = {d: F.when(F.col("_total") > 0, alive[d] * w[d] / F.col("_total")).when(F.col("_count") > 0, alive[d] / F.col("_count")).otherwise(F.lit(0.25)) for d in DIMS}
    df = df.withColumns({f"_e_{d}": eff[d] for d in DIMS})
    sem, others = F.col("_e_semantic"), F.col("_e_time") + F.col("_e_frequency") + F.col("_e_task")
    lift = (sem > 0) & (sem < floor) & (others > 0)
    out = {f"eff_{d}": F.when(lift, F.col(f"_e_{d}") * (1 - (floor - sem) / others)).otherwise(F.col(f"_e_{d}")) for d in DIMS if d != "semantic"}
    out["eff_semantic"] = F.when(lift, F.lit(floor)).otherwise(sem)
    return df.withColumns(out).drop("_total", "_count", *[f"_e_{d}" for d in DIMS])


def _drop_marks(df: DataFrame) -> DataFrame:
    return df.drop(*[f"_alive_{d}" for d in DIMS])


def score_normalized(df: DataFrame, weights=None, enabled: tuple[str, ...] = (), floor: float = SEMANTIC_FLOOR) -> DataFrame:
    """Gated weights over scores scaled to the batch's range; dimensions that do not vary stay raw."""
    df = gate(raw_scores(df), weights, enabled, floor)
    scaled = {}
    for d in DIMS:
        x, lo, hi = F.col(f"{d}_score"), F.min(f"{d}_score").over(_batch()), F.max(f"{d}_score").over(_batch())
        scaled[f"{d}_norm"] = F.when(F.col(f"_alive_{d}"), F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(F.lit(0.0))).otherwise(x)
    df = df.withColumns(scaled)
    return _drop_marks(_final(df, {d: F.col(f"eff_{d}") for d in DIMS}, {d: F.col(f"{d}_norm") for d in DIMS}))


def adaptive_decay(df: DataFrame, k: float = ADAPTIVE_K) -> DataFrame:
    """df plus lambda_eff: k over the batch's span in hours (1 at least); the default below two known times."""
    known = F.when(F.col("ts") > 0, F.col("ts"))
    span = (F.max(known).over(_batch()) - F.min(known).over(_batch())) / 3600.0
    return df.withColumn("lambda_eff", F.when(F.count(known).over(_batch()) < 2, F.lit(S.TIME_DECAY)).otherwise(k / F.greatest(span, F.lit(1.0))))


def score_adaptive_time(df: DataFrame, weights=None, enabled: tuple[str, ...] = ()) -> DataFrame:
    return _final(raw_scores(adaptive_decay(df), F.col("lambda_eff")), S.masked(dict(weights or DEFAULT_WEIGHTS), enabled))


def score_adaptive_gated(df: DataFrame, weights=None, enabled: tuple[str, ...] = (), floor: float = SEMANTIC_FLOOR) -> DataFrame:
    df = gate(raw_scores(adaptive_decay(df), F.col("lambda_eff")), weights, enabled, floor)
    return _drop_marks(_final(df, {d: F.col(f"eff_{d}") for d in DIMS}))


def add_source_bonus(df: DataFrame, sources: DataFrame, mu: float = 0.2) -> DataFrame:
    """final plus mu times the source score of the memory's owner (0 without one); mu <= 0 adds nothing."""
    if mu <= 0:
        return df.withColumn("source_bonus", F.lit(0.0))
    s = sources.select("query_id", F.col("node_id").alias("owner_node"), F.col("src_score").alias("_s"))
    out = df.join(s, ["query_id", "owner_node"], "left").withColumn("source_bonus", mu * F.coalesce("_s", F.lit(0.0)))
    return out.withColumn("final", F.col("final") + F.col("source_bonus")).drop("_s")


SCORERS = {"full": score_full, "noop": score_noop, "normalized": score_normalized, "adaptive_time": score_adaptive_time, "adaptive_gated": score_adaptive_gated}
