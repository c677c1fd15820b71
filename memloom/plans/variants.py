"""Simple schedules that differ in how sources share the K places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import stage_a

K, TOPK, LAM, TAU, MU = 10, 3, 0.7, 0.5, 0.2
VARIANTS = ("G1", "G2", "G3", "G4", "G4C", "G4S")


def chosen(name: str, sources: DataFrame, k: int = K, topk: int = TOPK) -> DataFrame:
    """The sources(query_id, node_id, strength, rel) a variant draws on, with quota and src_score.

    G1: all, k // n each. G2: the strongest alone. G3: the topk strongest, equal shares. G4, G4C: shares by
    the softmax of strength and relevance. G4S: the topk strongest, no quota; src_score to 4 places.
    """
    batch = Window.partitionBy("query_id")
    s = sources.withColumns({"source_rank": F.row_number().over(batch.orderBy(F.desc("strength"), "node_id")).cast("long"), "_n": F.count(F.lit(1)).over(batch)})
    s = s.withColumn("src_score", LAM * F.col("strength") + (1 - LAM) * F.col("rel"))
    if name == "G1":
        s = s.withColumn("quota", F.greatest(F.floor(F.lit(k) / F.col("_n")), F.lit(1)))
    elif name == "G2":
        s = s.filter("source_rank = 1").withColumn("quota", F.lit(k).cast("long"))
    else:
        s = s.filter(F.col("source_rank") <= topk)
        if name == "G4S":
            s = s.withColumns({"src_score": F.bround("src_score", 4), "quota": F.lit(k).cast("long")})
        else:
            s = stage_a.level_quota(s.withColumn("weight", F.lit(1.0)) if name == "G3" else stage_a.softmax_weights(s, TAU), k)
    return s.select("query_id", "node_id", "source_rank", "quota", "src_score")


def variant(name: str, scored: DataFrame, sources: DataFrame, k: int = K, topk: int = TOPK) -> DataFrame:
    """The picked rows of scored(query_id, memory_id, owner_node, seq, final), which holds all memories of each
    query's sources, with source_rank.

    G1 takes each source's first memories in writing order, G4S the best of all with the source's score as
    a bonus, the others each source's best; G4C ranks all together and caps each source, k in all.
    """
    s = chosen(name, sources, k, topk).withColumnRenamed("node_id", "owner_node")
    rows = scored.join(s, ["query_id", "owner_node"])
    if name == "G4S":
        rows = rows.withColumn("final", F.round(F.col("final") + MU * F.col("src_score"), 9))
    best = (F.col("seq"),) if name == "G1" else (F.desc("final"), F.col("seq"))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
    if name != "G4S":
        rows = rows.withColumn("_w", place("query_id", "owner_node")).filter(F.col("_w") <= F.col("quota"))
    if name in ("G4C", "G4S"):
        rows = rows.withColumn("_r", place("query_id")).filter(F.col("_r") <= k).drop("_r")
    return rows.drop("_w", "quota", "src_score")
