"""The data model's tables as views over the driver's tables.

memories: one for each embedding, with its document's text and language, its event's time and user;
queries: every memory whose id is divisible by 50; nodes: one for each label; edges: from lower to
higher labels by the similarity of their mean vectors; lexical queries: the benchmark passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_strength, infer_edge_type
from ..functions.vectors import as_double, clamp01, cosine, mean_vector

QUERY_STEP, EDGE_TOPK = 50, 4
COMMON_TASK = "en"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Unix seconds of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts) / 1e6


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d, v = (table(spark, sf_dir, t) for t in ("embeddings", "documents", "events"))
    uses = v.filter(F.col("event_type").isin("view", "click")).groupBy(F.col("user_id").alias("memory_id")).agg(F.count(F.lit(1)).alias("uses"))
    rows = e.select(F.col("vec_id").alias("memory_id"), F.col("label").cast("long").alias("owner_node"), as_double(F.col("embedding")).alias("emb"))
    rows = rows.join(v.select(F.col("event_id").alias("memory_id"), seconds(F.col("ts")).alias("ts"), "user_id"), "memory_id")
    rows = rows.join(d.select(F.col("doc_id").alias("memory_id"), "text", F.col("lang").alias("task_tag")), "memory_id", "left")
    rows = rows.join(uses, "memory_id", "left").withColumn("access_count", F.coalesce("uses", F.lit(0))).drop("uses")
    return rows.withColumn("seq", F.col("memory_id"))


def queries(mem: DataFrame) -> DataFrame:
    now = mem.agg(F.max("ts").alias("now"))
    q = mem.filter(F.col("memory_id") % QUERY_STEP == 0).select(
        F.col("memory_id").alias("query_id"), F.col("text").alias("q_text"), F.col("emb").alias("q_emb"), F.col("owner_node").alias("cur_node"), F.lit(COMMON_TASK).alias("q_task")
    )
    return q.join(F.broadcast(now))  # one row


def lexical_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q_text"))


def lexical_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"), "text", F.col("doc_id").alias("seq"))


def nodes(mem: DataFrame) -> DataFrame:
    """(node_id, emb, created_at, n_memories, root_id, version): labels that share a residue modulo 5 are versions of one root."""
    stats = mem.groupBy(F.col("owner_node").alias("node_id")).agg(F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("n_memories"))
    mean = mean_vector(mem.select(F.col("owner_node").alias("node_id"), "emb"), ["node_id"], "emb", "emb")
    return stats.join(mean, "node_id").withColumns({"root_id": F.col("node_id") % 5, "version": F.floor(F.col("node_id") / 5)})


def edges(node: DataFrame) -> DataFrame:
    """(src, dst, similarity, type, strength, interactions): for each node its most similar lower nodes."""
    a, b = (node.select(F.col("node_id").alias(n), F.col("emb").alias(f"{n}_emb")) for n in ("src", "dst"))
    pairs = a.join(F.broadcast(b), F.col("src") < F.col("dst"))  # nodes are few: one for each topic
    pairs = pairs.select("src", "dst", F.round(clamp01(0.5 + cosine(F.col("src_emb"), F.col("dst_emb"))), 9).alias("similarity"))
    best = Window.partitionBy("dst").orderBy(F.desc("similarity"), "src")
    top = pairs.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= EDGE_TOPK).drop("_r")
    kind = infer_edge_type(F.col("similarity"))
    return top.withColumns({"type": kind, "strength": base_strength(kind), "interactions": (F.col("src") + F.col("dst")) % 7})
