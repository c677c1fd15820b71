"""Selection of scored batches: adds kept and pick_rank; every selector is a window over query_id.

Rows need final (rounded where engines are compared) and the tie-break seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine

THRESHOLD, MAX_SHARED, TOP_K = 0.6, 10, 5
TASK_MIN, VERSION_COS = 0.5, 0.9


def _batch():
    return Window.partitionBy("query_id")



def _pick(df: DataFrame, k: int, *order, only=None) -> DataFrame:
    ranked = df.withColumn("pick_rank", F.row_number().over(_batch().orderBy(*order)).cast("long"))
    return ranked.withColumn("kept", (F.col("pick_rank") <= k) & (F.lit(True) if only is None else only))


def select_threshold(df: DataFrame, threshold: float = THRESHOLD, k: int = MAX_SHARED) -> DataFrame:
    """Scores of at least threshold, and of at least the mean less half a sample deviation; k at most."""
    bar = F.greatest(F.lit(float(threshold)), F.avg("final").over(_batch()) - 0.5 * F.coalesce(F.stddev_samp("final").over(_batch()), F.lit(0.0)))
    return _pick(df.withColumn("bar", F.round(bar, 9)), k, F.desc("final"), "seq", only=F.col("final") >= F.col("bar"))


def select_topk(df: DataFrame, k: int = TOP_K) -> DataFrame:
    return _pick(df, k, F.desc("final"), "seq")


def select_recency(df: DataFrame, k: int = TOP_K) -> DataFrame:
    return _pick(df, k, F.desc("ts"), "seq")


def superseded(df: DataFrame, version_cos: float = VERSION_COS) -> DataFrame:
    """The rows for which the batch holds a newer, similar memory. Batches are cut to the candidate cap
    before, so a batch compares at most its cap squared rows."""
    old, new = df.select("query_id", "memory_id", "ts", "emb").alias("m"), df.select("query_id", F.col("ts").alias("o_ts"), F.col("emb").alias("o_emb")).alias("o")
    newer = (F.col("m.query_id") == F.col("o.query_id")) & (F.col("o_ts") > F.col("ts")) & (F.round(cosine(F.col("emb"), F.col("o_emb")), 9) >= version_cos)
    return old.join(new, newer, "left_semi").select("query_id", "memory_id")


def select_cascade(df: DataFrame, k: int = TOP_K, task_filter: bool = True, version_filter: bool = True, version_cos: float = VERSION_COS, task_min: float = TASK_MIN) -> DataFrame:
    """Top k of the rows that pass the task and version filters, filled up with rejected ones."""
    rejected = (F.col("task_score") < task_min) if task_filter else F.lit(False)
    if version_filter:
        old = superseded(df, version_cos).withColumn("_old", F.lit(True))
        df = df.join(old, ["query_id", "memory_id"], "left")
        rejected = rejected | F.coalesce("_old", F.lit(False))
    out = _pick(df.withColumn("rejected", rejected), k, F.col("rejected"), F.desc("final"), "seq")
    return out.drop("_old") if version_filter else out


def select_quota(df: DataFrame, k: int = TOP_K, quota: str = "quota", source: str = "owner_node") -> DataFrame:
    """Top k with at most quota rows of a source (0: no cap), filled up with the rest."""
    within = F.row_number().over(Window.partitionBy("query_id", source).orderBy(F.desc("final"), "seq"))
    over = (F.col(quota) > 0) & (within > F.col(quota))
    return _pick(df.withColumn("over_quota", over), k, F.col("over_quota"), F.desc("final"), "seq")


def hard_quota_filter(df: DataFrame, quota: str = "quota", source: str = "owner_node", source_rank: str = "source_rank") -> DataFrame:
    """Each source's best quota rows, in the sources' order."""
    within = F.row_number().over(Window.partitionBy("query_id", source).orderBy(F.desc("final"), "seq"))
    kept = df.withColumn("_w", within).filter(F.col("_w") <= F.col(quota))
    return kept.withColumn("pick_rank", F.row_number().over(_batch().orderBy(source_rank, "_w")).cast("long")).drop("_w")


def compression_ratio(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy("query_id").agg(n.alias("n_candidates"), F.sum(F.col("kept").cast("long")).alias("n_kept")).withColumn("compression_ratio", F.round(F.col("n_kept") / F.col("n_candidates"), 6))


def shared_pool(arrivals: DataFrame, cap: int = MAX_SHARED, pool: str = "pool", dedup: bool = True) -> DataFrame:
    """The bounded pool after all arrivals(pool, memory_id, score, seq): the cap best by score; on a tie
    with the least the earlier stays. dedup keeps each memory's best row; False allows repeats."""
    if dedup:
        own = Window.partitionBy(pool, "memory_id").orderBy(F.desc("score"), "seq")
        arrivals = arrivals.withColumn("_d", F.row_number().over(own)).filter("_d = 1").drop("_d")
    order = Window.partitionBy(pool).orderBy(F.desc("score"), "seq")
    return arrivals.withColumn("pool_rank", F.row_number().over(order).cast("long")).filter(F.col("pool_rank") <= cap)


def dispatch(pool: DataFrame, n: int = TOP_K) -> DataFrame:
    """The first n items of each shared pool."""
    return pool.filter(F.col("pool_rank") <= n)


def bookmark(pool: DataFrame, n: int = TOP_K) -> DataFrame:
    """(pool, bookmark): for each pool a struct of its size, its best score and its first n memories."""
    top = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pool_rank", "memory_id"))), lambda x: x["memory_id"]), 1, n)  # a pool is bounded
    return pool.groupBy("pool").agg(F.struct(F.count(F.lit(1)).alias("size"), F.max("score").alias("best"), top.alias("memories")).alias("bookmark"))


def table_view(df: DataFrame, order: str, n: int = 20, tie: str = "memory_id") -> DataFrame:
    """The first n rows by a column, descending, as a table shows them."""
    return df.orderBy(F.desc(order), tie).limit(n)


SELECTORS = {"full": select_threshold, "topk": select_topk, "recency": select_recency, "cascade": select_cascade, "quota": select_quota}
