"""Writers. What a source of readers.py reads, a writer here writes in the same format; Spark's commit
protocol makes each write all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Log


def write_pool(df: DataFrame, path: str) -> None:
    """The whole pool as JSON lines, once for a batch of changes (read_memories)."""
    df.write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, after: int | None = None) -> int:
    """Nodes and edges as JSON lines of a new version, and its number (graph_payload reads the last). A commit
    names both, so a reader sees both of one version. It fails with Conflict if the last version is not `after`
    any more: by default the last there is when the writing begins."""
    log = Log(nodes.sparkSession, path)
    after = log.latest() if after is None else after
    folder = log.fresh()
    nodes.write.json(f"{folder}/nodes")
    edges.write.json(f"{folder}/edges")
    return log.commit({"graph": folder}, after)


def retire_graphs(spark: SparkSession, path: str, keep: int) -> None:
    """Deletes all versions of a graph but the last `keep`."""
    Log(spark, path).retire(keep, lambda entry: [entry["graph"]])


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_monitor(df: DataFrame, path: str, most: int = 200) -> None:
    """Job records(job, params, result): params and result cut to a length, the result's own length beside."""
    short = lambda c: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(F.col(c))
    df.withColumns({"params": F.substring("params", 1, most), "result_chars": F.length("result"), "result": short("result")}).write.mode("append").json(path)


def write_shared_pool(df: DataFrame, path: str) -> None:
    """The bounded pool as one JSON object of items (read_shared_pool)."""
    df.agg(F.sort_array(F.collect_list(F.struct("score", *[c for c in df.columns if c != "score"])), asc=False).alias("items")).coalesce(1).write.mode("overwrite").json(path)


def append_manifest(df: DataFrame, path: str) -> None:
    """Rows of a manifest as CSV without headers; schema.txt, written with the first rows, names the columns
    (read_manifest)."""
    df.write.mode("append").csv(f"{path}/rows", header=False)
    df.sparkSession.createDataFrame([(df.schema.simpleString()[7:-1].replace(":", " "),)], "value string").coalesce(1).write.mode("ignore").text(f"{path}/schema.txt")


def write_summary(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_dataset(df: DataFrame, path: str) -> DataFrame:
    """Rows as JSON lines; gives (n, sha256), a digest that does not depend on the rows' order."""
    df.write.mode("overwrite").json(path)
    each = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = df.select(F.substring(each, 1, 2).alias("p"), F.conv(F.substring(each, 3, 12), 16, 10).cast("long").alias("h")).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("h"))
    return parts.agg(F.sum("n").alias("n"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "p", "n", "h")))), 256).alias("sha256"))


def append_embeddings(df: DataFrame, path: str) -> None:
    """(text, vec, placeholder): real vectors only, as JSON lines (read_embedding_cache); placeholders are never
    kept."""
    df.filter("NOT placeholder").select("text", "vec").write.mode("append").json(path)
