"""Readers: files to the data model's tables. Rows that cannot be read are dropped, not what follows them."""

from __future__ import annotations

import glob
import os
from dataclasses import fields

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from .files import array_elements
from .versions import Log


def _json(spark: SparkSession, path, schema: str) -> DataFrame:
    bad = "_corrupt_record"
    rows = spark.read.schema(f"{schema}, {bad} string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=bad)
    return rows.filter(F.col(bad).isNull()).drop(bad)


def _defaults(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in values.items()})


def read_memories(spark: SparkSession, path) -> DataFrame:
    """A pool of memories from JSON lines; missing fields take their defaults."""
    empty = {"text": "", "path": "", "start_line": 0, "end_line": 0, "timestamp": 0.0, "access_count": 0, "user_id": "", "session_id": "", "bm25_score": 0.0, "vector_score": 0.0, "owner_node": S.MAIN_NODE, "producer_run": ""}
    return _defaults(_json(spark, path, S.MEMORY), empty)


def graph_payload(spark: SparkSession, folder: str, fallback, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph that write_graph wrote, by default its last version, else those of the first
    episode of fallback (a file of graph episodes, or None), else empty ones."""
    jvm = spark.sparkContext._jvm
    there = lambda p: (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(h)
    log = Log(spark, folder)
    if version or log.latest():
        at = log.read(version or log.latest())["graph"]
        return read_graph(spark, f"{at}/nodes", f"{at}/edges")
    nodes, edges = spark.createDataFrame([], S.NODE), spark.createDataFrame([], S.EDGE)
    if fallback is not None and there(fallback):
        t = explode_episodes(read_episodes(spark, fallback, 1))
        from ..functions.text import base_strength

        nodes = nodes.unionByName(t["nodes"].drop("episode_id", "seq"), allowMissingColumns=True)
        edges = edges.unionByName(t["edges"].drop("episode_id", "seq").withColumn("strength", base_strength(F.col("type"))), allowMissingColumns=True)
    return nodes, edges


def read_graph(spark: SparkSession, nodes_path, edges_path) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from JSON lines; a main node is added where there is none."""
    n = _defaults(_json(spark, nodes_path, S.NODE), {"topic": "", "summary": "", "version": 1, "status": "active", "n_memories": 0})
    main = spark.createDataFrame([(S.MAIN_NODE, S.MAIN_NODE, "", 1, "active", 0)], "node_id string, topic string, summary string, version int, status string, n_memories int")
    n = n.unionByName(main.join(n.select("node_id"), "node_id", "left_anti"), allowMissingColumns=True)
    e = _defaults(_json(spark, edges_path, S.EDGE), {"evidence": "", "stage": "coarse", "status": "active", "similarity": 0.0, "interactions": 0})
    from ..functions.text import base_strength
    from ..functions.vectors import clamp01

    return n, e.withColumn("strength", clamp01(F.coalesce("strength", base_strength(F.col("type")))))


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _ordered(df: DataFrame) -> DataFrame:
    """df plus _order: the file's name, then the row's place in it."""
    return df.withColumn("_order", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))


def read_embedding_cache(spark: SparkSession, path, dim: int) -> DataFrame:
    """(text, vec): vectors of the right length, the last for each text."""
    rows = _ordered(_json(spark, path, S.EMBEDDING_CACHE)).filter(F.size("vec") == dim)
    return last_by(rows, ["text"], "_order").drop("_order")


def read_shared_pool(spark: SparkSession, path: str) -> DataFrame:
    """Items of a shared pool's JSON file; an absent or broken file is empty."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], S.SHARED_ITEM)
    rows = spark.read.schema(S.SHARED_POOL).json(path, multiLine=True, mode="PERMISSIVE")
    return rows.select(F.explode("items").alias("i")).select("i.*")


def read_episodes(spark: SparkSession, path, n: int | None = None, graph: bool = True) -> DataFrame:
    rows = _json(spark, path, S.GRAPH_EPISODE if graph else S.FLAT_EPISODE)
    return rows.limit(n) if n else rows


def explode_episodes(episodes: DataFrame) -> dict[str, DataFrame]:
    """Nested episodes as flat tables: queries, memories, nodes, edges and relevant."""
    each = lambda c: episodes.select("episode_id", F.posexplode(c).alias("seq", "x")).select("episode_id", "seq", "x.*")
    out = {"queries": episodes.drop("corpus", "nodes", "edges", "relevant", "relevant_sources"), "memories": each("corpus"), "relevant": episodes.select("episode_id", F.explode("relevant").alias("memory_id"))}
    if "nodes" in episodes.columns:
        out |= {"nodes": each("nodes"), "edges": each("edges"), "relevant_sources": episodes.select("episode_id", F.explode("relevant_sources").alias("owner_node"))}
    return out


def read_metrics(spark: SparkSession, pattern, group: str | None = None, scene: str | None = None) -> DataFrame:
    """Metric rows of all files, the last of each group's episode."""
    rows = _ordered(_json(spark, pattern, S.METRIC_ROW))
    if group:
        rows = rows.filter(F.col("group") == group)
    if scene:
        rows = rows.filter(F.col("scene") == scene)
    return last_by(rows, ["group", "episode_id"], "_order").drop("_order")


def read_conversations(spark: SparkSession, path) -> DataFrame:
    """(sample, item, session, turn, speaker, dia_id, text) of long conversations whose sessions are dynamic keys;
    sample is the file, item where its object begins. Files of any size are read in ranges."""
    raw = array_elements(spark, str(path)).select(F.col("file").alias("sample"), F.col("at").alias("item"), F.from_json("value", "struct<conversation:map<string,string>>").alias("c"))
    sessions = raw.select("sample", "item", F.explode("c.conversation").alias("k", "v")).filter(F.col("k").rlike("^session_\\d+$"))
    turns = sessions.select("sample", "item", F.split("k", "_")[1].cast("int").alias("session"), F.posexplode(F.from_json("v", "array<struct<speaker:string,dia_id:string,text:string>>")).alias("turn", "t"))
    return turns.select("sample", "item", "session", "turn", "t.*")


def parse_time(text: Column, index: Column) -> Column:
    """Unix seconds of a session's time in any known form; index days where none fits."""
    forms = ("h:mm a 'on' d MMMM, yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    got = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])
    return F.coalesce(F.unix_timestamp(got).cast("double"), index * 86400.0)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """What append_manifest wrote."""
    return spark.read.schema(spark.read.text(f"{path}/schema.txt").first()[0]).csv(f"{path}/rows")


def read_training(spark: SparkSession, path) -> DataFrame:
    return _json(spark, path, S.TRAINING)


def read_poc(spark: SparkSession, path) -> dict[str, DataFrame]:
    """The tables of a one-file data set: nodes, edges, memories and queries."""
    raw = spark.read.json(path, multiLine=True)
    return {t: raw.select(F.posexplode(t).alias("seq", "x")).select("seq", "x.*") for t in ("nodes", "edges", "memories", "queries")}


# Names of a preset file and what they set. A name with a dot lies in a section of the file.
CONFIG_NAMES = {
    "retriever_impl": "retriever", "attention_impl": "attention", "weight_impl": "weight", "selector_impl": "selector", "reward_impl": "reward",
    "candidate_override": "candidates", "cascade_task_filter": "task_filter", "cascade_version_filter": "version_filter", "cascade_version_cos": "version_cos",
    "attention_semantic_floor": "semantic_floor", "budget.default_tier": "tier", "budget.llm_calls_per_schedule": "llm_calls", "budget.force_candidate": "candidates", "budget.force_lambda": "graph.lam",
    "graph.source_topk_full_cover": "graph.full_cover", "graph.quota_tau": "graph.tau", "graph.quota_lambda": "graph.lam", "graph.quota_mu": "graph.mu",
    "graph.edge_strength_weights": "graph.strength_weights", "graph.edge_strength_alpha": "graph.strength_alpha",
}


def read_config(path: str, kind):
    """A preset of dataclass `kind` from YAML; a missing file raises. `fixed:` gives values the top level does
    not; sections and implementation names are mapped by CONFIG_NAMES, 'selector.topk' names topk; disabled
    dimensions leave the others enabled; names the engine has no use for are ignored."""
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    flat: dict = {}
    for section in (raw.get("fixed") or {}, {k: v for k, v in raw.items() if k != "fixed"}):
        for k, v in section.items():
            flat |= {f"{k}.{n}": x for n, x in v.items()} if k in ("graph", "budget") and isinstance(v, dict) else {k: v}
    # a forced value comes after the plain one it overrides
    values = {CONFIG_NAMES.get(k, k): v for k, v in sorted(flat.items(), key=lambda x: x[0].startswith("budget.force")) if v is not None}
    values = {k: v.split(".", 1)[1] if isinstance(v, str) and k in ("retriever", "attention", "weight", "selector", "reward") and "." in v else v for k, v in values.items()}
    if off := values.pop("attention_disabled_dims", None):
        values["enabled_dims"] = tuple(d for d in S.DIMS if d not in off)
    known = {f.name: f for f in fields(kind)}
    top = {k: v for k, v in values.items() if k in known and k != "graph"}
    if "graph" in known:
        inner = known["graph"].default_factory
        names = {f.name for f in fields(inner)}
        top["graph"] = inner(**{k.removeprefix("graph."): v for k, v in values.items() if k.startswith("graph.") and k.removeprefix("graph.") in names})
    return kind(**top)


def read_config_dir(spark: SparkSession, folder: str) -> DataFrame:
    """(group, retriever, attention, weight, selector, condition) of a folder of YAML files, in the order of names:
    what each names, null where it names nothing; condition is the list of dimensions that the condition sways."""
    rows = []
    for path in sorted(glob.glob(os.path.join(folder, "*.yaml"))):
        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
        rows.append((os.path.splitext(os.path.basename(path))[0], *[raw.get(f"{k}_impl") for k in ("retriever", "attention", "weight", "selector")], raw.get("conditioning_dims") or None))
    return spark.createDataFrame(rows, "group string, retriever string, attention string, weight string, selector string, condition array<string>")
