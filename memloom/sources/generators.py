"""Data sets by rule: every row follows from its number and a seed, so any part can be made anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import checked_broadcast

DOMAINS, TOPICS = 6, 6
DISTRACTORS = 8
# The graph set's size, its special memories by kind and its episodes by scene.
N_NODES, N_EDGES, CORE_PER_NODE = 22, 46, 20
KINDS = {"stale": 12, "cross_task": 6, "version": 18, "param": 12, "distractor": 2}
SCENES = {"fact": 35, "SA": 6, "SB": 4, "SC": 3, "SF": 2}
NOW = 1_760_000_000.0


def pick(seed: int, n: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n))


def flat_episodes(spark: SparkSession, n: int = 200, seed: int = 20260825) -> DataFrame:
    """Flat episodes: one relevant memory of the query's domain and topic, and distractors of other topics."""
    e = spark.range(n).withColumns({"d": pick(seed, DOMAINS, F.col("id")), "t": pick(seed + 1, TOPICS, F.col("id"))})
    memory = lambda i, d, t, tag: F.struct(F.concat(F.lit("e"), F.col("id"), F.lit("m"), i).alias("memory_id"), F.concat(F.lit("domain "), d, F.lit(" topic "), t, F.lit(" note "), i).alias("text"), tag.alias("task_tag"))
    tag = F.concat(F.lit("task"), F.col("d"))
    first = memory(F.lit(0), F.col("d"), F.col("t"), tag)
    other = F.transform(F.sequence(F.lit(1), F.lit(DISTRACTORS)), lambda i: memory(i, (F.col("d") + i) % DOMAINS, (F.col("t") + 1 + i % (TOPICS - 1)) % TOPICS, F.concat(F.lit("task"), (F.col("d") + i) % DOMAINS)))
    return e.select(
        F.concat(F.lit("ep"), "id").alias("episode_id"), tag.alias("task_tag"), F.concat(F.lit("user"), F.col("id") % 5).alias("user_id"), F.lit("scenario").alias("scenario"), F.lit("business").alias("business"),
        F.concat(F.lit("domain "), "d", F.lit(" topic "), "t").alias("query"), F.concat(F.array(first), other).alias("corpus"), F.array(F.concat(F.lit("e"), "id", F.lit("m0"))).alias("relevant"),
    )


def graph_nodes(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(N_NODES).select(F.concat(F.lit("n"), i).alias("node_id"), F.concat(F.lit("topic "), i).alias("topic"), F.concat(F.lit("summary of topic "), i).alias("summary"))


def graph_edges(spark: SparkSession) -> DataFrame:
    """Links from each node to the next three, as many as the set has; lower to higher, so acyclic."""
    pairs = spark.range(N_NODES).select(F.col("id").alias("s"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("g")).withColumn("d", F.col("s") + F.col("g")).filter(F.col("d") < N_NODES)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("derives_from", "depends_on", "references")]), F.col("g"))
    best = pairs.orderBy("g", "s").limit(N_EDGES)
    return best.select(F.concat(F.lit("n"), "s").alias("src"), F.concat(F.lit("n"), "d").alias("dst"), kind.alias("type"))


def graph_memories(spark: SparkSession) -> DataFrame:
    """Core memories of every node, then stale, cross-task, versioned, parameter and distractor ones."""
    total = N_NODES * CORE_PER_NODE + sum(KINDS.values())
    i, kind, low = F.col("id"), F.lit("core"), N_NODES * CORE_PER_NODE
    for name, n in KINDS.items():
        kind = F.when((i >= low) & (i < low + n), F.lit(name)).otherwise(kind)
        low += n
    rows = spark.range(total).withColumns({"node": i % N_NODES, "kind": kind})
    hours = F.when(F.col("kind") == "stale", -2.0).when(F.col("kind") == "cross_task", 1.5).when(F.col("kind") == "version", -96.0 + (i % 3) * 32.0).otherwise(-1.0 * (i % 24))
    return rows.select(
        F.concat(F.lit("m"), i).alias("memory_id"), F.concat(F.lit("topic "), "node", F.lit(" fact "), i).alias("text"), F.concat(F.lit("task"), F.when(F.col("kind") == "cross_task", F.col("node") + 1).otherwise(F.col("node")) % 4).alias("task_tag"),
        F.concat(F.lit("n"), "node").alias("owner_node"), (F.lit(NOW) + hours * 3600.0).alias("timestamp"), "kind", F.when(F.col("kind") == "version", F.concat(F.lit("c"), F.floor(i / 3))).alias("chain"), F.when(F.col("kind") == "version", i % 3 + 1).cast("int").alias("version"),
    )


def graph_queries(spark: SparkSession) -> DataFrame:
    """Episodes by scene, each at a node with upstream links, with the memories of that node's sources as relevant."""
    scene, low = F.lit("fact"), 0
    for name, n in SCENES.items():
        scene = F.when((F.col("id") >= low) & (F.col("id") < low + n), F.lit(name)).otherwise(scene)
        low += n
    rows = spark.range(sum(SCENES.values())).withColumns({"scene": scene, "node": F.col("id") % (N_NODES - 1) + 1})
    return rows.select(F.concat(F.lit("g"), "id").alias("episode_id"), "scene", F.concat(F.lit("n"), "node").alias("cur_node"), F.concat(F.lit("what does topic "), F.col("node") - 1, F.lit(" say")).alias("query"), F.lit(NOW).alias("now"), F.array(F.concat(F.lit("n"), F.col("node") - 1)).alias("relevant_sources"))


def distil_samples(spark: SparkSession, n: int, dim: int = 16, seed: int = 0) -> DataFrame:
    """Seeded normal queries whose target weights follow from their first four entries."""
    q = F.array(*[F.randn(seed + k) for k in range(dim)])
    rows = spark.range(n).select("id", q.alias("q_emb"))
    e = [F.exp(F.get("q_emb", F.lit(k))) for k in range(4)]
    total = e[0] + e[1] + e[2] + e[3]
    return rows.withColumn("target_weights", F.struct(*[(x / total).alias(d) for x, d in zip(e, ("time", "semantic", "frequency", "task"), strict=True)]))


def shared_words(messages: DataFrame) -> DataFrame:
    """(conv_id, src, dst, similarity): the Jaccard similarity of the word sets of each earlier and later turn of a
    conversation that have a word in common. Turns meet on their words, so a pair costs what it shares."""
    from ..functions.text import tokens

    sets = messages.select("conv_id", "turn", F.array_distinct(tokens(F.col("text"))).alias("w")).select("conv_id", "turn", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = (sets.select("conv_id", "word", F.col("turn").alias(t), F.col("n").alias(f"n_{t}")) for t in ("src", "dst"))
    both = a.join(b, ["conv_id", "word"]).filter("src < dst").groupBy("conv_id", "src", "dst").agg(F.count(F.lit(1)).alias("c"), F.first("n_src").alias("p"), F.first("n_dst").alias("q"))
    return both.select("conv_id", "src", "dst", (F.col("c") / (F.col("p") + F.col("q") - F.col("c"))).alias("similarity"))


def conversation_world(messages: DataFrame) -> dict[str, DataFrame]:
    """A topic graph from messages(conv_id, turn, role, text): conversations are users' scopes, turns are topics,
    later turns depend on earlier ones that share words, and every turn is a memory."""
    from ..functions.text import base_strength, infer_edge_type, tokens

    nodes = messages.select("conv_id", F.col("turn").alias("node_id"), F.array_distinct(tokens(F.col("text"))).alias("words"))
    kind = infer_edge_type(F.col("similarity"))
    edges = shared_words(messages).withColumns({"type": kind, "strength": base_strength(kind)})
    memories = messages.select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("memory_id"), F.col("turn").alias("owner_node"), "text", F.col("turn").alias("seq"))
    return {"nodes": nodes, "edges": edges, "memories": memories}


def conversation_episodes(qa: DataFrame, evidence_map: DataFrame) -> DataFrame:
    """Episodes from qa(conv_id, qa_id, question, evidence array) and evidence_map(conv_id, evidence, memory_id,
    owner_node, seq): relevant memories and sources in order, of several entries for an evidence the first by
    seq. A question without mapped evidence makes no episode."""
    first = evidence_map.groupBy("conv_id", "evidence").agg(F.min(F.struct("seq", "memory_id", "owner_node")).alias("m"))
    asked = qa.select("conv_id", "qa_id", "question", F.posexplode("evidence").alias("at", "evidence"))
    found = asked.join(first, ["conv_id", "evidence"])
    per = found.groupBy("conv_id", "qa_id", "question").agg(F.array_sort(F.collect_list(F.struct("at", "m.memory_id", "m.owner_node"))).alias("e"))  # a question's evidence
    pick = lambda c: F.array_distinct(F.transform("e", lambda x: x[c]))
    return per.select("conv_id", "qa_id", "question", pick("memory_id").alias("relevant"), pick("owner_node").alias("relevant_sources"))


def without_private(df: DataFrame, prefix: str = "_") -> DataFrame:
    """df without the columns whose names begin with prefix."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith(prefix)])


def anchored(memories: DataFrame, queries: DataFrame, least: int = 1) -> DataFrame:
    """(query_id, memory_id): memories of a query's relevant_nodes whose text contains at least `least` of its
    anchors."""
    # a want is a node with anchors; a memory and a query meet at the first want that both have, so no pairs are compared
    asked = queries.select("query_id", F.explode("relevant_nodes").alias("owner_node"), "anchors").distinct()
    wants = asked.select("owner_node", "anchors").distinct()
    rows = memories.select("memory_id", "owner_node", "text").join(checked_broadcast(wants), "owner_node")
    hits = F.size(F.filter("anchors", lambda a: F.contains(F.col("text"), a)))
    want = F.struct("owner_node", "anchors").alias("want")
    mine = rows.filter(hits >= least).select("memory_id", want).groupBy("memory_id").agg(F.collect_set("want").alias("m"))
    theirs = asked.select("query_id", want).groupBy("query_id").agg(F.collect_set("want").alias("q"))
    mine, theirs = (d.withColumn("want", F.explode(c)) for d, c in ((mine, "m"), (theirs, "q")))
    both = mine.join(checked_broadcast(theirs), "want")
    return both.filter(F.col("want") == F.array_min(F.array_intersect("m", "q"))).select("query_id", "memory_id")


def embedded(texts: DataFrame, cache: DataFrame, embed) -> tuple[DataFrame, DataFrame]:
    """(known, missing) of texts(text): vectors from a cache(text, vec), and those embed(column) makes for the
    distinct texts the cache does not hold; append_embeddings(missing) warms the cache up."""
    distinct = texts.select("text").distinct()
    known = distinct.join(cache.select("text", "vec"), "text").withColumn("placeholder", F.lit(False))
    missing = distinct.join(cache.select("text"), "text", "left_anti").withColumn("vec", embed(F.col("text"))).withColumn("placeholder", F.lit(False))
    return known, missing
