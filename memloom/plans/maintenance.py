"""Queries of the memory store, graph maintenance, conversations and reports, each with the SQL it must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import clamp01
from ..operators import graph, metrics, retrieval, selection, state, weights
from ..operators.vector_index import VectorIndex
from ..schema import DIMS
from ..sources import generators as G
from ..sources import readers
from ..tables import scratch_dir
from . import presets, schedule
from .catalog import K, QUERIES, View, six
from .oracles import BAR, FACT, ORACLES, OUTS, TAU, VPARTS, WARM, with_


def query(sql: str):
    """Register f(view) under its name, with its SQL."""
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(View(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return put


# the memory store


@query(with_("SELECT memory_id, owner_node, user_id, task_tag FROM mem WHERE memory_id = 17"))
def point_lookup(v):
    return retrieval.get(v.mem, 17).select("memory_id", "owner_node", "user_id", "task_tag")


@query(with_("SELECT memory_id, CASE WHEN memory_id % 4 = 0 THEN 99 ELSE owner_node END::BIGINT AS owner_node FROM mem UNION ALL SELECT -1, 99"))
def store_put(v):
    """Every fourth memory replaced, one added."""
    old = v.mem.select("memory_id", "owner_node")
    changed = old.filter("memory_id % 4 = 0").withColumn("owner_node", F.lit(99).cast("long"))
    return retrieval.put(old, changed.union(v.spark.createDataFrame([(-1, 99)], "memory_id long, owner_node long")))


@query(with_("SELECT query_id, memory_id, round(cos, 6) AS cos, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, seq) AS place FROM sim WHERE memory_id % 3 <> 0) WHERE place <= 10"))
def store_remove_search(v):
    """A search after every third memory left the index."""
    rows = v.mem.select("memory_id", "seq", "emb")
    index = VectorIndex.create(rows, f"{scratch_dir(v.spark)}/index-{uuid.uuid4().hex}").change(remove=rows.filter("memory_id % 3 = 0"))
    return six(index.search(v.q, K), "cos").select("query_id", "memory_id", "cos", "rank")


@query(with_("SELECT query_id, memory_id, round(cos, 6) AS cos, rank FROM vec WHERE rank <= 10 AND memory_id % 2 = 0"))
def store_recall_parity(v):
    """The original's order: the best of the whole index first, then what the user may see of them."""
    pool = v.mem.withColumn("visible", F.col("memory_id") % 2 == 0)
    return six(retrieval.retrieve_vector(v.q, pool, K, parity=True), "cos").select("query_id", "memory_id", "cos", "rank")


@query(with_("SELECT node_id, n_memories + n AS n_memories FROM nodes JOIN (SELECT owner_node, count(*) AS n FROM mem WHERE memory_id % 10 = 0 GROUP BY 1) ON owner_node = node_id"))
def memory_counts(v):
    return graph.with_memory_counts(v.nodes, v.mem.filter("memory_id % 10 = 0")).select("node_id", "n_memories")


@query(with_("SELECT pool_rank, memory_id, round(final, 6) AS score FROM (SELECT memory_id, final, row_number() OVER (ORDER BY final DESC, s) AS pool_rank FROM (SELECT memory_id, final, query_id * 1000 + pick_rank AS s, row_number() OVER (PARTITION BY memory_id ORDER BY final DESC, query_id * 1000 + pick_rank) AS d FROM kept) WHERE d = 1) WHERE pool_rank <= 3"))
def dispatch(v):
    return six(selection.dispatch(_pool(v), 3), "score").select("pool_rank", "memory_id", "score")


def _pool(v):
    rows = v.kept.select(F.lit("main").alias("pool"), "memory_id", F.col("final").alias("score"), (F.col("query_id") * 1000 + F.col("pick_rank")).alias("seq"))
    return selection.shared_pool(rows)


@query(with_("SELECT 'main' AS pool, count(*) AS size, round(max(final), 6) AS best, string_agg(memory_id::VARCHAR, ',' ORDER BY pool_rank) FILTER (pool_rank <= 5) AS memories FROM (SELECT memory_id, final, row_number() OVER (ORDER BY final DESC, s) AS pool_rank FROM (SELECT memory_id, final, query_id * 1000 + pick_rank AS s, row_number() OVER (PARTITION BY memory_id ORDER BY final DESC, query_id * 1000 + pick_rank) AS d FROM kept) WHERE d = 1) WHERE pool_rank <= 10"))
def bookmark(v):
    b = selection.bookmark(_pool(v))
    return b.select("pool", "bookmark.size", F.round("bookmark.best", 6).alias("best"), F.array_join(F.transform("bookmark.memories", lambda m: m.cast("string")), ",").alias("memories"))


@query(with_("SELECT memory_id, access_count FROM mem ORDER BY access_count DESC, memory_id LIMIT 20"))
def table_view(v):
    return selection.table_view(v.mem.select("memory_id", "access_count"), "access_count")


@query(with_("SELECT memory_id, CASE WHEN memory_id % 3 = 0 THEN 0.5 ELSE memory_id / 1000 END AS x, CASE WHEN memory_id % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS y FROM (SELECT DISTINCT memory_id FROM kept)"))
def shared_positions(v):
    """Shared memories with their place on the map, its middle for those without one."""
    place = v.mem.filter("memory_id % 3 != 0").select("memory_id", (F.col("memory_id") / 1000).alias("x"), F.lit(1.0).alias("y"))
    return v.kept.select("memory_id").distinct().join(place, "memory_id", "left").fillna(0.5, ["x", "y"])


@query(with_("SELECT q.query_id, m.memory_id FROM q JOIN mem m ON m.ts < q.now - 3600 * (q.query_id % 7 + 1) * 24"))
def visible_earlier(v):
    """What was written before each query's own time."""
    asked = v.q.select("query_id", (F.col("now") - 3600.0 * (F.col("query_id") % 7 + 1) * 24).alias("query_ts"))
    return state.visible(v.mem.select("memory_id", "ts"), asked).select("query_id", "memory_id")


# graph maintenance


@query(with_("SELECT node_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node_id, 1 AS o, 0 AS i FROM edges WHERE interactions >= 2 UNION ALL SELECT dst, 0, 1 FROM edges WHERE interactions >= 2) GROUP BY 1"))
def active_degrees(v):
    return graph.degrees(_with_status(v))


def _with_status(v):
    return v.edges.withColumn("status", F.when(F.col("interactions") >= 2, "active").otherwise("retired"))


@query(with_("SELECT node_id, count(*) AS n, string_agg(src || '>' || dst, ',' ORDER BY src, dst) AS rejected FROM (SELECT unnest([src, dst]) AS node_id, src, dst FROM edges WHERE interactions < 2) GROUP BY 1"))
def rejected_edges(v):
    r = graph.rejected_edges(_with_status(v))
    return r.select("node_id", F.size("rejected").cast("long").alias("n"), F.array_join(F.transform("rejected", lambda x: F.concat(x["src"].cast("string"), F.lit(">"), x["dst"].cast("string"))), ",").alias("rejected"))


@query(with_("SELECT src, dst, type FROM edges WHERE interactions >= 2 AND (src IN (2, 7) OR dst IN (2, 7))"))
def affected_edges(v):
    return graph.affected_edges(_with_status(v), v.nodes.filter(F.col("node_id").isin(2, 7))).select("src", "dst", "type")


@query(with_("SELECT src, dst, type FROM edges WHERE src = 3 OR dst = 3"))
def edges_of_node(v):
    return graph.edges_of(v.edges, 3).select("src", "dst", "type")


@query(with_("SELECT src, dst, CASE WHEN src = 4 OR dst = 4 THEN 'unknown node' ELSE 'unknown type' END AS reason FROM edges WHERE src = 4 OR dst = 4 OR (src + dst) % 2 = 0"))
def referential_check(v):
    """Links that name a node that is gone, or a type that does not exist."""
    odd = v.edges.withColumn("type", F.when((F.col("src") + F.col("dst")) % 2 == 0, "causes").otherwise(F.col("type")))
    return graph.invalid_edges(odd, v.nodes.filter("node_id != 4")).select("src", "dst", "reason")


@query("SELECT conv_id, 1::BIGINT AS number, 'depends_on' AS type FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT conv_id, 3, 'similar_to' FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 0)")
def judged_types(v):
    last = F.when(F.col("conv_id") % 2 == 0, "similar_to").otherwise("related")
    raw = F.concat(F.lit('Answer:\n{"1": "depends_on", "x": "references", "2": "unknown",\n"3": "'), last, F.lit('"} ok'))
    return graph.judged_types(v.table("conversations").select("conv_id").distinct().withColumn("answer", raw), "conv_id")


@query(with_("SELECT src, dst, interactions + CASE WHEN (src + dst) % 2 = 0 THEN 2 ELSE 0 END AS interactions FROM edges UNION ALL SELECT src, dst, interactions FROM edges WHERE src = 0"))
def bump_interactions(v):
    """Two uses of every second link; a second link of the same pair, later by id, stays as it is."""
    e = v.edges.withColumn("edge_id", F.concat(F.lit("a"), "src", F.lit("-"), "dst"))
    e = e.unionByName(v.edges.filter("src = 0").withColumn("edge_id", F.lit("b")))
    used = v.edges.filter("(src + dst) % 2 = 0").select("src", "dst")
    return graph.bump_interactions(e, used.union(used)).select("src", "dst", "interactions")


@query(with_("SELECT node_id, version + CASE WHEN node_id < 3 THEN 10 ELSE 0 END AS version FROM nodes UNION ALL SELECT 50, 1"))
def upsert_nodes(v):
    n = v.nodes.select("node_id", "version")
    changed = n.filter("node_id < 3").withColumn("version", F.col("version") + 10)
    return graph.upsert_nodes(n, changed.union(v.spark.createDataFrame([(50, 1)], "node_id long, version long")))


@query(with_("SELECT round(avg(CASE WHEN src >= 4 THEN 1.0 ELSE 0 END), 6) AS coverage FROM edges"))
def refine_coverage(v):
    return six(graph.refine_coverage(v.edges.withColumn("stage", F.when(F.col("src") >= 4, "refined").otherwise("coarse"))), "coverage")


REFINED = "SELECT src, dst, round(similarity, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY similarity DESC, src) AS r FROM (SELECT a.node_id AS src, b.node_id AS dst, round(list_cosine_similarity(a.emb, b.emb), 9) AS similarity FROM nodes a JOIN nodes b ON a.node_id <> b.node_id AND a.root_id <> b.root_id WHERE b.node_id IN (6, 9))) WHERE r <= 4"


@query(with_("SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, CASE WHEN a.src IS NULL THEN 'added' ELSE 'removed' END AS change FROM (SELECT src, dst FROM edges WHERE dst IN (6, 9)) a FULL JOIN refd b ON a.src = b.src AND a.dst = b.dst WHERE a.src IS NULL OR b.src IS NULL", {"refd": REFINED}))
def refine_node(v):
    return graph.refine(v.nodes, v.edges, [6, 9])[1]


@query(with_("SELECT src, dst, type, 'old' AS origin FROM edges WHERE src < 8 AND dst < 8 UNION ALL SELECT src, dst, CASE WHEN similarity >= 0.85 THEN 'derives_from' WHEN similarity >= 0.72 THEN 'depends_on' WHEN similarity >= 0.58 THEN 'references' ELSE 'similar_to' END, 'new' FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY similarity DESC, src) AS r FROM (SELECT a.node_id AS src, b.node_id AS dst, round(list_cosine_similarity(a.emb, b.emb), 9) AS similarity FROM nodes a JOIN nodes b ON a.node_id <> b.node_id AND a.root_id <> b.root_id WHERE b.node_id >= 8)) WHERE r <= 4"))
def create_nodes(v):
    """Two topics added to the graph of the others, with their links."""
    links = v.edges.filter("src < 8 AND dst < 8").withColumn("stage", F.lit("old"))
    _, edges = graph.create_nodes(v.nodes.filter("node_id < 8"), links, v.nodes.filter("node_id >= 8"))
    return edges.select("src", "dst", "type", F.when(F.col("stage") == "old", "old").otherwise("new").alias("origin"))


@query(with_("SELECT e.src, e.dst, interactions + coalesce(used, 0) AS interactions, round(greatest(0, least(1, 0.5 * CASE type WHEN 'derives_from' THEN 0.9 WHEN 'depends_on' THEN 0.8 WHEN 'references' THEN 0.5 ELSE 0.3 END + 0.5 * f_topic)), 6)::DOUBLE AS strength FROM fact e LEFT JOIN warmed USING (src, dst)", {"warmed": WARM, "tau": TAU, "outs": OUTS, "fact": FACT}))
def warm_up_edges(v):
    """Links after a warm-up round: raised by what past queries took along them, strengths made anew."""
    out = schedule.warm_up(presets.PRESETS["graph_g4"], v.q, v.mem, v.nodes, v.edges)
    return six(out, "strength").select("src", "dst", "interactions", "strength")


# schedules and their reports


@query(with_("SELECT query_id, memory_id, pick_rank, round(f, 6) AS final FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, seq) AS pick_rank FROM (SELECT *, round(final + 0.2, 9) AS f FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, seq) AS cr FROM (SELECT p.* FROM vpool p JOIN vrank s ON s.query_id = p.query_id AND s.node_id = p.owner_node WHERE source_rank = 1)) WHERE cr <= 50)) WHERE pick_rank <= 8", VPARTS))
def schedule_oracle(v):
    """The schedule with labelled sources in place of chosen ones: each query's strongest upstream node."""
    from .variants import chosen

    labelled = chosen("G2", v.near.withColumn("rel", F.lit(0.0))).select("query_id", "node_id")
    return schedule_picks(schedule.schedule(presets.PRESETS["graph_g4"], v.folded.join(labelled.select("query_id"), "query_id", "left_semi"), v.mem, oracle=labelled))


def schedule_picks(rows):
    return six(rows.filter("kept"), "final").select("query_id", "memory_id", "pick_rank", "final")


@query(with_("SELECT query_id, 50::BIGINT AS n_candidates, 10::BIGINT AS n_kept, round(max(final), 6) AS best FROM scored WHERE query_id IN (SELECT query_id FROM q ORDER BY query_id LIMIT 5) GROUP BY 1"))
def smoke_run(v):
    cfg = presets.SchedulingConfig(retriever="vector", selector="topk", top_k=K, tier="full")
    return six(schedule.smoke(cfg, v.q, v.mem, v.nodes, v.edges), "best")


TOP2 = "SELECT query_id, memory_id FROM vec WHERE rank <= 2"
FLAT = "SELECT query_id, CASE WHEN hit >= 2 THEN 1.0 ELSE 0.0 END AS recall, hit / n AS precision, first_rank AS rank FROM (SELECT k.query_id, count(*) AS n, count(t.memory_id) AS hit, min(pick_rank) FILTER (t.memory_id IS NOT NULL) AS first_rank FROM kept k LEFT JOIN toptwo t USING (query_id, memory_id) GROUP BY 1)"


def _flat(v):
    two = retrieval.retrieve_vector(v.q, v.mem, 2).select("query_id", "memory_id")
    return metrics.flat_metrics(v.kept, two, v.q)


@query(with_("SELECT query_id, recall::DOUBLE AS recall, round(precision, 6) AS precision, coalesce(rank, 0) AS rank FROM flatm", {"toptwo": TOP2, "flatm": FLAT}))
def flat_metrics(v):
    """All or nothing: whether both of the two most similar memories were kept."""
    return six(_flat(v), "precision").fillna(0, ["rank"])


@query(with_("SELECT s AS scene, count(*) AS n, round(avg(recall), 6) AS avg_recall, round(avg(precision), 6) AS avg_precision, round(avg(rank), 6) AS avg_rank FROM (SELECT flatm.*, 's' || (cur_node % 3) AS s FROM flatm JOIN q USING (query_id)) GROUP BY 1", {"toptwo": TOP2, "flatm": FLAT}))
def flat_summary(v):
    rows = _flat(v).join(v.q.select("query_id", F.concat(F.lit("s"), F.col("cur_node") % 3).alias("scene")), "query_id")
    return metrics.flat_summary(rows, ["scene"])


@query(with_(f"SELECT b.query_id, b.memory_id, round(final, 6) AS final, round(final - bar, 6) AS margin, pick_rank <= 10 AND final >= bar AS kept, r.memory_id IS NOT NULL AS relevant FROM ({BAR.format(t=0.4)}) b LEFT JOIN relevant r ON r.query_id = b.query_id AND r.memory_id = b.memory_id"))
def episode_diagnosis(v):
    out = metrics.episode_diagnosis(selection.select_threshold(v.scored, 0.4, K), v.relevant)
    return six(out, "final").select("query_id", "memory_id", "final", "margin", "kept", "relevant")


@query("SELECT source, count(*) AS before, count(DISTINCT text) AS after, round(greatest(0, count(*) - count(DISTINCT text)) / count(*), 6)::DOUBLE AS dedup_rate FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_rates(v):
    d = v.table("documents").filter("text IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("before"), F.count_distinct("text").alias("after"))
    return d.withColumn("dedup_rate", metrics.dedup_rate(F.col("before"), F.col("after")))


@query(with_("SELECT query_id, round(avg(CASE WHEN c.memory_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS cand_hit_rate FROM relevant r LEFT JOIN cand c USING (query_id, memory_id) GROUP BY 1"))
def candidate_hit_rate(v):
    return six(metrics.candidate_hit_rate(v.cand, v.relevant, v.q), "cand_hit_rate")


@query("SELECT event_type, n, m.run, m.note FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) LEFT JOIN (VALUES ('view', 'r1', 'first'), ('click', 'r2', 'second')) m(kind, run, note) ON kind = event_type")
def manifest_join(v):
    """Group summaries beside what a manifest says of their runs."""
    s = v.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    m = v.spark.createDataFrame([("view", "r1", "first"), ("click", "r2", "second")], "event_type string, run string, note string")
    return s.join(m, "event_type", "left")


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS llm_calls, count(*) FILTER (event_type = 'click') AS embed_calls, floor(sum(length(props)) / 1.5)::BIGINT AS input_tokens FROM events GROUP BY 1")
def cost_counters(v):
    kind = F.when(F.col("event_type") == "view", "llm").when(F.col("event_type") == "click", "embed")
    return state.cost_counters(v.table("events").select("user_id", kind.alias("kind"), F.length("props").alias("chars")), "user_id")


@query("SELECT event_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM (SELECT event_id, event_id / 10000 AS p FROM events)")
def significance_stars(v):
    return v.table("events").select("event_id", metrics.stars(F.col("event_id") / 10000).alias("stars"))


@query("SELECT min(ts) AS first, max(ts) AS last, count(DISTINCT ts) AS n_times FROM events")
def time_span(v):
    return v.table("events").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("ts").alias("n_times"))


# conversations, labels, texts

QA = "SELECT conv_id, turn AS qa_id, text AS question, unnest([conv_id || ':' || (turn - 1), conv_id || ':' || (turn + 1), 'none']) AS ev, unnest([0, 1, 2]) AS pos FROM conversations WHERE role = 'user'"


@query(f"SELECT conv_id, qa_id, string_agg(memory, ',' ORDER BY pos) AS relevant, string_agg(owner::VARCHAR, ',' ORDER BY pos) AS relevant_sources FROM (SELECT q.conv_id, qa_id, pos, 'm' || m.conv_id || '-' || m.turn AS memory, m.turn AS owner FROM ({QA}) q JOIN conversations m ON m.role = 'assistant' AND m.conv_id = q.conv_id AND m.conv_id || ':' || m.turn = ev) GROUP BY 1, 2")
def conversation_episodes(v):
    """Questions are user turns, their evidence the turns around them; only assistants' turns are memories."""
    c = v.table("conversations")
    ident = lambda n: F.concat(F.col("conv_id").cast("string"), F.lit(":"), n.cast("string"))
    qa = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("qa_id"), F.col("text").alias("question"), F.array(ident(F.col("turn") - 1), ident(F.col("turn") + 1), F.lit("none")).alias("evidence"), F.lit("x").alias("_private"))
    known = c.filter("role = 'assistant'").select("conv_id", ident(F.col("turn")).alias("evidence"), F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("memory_id"), F.col("turn").alias("owner_node"), F.col("turn").alias("seq"))
    out = G.conversation_episodes(G.without_private(qa), known)
    return out.select("conv_id", "qa_id", F.array_join("relevant", ",").alias("relevant"), F.array_join(F.transform("relevant_sources", lambda x: x.cast("string")), ",").alias("relevant_sources"))


@query(with_("SELECT query_id, m.memory_id FROM q JOIN mem m ON m.owner_node IN (cur_node, (cur_node + 1) % 10) WHERE (m.text LIKE '%the%')::INT + (m.text LIKE '%and%')::INT + (m.text LIKE '%ing%')::INT >= 2"))
def anchored_memories(v):
    """Memories of a query's nodes whose text holds two of its three anchors."""
    asked = v.q.select("query_id", F.array("cur_node", (F.col("cur_node") + 1) % 10).alias("relevant_nodes"), F.array(F.lit("the"), F.lit("and"), F.lit("ing")).alias("anchors"))
    return G.anchored(v.mem, asked, 2)


@query("SELECT item_id, min(doc_id) AS memory_id FROM benchmark b JOIN (SELECT doc_id, substr(text, 1, 40) AS t FROM documents) d ON d.t = substr(b.text, 1, 40) GROUP BY 1 UNION ALL SELECT -doc_id, (SELECT min(doc_id) FROM documents e WHERE e.text = d.text) FROM documents d WHERE text IS NOT NULL")
def label_to_memory(v):
    """Texts of labels as ids of the first memory with that text."""
    d = v.table("documents").filter("text IS NOT NULL")
    heads = v.table("benchmark").select("item_id", F.substring("text", 1, 40).alias("t")).join(d.select("doc_id", F.substring("text", 1, 40).alias("t")), "t")
    first = d.groupBy("text").agg(F.min("doc_id").alias("memory_id"))
    whole = d.join(first, "text").select((-F.col("doc_id")).alias("item_id"), "memory_id")
    return heads.groupBy("item_id").agg(F.min("doc_id").alias("memory_id")).union(whole)


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 0.25 ELSE 0.1 + 0.2 * quality END::DOUBLE AS time, CASE WHEN quality IS NULL THEN 0.35 ELSE 0.5 END::DOUBLE AS semantic FROM documents d LEFT JOIN (SELECT text, max(quality) AS quality FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL GROUP BY 1) l ON l.text = d.text")
def label_prior(v):
    """The target weights of a label of the same text, else the default ones."""
    w = F.struct((0.1 + 0.2 * F.col("quality")).alias("time"), F.lit(0.5).alias("semantic"), F.lit(0.2).alias("frequency"), F.lit(0.2).alias("task"))
    labels = v.table("labels").join(v.table("documents").filter("text IS NOT NULL").select("doc_id", F.col("text").alias("query")), "doc_id").select("query", w.alias("target_weights"))
    out = weights.with_label_prior(v.table("documents").select("doc_id", F.col("text").alias("q_text")), labels)
    return out.select("doc_id", *[F.round(F.col(f"prior.{d}"), 9).alias(d) for d in DIMS[:2]])


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch(TIMESTAMP '2023-05-08 13:56:00') + 0.0 WHEN 1 THEN epoch(TIMESTAMP '2024-02-29 00:00:00') ELSE event_id * 86400.0 END::DOUBLE AS seconds FROM events")
def session_times(v):
    text = F.when(F.col("event_id") % 3 == 0, "1:56 pm on 8 May, 2023").when(F.col("event_id") % 3 == 1, "2024-02-29").otherwise("some day")
    return v.table("events").select("event_id", readers.parse_time(text, F.col("event_id")).alias("seconds"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' ELSE 'known' END AS state FROM (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text) WHERE doc_id % 2 = 0 AND text IS NOT NULL UNION ALL SELECT doc_id, 'embedded' FROM (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text) WHERE doc_id % 2 = 1 AND text IS NOT NULL")
def embedding_warm_up(v):
    """Distinct texts by whether the cache holds them or they were embedded for it."""
    first = v.table("documents").filter("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    cache = first.filter("doc_id % 2 = 0").select("text", F.array(F.lit(1.0)).alias("vec"))
    known, missing = G.embedded(v.table("documents").filter("text IS NOT NULL"), cache, lambda t: F.array(F.length(t).cast("double")))
    say = lambda df, what: df.join(first, "text").select("doc_id", F.lit(what).alias("state"))
    return say(known, "known").union(say(missing, "embedded"))


@query(with_("SELECT src, dst, round(greatest(0, least(1, similarity + 0.25)), 6) AS raised, substr('topic ' || src || ' and ' || dst, 1, 8) || '…' AS title FROM edges"))
def edge_titles(v):
    title = tx.short_title(F.concat(F.lit("topic "), F.col("src").cast("string"), F.lit(" and "), F.col("dst").cast("string")))
    return v.edges.select("src", "dst", F.round(clamp01(F.col("similarity") + 0.25), 6).alias("raised"), title.alias("title"))
