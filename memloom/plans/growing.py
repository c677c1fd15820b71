"""Queries of operators that change or grow: indexes, streams, orders of long graphs, draws, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph, metrics
from ..operators.vector_index import VectorIndex
from ..schema import EDGE_STRENGTH
from ..streaming import state as live
from ..tables import scratch_dir
from . import plugins, presets, schedule
from .catalog import K, six
from .maintenance import query
from .oracles import with_

BOTH = "SELECT user_id, event_type, round(avg(value), 6) AS m FROM events GROUP BY 1, 2"
KINDS = list(EDGE_STRENGTH)


def _folder(v, name: str) -> str:
    return f"{scratch_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


@query(with_("SELECT query_id, memory_id, round(cos, 6) AS cos, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, seq) AS place FROM (SELECT q.query_id, m.memory_id, m.seq, round(list_cosine_similarity(q_emb, CASE WHEN m.memory_id % 5 = 1 THEN list_reverse(emb) ELSE emb END), 9) AS cos FROM q JOIN mem m ON m.memory_id <> q.query_id WHERE m.memory_id % 3 <> 0)) WHERE place <= 10"))
def store_change_search(v):
    """A search of the index after every third memory left it and every fifth came back with another vector."""
    rows = v.mem.select("memory_id", "seq", "emb")
    index = VectorIndex.create(rows, _folder(v, "index"))
    turned = rows.filter("memory_id % 5 = 1 AND memory_id % 3 != 0").withColumn("emb", F.reverse("emb"))
    index = index.change(remove=rows.filter("memory_id % 3 = 0")).change(put=turned)
    return six(index.search(v.q, K), "cos").select("query_id", "memory_id", "cos", "rank")


@query("SELECT event_id, row_number() OVER w - 1 AS level FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY count(*) OVER (PARTITION BY user_id) > 1")
def event_levels(v):
    """How many events of its user lead to each event: the order of a graph of chains with short cuts."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ahead = v.table("events").select(F.col("event_id").alias("src"), F.lead("event_id", 1).over(own).alias("one"), F.lead("event_id", 3).over(own).alias("three"))
    return graph.levels(ahead.select("src", F.explode(F.array("one", "three")).alias("dst")).filter("dst IS NOT NULL")).select(F.col("node_id").alias("event_id"), "level")


@query(f"""
WITH RECURSIVE names AS (SELECT list(DISTINCT event_type ORDER BY event_type) AS t FROM events),
moves AS (SELECT user_id, event_id AS seq, lag(event_type) OVER w AS src, event_type AS dst, row_number() OVER w - 1 AS n, {KINDS}[(event_id % {len(KINDS)}) + 1] AS type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
steps AS MATERIALIZED (SELECT user_id, seq, src, dst, n, type, list_position(t, src) - 1 AS a, list_position(t, dst) - 1 AS b, len(t) AS size FROM moves, names WHERE n > 0),
walk AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, NULL::VARCHAR AS type, false AS cycle, list_transform(range(size * size), lambda i: i // size = i % size) AS reach FROM steps
  UNION ALL
  SELECT s.user_id, s.n, s.seq, s.src, s.dst, s.type, reach[s.b * s.size + s.a + 1], CASE WHEN reach[s.b * s.size + s.a + 1] THEN reach ELSE list_transform(range(s.size * s.size), lambda i: reach[i + 1] OR (reach[(i // s.size) * s.size + s.a + 1] AND reach[s.b * s.size + i % s.size + 1])) END
  FROM walk w JOIN steps s ON s.user_id = w.user_id AND s.n = w.n + 1
)
SELECT user_id, src, dst, kind AS type, CASE WHEN off THEN 0.0 ELSE CASE kind {' '.join(f"WHEN '{k}' THEN {x}" for k, x in EDGE_STRENGTH.items())} END END::DOUBLE AS strength, CASE WHEN off THEN 'cycle_rejected' ELSE 'active' END AS status, updates, seq
FROM (SELECT user_id, src, dst, CASE WHEN cycle THEN 'references' ELSE type END AS kind, arg_min(cycle, seq) AS off, count(*) - 1 AS updates, min(seq) AS seq FROM walk WHERE n > 0 GROUP BY 1, 2, 3, 4)
""")
def edge_arrivals(v):
    """Each user's graph of event types, an edge from every event's type to the next one's, inserted in order."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("event_id") % len(KINDS) + 1).cast("int"))
    rows = v.table("events").select("user_id", F.col("event_id").alias("seq"), F.lag("event_type").over(own).alias("src"), F.col("event_type").alias("dst"), kind.alias("type"))
    return graph.insert_edges(rows.filter("src IS NOT NULL"), "user_id")


def _streamed(v, df: DataFrame, name: str) -> DataFrame:
    """All rows that a stream over the tables there are gives out."""
    folder = _folder(v, name)
    started = df.writeStream.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")).outputMode("update")
    started.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(f"{folder}/out")


def _events(v) -> DataFrame:
    live.use_state_store(v.spark)
    return v.spark.readStream.schema(v.table("events").schema).parquet(f"{v.dir}/events.parque[t]")  # a pattern may name a file


@query("SELECT event_type AS pool, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS pool_rank, user_id AS memory_id, value AS score, event_id AS seq FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) = 1) QUALIFY pool_rank <= 10")
def pool_stream(v):
    """The shared pools that a stream of events leaves behind."""
    rows = _events(v).select(F.col("event_type").alias("pool"), F.col("user_id").alias("memory_id"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    out = _streamed(v, live.shared_pool(rows), "pools")
    last = out.groupBy("pool").agg(F.max("round").alias("round"))
    return out.join(F.broadcast(last), ["pool", "round"]).select("pool", F.col("pool_rank").cast("long").alias("pool_rank"), "memory_id", "score", "seq")


@query("SELECT user_id % 7 AS src, event_id % 5 AS dst, count(DISTINCT event_id // 10) AS n FROM events WHERE user_id % 7 <> event_id % 5 GROUP BY 1, 2")
def interaction_stream(v):
    """How many groups of events went along each link, from a stream."""
    rows = _events(v).select(F.floor(F.col("event_id") / 10).alias("query_id"), (F.col("user_id") % 7).alias("owner_node"), (F.col("event_id") % 5).alias("cur_node"))
    return _streamed(v, live.interaction_counts(rows), "links").groupBy("src", "dst").agg(F.max("n").alias("n"))


@query(f"""
WITH both_ AS ({BOTH}), diffs AS (SELECT a.event_type || '-' || b.event_type AS pair, a.user_id AS episode_id, a.m - b.m AS diff FROM both_ a JOIN both_ b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type <> 'view'),
drawn AS (SELECT pair, diff, block, md5('{metrics.SEED}:' || block || ':' || episode_id) AS h FROM diffs, range({metrics.N_BOOT // metrics.LANES}) AS blocks(block)),
lanes AS (SELECT pair, diff, block * {metrics.LANES} + lane AS draw, ('0x' || substr(h, 8 * lane::INT + 1, 8))::BIGINT AS u FROM drawn, range({metrics.LANES}) AS l(lane)),
taken AS (SELECT pair, draw, diff, {' + '.join(f'(u >= {t})::BIGINT' for t in metrics.POISSON)} AS w FROM lanes),
means AS (SELECT pair, round(coalesce(sum(diff * w) / nullif(sum(w), 0), 0), 9) AS mean FROM taken GROUP BY pair, draw),
ends AS (SELECT pair, list(mean ORDER BY mean) AS m, least(1.0, 2 * least(count(*) FILTER (mean <= 0), count(*) FILTER (mean >= 0)) / {metrics.N_BOOT}) AS p FROM means GROUP BY pair)
SELECT pair, round(avg(diff), 6) AS delta, round(any_value(m[{int(0.025 * metrics.N_BOOT) + 1}]), 6) AS ci_low, round(any_value(m[{int(0.975 * metrics.N_BOOT) + 1}]), 6) AS ci_high, any_value(p) AS p, count(*) AS n
FROM diffs JOIN ends USING (pair) GROUP BY pair
""")
def hashed_bootstrap(v):
    """Views against every other type of event, by user, in 10,000 draws."""
    rows = v.table("events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("m"))
    view = rows.filter("event_type = 'view'").select("user_id", F.col("m").alias("v"))
    d = rows.filter("event_type != 'view'").join(view, "user_id").select(F.concat(F.lit("view-"), "event_type").alias("pair"), F.col("user_id").alias("episode_id"), (F.col("v") - F.col("m")).alias("diff"))
    return six(metrics.hashed_bootstrap(d, ["pair"]), "delta", "ci_low", "ci_high")


@query(with_("""SELECT query_id, memory_id, pick_rank, round(final, 6) AS final FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, seq) AS pick_rank FROM (
    SELECT query_id, memory_id, seq, round(CASE WHEN cur_node % 2 = 0 THEN 0.1 * time_score + 0.7 * semantic_score + 0.1 * frequency_score + 0.1 * task_score ELSE 0.25 * time_score + 0.35 * semantic_score + 0.15 * frequency_score + 0.25 * task_score END, 9) AS final FROM raw)) WHERE pick_rank <= 10"""))
def schedule_prior(v):
    """A schedule whose queries of even topics get weights by a model's answer; the others' answers hold none."""
    class Answers:
        name = "by topic"

        def __call__(self, prompts: DataFrame) -> DataFrame:
            told = F.when(F.col("cur_node") % 2 == 0, F.lit('so: {"time": 1, "semantic": 7, "frequency": 1, "task": 1}.')).otherwise(F.lit("no {weights}"))
            return prompts.join(v.q.select("query_id", "cur_node"), "query_id").select("query_id", told.alias("answer"))

    cfg = presets.SchedulingConfig(retriever="vector", selector="topk", top_k=K, tier="full")
    return six(schedule.schedule(cfg, v.q, v.mem, weight=plugins.PriorWeight(Answers())).filter("kept"), "final").select("query_id", "memory_id", "pick_rank", "final")
