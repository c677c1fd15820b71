"""Schemas (as DDL) and fixed values of the data model."""

from __future__ import annotations

# The four score dimensions in their order, with the default weights.
DIMS = ("time", "semantic", "frequency", "task")
DEFAULT_WEIGHTS = {"time": 0.25, "semantic": 0.35, "frequency": 0.15, "task": 0.25}
UNIFORM_WEIGHTS = dict(DEFAULT_WEIGHTS)
TASK_SEMANTIC_WEIGHTS = {"time": 0.0, "semantic": 0.7, "frequency": 0.0, "task": 0.3}

# Edge types, their base strengths and the least similarity that infers each.
EDGE_STRENGTH = {"derives_from": 0.9, "depends_on": 0.8, "references": 0.5, "similar_to": 0.3}
EDGE_FROM_SIMILARITY = (("derives_from", 0.85), ("depends_on", 0.72), ("references", 0.58))
EDGE_FALLBACK = "similar_to"

# Tiers with their prior mode, candidate cap and lambda.
TIERS = {"full": ("call", 50, 0.7), "balanced": ("cache", 30, 0.7), "fast": ("off", 20, 1.0)}
TIER_ORDER = ("full", "balanced", "fast")

MAIN_NODE = "main"

MEMORY = (
    "memory_id string, text string, path string, start_line int, end_line int, timestamp double, access_count int, "
    "task_tag string, user_id string, session_id string, bm25_score double, vector_score double, embedding array<float>, "
    "owner_node string, producer_run string"
)
NODE = (
    "node_id string, topic string, summary string, emb array<float>, owner_user string, session_id string, created_at double, "
    "summary_at double, version int, root_id string, status string, n_memories int"
)
EDGE = (
    "edge_id string, src string, dst string, type string, strength double, created_at double, updated_at double, evidence string, "
    "stage string, status string, similarity double, interactions int, factors map<string,double>"
)
TRAINING = (
    "query string, condition struct<user_id:string,scenario_id:string,business_id:string>, "
    "target_weights struct<time:double,semantic:double,frequency:double,task:double>"
)
FLAT_EPISODE = (
    "episode_id string, task_tag string, user_id string, scenario string, business string, query string, "
    "corpus array<struct<memory_id:string,text:string,task_tag:string>>, relevant array<string>"
)
GRAPH_EPISODE = (
    "episode_id string, task_tag string, user_id string, scenario string, business string, query string, cur_node string, now double, scene string, "
    "relevant array<string>, relevant_sources array<string>, nodes array<struct<node_id:string,topic:string,summary:string>>, "
    "edges array<struct<src:string,dst:string,type:string>>, "
    "corpus array<struct<memory_id:string,text:string,task_tag:string,owner_node:string,timestamp:double,kind:string,replaced_by:string,chain:string,version:int,is_current:boolean,param:string>>"
)
SCHEDULE_LOG = (
    "event string, ts double, query string, condition_key string, cur_node string, weights map<string,double>, n_candidates int, "
    "n_kept int, n_discarded int, compression_ratio double, latency_ms map<string,double>, scope_size int, scope_ratio double"
)
METRIC_ROW = (
    "group string, episode_id string, scene string, recall_kept double, recall_norm double, source_hit_rate double, mrr double, ndcg double, "
    "multi_source_ratio double, cand_hit_rate double, n_kept int, latency_ms double"
)
EMBEDDING_CACHE = ("text string, vec array<float>")
SHARED_ITEM = "memory_id string, text string, path string, start_line int, end_line int, score double, timestamp double, owner_node string"
SHARED_POOL = f"items array<struct<{SHARED_ITEM.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')}>>"
