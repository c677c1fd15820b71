"""The catalog's queries as DuckDB SQL, put together from common table expressions."""

from __future__ import annotations

# Each fragment is one common table expression; FRAGMENTS lists what it reads.
PARTS = {
    "mem": """SELECT e.vec_id AS memory_id, e.vec_id AS seq, d.text, epoch_us(v.ts) / 1e6 AS ts, e.label::BIGINT AS owner_node, d.lang AS task_tag, v.user_id,
        coalesce(a.n, 0) AS access_count, e.embedding::DOUBLE[] AS emb
        FROM embeddings e JOIN events v ON v.event_id = e.vec_id LEFT JOIN documents d ON d.doc_id = e.vec_id
        LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1) a ON a.user_id = e.vec_id""",
    "q": "SELECT memory_id AS query_id, text AS q_text, emb AS q_emb, owner_node AS cur_node, 'en' AS q_task, (SELECT max(ts) FROM mem) AS now FROM mem WHERE memory_id % 50 = 0",
    "sim": "SELECT q.query_id, q.cur_node, q.q_task, q.now, m.*, round(list_cosine_similarity(q_emb, emb), 9) AS cos FROM q JOIN mem m ON m.memory_id <> q.query_id",
    "vec": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, seq) AS rank FROM sim",
    "cand": "SELECT * FROM vec WHERE rank <= 50",
    "raw": """SELECT *, exp(-0.01 * greatest(0, (now - ts) / 3600)) AS time_score, 0.8 * cos AS semantic_score, 1 - exp(-0.1 * access_count) AS frequency_score,
        CASE WHEN q_task IS NULL OR task_tag IS NULL THEN 0.5::DOUBLE WHEN q_task = task_tag THEN 1.0 ELSE 0.3 END AS task_score FROM cand""",
    "scored": "SELECT *, round(0.25 * time_score + 0.35 * semantic_score + 0.15 * frequency_score + 0.25 * task_score, 9) AS final FROM raw",
    "kept": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, seq) AS pick_rank FROM scored) WHERE pick_rank <= 10",
    "dims": """SELECT node_id, list(x ORDER BY i) AS emb FROM (SELECT owner_node AS node_id, i, avg(x) AS x FROM
        (SELECT owner_node, unnest(emb) AS x, generate_subscripts(emb, 1) AS i FROM mem) GROUP BY 1, 2) GROUP BY 1""",
    "nodes": """SELECT owner_node AS node_id, min(ts) AS created_at, count(*) AS n_memories, owner_node % 5 AS root_id, owner_node // 5 AS version, any_value(dims.emb) AS emb
        FROM mem JOIN dims ON dims.node_id = owner_node GROUP BY owner_node""",
    "edges": """SELECT *, CASE type WHEN 'derives_from' THEN 0.9 WHEN 'depends_on' THEN 0.8 WHEN 'references' THEN 0.5 ELSE 0.3 END AS strength, (src + dst) % 7 AS interactions
        FROM (SELECT *, CASE WHEN similarity >= 0.85 THEN 'derives_from' WHEN similarity >= 0.72 THEN 'depends_on' WHEN similarity >= 0.58 THEN 'references' ELSE 'similar_to' END AS type
        FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY similarity DESC, src) AS r FROM (SELECT a.node_id AS src, b.node_id AS dst,
        round(greatest(0, least(1, 0.5 + list_cosine_similarity(a.emb, b.emb))), 9) AS similarity FROM nodes a JOIN nodes b ON a.node_id < b.node_id)) WHERE r <= 4)""",
    "fold": "SELECT node_id, first_value(node_id) OVER (PARTITION BY root_id ORDER BY version DESC, created_at DESC, node_id) AS primary_id FROM nodes",
    "fq": "SELECT q.query_id, q.q_emb, q.q_task, q.now, coalesce(primary_id, cur_node) AS cur_node FROM q LEFT JOIN fold ON node_id = cur_node",
    "near": "SELECT query_id, src AS node_id, max(strength) AS strength FROM fq JOIN edges ON dst = cur_node WHERE src <> cur_node GROUP BY 1, 2",
    "rels": "SELECT near.*, round(list_cosine_similarity(q_emb, emb), 9) AS rel FROM near JOIN fq USING (query_id) JOIN nodes USING (node_id)",
    "sa": """SELECT *, round(lambda_eff * strength + (1 - lambda_eff) * rel, 9) AS src_score FROM
        (SELECT *, CASE WHEN coalesce(var_samp(rel) OVER (PARTITION BY query_id), 0) < 0.0 THEN 1.0 ELSE 0.7 END AS lambda_eff FROM rels)""",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src_score DESC, node_id) AS source_rank FROM sa) WHERE source_rank <= 3",
    "srcs": """SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS weight FROM
        (SELECT *, exp(src_score / 0.5 - max(src_score / 0.5) OVER (PARTITION BY query_id)) AS e FROM top)""",
    "relevant": "SELECT query_id, m.memory_id FROM q JOIN mem m ON m.owner_node = q.cur_node AND m.memory_id <> q.query_id",
    "met": """SELECT query_id, n_relevant, n_kept, n_hit, first_rank, n_hit / n_relevant AS recall, least(1.0, 10 / n_relevant) AS ceiling, n_hit / n_relevant / least(1.0, 10 / n_relevant) AS recall_norm,
        n_hit / n_kept AS precision, coalesce(1.0 / first_rank, 0) AS mrr, dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(n_relevant, n_kept)) AS ndcg FROM
        (SELECT query_id, count(*) AS n_relevant FROM relevant GROUP BY 1) JOIN
        (SELECT k.query_id, count(*) AS n_kept, count(r.memory_id) AS n_hit, min(pick_rank) FILTER (r.memory_id IS NOT NULL) AS first_rank,
        coalesce(sum(1 / log2(pick_rank + 1)) FILTER (r.memory_id IS NOT NULL), 0) AS dcg FROM kept k LEFT JOIN relevant r USING (query_id, memory_id) GROUP BY 1) USING (query_id)""",
    "gated": """SELECT *, CASE WHEN lift THEN e_time * (1 - (0.5 - e_sem) / others) ELSE e_time END AS eff_time, CASE WHEN lift THEN 0.5 ELSE e_sem END AS eff_semantic,
        CASE WHEN lift THEN e_freq * (1 - (0.5 - e_sem) / others) ELSE e_freq END AS eff_frequency, CASE WHEN lift THEN e_task * (1 - (0.5 - e_sem) / others) ELSE e_task END AS eff_task FROM
        (SELECT *, e_time + e_freq + e_task AS others, e_sem > 0 AND e_sem < 0.5 AND e_time + e_freq + e_task > 0 AS lift FROM
        (SELECT *, CASE WHEN tot > 0 THEN 0.25 * a_time / tot WHEN n > 0 THEN a_time / n ELSE 0.25 END AS e_time, CASE WHEN tot > 0 THEN 0.35 * a_sem / tot WHEN n > 0 THEN a_sem / n ELSE 0.25 END AS e_sem,
        CASE WHEN tot > 0 THEN 0.15 * a_freq / tot WHEN n > 0 THEN a_freq / n ELSE 0.25 END AS e_freq, CASE WHEN tot > 0 THEN 0.25 * a_task / tot WHEN n > 0 THEN a_task / n ELSE 0.25 END AS e_task FROM
        (SELECT *, 0.25 * a_time + 0.35 * a_sem + 0.15 * a_freq + 0.25 * a_task AS tot, a_time + a_sem + a_freq + a_task AS n FROM
        (SELECT *, (coalesce(stddev_samp(time_score) OVER w, 0) > 1e-9)::INT AS a_time, (coalesce(stddev_samp(semantic_score) OVER w, 0) > 1e-9)::INT AS a_sem,
        (coalesce(stddev_samp(frequency_score) OVER w, 0) > 1e-9)::INT AS a_freq, (coalesce(stddev_samp(task_score) OVER w, 0) > 1e-9)::INT AS a_task FROM {raw} WINDOW w AS (PARTITION BY query_id)))))""",
    "adapt": """SELECT * REPLACE (exp(-lambda_eff * greatest(0, (now - ts) / 3600)) AS time_score) FROM
        (SELECT *, 2.0 / greatest((max(ts) OVER (PARTITION BY query_id) - min(ts) OVER (PARTITION BY query_id)) / 3600, 1) AS lambda_eff FROM raw)""",
}
PARTS["gate_raw"] = PARTS["gated"].replace("{raw}", "raw")
PARTS["gate_adapt"] = PARTS.pop("gated").replace("{raw}", "adapt")

CJK = r"[\x{4e00}-\x{9fff}]"
STOP = "['的','了','是','在','和','有','我','你','他','她','它','与','就','都','而','及','着','或','the','a','an','is','are','was','were','to','of','in','and','or','for','on','with','at','by','from','as']"


def toks(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '{CJK}|[a-z0-9]+'), lambda t: NOT list_contains({STOP}, t))"


def bm25(pool: str, queries: str) -> dict[str, str]:
    return {
        "dt": f"SELECT memory_id, seq, {toks('text')} AS t FROM {pool}",
        "sc": "SELECT count(*) AS n, greatest(avg(len(t)), 1) AS avgdl FROM dt",
        "tf": "SELECT memory_id, len(t) AS dl, tok, count(*) AS f FROM (SELECT memory_id, t, unnest(t) AS tok FROM dt) GROUP BY memory_id, len(t), tok",
        "df": "SELECT tok, count(*) AS df FROM tf GROUP BY tok",
        "qt": f"SELECT DISTINCT query_id, unnest({toks('q_text')}) AS tok FROM {queries}",
        "hit": "SELECT query_id, memory_id, round(sum(ln(1 + n / (1 + df)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS bm25_score FROM tf JOIN qt USING (tok) JOIN df USING (tok), sc GROUP BY 1, 2",
    }


def with_(body: str, extra: dict[str, str] | None = None, recursive: str = "") -> str:
    """body after every fragment that it or its fragments name, in an order that works."""
    import re

    parts = PARTS | (extra or {})
    done: list[str] = []

    def need(sql: str) -> None:
        for name in parts:
            if name not in done and re.search(rf"\b{name}\b", sql) and parts[name] is not sql:
                need(parts[name])
                if name not in done:
                    done.append(name)

    need(body + recursive)
    ctes = [f"{n} AS ({parts[n]})" for n in done] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + f"\n{body}" if ctes else body


R6 = "round(time_score, 6) AS time_score, round(semantic_score, 6) AS semantic_score, round(frequency_score, 6) AS frequency_score, round(task_score, 6) AS task_score"


def picks(order: str, k: int, source: str = "scored", where: str = "true") -> str:
    return with_(f"SELECT query_id, memory_id, pick_rank, round(final, 6) AS final FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS pick_rank FROM {source}) WHERE pick_rank <= {k} AND {where}")


BAR = "SELECT *, round(greatest({t}, avg(final) OVER w - 0.5 * coalesce(stddev_samp(final) OVER w, 0)), 9) AS bar, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, seq) AS pick_rank FROM scored WINDOW w AS (PARTITION BY query_id)"
OLD = "SELECT m.query_id, m.memory_id FROM scored m WHERE EXISTS (SELECT 1 FROM scored o WHERE o.query_id = m.query_id AND o.ts > m.ts AND round(list_cosine_similarity(m.emb, o.emb), 9) >= 0.3)"
WALK = "walk(a, b, hops) AS (SELECT n, n, 0 FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges) UNION ALL SELECT w.a, e.dst, w.hops + 1 FROM walk w JOIN edges e ON w.b = e.src WHERE w.hops < 64)"
LEVEL = "walk(node_id, level) AS (SELECT n, 0 FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges) WHERE n NOT IN (SELECT dst FROM edges) UNION ALL SELECT e.dst, w.level + 1 FROM walk w JOIN edges e ON w.node_id = e.src)"
BASE = "CASE type WHEN 'derives_from' THEN 0.9 WHEN 'depends_on' THEN 0.8 WHEN 'references' THEN 0.5 ELSE 0.3 END"
NORM = "CASE WHEN a_{a} = 1 THEN coalesce(({c} - min({c}) OVER w) / nullif(max({c}) OVER w - min({c}) OVER w, 0), 0) ELSE {c} END"
norm = {d: NORM.format(a=a, c=f"{d}_score") for d, a in (("time", "time"), ("semantic", "sem"), ("frequency", "freq"), ("task", "task"))}
ROWS = "SELECT CASE WHEN query_id % 100 = 0 THEN 'a' ELSE 'b' END AS \"group\", 's' || (cur_node % 3) AS scene, met.* FROM met JOIN q USING (query_id)"
PAIRED = "SELECT a.m - b.m AS diff FROM (SELECT user_id, round(avg(value), 6) AS m FROM events WHERE event_type = 'view' GROUP BY 1) a JOIN (SELECT user_id, round(avg(value), 6) AS m FROM events WHERE event_type = 'click' GROUP BY 1) b USING (user_id)"
OWN = "SELECT q.query_id, min(rank) AS rank FROM q LEFT JOIN cand c ON c.query_id = q.query_id AND c.owner_node = c.cur_node GROUP BY 1"
TAU = "SELECT coalesce(max(gap), 3600) AS tau FROM (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS pos, count(*) OVER () AS n FROM (SELECT created_at - lag(created_at) OVER (ORDER BY created_at, node_id) AS gap FROM nodes) WHERE gap > 0) WHERE pos = n // 2"
OUTS = "SELECT src, list(DISTINCT dst) AS o FROM edges GROUP BY src"
FACT = """SELECT e.*, CASE WHEN similarity = 0 THEN 0.5 ELSE (similarity + 1) / 2 END AS f_topic, exp(-abs(s.created_at - d.created_at) / tau) AS f_temporal,
    coalesce(len(list_intersect(coalesce(so.o, []), coalesce(dd.o, []))) / nullif(len(list_distinct(list_concat(coalesce(so.o, []), coalesce(dd.o, [])))), 0), 0) AS f_struct, 1 - exp(-0.3 * interactions) AS f_interact
    FROM edges e JOIN nodes s ON s.node_id = e.src JOIN nodes d ON d.node_id = e.dst LEFT JOIN outs so ON so.src = e.src LEFT JOIN outs dd ON dd.src = e.dst, tau"""
LEXQ = "(SELECT item_id AS query_id, text AS q_text FROM benchmark)"
WEIGHTED = "0.25 * exp(-0.01 * greatest(0, ({now} - ts) / 3600)) + 0.28 * cos + 0.15 * (1 - exp(-0.1 * access_count)) + 0.25 * CASE WHEN q_task IS NULL OR task_tag IS NULL THEN 0.5 WHEN q_task = task_tag THEN 1.0 ELSE 0.3 END"
VPOOL = f"SELECT sim.*, round({WEIGHTED.format(now='now')}, 9) AS final FROM sim JOIN near ON near.query_id = sim.query_id AND near.node_id = sim.owner_node"
VRANK = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, node_id) AS source_rank, count(*) OVER (PARTITION BY query_id) AS n, 0.7 * strength + (1 - 0.7) * rel AS sc FROM rels"
VSOFT = "SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS weight FROM (SELECT *, exp(sc / 0.5 - max(sc / 0.5) OVER (PARTITION BY query_id)) AS e FROM vrank WHERE source_rank <= 3)"


def _moved(rows: str, units: str, order: str) -> str:
    """rows(query_id, node_id, source_rank, q, gap) with the first |gap| units of each query dealt."""
    return f"""(WITH g AS ({rows}), u AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS r, gap FROM (SELECT *, unnest({units}) AS t FROM g)),
        m AS (SELECT query_id, node_id, count(*) AS moved FROM u WHERE r <= abs(gap) GROUP BY 1, 2)
        SELECT g.*, q + sign(gap) * coalesce(moved, 0) AS quota FROM g LEFT JOIN m USING (query_id, node_id))"""


def by_rounds(sources: str, k: int, weight: str = "weight") -> str:
    """Rounded shares; what is over or short goes round by round, the largest first, none below 1."""
    rows = f"SELECT *, (greatest({k}, c) - sum(q) OVER (PARTITION BY query_id))::BIGINT AS gap FROM (SELECT *, greatest(1, round_even(greatest({k}, c) * {weight}, 0))::BIGINT AS q FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS c FROM {sources}))"
    return _moved(rows, "CASE WHEN gap < 0 THEN range(q - 1) ELSE range(gap) END", "t, q DESC, source_rank")


def by_level(sources: str, k: int, weight: str) -> str:
    """Rounded shares scaled back to k; one by one the largest gives or the smallest takes."""
    rows = f"SELECT *, ({k} - sum(q) OVER (PARTITION BY query_id))::BIGINT AS gap FROM (SELECT *, greatest(1, round_even({k} * raw / sum(raw) OVER (PARTITION BY query_id), 0))::BIGINT AS q FROM (SELECT *, greatest(1, round_even({k} * {weight}, 0)) AS raw FROM {sources}))"
    return _moved(rows, "CASE WHEN gap < 0 THEN range(1, q + 1) ELSE range(gap) END", "CASE WHEN gap < 0 THEN -t ELSE q + t END, source_rank")


def _variant(sources: str, order: str, limit: str = "quota") -> str:
    return f"SELECT query_id, memory_id, owner_node, final, seq FROM (SELECT p.*, s.*, row_number() OVER (PARTITION BY p.query_id, p.owner_node ORDER BY {order}) AS w FROM vpool p JOIN {sources} s ON s.query_id = p.query_id AND s.node_id = p.owner_node) WHERE w <= {limit}"


BEST = "final DESC, seq"
VARIANTS = {
    "g1": _variant("vrank", "seq", "greatest(10 // n, 1)"),
    "g2": _variant("(SELECT * FROM vrank WHERE source_rank = 1)", BEST, "10"),
    "g3": _variant(by_level("(SELECT * FROM vrank WHERE source_rank <= 3)", 10, "1.0"), BEST),
    "g4": _variant(by_level("vsoft", 10, "weight"), BEST),
    "g4s": "SELECT query_id, memory_id, owner_node, f AS final, seq FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, seq) AS w FROM (SELECT p.*, round(p.final + 0.2 * round_even(sc, 4), 9) AS f FROM vpool p JOIN vrank s ON s.query_id = p.query_id AND s.node_id = p.owner_node WHERE source_rank <= 3)) WHERE w <= 10",
}
VARIANTS["g4c"] = VARIANTS["g4"]  # quotas add up to 10, so capping the common ranking picks the same
VPARTS = {"vpool": VPOOL, "vrank": VRANK, "vsoft": VSOFT}

GROUPS = " UNION ALL ".join(
    [f"SELECT 'graph_{g}' AS g, * FROM ({VARIANTS[g]})" for g in ("g1", "g2", "g3", "g4")]
    + ["SELECT 'graph_g0', query_id, memory_id, owner_node, final, seq FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS w FROM vpool) WHERE w <= 10"]
)
EPISODES = f"""SELECT e.*, 0 AS dedup_rate, epv.value AS latency_ms FROM (WITH kk AS (SELECT *, row_number() OVER (PARTITION BY g, query_id ORDER BY final DESC, seq) AS pr FROM ({GROUPS})),
    ss AS (SELECT 'graph_g0' AS g, query_id, node_id, 0.0 AS src_score FROM vrank UNION ALL SELECT 'graph_g1', query_id, node_id, sc FROM vrank
        UNION ALL SELECT 'graph_g2', query_id, node_id, sc FROM vrank WHERE source_rank = 1 UNION ALL SELECT 'graph_g3', query_id, node_id, sc FROM vrank WHERE source_rank <= 3
        UNION ALL SELECT 'graph_g4', query_id, node_id, sc FROM vrank WHERE source_rank <= 3),
    rel5 AS (SELECT query_id, memory_id, owner_node FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, seq) AS w FROM vpool) WHERE w <= 5),
    n1 AS (SELECT query_id, count(*) AS n_relevant, count(DISTINCT owner_node) AS n_relevant_sources FROM rel5 GROUP BY 1),
    n2 AS (SELECT g, query_id, count(*) AS n_sources FROM ss GROUP BY 1, 2),
    n3 AS (SELECT kk.g, kk.query_id, count(*) AS kept, count(rel5.memory_id) AS hit, min(pr) FILTER (rel5.memory_id IS NOT NULL) AS first_rank, coalesce(sum(1 / log2(pr + 1)) FILTER (rel5.memory_id IS NOT NULL AND pr <= 10), 0) AS dcg
        FROM kk LEFT JOIN rel5 USING (query_id, memory_id) GROUP BY 1, 2),
    n4 AS (SELECT ss.g, ss.query_id, count(*) AS candidate_count, count(rel5.memory_id) AS cand_hit FROM ss JOIN vpool p ON p.query_id = ss.query_id AND p.owner_node = ss.node_id LEFT JOIN rel5 ON rel5.query_id = p.query_id AND rel5.memory_id = p.memory_id GROUP BY 1, 2),
    n5 AS (SELECT n2.g, n2.query_id, avg(CASE WHEN o.owner_node IS NULL THEN 0.0 ELSE 1.0 END) AS source_hit_rate FROM n2 JOIN (SELECT DISTINCT query_id, owner_node FROM rel5) r ON r.query_id = n2.query_id
        LEFT JOIN (SELECT DISTINCT g, query_id, owner_node FROM kk) o ON o.g = n2.g AND o.query_id = n2.query_id AND o.owner_node = r.owner_node GROUP BY 1, 2),
    n6 AS (SELECT g, query_id, 1 - max(c) / sum(c) AS multi_source_ratio FROM (SELECT g, query_id, owner_node, count(*) AS c FROM kk GROUP BY 1, 2, 3) GROUP BY 1, 2),
    n7 AS (SELECT kk.g, kk.query_id, avg(src_score) AS cross_source_relevance FROM kk JOIN ss ON ss.g = kk.g AND ss.query_id = kk.query_id AND ss.node_id = kk.owner_node GROUP BY 1, 2),
    n8 AS (SELECT g, query_id, sum(s)::BIGINT AS scope_size FROM ss JOIN (SELECT owner_node, count(*) AS s FROM mem GROUP BY 1) ON owner_node = node_id GROUP BY 1, 2),
    n9 AS (SELECT g, kk.query_id, coalesce(sum(floor(length(mem.text) / 1.5)), 0) AS injected_tokens FROM kk JOIN mem USING (memory_id) GROUP BY 1, 2),
    na AS (SELECT g, query_id, (g NOT IN ('graph_g0', 'graph_g1') AND coalesce(candidate_count, 0) > 5 AND coalesce(max((coalesce(candidate_count, 0) > 5)::INT) OVER (PARTITION BY g, k ORDER BY query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0)::INT AS llm_calls,
        (count(*) OVER (PARTITION BY g, q_text ORDER BY query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0)::INT AS embed_calls_miss
        FROM (SELECT n2.g, n2.query_id, candidate_count, q.q_text, trim(regexp_replace(lower(coalesce(q.q_text, '')), '\\s+', ' ', 'g')) AS k FROM n2 JOIN q USING (query_id) LEFT JOIN n4 USING (g, query_id)))
    SELECT g, query_id, n_relevant, n_relevant_sources, n_sources, kept, candidate_count, scope_size, coalesce(injected_tokens, 0) AS injected_tokens, llm_calls, embed_calls_miss, hit / n_relevant AS recall_kept, least(1.0, 10 / n_relevant) AS ceiling, hit / n_relevant / least(1.0, 10 / n_relevant) AS recall_norm,
        cand_hit / n_relevant AS cand_hit_rate, coalesce(1.0 / first_rank, 0) AS mrr, dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(n_relevant, kept)) AS ndcg_at_k, source_hit_rate, multi_source_ratio, cross_source_relevance
    FROM n2 JOIN n1 USING (query_id) LEFT JOIN n3 USING (g, query_id) LEFT JOIN n4 USING (g, query_id) LEFT JOIN n5 USING (g, query_id) LEFT JOIN n6 USING (g, query_id) LEFT JOIN n7 USING (g, query_id)
        LEFT JOIN n8 USING (g, query_id) LEFT JOIN n9 USING (g, query_id) LEFT JOIN na USING (g, query_id)) e JOIN events epv ON epv.event_id = e.query_id"""
MEAN_OF = (
    "recall_kept", "ceiling", "recall_norm", "cand_hit_rate", "mrr", "ndcg_at_k", "source_hit_rate", "multi_source_ratio", "cross_source_relevance", "dedup_rate", "candidate_count", "scope_size", "kept",
    "injected_tokens", "llm_calls", "embed_calls_miss", "latency_ms",
)
SUMMARY = (
    'SELECT g AS "group", count(*) AS n_episodes, count(*) FILTER (n_relevant_sources >= 2) AS n_multi_source_episodes, '
    + ", ".join(f"round(avg({m}), 4) AS avg_{m}" for m in MEAN_OF) + ", "
    + ", ".join(f"round(coalesce(avg({m}) FILTER (n_relevant_sources >= 2), 0), 4) AS avg_{m}_multi" for m in ("multi_source_ratio", "recall_kept", "source_hit_rate"))
    + ", round(quantile_cont(latency_ms, 0.5), 2) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.9), 2) AS p90_latency_ms, round(avg(n_relevant), 4) AS n_relevant_mean, round(avg(n_sources), 4) AS n_sources_mean FROM eps GROUP BY 1"
)


def _judge() -> str:
    get = lambda g, m: f"(SELECT {m} FROM summ WHERE \"group\" = 'graph_{g}')"
    diff = lambda a, b, m: f"{get(a, m)} - {get(b, m)}"
    rows = [
        ("structure_recall", diff("g4", "g2", "avg_recall_kept"), "v > 0"), ("structure_source_hit", diff("g4", "g2", "avg_source_hit_rate"), "v > 0"),
        ("attribution_recall_norm", diff("g4", "g1", "avg_recall_norm"), "round(v, 4) >= 0.05"), ("source_selection_hit", diff("g4", "g3", "avg_source_hit_rate"), "round(v, 4) >= 0.08"),
        ("scheduling_recall", diff("g1", "g0", "avg_recall_kept"), "round(v, 4) > 0"), ("speed_p90", get("g4", "p90_latency_ms"), "v < 1000"), ("multi_source", get("g4", "avg_multi_source_ratio_multi"), "v > 0.3"),
    ]
    return " UNION ALL ".join(f"SELECT '{n}' AS criterion, round(v, 4) AS value, {t} AS pass FROM (SELECT {x} AS v)" for n, x, t in rows)


def graph_sources(lam: float, topk: int) -> str:
    rank = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src_score DESC, node_id) AS source_rank FROM (SELECT *, round(l * strength + (1 - l) * rel, 9) AS src_score FROM "
    return f"(SELECT * FROM ({rank}(SELECT *, CASE WHEN coalesce(var_samp(rel) OVER (PARTITION BY query_id), 0) < 0.02 THEN 1.0 ELSE {lam} END AS l FROM rels))) WHERE source_rank <= {topk or 1000})"


def graph_schedule(lam: float = 0.7, topk: int = 3, mu: float = 0.2, cap: int = 50, noop: bool = False, now: str = "now") -> str:
    """Rows (query_id, memory_id, owner_node, node, final, pick_rank) kept by a schedule over sources that takes the best 8."""
    s = graph_sources(lam, topk)
    scope = f"SELECT sim.*, s.src_score FROM sim JOIN {s} s ON s.query_id = sim.query_id AND s.node_id = sim.owner_node UNION ALL SELECT sim.*, NULL FROM sim WHERE sim.query_id NOT IN (SELECT query_id FROM rels)"
    score = "0.25" if noop else WEIGHTED.format(now=now)
    rows = f"SELECT *, round({score} + {mu} * coalesce(src_score, 0), 9) AS final FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, seq) AS cr FROM ({scope})) WHERE cr <= {cap}"
    return f"SELECT query_id, memory_id, owner_node, final, pick_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, seq) AS pick_rank FROM ({rows})) WHERE pick_rank <= 8"


ABLATION = {
    "graph_g0": graph_schedule(1.0, 0, 0.0, 20, True), "graph_g1": graph_schedule(1.0, 0, 0.2, 20, True), "graph_g2": graph_schedule(0.7, 1, 0.0), "graph_g3": graph_schedule(), "graph_g4": graph_schedule(),
}
WARM = f"SELECT owner_node AS src, fq.cur_node AS dst, count(DISTINCT query_id) AS used FROM ({graph_schedule(now='(now - 3600)')}) JOIN fq USING (query_id) WHERE owner_node <> fq.cur_node GROUP BY 1, 2"
WORLD = f"WITH t AS (SELECT conv_id, turn, list_distinct({toks('text')}) AS k FROM conversations) SELECT a.conv_id, a.turn AS src, b.turn AS dst, len(list_intersect(a.k, b.k)) / nullif(len(list_distinct(list_concat(a.k, b.k))), 0) AS s FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn"


ORACLES = {
    "schedule_topk": with_(f"SELECT query_id, memory_id, pick_rank, round(final, 6) AS final FROM ({BAR.format(t=0.0)}) WHERE pick_rank <= 10 AND final >= bar"),
    "retrieve_full": with_("SELECT query_id, memory_id, rank FROM (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS rank FROM q JOIN mem ON memory_id <> query_id) WHERE rank <= 10"),
    "retrieve_reme": with_("SELECT query_id, memory_id, rank FROM (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS rank FROM q JOIN mem ON memory_id <> query_id) WHERE rank <= 10"),
    "retrieve_bm25": with_(f"SELECT query_id, memory_id, round(s, 6) AS bm25_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, seq) AS rank FROM (SELECT lq.query_id, dt.memory_id, dt.seq, coalesce(bm25_score, 0) AS s FROM {LEXQ} lq CROSS JOIN dt LEFT JOIN hit USING (query_id, memory_id))) WHERE rank <= 10", bm25("(SELECT doc_id AS memory_id, doc_id AS seq, text FROM documents)", LEXQ)),
    "retrieve_vector": with_("SELECT query_id, memory_id, round(cos, 6) AS cos, rank FROM vec WHERE rank <= 10"),
    "retrieve_rrf": with_("SELECT query_id, memory_id, bm25_rank, vector_rank, round(f, 6) AS rrf_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, seq) AS rank FROM (SELECT *, round(1 / (60 + bm25_rank) + 1 / (60 + vector_rank), 12) AS f FROM (SELECT v.query_id, v.memory_id, v.seq, v.rank AS vector_rank, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(bm25_score, 0) DESC, seq) AS bm25_rank FROM vec v LEFT JOIN hit USING (query_id, memory_id)))) WHERE rank <= 10", bm25("mem", "q")),
    "scoped_recall": with_("SELECT query_id, memory_id, owner_node, round(cos, 6) AS cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, seq) AS rank FROM (SELECT sim.query_id, sim.memory_id, sim.owner_node, sim.cos, sim.seq FROM sim JOIN srcs ON srcs.query_id = sim.query_id AND srcs.node_id = sim.owner_node UNION ALL SELECT sim.query_id, sim.memory_id, sim.owner_node, sim.cos, sim.seq FROM sim WHERE query_id NOT IN (SELECT query_id FROM srcs))) WHERE rank <= 10"),
    "isolation": with_("SELECT memory_id, user_id FROM mem WHERE user_id = 7"),
    "score_full": with_(f"SELECT query_id, memory_id, {R6}, round(final, 6) AS final FROM scored"),
    "score_noop": with_("SELECT query_id, memory_id, 0.25::DOUBLE AS time_score, 0.25::DOUBLE AS semantic_score, 0.25::DOUBLE AS frequency_score, 0.25::DOUBLE AS task_score, 0.25::DOUBLE AS final FROM cand"),
    "score_normalized": with_(f"SELECT query_id, memory_id, {R6}, round((eff_time * ({norm['time']}) + eff_semantic * ({norm['semantic']}) + eff_frequency * ({norm['frequency']}) + eff_task * ({norm['task']})) / (eff_time + eff_semantic + eff_frequency + eff_task), 6) AS final FROM gate_raw WINDOW w AS (PARTITION BY query_id)"),
    "score_adaptive_time": with_(f"SELECT query_id, memory_id, {R6}, round(lambda_eff, 6) AS lambda_eff, round(0.25 * time_score + 0.35 * semantic_score + 0.15 * frequency_score + 0.25 * task_score, 6) AS final FROM adapt"),
    "score_adaptive_gated": with_(f"SELECT query_id, memory_id, {R6}, round(eff_time, 6) AS eff_time, round(eff_semantic, 6) AS eff_semantic, round(eff_frequency, 6) AS eff_frequency, round(eff_task, 6) AS eff_task, round((eff_time * time_score + eff_semantic * semantic_score + eff_frequency * frequency_score + eff_task * task_score) / (eff_time + eff_semantic + eff_frequency + eff_task), 6) AS final FROM gate_adapt"),
    "dim_mask": with_(f"SELECT query_id, memory_id, {R6}, round((0.35 * semantic_score + 0.25 * task_score) / 0.6, 6) AS final FROM raw"),
    "source_bonus": with_("SELECT s.query_id, s.memory_id, round(0.2 * coalesce(src_score, 0), 6) AS source_bonus, round(final + 0.2 * coalesce(src_score, 0), 6) AS final FROM scored s LEFT JOIN srcs ON srcs.query_id = s.query_id AND srcs.node_id = s.owner_node"),
    "select_threshold": with_(f"SELECT query_id, memory_id, round(final, 6) AS final, round(bar, 6) AS bar, pick_rank <= 10 AND final >= bar AS kept FROM ({BAR.format(t=0.4)})"),
    "select_topk": picks("final DESC, seq", 5),
    "select_recency": picks("ts DESC, seq", 5),
    "select_cascade": with_("SELECT query_id, memory_id, pick_rank, round(final, 6) AS final FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY task_score < 0.5 OR (query_id, memory_id) IN (SELECT (query_id, memory_id) FROM old), final DESC, seq) AS pick_rank FROM scored) WHERE pick_rank <= 5", {"old": OLD}),
    "version_supersede_antijoin": with_(OLD),
    "select_quota": with_("SELECT query_id, memory_id, pick_rank, round(final, 6) AS final FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over_quota, final DESC, seq) AS pick_rank FROM (SELECT *, owner_node % 3 > 0 AND row_number() OVER (PARTITION BY query_id, owner_node ORDER BY final DESC, seq) > owner_node % 3 AS over_quota FROM scored)) WHERE pick_rank <= 5"),
    "hard_quota_filter": with_("SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY owner_node, w) AS pick_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, owner_node ORDER BY final DESC, seq) AS w FROM scored) WHERE w <= owner_node % 3"),
    "compression_ratio": with_(f"SELECT query_id, count(*) AS n_candidates, count(*) FILTER (pick_rank <= 10 AND final >= bar) AS n_kept, round(count(*) FILTER (pick_rank <= 10 AND final >= bar) / count(*), 6) AS compression_ratio FROM ({BAR.format(t=0.4)}) GROUP BY 1"),
    "shared_pool_topn": with_("SELECT memory_id, round(final, 6) AS score, pool_rank FROM (SELECT *, row_number() OVER (ORDER BY final DESC, s) AS pool_rank FROM (SELECT memory_id, final, query_id * 1000 + pick_rank AS s, row_number() OVER (PARTITION BY memory_id ORDER BY final DESC, query_id * 1000 + pick_rank) AS d FROM kept) WHERE d = 1) WHERE pool_rank <= 10"),
    "edge_candidates": with_("SELECT src, dst, round(similarity, 6) AS similarity, type, strength::DOUBLE AS strength FROM edges"),
    "edge_types": with_("SELECT type, count(*) AS n FROM edges GROUP BY 1"),
    "graph_reachability": with_("SELECT DISTINCT a AS src, b AS dst FROM walk", recursive=WALK),
    "graph_levels": with_("SELECT node_id, max(level)::BIGINT AS level FROM walk GROUP BY 1", recursive=LEVEL),
    "graph_layout": with_("SELECT node_id, level * 196.0::DOUBLE AS x, (row_number() OVER (PARTITION BY level ORDER BY node_id) - (count(*) OVER (PARTITION BY level) + 1) / 2.0) * 96.0::DOUBLE AS y FROM (SELECT node_id, max(level) AS level FROM walk GROUP BY 1)", recursive=LEVEL),
    "graph_is_dag": with_("SELECT count(*) = 0 AS is_dag FROM edges JOIN walk ON src = b AND dst = a", recursive=WALK),
    "graph_degrees": with_("SELECT node_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node_id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1"),
    "graph_predecessors": with_("SELECT dst AS node_id, src AS other_id, max(strength)::DOUBLE AS strength FROM edges GROUP BY 1, 2"),
    "graph_neighbors_k": with_("SELECT node_id, other_id, max(strength)::DOUBLE AS strength, min(hops)::BIGINT AS hops FROM (SELECT src AS node_id, dst AS other_id, strength, 1 AS hops FROM edges UNION ALL SELECT a.src, b.dst, b.strength, 2 FROM edges a JOIN edges b ON a.dst = b.src) WHERE node_id <> other_id GROUP BY 1, 2"),
    "edge_filter": with_("SELECT src, dst, type FROM edges WHERE strength >= 0.5 AND type IN ('references', 'depends_on')"),
    "version_fold": with_("SELECT node_id, primary_id FROM fold"),
    "strength_feedback": with_(f"SELECT src, dst, round(greatest(0, least(1, strength + 0.1 + 0.15 * ({BASE} - strength - 0.1))), 6)::DOUBLE AS strength FROM edges"),
    "strength_summary": with_(f"SELECT src, dst, round(greatest(0, least(1, {BASE} * (0.6 + 0.4 * greatest(0, similarity)))), 6)::DOUBLE AS strength FROM edges"),
    "strength_multifactor": with_(f"SELECT src, dst, round(f_topic, 6) AS f_topic, round(f_temporal, 6) AS f_temporal, round(f_struct, 6) AS f_struct, round(f_interact, 6) AS f_interact, round(greatest(0, least(1, 0.5 * {BASE} + 0.5 * (0.6 * f_topic + 0.3 * f_temporal + 0.3 * f_struct + 0.8 * f_interact) / 2.0)), 6) AS strength FROM fact", {"tau": TAU, "outs": OUTS, "fact": FACT}),
    "graph_stats": with_("SELECT n_nodes, count(*) AS n_edges, round(avg(strength), 6)::DOUBLE AS avg_strength, round(coalesce(var_samp(strength), 0), 6) AS var_strength, round(count(*) / n_nodes, 6) AS avg_out_degree FROM edges, (SELECT count(*) AS n_nodes FROM nodes) GROUP BY n_nodes"),
    "coarse_links": with_("SELECT src, dst, round(similarity, 6) AS similarity, CASE WHEN similarity >= 0.85 THEN 'derives_from' WHEN similarity >= 0.72 THEN 'depends_on' WHEN similarity >= 0.58 THEN 'references' ELSE 'similar_to' END AS type FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY similarity DESC, src) AS r FROM (SELECT a.node_id AS src, b.node_id AS dst, round(list_cosine_similarity(a.emb, b.emb), 9) AS similarity FROM nodes a JOIN nodes b ON a.node_id <> b.node_id AND a.root_id <> b.root_id)) WHERE r <= 4"),
    "refine_diff": with_("SELECT src, dst, CASE WHEN interactions < 5 THEN 'removed' ELSE 'added' END AS change FROM edges WHERE (interactions < 5) <> (interactions > 1)"),
    "summary_due": with_("SELECT node_id, CASE WHEN version > 0 THEN n_memories >= 20 ELSE n_memories >= 3 END AS due FROM nodes"),
    "session_jaccard_edges": f"SELECT conv_id, src, dst, round(s, 6) AS jaccard FROM ({WORLD}) WHERE round(s, 6) >= 0.05",
    "stage_a_scores": with_("SELECT query_id, node_id, strength::DOUBLE AS strength, round(rel, 6) AS rel, lambda_eff::DOUBLE AS lambda_eff, round(src_score, 6) AS src_score FROM sa"),
    "stage_a_softmax": with_("SELECT query_id, node_id, source_rank, round(weight, 6) AS weight FROM srcs"),
    "semantic_expansion": with_("SELECT query_id, node_id, round(r, 6) AS rel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, node_id) AS p FROM (SELECT fq.query_id, n.node_id, round(list_cosine_similarity(q_emb, emb), 9) AS r FROM fq JOIN nodes n ON n.node_id <> cur_node WHERE (fq.query_id, n.node_id) NOT IN (SELECT (query_id, node_id) FROM near))) WHERE p <= 2"),
    "manual_sources": with_("SELECT fq.query_id, w.node_id::BIGINT AS node_id, w.position, coalesce(strength, 0)::DOUBLE AS strength FROM fq CROSS JOIN (VALUES (1, 0), (3, 1)) w(node_id, position) SEMI JOIN nodes n ON n.node_id = w.node_id LEFT JOIN near ON near.query_id = fq.query_id AND near.node_id = w.node_id"),
    "ranking_metrics": with_("SELECT query_id, n_relevant, n_kept, n_hit, coalesce(first_rank, 0) AS first_rank, round(recall, 6) AS recall, round(ceiling, 6) AS ceiling, round(recall_norm, 6) AS recall_norm, round(precision, 6) AS precision, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM met"),
    "source_hit": with_("SELECT q.query_id, round(avg(CASE WHEN (q.query_id, o) IN (SELECT (query_id, owner_node) FROM kept) THEN 1.0 ELSE 0 END), 6) AS source_hit FROM q, unnest([cur_node, (cur_node + 5) % 10]) t(o) GROUP BY 1"),
    "multi_source_ratio": with_("SELECT query_id, round(1 - max(n) / sum(n), 6) AS multi_source_ratio FROM (SELECT query_id, owner_node, count(*) AS n FROM kept GROUP BY 1, 2) GROUP BY 1"),
    "cross_source_relevance": with_("SELECT k.query_id, round(avg(src_score), 6) AS cross_source_relevance FROM kept k JOIN srcs ON srcs.query_id = k.query_id AND srcs.node_id = k.owner_node GROUP BY 1"),
    "group_aggregate": with_(f'SELECT "group", count(*) AS n, round(avg(recall), 6) AS avg_recall, round(avg(mrr), 6) AS avg_mrr, round(avg(ndcg), 6) AS avg_ndcg FROM ({ROWS}) GROUP BY 1'),
    "scene_aggregate": with_(f'SELECT "group", scene, count(*) AS n, round(avg(recall), 6) AS avg_recall, round(avg(mrr), 6) AS avg_mrr FROM ({ROWS}) GROUP BY GROUPING SETS (("group"), ("group", scene))'),
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.9), 2) AS p90, round(max(value), 2) AS max, count(*) AS n FROM events GROUP BY 1",
    "paired_difference": f"SELECT count(*) AS n, round(avg(diff), 6) AS delta, round(stddev_samp(diff), 6) AS sd, round(avg(diff) / stddev_samp(diff), 6) AS cohens_d FROM ({PAIRED})",
    "reach_curve": with_("SELECT k::BIGINT AS k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END), 6) AS coverage FROM own, (VALUES (1), (3), (5), (10)) t(k) GROUP BY k", {"own": OWN}),
    "rank_histogram": with_("SELECT CASE WHEN rank <= 1 THEN '1' WHEN rank <= 3 THEN '2-3' WHEN rank <= 5 THEN '4-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 20 THEN '11-20' WHEN rank <= 50 THEN '21-50' ELSE '>50' END AS bucket, count(*) AS n, round(avg(cos), 6) AS avg_cos FROM (SELECT query_id, min(rank) AS rank, max(cos) AS cos FROM vec WHERE owner_node = cur_node GROUP BY 1) GROUP BY 1"),
    "token_savings": f"SELECT source, sum(t)::BIGINT AS trace_tokens, sum(c)::BIGINT AS cost_tokens, round(1 - sum(t) / sum(c), 6) AS saved FROM (SELECT source, len(regexp_extract_all(text, '{CJK}')) + len(regexp_extract_all(text, '[A-Za-z0-9]+')) + greatest(0, length(text) - length(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g'))) // 4 AS t, floor(length(text) / 1.5) AS c FROM documents) GROUP BY 1",
    "dim_diagnostics": with_(" UNION ALL ".join(f"SELECT '{c}' AS dim, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, count(DISTINCT round({c}, 6)) AS n_unique FROM scored" for c in ("time_score", "semantic_score", "frequency_score", "task_score"))),
    "judge": with_(_judge(), VPARTS | {"eps": EPISODES, "summ": SUMMARY}),
    "log_summary": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "access_counts": "SELECT user_id, count(*) AS access_count FROM events WHERE event_type IN ('view', 'click') GROUP BY 1",
    "interactions": with_("SELECT src, dst, count(*) AS n FROM (SELECT DISTINCT query_id, owner_node AS src, cur_node AS dst FROM kept WHERE owner_node <> cur_node) GROUP BY 1, 2"),
    "latency_window": "SELECT event_id, count(*) OVER w AS win_n, round(quantile_cont(value, 0.5) OVER w, 4) AS p50, round(quantile_cont(value, 0.9) OVER w, 4) AS p90 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "prior_gate": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'tier_off' WHEN event_id % 5 = 0 THEN 'cache_hit' WHEN event_id % 2 >= 1 THEN 'budget' WHEN event_id % 11 <= 5 THEN 'few_cand' WHEN event_id % 7 = 0 AND event_id % 3 = 1 THEN 'low_src_var' ELSE 'call' END AS reason FROM events",
    "prior_key": r"SELECT item_id, sha1(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) || '||u|s|b') AS key FROM benchmark",
    "api_error_class": "SELECT event_id, CASE WHEN s LIKE '%402%' THEN 'balance' WHEN s LIKE '%401%' THEN 'auth' WHEN s LIKE '%403%' THEN 'forbidden' WHEN s LIKE '%429%' OR s LIKE '%rate%' OR s LIKE '%limit%' THEN 'rate_limit' WHEN s LIKE '%timed out%' THEN 'network' ELSE 'other' END AS class FROM (SELECT event_id, (395 + event_id % 40) || ' ' || event_type || CASE WHEN event_id % 9 = 0 THEN ' timed out' ELSE '' END AS s FROM events)",
    "chat_rounds": "SELECT conv_id, turn, 'R' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round_id, CASE WHEN length(text) > 8 THEN substr(text, 1, 8) || '…' ELSE text END AS title FROM conversations",
    "reward_map": "SELECT doc_id, CASE WHEN quality = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS explicit, 0.0::DOUBLE AS none FROM labels",
    "hybrid_weights": with_("SELECT memory_id, round((0.6 * CASE WHEN task_tag = 'en' THEN 0.0 ELSE 0.25 END + 0.4 * 0.25) / t, 6)::DOUBLE AS time, round((0.6 * CASE WHEN task_tag = 'en' THEN 0.7 ELSE 0.35 END) / t, 6)::DOUBLE AS semantic, round((0.6 * CASE WHEN task_tag = 'en' THEN 0.0 ELSE 0.15 END) / t, 6)::DOUBLE AS frequency, round((0.6 * CASE WHEN task_tag = 'en' THEN 0.3 ELSE 0.25 END + 0.4 * 0.25) / t, 6)::DOUBLE AS task FROM mem, (SELECT 0.8 AS t)"),
    "prior_parse": "SELECT doc_id, round((quality + 1) / t, 6) AS time, round(2 / t, 6) AS semantic, round(1 / t, 6) AS frequency, round(toxic / t, 6) AS task FROM (SELECT *, quality + 1 + 3 + toxic AS t FROM labels)",
    "variant_g1": with_(f"SELECT query_id, memory_id, round(final, 6) AS final FROM ({VARIANTS['g1']})", VPARTS),
    "variant_g2": with_(f"SELECT query_id, memory_id, round(final, 6) AS final FROM ({VARIANTS['g2']})", VPARTS),
    "variant_g4s": with_(f"SELECT query_id, memory_id, round(final, 6) AS final FROM ({VARIANTS['g4s']})", VPARTS),
    "generate_graph": """WITH n AS (SELECT i FROM range(22) t(i)), m AS (SELECT i % 22 AS i, CASE WHEN i < 440 THEN 'core' WHEN i < 452 THEN 'stale' WHEN i < 458 THEN 'cross_task' WHEN i < 476 THEN 'version' WHEN i < 488 THEN 'param' ELSE 'distractor' END AS kind FROM range(490) t(i)),
        l AS (SELECT s, s + 1 AS d FROM range(21) t(s) UNION ALL SELECT s, s + 2 FROM range(20) t(s) UNION ALL SELECT s, s + 3 FROM range(5) t(s)), e AS (SELECT i % 21 + 1 AS i FROM range(50) t(i))
        SELECT 'n' || i AS node_id, (SELECT count(*) FROM m WHERE m.i = n.i AND kind = 'core') AS core, (SELECT count(*) FROM m WHERE m.i = n.i AND kind = 'stale') AS stale, (SELECT count(*) FROM m WHERE m.i = n.i AND kind = 'cross_task') AS cross_task, (SELECT count(*) FROM m WHERE m.i = n.i AND kind = 'version') AS version, (SELECT count(*) FROM m WHERE m.i = n.i AND kind = 'param') AS param, (SELECT count(*) FROM m WHERE m.i = n.i AND kind = 'distractor') AS distractor,
        (SELECT count(*) FROM l WHERE s = n.i) AS out_degree, (SELECT count(*) FROM l WHERE d = n.i) AS in_degree, (SELECT count(*) FROM e WHERE e.i = n.i) AS episodes FROM n""",
    "conversation_world": f"SELECT conv_id, src, dst, round(s, 6) AS similarity, CASE WHEN s >= 0.85 THEN 'derives_from' WHEN s >= 0.72 THEN 'depends_on' WHEN s >= 0.58 THEN 'references' ELSE 'similar_to' END AS type FROM ({WORLD}) WHERE s > 0",
    "pipeline_trace": with_("SELECT * FROM (SELECT query_id, count(*) AS n_candidates, round(max(final), 6) AS best, round(avg(semantic_score), 6) AS avg_semantic FROM scored GROUP BY 1) JOIN (SELECT query_id, string_agg(memory_id::VARCHAR, ',' ORDER BY pick_rank) AS kept FROM kept GROUP BY 1) USING (query_id)"),
    "status_report": with_("SELECT node_id, n_memories, n_users, n_access, coalesce(o, 0)::BIGINT AS out_degree, coalesce(i, 0)::BIGINT AS in_degree FROM (SELECT owner_node AS node_id, count(*) AS n_memories, count(DISTINCT user_id) AS n_users, sum(access_count)::BIGINT AS n_access FROM mem GROUP BY 1) LEFT JOIN (SELECT src AS node_id, count(*) AS o FROM edges GROUP BY 1) USING (node_id) LEFT JOIN (SELECT dst AS node_id, count(*) AS i FROM edges GROUP BY 1) USING (node_id)"),
    "variant_g3": with_(f"SELECT query_id, memory_id, round(final, 6) AS final FROM ({VARIANTS['g3']})", VPARTS),
    "variant_g4": with_(f"SELECT query_id, memory_id, round(final, 6) AS final FROM ({VARIANTS['g4']})", VPARTS),
    "variant_g4c": with_(f"SELECT query_id, memory_id, round(final, 6) AS final FROM ({VARIANTS['g4c']})", VPARTS),
    "group_summary": with_(SUMMARY, VPARTS | {"eps": EPISODES}),
    "stage_a_gate": with_(f"SELECT query_id, node_id, l::DOUBLE AS lambda_eff, round(src_score, 6) AS src_score FROM {graph_sources(0.7, 0)}"),
    "hard_quota_repair": with_(f"SELECT query_id, node_id, source_rank, quota::BIGINT AS quota FROM {by_rounds('srcs', 10)}"),
    "schedule_graph_g4": with_(f"SELECT query_id, memory_id, pick_rank, round(final, 6) AS final FROM ({ABLATION['graph_g4']})"),
    "ablation_groups": with_(" UNION ALL ".join(f"SELECT '{g}' AS \"group\", count(*) AS n_kept, count(DISTINCT query_id) AS n_queries, round(avg(final), 6)::DOUBLE AS avg_final FROM ({x})" for g, x in ABLATION.items())),
    "cycle_downgrade": with_("SELECT 0 AS graph_id, src, dst, type, strength::DOUBLE AS strength, 'active' AS status, 0::BIGINT AS updates, dst * 100 + src AS seq FROM edges UNION ALL SELECT 0, dst, src, 'references', 0, 'cycle_rejected', 0, dst * 100 + src + 50 FROM edges"),
}
