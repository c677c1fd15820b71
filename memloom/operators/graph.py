"""Topic graph operators over nodes and directed edges (dependency -> dependent).

The graph holds topics, not memories: one row for each topic or link. Reachability, whose result is all connected
pairs, doubles its reach in each round. Orders, layers and the test for cycles hold one row for each link: every
topic follows one link upwards, the lengths of these paths come from doubling jumps, and topics change to a
better link until none is left. Insertion in order is a fold only where links may close cycles.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import base_strength, hash_embedding, infer_edge_type
from ..functions.vectors import clamp01
from ..schema import EDGE_STRENGTH
from ..tables import BROADCAST_BYTES, checked_broadcast, discard, is_small, join_hot, materialize, scratch
from .retrieval import nearest

MAX_HOPS = 64
FEEDBACK_STEP, REGULARISE = 0.1, 0.15
BIAS_ALPHA, DEFAULT_TAU = 0.5, 3600.0
#: A graph of so many different links and types of arrivals at most is folded whole.
SMALL_GRAPH = 1000


def active(edges: DataFrame) -> DataFrame:
    return edges.filter("status = 'active'") if "status" in edges.columns else edges


def filter_edges(edges: DataFrame, strength_min: float = 0.0, types=None) -> DataFrame:
    out = edges.filter(F.col("strength") >= strength_min)
    return out.filter(F.col("type").isin(list(types))) if types else out


def edges_of(edges: DataFrame, node, direction: str = "both") -> DataFrame:
    """Edges that leave (out), reach (in) or touch (both) a node."""
    hit = {"out": F.col("src") == node, "in": F.col("dst") == node, "both": (F.col("src") == node) | (F.col("dst") == node)}
    return edges.filter(hit[direction])


def degrees(edges: DataFrame) -> DataFrame:
    e = active(edges)
    ends = e.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def _closure(links: DataFrame) -> DataFrame:
    """(src, dst, hops): a row for each pair that a path of links(src, dst) connects, with the hops of the shortest
    one. A round joins the pairs with themselves; it ends when no pair is new and no path shorter."""
    with scratch() as keep:
        now = materialize(links.select("src", "dst").distinct().withColumn("hops", F.lit(1).cast("long")))
        state = None
        while True:
            got = now.agg(F.count(F.lit(1)), F.sum("hops")).first()
            if got == state or not got[0]:
                return keep(now)
            state = got
            onward = now.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("hops").alias("h"))
            joined = now.join(onward, "dst").select("src", F.col("end").alias("dst"), (F.col("hops") + F.col("h")).alias("hops"))
            now = materialize(now.unionByName(joined).groupBy("src", "dst").agg(F.min("hops").alias("hops")))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()


def reachability(edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(src, dst, hops): nodes reachable over active edges in max_hops at most, with the fewest hops; each node
    reaches itself."""
    e = active(edges)
    own = _ends(e).select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0).cast("long").alias("hops"))
    return own.unionByName(_closure(e).filter((F.col("hops") <= max_hops) & (F.col("src") != F.col("dst"))))


def _hinted(df: DataFrame, few: bool = False) -> DataFrame:
    """df, to be broadcast if it is known to have few rows, else never: files of a few MB may be many times that in memory."""
    return F.broadcast(df) if few else df.hint("merge")


def _followed(nodes: DataFrame, up: DataFrame, few: bool) -> DataFrame:
    """(node_id, level): how many links of up(node_id, up), one for each node at most, lead to a node without one;
    null if they lead to a cycle. Jumps double in each round."""
    now = materialize(nodes.join(_hinted(up, few), "node_id", "left").select("node_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("level")))
    rounds = nodes.count().bit_length() + 1
    for _ in range(rounds):
        going = now.filter("up IS NOT NULL")
        if not going.limit(1).count():
            break
        onward = now.select(F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("level").alias("_level"))
        joined = going.join(F.broadcast(onward), "up") if few else join_hot(going, _hinted(onward), "up")
        after = materialize(now.filter("up IS NULL").unionByName(joined.select("node_id", F.col("_up").alias("up"), (F.col("level") + F.col("_level")).alias("level"))))
        discard(now)
        now = after
    return now.select("node_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def depths(edges: DataFrame) -> DataFrame:
    """(node_id, level) of all ends of edges(src, dst): the longest path that leads there, null for nodes on a cycle or
    behind one.

    Every node follows one link; a node changes to a link whose start lies deeper, until none does. Then no path is
    longer than the one followed, and a cycle cannot have been missed, as each of its nodes would lie deeper than
    the next. Nodes follow the start with most links into it first, a guess at the deepest. A round takes a row for
    each link and, log2(nodes) times, a row for each node.
    """
    e = materialize(edges.select("src", "dst").distinct())
    nodes = materialize(_ends(e))
    few = is_small(nodes, size=BROADCAST_BYTES // 4)

    def deepest(level: DataFrame) -> DataFrame:
        at = level.select(F.col("node_id").alias("src"), F.struct(F.col("level").isNull().alias("endless"), "level", F.col("node_id").alias("up")).alias("best"))
        met = e.join(F.broadcast(at), "src") if few else join_hot(e, _hinted(at), "src")
        return met.groupBy(F.col("dst").alias("node_id")).agg(F.max("best").alias("best"))

    guess = nodes.join(_hinted(e.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("level")), few), "node_id", "left").fillna(0, ["level"])
    up = materialize(deepest(guess).select("node_id", "best.up"))
    while True:
        level = materialize(_followed(nodes, up, few))
        better = deepest(level).join(_hinted(level, few), "node_id").filter("level IS NOT NULL AND (best.endless OR best.level + 1 > level)")
        better = materialize(better.select("node_id", F.col("best.up").alias("_up")))
        if not better.limit(1).count():
            return level
        changed = up.join(_hinted(better, few), "node_id", "left").select("node_id", F.coalesce("_up", "up").alias("up"))
        discard(level)
        up = materialize(changed)


def levels(edges: DataFrame) -> DataFrame:
    """(node_id, level): the longest path from a root, a topological order; nodes on a cycle or behind one have
    no row."""
    return depths(active(edges)).filter("level IS NOT NULL")


def layout(edges: DataFrame, x_step: float = 196.0, y_step: float = 96.0) -> DataFrame:
    """levels plus x by level and y centred within the level."""
    lv = levels(edges)
    w = Window.partitionBy("level")
    pos = F.row_number().over(w.orderBy("node_id"))
    return lv.withColumn("x", F.col("level") * x_step).withColumn("y", (pos - (F.count(F.lit(1)).over(w) + 1) / 2.0) * y_step)


def is_acyclic(edges: DataFrame) -> DataFrame:
    """One row (is_dag): whether no path of active edges returns to its start."""
    return depths(active(edges)).agg((F.count_if(F.col("level").isNull()) == 0).alias("is_dag"))


def neighbours(edges: DataFrame, depth: int = 1, strength_min: float = 0.0, types=None, direction: str = "out") -> DataFrame:
    """(node_id, other_id, strength, hops) within depth; strength is that of the strongest single edge that
    reaches other_id on such a walk, hops the fewest."""
    e = filter_edges(active(edges), strength_min, types)
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    step = e.select(F.col(a).alias("node_id"), F.col(b).alias("other_id"), "strength").groupBy("node_id", "other_id").agg(F.max("strength").alias("strength"))
    if depth <= 1:
        return step.withColumn("hops", F.lit(1)).filter("node_id != other_id")
    walk = every = step.withColumn("hops", F.lit(1))
    hop = step.select(F.col("node_id").alias("via"), F.col("other_id").alias("next_id"), F.col("strength").alias("next_strength"))
    for d in range(2, depth + 1):  # distinct pairs after each hop, so walks do not multiply
        walk = walk.join(hop, F.col("other_id") == F.col("via")).select("node_id", F.col("next_id").alias("other_id"), F.col("next_strength").alias("strength"))
        walk = walk.groupBy("node_id", "other_id").agg(F.max("strength").alias("strength")).withColumn("hops", F.lit(d))
        every = every.unionByName(walk)
    best = every.groupBy("node_id", "other_id").agg(F.max("strength").alias("strength"), F.min("hops").alias("hops"))
    return best.filter("node_id != other_id")


def version_fold(nodes: DataFrame) -> DataFrame:
    """nodes' node_id with primary_id: the highest (version, created_at) of its root."""
    root = F.coalesce(F.col("root_id"), F.col("node_id"))
    w = Window.partitionBy(root).orderBy(F.desc("version"), F.desc("created_at"), "node_id")
    return nodes.select("node_id", F.first("node_id").over(w).alias("primary_id"))


def feedback_strength(strength: Column, reward: Column, edge_type: Column) -> Column:
    """Strength after feedback: a step by the reward, then pulled towards the type's base."""
    s = strength + FEEDBACK_STEP * reward
    return clamp01(s + REGULARISE * (base_strength(edge_type) - s))


def summary_strength(similarity: Column, edge_type: Column) -> Column:
    return clamp01(base_strength(edge_type) * (0.6 + 0.4 * F.greatest(F.lit(0.0), similarity)))


def gap_tau(nodes: DataFrame, parity: bool = False) -> DataFrame:
    """One row (tau): the median positive gap between creation times in order, 3600 without one.
    parity takes the middle of the unsorted gaps, as the original does."""
    w = Window.orderBy("created_at", "node_id")  # topics only: a row each
    gaps = nodes.withColumn("gap", F.col("created_at") - F.lag("created_at").over(w)).filter("gap > 0")
    at = gaps.withColumn("pos", F.row_number().over(Window.orderBy("created_at") if parity else Window.orderBy("gap")) - 1)
    mid = at.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())).filter("pos = floor(n / 2)")
    return mid.agg(F.coalesce(F.max("gap"), F.lit(DEFAULT_TAU)).alias("tau"))


def edge_factors(nodes: DataFrame, edges: DataFrame, parity: bool = False) -> DataFrame:
    """edges plus f_topic, f_temporal, f_struct and f_interact."""
    n = nodes.select("node_id", "created_at")
    out = edges.join(n.select(F.col("node_id").alias("src"), F.col("created_at").alias("_s")), "src", "left")
    out = out.join(n.select(F.col("node_id").alias("dst"), F.col("created_at").alias("_d")), "dst", "left")
    outs = active(edges).groupBy("src").agg(F.collect_set("dst").alias("_o"))  # a topic's links
    out = out.join(outs.withColumnRenamed("_o", "_so"), "src", "left")
    out = out.join(outs.select(F.col("src").alias("dst"), F.col("_o").alias("_do")), "dst", "left")
    out = out.join(F.broadcast(gap_tau(nodes, parity)))  # one row
    empty = F.array().cast(dict(edges.dtypes)["dst"].join(["array<", ">"]))
    so, do = F.coalesce("_so", empty), F.coalesce("_do", empty)
    union = F.size(F.array_union(so, do))
    return out.withColumns({
        "f_topic": F.when(F.col("similarity") == 0, F.lit(0.5)).otherwise((F.col("similarity") + 1) / 2),
        "f_temporal": F.coalesce(F.exp(-F.abs(F.col("_s") - F.col("_d")) / F.col("tau")), F.lit(0.5)),
        "f_struct": F.when(union > 0, F.size(F.array_intersect(so, do)) / union).otherwise(F.lit(0.0)),
        "f_interact": 1 - F.exp(-0.3 * F.col("interactions")),
    }).drop("_s", "_d", "_so", "_do", "tau")


def multifactor_strength(factored: DataFrame, weights: dict[str, float] | None = None, alpha: float = BIAS_ALPHA) -> DataFrame:
    """factored plus strength: the type's base blended with the weighted mean of the factors."""
    w = weights or {"topic": 1.0}
    total = sum(w.values()) or 1.0
    mix = sum((F.lit(float(x)) * F.col(f"f_{k}") for k, x in w.items()), F.lit(0.0)) / total
    return factored.withColumn("strength", clamp01((1 - alpha) * base_strength(F.col("type")) + alpha * mix))


def bump_interactions(edges: DataFrame, used: DataFrame, order: str = "edge_id") -> DataFrame:
    """edges with interactions raised by the rows of used(src, dst), on the first active edge, by order, of a
    pair alone."""
    n = used.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_n"))
    first = active(edges).groupBy("src", "dst").agg(F.min(order).alias(order)).withColumn("_first", F.lit(True))
    out = edges.join(first, ["src", "dst", order], "left").join(n, ["src", "dst"], "left")
    raised = F.col("interactions") + F.when(F.col("_first"), F.coalesce("_n", F.lit(0))).otherwise(F.lit(0))
    return out.withColumn("interactions", raised).drop("_n", "_first")


def coarse_links(new: DataFrame, nodes: DataFrame, k: int = 4) -> DataFrame:
    """(src, dst, similarity, type, strength): links from existing nodes to new(node_id, emb, root_id), the k
    most similar other than itself, main and its own versions, found by blocks of vectors."""
    asked = new.select(F.col("node_id").alias("query_id"), F.col("emb").alias("q_emb"), F.col("root_id").alias("root"))
    there = nodes.filter(F.col("node_id").cast("string") != "main").select(F.col("node_id").alias("memory_id"), F.col("node_id").alias("seq"), "emb", F.col("root_id").alias("root"))
    top = nearest(asked, there, k, differ="root").select(F.col("memory_id").alias("src"), F.col("query_id").alias("dst"), F.col("cos").alias("similarity"))
    kind = infer_edge_type(F.col("similarity"))
    return top.select("src", "dst", "similarity", kind.alias("type"), base_strength(kind).alias("strength"))


def refine_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst, change): links that refining adds or removes."""
    a, b = before.select("src", "dst").distinct(), after.select("src", "dst").distinct()
    return b.exceptAll(a).withColumn("change", F.lit("added")).union(a.exceptAll(b).withColumn("change", F.lit("removed")))


def refine_coverage(edges: DataFrame) -> DataFrame:
    return active(edges).agg(F.avg(F.when(F.col("stage") == "refined", 1.0).otherwise(0.0)).alias("coverage"))


def summary_due(n: Column, summarised: Column, threshold: int = 20) -> Column:
    """Whether a node's summary is due: early the first time, at the threshold later."""
    return F.when(summarised, n >= threshold).otherwise(n >= max(1, min(threshold, 3)))


def hash_embedded(df: DataFrame, text: str = "topic", name: str = "emb", dim: int = 128) -> DataFrame:
    return df.withColumn(name, hash_embedding(F.col(text), dim))


def components(links: DataFrame) -> DataFrame:
    """(node_id, component): the least node that links(src, dst), taken both ways, connect each of their ends with.
    Every node takes the least label around it and then its label's own, until nothing changes."""
    both = materialize(links.select("src", "dst").union(links.select("dst", "src")).distinct())
    now = materialize(both.groupBy(F.col("src").alias("node_id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        label = now.select(F.col("node_id").alias("dst"), "component")
        around = join_hot(both, _hinted(label), "dst").groupBy(F.col("src").alias("node_id")).agg(F.min("component").alias("_around"))
        lower = materialize(now.join(_hinted(around), "node_id").select("node_id", F.col("component").alias("_old"), F.least("component", "_around").alias("component")))
        jump = lower.select(F.col("node_id").alias("component"), F.col("component").alias("_jump"))
        after = materialize(join_hot(lower, _hinted(jump), "component").select("node_id", "_old", F.least("component", "_jump").alias("component")))
        discard(now)
        if not after.filter("component != _old").limit(1).count():
            return after.select("node_id", "component")
        now = after


def insert_edges(arrivals: DataFrame, graph: str = "graph_id") -> DataFrame:
    """arrivals(graph, seq, src, dst, type) inserted one after another: an edge that closes a cycle becomes an
    inactive reference of strength 0; an edge that exists already only updates it.

    A link's first arrival decides for all of its arrivals: if it closes no cycle, no later edge may lead back along
    it; if it closes one, that path stays. So arrivals are counted by link and type first. Graphs of at most
    SMALL_GRAPH such rows are folded in order, many in a task. Of larger ones only edges between nodes that have a
    cycle of arrivals both before and behind them can close one, and these alone are folded, one task for each
    connected part of them: which edges of such a part stay depends on all before (keeping edges in order while they
    close no cycle is complete for polynomial time, so no way to split it further is known)."""
    rows = materialize(arrivals.groupBy(graph, "src", "dst", "type").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n")))
    name = F.concat(F.octet_length(F.col(graph).cast("string")).cast("string"), F.lit(":"), F.col(graph).cast("string"))
    known = F.when(F.col("src").isNotNull() & F.col("dst").isNotNull(), name)  # without a graph or an end nothing is closed
    large = materialize(rows.groupBy(graph).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > SMALL_GRAPH).select(graph))
    if large.limit(1).count():
        large = checked_broadcast(large)
        parts = rows.join(large, graph, "left_anti").withColumn("component", known)
        parts = parts.unionByName(_cyclic_parts(materialize(rows.join(large, graph, "left_semi")), name))
    else:
        parts = rows.withColumn("component", known)
    judged = _closing(parts.filter("component IS NOT NULL")).unionByName(parts.filter("component IS NULL").withColumn("cycle", F.lit(False)))
    kind = F.when(F.col("cycle"), F.lit("references")).otherwise(F.col("type"))
    merged = judged.groupBy(graph, "src", "dst", kind.alias("type"), "cycle").agg((F.sum("n") - 1).alias("updates"), F.min("seq").alias("seq"))
    strength = F.coalesce(*[F.when(F.col("type") == t, F.lit(x)) for t, x in EDGE_STRENGTH.items()], F.lit(0.3))
    strength = F.when(F.col("cycle"), F.lit(0.0)).otherwise(strength)
    status = F.when(F.col("cycle"), F.lit("cycle_rejected")).otherwise(F.lit("active"))
    return merged.select(graph, "src", "dst", "type", strength.alias("strength"), status.alias("status"), "updates", "seq")


def _cyclic_parts(rows: DataFrame, name: Column) -> DataFrame:
    """rows plus component: the connected part that may close cycles, null for edges that cannot."""
    key = lambda c: F.concat(name, F.col(c).cast("string"))
    rows = rows.withColumns({"_s": key("src"), "_d": key("dst")})
    links = rows.select(F.col("_s").alias("src"), F.col("_d").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    behind = depths(links).filter("level IS NULL").select("node_id")
    core = materialize(links.join(_hinted(behind.withColumnRenamed("node_id", "src")), "src", "left_semi"))
    before = depths(core.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("level IS NULL").select("node_id")
    core = materialize(core.join(_hinted(before.withColumnRenamed("node_id", "dst")), "dst", "left_semi"))
    part = components(core) if core.limit(1).count() else core.select(F.col("src").alias("node_id"), F.col("src").alias("component"))
    at = join_hot(core, _hinted(part.withColumnRenamed("node_id", "src")), "src").select(F.col("src").alias("_s"), F.col("dst").alias("_d"), "component")
    return rows.join(_hinted(at), ["_s", "_d"], "left").drop("_s", "_d")


def _closing(rows: DataFrame) -> DataFrame:
    """rows(component, seq, src, dst, ...) plus cycle: whether a row's link closed a cycle when it first came. A task
    takes its components one after another and holds the links of one."""
    import pyarrow as pa

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, after, closed = None, {}, {}

        def reaches(a, b) -> bool:
            seen, todo = {a}, [a]
            while todo:
                x = todo.pop()
                if x == b:
                    return True
                todo += [y for y in after.get(x, ()) if y not in seen]
                seen.update(after.get(x, ()))
            return False

        for batch in batches:
            cycle = []
            for part, a, b in zip(*(batch.column(c).to_pylist() for c in ("component", "src", "dst"))):
                if part != now:
                    now, after, closed = part, {}, {}
                if (a, b) not in closed:
                    closed[a, b] = reaches(b, a)
                    if not closed[a, b]:
                        after.setdefault(a, set()).add(b)
                cycle.append(closed[a, b])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cycle, pa.bool_())], names=[*batch.schema.names, "cycle"])

    dealt = rows.repartition("component").sortWithinPartitions("component", "seq", "src", "dst")
    return dealt.mapInArrow(fold, T.StructType([*dealt.schema, T.StructField("cycle", T.BooleanType())]))


def rejected_edges(edges: DataFrame, node=None) -> DataFrame:
    """Inactive edges, of one node or (node_id, rejected) lists for every node they touch."""
    off = edges.filter("status != 'active'")
    if node is not None:
        return edges_of(off, node)
    touched = off.select(F.explode(F.array("src", "dst")).alias("node_id"), "src", "dst", "type", "status")
    return touched.groupBy("node_id").agg(F.array_sort(F.collect_set(F.struct("src", "dst", "type", "status"))).alias("rejected"))  # a topic's links


def affected_edges(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Active edges that touch a node of changed(node_id)."""
    e, ids = active(edges), changed.select("node_id").distinct()
    return e.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").unionByName(e.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")).distinct()


def invalid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that may not be added, with reason: an unknown node or an unknown type."""
    known = nodes.select("node_id").distinct()
    end = lambda n: known.select(F.col("node_id").alias(n), F.lit(True).alias(f"_{n}"))
    out = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    unknown = F.col("_src").isNull() | F.col("_dst").isNull()
    reason = F.when(unknown, F.lit("unknown node")).when(~F.coalesce(F.col("type").isin(list(EDGE_STRENGTH)), F.lit(False)), F.lit("unknown type"))
    return out.withColumn("reason", reason).drop("_src", "_dst").filter("reason IS NOT NULL")


def with_memory_counts(nodes: DataFrame, written: DataFrame) -> DataFrame:
    """nodes with n_memories raised by the rows of written(owner_node)."""
    n = written.groupBy(F.col("owner_node").alias("node_id")).agg(F.count(F.lit(1)).alias("_n"))
    return nodes.join(n, "node_id", "left").withColumn("n_memories", F.coalesce("n_memories", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def judged_types(answers: DataFrame, key: str = "dst", raw: str = "answer") -> DataFrame:
    """(key, number, type) from a model's answer, text around a JSON object of numbers and edge types; numbers
    that are none and unknown types are left out."""
    said = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "map<string,string>")
    rows = answers.select(key, F.explode(said).alias("n", "type"))
    return rows.filter(F.col("type").isin(list(EDGE_STRENGTH)) & F.col("n").rlike("^[0-9]+$")).select(key, F.col("n").cast("long").alias("number"), "type")


def refine(nodes: DataFrame, edges: DataFrame, node_ids: list, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """(edges, diff): the active edges into the given nodes replaced by links to what is most similar to their
    present vectors, marked refined, and (src, dst, change) of what that added and removed."""
    target = F.col("dst").isin(list(node_ids))
    links = coarse_links(nodes.filter(F.col("node_id").isin(list(node_ids))), nodes, k).withColumn("stage", F.lit("refined"))
    before = active(edges).filter(target)
    stay = edges.join(before.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return stay.unionByName(links, allowMissingColumns=True), refine_diff(before, links)


def create_nodes(nodes: DataFrame, edges: DataFrame, new: DataFrame, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with new(node_id, topic, ...) added, embedded from their topics if they have no vector,
    and linked from what is there."""
    fresh = new if "emb" in new.columns else hash_embedded(new)
    every = upsert_nodes(nodes, fresh)
    links = coarse_links(fresh, every, k).withColumn("stage", F.lit("coarse"))
    return every, edges.unionByName(links, allowMissingColumns=True)


def upsert_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes with the rows of changes (one for each node_id) added or put in place of their namesakes."""
    return nodes.join(changes.select("node_id"), "node_id", "left_anti").unionByName(changes, allowMissingColumns=True)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, mean out-degree, mean and sample variance of strength."""
    e = active(edges)
    a = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    b = e.agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.avg("strength"), 6).alias("avg_strength"), F.round(F.coalesce(F.var_samp("strength"), F.lit(0.0)), 6).alias("var_strength"))
    return a.join(b).withColumn("avg_out_degree", F.round(F.col("n_edges") / F.greatest(F.col("n_nodes"), F.lit(1)), 6))


def type_histogram(edges: DataFrame) -> DataFrame:
    return active(edges).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
