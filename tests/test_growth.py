"""Operators that hold no whole graph, key or file: against plain forms, on long, dense and large input."""

import hashlib
import json
import math
import os

import numpy as np
import pytest
from conftest import norm
from pyspark.sql import functions as F

from memloom.operators import graph, metrics, selection, state, weights
from memloom.sources import files, readers
from memloom.streaming import state as live


def links(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def plain_levels(pairs):
    """Longest paths by peeling; nodes on or behind a cycle have none."""
    into, out = {}, {}
    for a, b in set(pairs):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
        into[b] = into.get(b, 0) + 1
        into.setdefault(a, 0)
    level, todo = {}, [n for n, k in into.items() if not k]
    level.update(dict.fromkeys(todo, 0))
    best = dict.fromkeys(into, 0)
    while todo:
        a = todo.pop()
        level[a] = best[a]
        for b in out[a]:
            best[b] = max(best[b], best[a] + 1)
            into[b] -= 1
            if not into[b]:
                todo.append(b)
    return level


def test_a_long_chain_and_a_complete_order(spark):
    n = 100_000
    mixed = lambda c: (F.col(c) * 48271 % 100_003).alias(c)
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).select(mixed("src"), mixed("dst"))
    got = graph.levels(chain).agg(F.count(F.lit(1)), F.max("level"), F.countDistinct("level")).first()
    assert tuple(got) == (n + 1, n, n + 1)
    full = spark.range(2000).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(1999))).alias("dst")).filter("src < dst AND dst < 2000")
    got = graph.levels(full.select(mixed("src"), mixed("dst"))).agg(F.count(F.lit(1)), F.max("level")).first()
    assert tuple(got) == (2000, 1999)


@pytest.mark.parametrize("seed", range(4))
def test_levels_equal_peeling(spark, seed):
    rng = np.random.default_rng(seed)
    order = rng.permutation(60)
    pairs = [(int(order[a]), int(order[b])) for a, b in rng.integers(0, 60, (140, 2)) if a < b or (seed % 2 and rng.random() < 0.02)]
    got = {r.node_id: r.level for r in graph.levels(links(spark, pairs)).collect()}
    assert got == plain_levels(pairs)


def plain_insert(rows):
    out, after = {}, {}
    for g, seq, a, b, t in sorted(rows, key=lambda r: (r[0], r[1])):
        seen, todo = {b}, [b]
        while todo:
            x = todo.pop()
            todo += [y for y in after.get((g, x), ()) if y not in seen]
            seen |= after.get((g, x), set())
        cycle = a in seen
        kind = "references" if cycle else t
        if (g, a, b, kind) in out:
            out[g, a, b, kind][3] += 1
            continue
        out[g, a, b, kind] = [0.0 if cycle else {"derives_from": 0.9, "depends_on": 0.8, "references": 0.5, "similar_to": 0.3}[t], "cycle_rejected" if cycle else "active", seq, 0]
        if not cycle:
            after.setdefault((g, a), set()).add(b)
    return {(k, *v) for k, v in out.items()}


def test_insertion_equals_one_after_another(spark):
    rng = np.random.default_rng(5)
    kinds = ["derives_from", "depends_on", "references", "similar_to"]
    rows = [(g, i, f"n{a}", f"n{b}", kinds[i % 4]) for g in range(3) for i, (a, b) in enumerate(rng.integers(0, (6, 14, 40)[g], (40, 2)).tolist())]
    got = graph.insert_edges(spark.createDataFrame(rows, "graph_id int, seq int, src string, dst string, type string").repartition(5))
    assert {((r.graph_id, r.src, r.dst, r.type), r.strength, r.status, r.seq, r.updates) for r in got.collect()} == plain_insert(rows)


@pytest.mark.parametrize("small", [0, 30, 1000])
def test_insertion_folds_small_graphs_whole(spark, monkeypatch, small):
    """Small graphs take no rounds over all nodes, whatever number of them is there; large ones have the same result."""
    rng = np.random.default_rng(9)
    rows = [(g, i, int(a), int(b), ["derives_from", "depends_on", "references", "similar_to"][k]) for g in range(12) for i, (a, b, k) in enumerate(rng.integers(0, (4 + 3 * g, 4 + 3 * g, 4), (60, 3)).tolist())]
    arrivals = spark.createDataFrame(rows, "graph_id int, seq int, src int, dst int, type string").repartition(5)
    monkeypatch.setattr(graph, "SMALL_GRAPH", small)
    if small == 1000:
        monkeypatch.setattr(graph, "depths", lambda links: pytest.fail("rounds over all nodes"))
    got = graph.insert_edges(arrivals)
    assert {((r.graph_id, r.src, r.dst, r.type), r.strength, r.status, r.seq, r.updates) for r in got.collect()} == plain_insert(rows)


def test_rounds_send_no_table_to_the_driver_unless_it_is_small(spark, monkeypatch):
    """Spark itself broadcasts files below its threshold, which may be many times that in memory."""
    monkeypatch.setattr(graph, "is_small", lambda *args, **kinds: False)
    written = []
    plain = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: written.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    pairs = [(i, i + 1) for i in range(40)] + [(20, 3)]
    assert {r.node_id for r in graph.depths(links(spark, pairs)).filter("level IS NULL").collect()} == set(range(3, 41))
    assert graph.components(links(spark, pairs)).select("component").distinct().count() == 1
    assert any("Join" in p for p in written) and not any("BroadcastHashJoin" in p for p in written)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 200)]
    got = {r.node_id: r.component for r in graph.components(links(spark, pairs)).collect()}
    assert got == {**dict.fromkeys([*range(51), 200], 0), **dict.fromkeys([100, 101, 102], 100)}


@pytest.fixture
def stored(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    live.use_state_store(spark)
    yield spark
    spark.conf.set(key, before)


def test_restarted_streams_equal_the_batch(stored, tmp_path):
    spark, path = stored, lambda n: str(tmp_path / n)
    kind = "pool string, memory_id long, score double, seq long, query_id long, owner_node long, cur_node long"
    rng = np.random.default_rng(2)
    rows = [(f"p{a}", int(b), float(c), i, int(d), int(e), int(f)) for i, (a, b, c, d, e, f) in enumerate(rng.integers(0, (2, 9, 12, 5, 3, 3), (80, 6)))]
    for n in range(2):  # the second start goes on from the first one's state
        spark.createDataFrame(rows[40 * n : 40 * n + 40], kind).repartition(2).write.mode("append").parquet(path("in"))
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path("in"))
        for name, df in (("pools", live.shared_pool(stream, 4)), ("links", live.interaction_counts(stream))):
            keep = lambda out, batch, name=name: out.write.mode("overwrite").parquet(path(f"{name}/{batch}"))
            df.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", path(f"{name}_state")).trigger(availableNow=True).start().awaitTermination()
    batch = spark.createDataFrame(rows, kind)
    pools = spark.read.parquet(path("pools/*"))
    last = pools.join(pools.groupBy("pool").agg(F.max("round").alias("round")), ["pool", "round"])
    want = selection.shared_pool(batch.select("pool", "memory_id", "score", "seq"), 4)
    cols = ["pool", "pool_rank", "memory_id", "score", "seq"]
    assert norm(map(tuple, last.select(cols).collect())) == norm(map(tuple, want.select(cols).collect()))
    counts = spark.read.parquet(path("links/*")).groupBy("src", "dst").agg(F.max("n").alias("n"))
    assert norm(map(tuple, counts.collect())) == norm(map(tuple, state.interaction_counts(batch).collect()))


def test_queries_of_one_link_are_remembered_in_all_partitions(stored, tmp_path):
    spark, path = stored, lambda n: str(tmp_path / n)
    spark.range(4000).selectExpr("id % 500 AS query_id", "1L AS owner_node", "2L AS cur_node").write.parquet(path("in"))
    stream = live.interaction_counts(spark.readStream.schema("query_id long, owner_node long, cur_node long").parquet(path("in")))
    run = stream.writeStream.foreachBatch(lambda out, batch: out.write.parquet(path(f"out/{batch}"))).outputMode("update").option("checkpointLocation", path("state"))
    run.trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(path("out/*")).collect()] == [(1, 2, 500)]
    held = [spark.read.format("statestore").option("operatorId", k).load(path("state")).groupBy("partition_id").count().collect() for k in (0, 1)]
    seen = max(held, key=lambda rows: sum(r["count"] for r in rows))
    assert len(seen) == 4 and sum(r["count"] for r in seen) == 500 and max(r["count"] for r in seen) < 250


def test_tier_folds_go_on(spark):
    x = np.random.default_rng(1).choice([100.0, 500.0, 2000.0], 90)
    tiers, past, tier, calm = state.tier_fold(x[:37])
    assert tiers + state.tier_fold(x[37:], past, tier, calm)[0] == state.tier_steps(x)


def plain_draws(diffs, n_boot, seed):
    """Means of diffs (episode -> diff) drawn by digests."""
    means = []
    for b in range(n_boot):
        s = n = 0
        for e, d in diffs.items():
            u = int(hashlib.md5(f"{seed}:{b // 4}:{e}".encode()).hexdigest()[8 * (b % 4) : 8 * (b % 4) + 8], 16)
            w = sum(u >= t for t in metrics.POISSON)
            s, n = s + w * d, n + w
        means.append(round(s / n if n else 0.0, 9))
    return sorted(means)


def test_hashed_bootstrap_equals_plain_draws(spark):
    rng = np.random.default_rng(8)
    sets = {"a": {i: float(x) for i, x in enumerate(rng.normal(0.2, 1, 40).round(3))}, "b": {i: 0.0 for i in range(5)}, "one": {3: 0.5}}
    df = spark.createDataFrame([(k, e, d) for k, v in sets.items() for e, d in v.items()], "pair string, episode_id long, diff double").repartition(3)
    got = {r.pair: r for r in metrics.hashed_bootstrap(df, ["pair"], 202, 5).collect()}
    for k, v in sets.items():
        m = plain_draws(v, 202, 5)
        if k == "one":
            assert (got[k].ci_low, got[k].ci_high, got[k].p) == (0.5, 0.5, 1.0)
        else:
            p = min(1.0, 2 * min(sum(x <= 0 for x in m), sum(x >= 0 for x in m)) / 202)
            assert (got[k].ci_low, got[k].ci_high, got[k].p, got[k].n) == (pytest.approx(m[5], abs=2e-9), pytest.approx(m[196], abs=2e-9), pytest.approx(p), len(v))
    # the draws stand for a bootstrap: its interval is near that of the generator's
    lo, hi, _ = metrics.bootstrap(list(sets["a"].values()), 2000)
    wide = metrics.hashed_bootstrap(df.filter("pair = 'a'"), ["pair"], 2000).first()
    assert wide.ci_low == pytest.approx(lo, abs=0.08) and wide.ci_high == pytest.approx(hi, abs=0.08)
    # how often a row is drawn is near Poisson(1)
    assert sum(math.exp(-1) / math.factorial(k) for k in range(11)) == pytest.approx(metrics.POISSON[-1] / 2**32)


def samples(spark, n):
    rng = np.random.default_rng(n)
    rows = []
    for _ in range(n):
        w = rng.dirichlet(np.ones(4))
        rows.append((rng.normal(0, 1, 6).tolist(), rng.normal(0, 1, 32).tolist(), dict(zip(("time", "semantic", "frequency", "task"), map(float, w)))))
    return rows, spark.createDataFrame(rows, "q_emb array<double>, condition_emb array<double>, target_weights struct<time:double,semantic:double,frequency:double,task:double>").repartition(5)


def test_gradient_over_tasks_equals_one_machine(spark):
    rows, df = samples(spark, 83)
    net = weights.WeightNet(6, seed=3)
    x = weights.WeightNet.features(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    y = np.array([[r[2][d] for d in ("time", "semantic", "frequency", "task")] for r in rows])
    want, loss = net.gradient(x, y)
    got, total, n = weights.summed_gradient(net, df)
    assert n == 83 and total == pytest.approx(loss, abs=1e-9)
    assert all(np.abs(a - b).max() < 1e-9 for k in want for a, b in zip(want[k], got[k]))
    got, total, n = weights.summed_gradient(net, df.limit(0))
    assert n == 0 and total == 0 and all((g == 0).all() for layer in got.values() for g in layer)


def test_fit_over_all_rows_learns(spark):
    _, df = samples(spark, 40)
    one = df.withColumn("target_weights", F.expr("named_struct('time', 0.7D, 'semantic', 0.1D, 'frequency', 0.1D, 'task', 0.1D)"))
    net, losses = weights.fit_all(one, 6, epochs=4, batches=2, rate=0.05)
    assert losses["train"] < 0.08 and 0 < losses["held_out"] < 0.08


ODD_TEXTS = ['a "quoted" {brace', "back\\slash\\", "]} end\\\\", "", "ünï [", "\\\"", "line\nbreak\t"]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_array_elements_by_ranges(spark, tmp_path, size):
    rows = [{"id": i, "text": ODD_TEXTS[i % len(ODD_TEXTS)] * (i % 3), "deep": [{"k": [{}, []]}, "}{"]} for i in range(12 if size == 1 else 40)]
    (tmp_path / "a.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps([1, "x", {"id": -1}], indent=1))
    (tmp_path / "c.json").write_text("[]")
    names = ["b.json", "c.json"] if size == 1 else ["a.json", "b.json", "c.json"]
    for name in names:
        got = [json.loads(r.value) for r in files.array_elements(spark, str(tmp_path / name), size).orderBy("at").collect()]
        assert got == [x for x in json.loads((tmp_path / name).read_text(encoding="utf-8")) if isinstance(x, dict)]
    if size == 64:
        assert files.array_elements(spark, str(tmp_path), size).count() == 41


def test_large_conversation_file(spark, tmp_path):
    turn = {"speaker": "A", "dia_id": "D1:1", "text": "word " * 40}
    with open(tmp_path / "big.json", "w") as f:
        f.write("[" + ",".join(json.dumps({"conversation": {"session_1": [turn] * 20, "session_1_date_time": "x"}}) for _ in range(4000)) + "]")
    assert os.path.getsize(tmp_path / "big.json") > 2 * files.RANGE_BYTES
    got = readers.read_conversations(spark, str(tmp_path / "big.json"))
    assert got.count() == 80_000 and got.select("item").distinct().count() == 4000


def test_appended_lines_are_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log, path = tmp_path / "in" / "log.jsonl", lambda n: str(tmp_path / n)

    def take():
        df = files.appended_json(spark, path("in"), "id long, text string")
        df.writeStream.format("parquet").option("path", path("out")).option("checkpointLocation", path("state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.id, r.text) for r in spark.read.schema("id long, text string").parquet(path("out")).collect())

    log.write_text('{"id": 1, "text": "a"}\nnot json\n{"id": 2, "te')
    assert take() == [(1, "a")]
    with log.open("a") as f:
        f.write('xt": "b"}\n{"id": 3, "text": "ü"}\n')
    (tmp_path / "in" / "more.jsonl").write_text('{"id": 9}\n')
    assert take() == [(1, "a"), (2, "b"), (3, "ü"), (9, None)]
