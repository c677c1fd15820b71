"""Parts that take part in a schedule, checks of the network, drawn vectors and costs."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.operators import state, weights
from memloom.plans import plugins, presets, schedule
from memloom.plans.catalog import View
from memloom.sources import readers

TEXTS = ["a Plan for plans", "向量 cache, 向量", "", None, "x"]


def test_drawn_vectors_have_their_values(spark):
    def unit(v):
        n = np.linalg.norm(v)
        return v / n if n else v

    def grams(t):
        words = re.findall("[A-Za-z0-9]+|[一-鿿]", (t or "").lower())
        all_ = words + [words[i] + words[i + 1] for i in range(len(words) - 1)]
        return unit(sum((np.random.default_rng(int(hashlib.md5(g.encode()).hexdigest()[:8], 16)).normal(size=96) for g in all_), np.zeros(96)))

    def place(t):
        if not t:
            return np.zeros(16)
        return unit(np.random.default_rng(int(hashlib.sha256(t.encode()).hexdigest()[:8], 16)).normal(0, 1, 16).astype(np.float32))

    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in df.select("i", tx.gram_embedding(F.col("t")).alias("g"), tx.placeholder_embedding(F.col("t"), 16).alias("p")).collect():
        assert np.allclose(r.g, grams(TEXTS[r.i]), atol=1e-12) and np.allclose(r.p, place(TEXTS[r.i]), atol=1e-6)


def test_embedding_and_weight_take_part(spark, sf):
    v = View(spark, sf)
    cfg = presets.SchedulingConfig(retriever="vector", selector="topk", top_k=4, tier="full", candidates=12)
    q, pool = v.q.drop("q_emb"), v.mem.drop("emb")
    for name in ("embed.hash", "embed.grams", "embed.placeholder"):
        out = schedule.schedule(cfg, q, pool, embed=plugins.standard().get(name)(32))
        r = out.filter("pick_rank = 1").first()
        a, b = (np.array(x) for x in (r.q_emb, r.emb))
        assert len(a) == 32 and r.cos == pytest.approx(float(a @ b), abs=1e-6)

    class Model:
        name, asked = "one", 0

        def __call__(self, prompts):
            Model.asked += 1
            first = prompts.first()
            assert first is None or first.prompt.startswith("Give weights of time, semantic, frequency, task")
            return prompts.select("query_id", F.lit('{"time": 0, "semantic": 1, "frequency": 0, "task": 0}').alias("answer"))

    out = schedule.schedule(cfg, v.q, v.mem, weight=plugins.PriorWeight(Model()))
    assert out.filter("abs(final - semantic_score) > 1e-6").count() == 0 and "_weights" not in out.columns
    fast = presets.SchedulingConfig(retriever="vector", selector="topk", top_k=4, tier="fast")
    plain = schedule.schedule(fast, v.q, v.mem).select("query_id", "memory_id", "final")
    told = schedule.schedule(fast, v.q, v.mem, weight=plugins.PriorWeight(Model())).select("query_id", "memory_id", "final")
    assert plain.exceptAll(told).count() == 0  # the fast tier asks for none


def test_roles_and_kinds():
    r = plugins.standard()
    assert r.get("factory.roles")("main") == presets.PRESETS["graph_g4"] and r.get("factory.roles")("sub", top_k=3).top_k == 3
    assert {n.partition(".")[0] for n in r.names()} == set(plugins.KINDS) - {"model"}  # models are the user's own
    with pytest.raises(KeyError):
        r.get("factory.roles")("cook")


def test_network_passes_its_checks():
    net, q = weights.WeightNet(64, seed=1), np.random.default_rng(7).normal(size=64)
    got = weights.conditioning_check(net, q, "u|research|s", ["u|demo|s", "w|research|s", "u|research|club"])
    assert got["sways"] and got["isolated"]
    same = weights.conditioning_check(net, q, "u|research|s", ["u|research|s"])
    assert not same["sways"] and same["isolated"]
    before = net.weights(weights.WeightNet.features(q, np.zeros(32)))
    got = weights.feedback_check(net, q, "u|research|s", "w|demo|s")
    assert got["raised"] and got["lowered"] and got["bounded"]
    assert (net.weights(weights.WeightNet.features(q, np.zeros(32))) == before).all()  # the network itself is as it was


def test_config_folder_has_all_fields(spark, tmp_path):
    (tmp_path / "b.yaml").write_text("retriever_impl: retriever.bm25\nconditioning_dims: [semantic, task]\nweight_impl: weight.full\n")
    (tmp_path / "a.yaml").write_text("selector_impl: selector.topk\nconditioning_dims: []\n")
    got = [tuple(r) for r in readers.read_config_dir(spark, str(tmp_path)).collect()]
    assert got == [("a", None, None, None, "selector.topk", None), ("b", "retriever.bm25", None, "weight.full", None, ["semantic", "task"])]


def test_costs_of_schedules(spark):
    asked = [(1, "g", 1, "full", "Ask  me", 9), (2, "g", 2, "full", "ask me", 9), (3, "g", 3, "full", "Ask  me", 9), (4, "g", 4, "full", "few", 5), (5, "g", 5, "full", "few", 6), (6, "g", 6, "fast", "new", 9), (7, "h", 1, "full", "ask me", 9)]
    a = spark.createDataFrame(asked, "query_id int, grp string, at int, tier string, q_text string, candidate_count int")
    kept = spark.createDataFrame([(1, "abcdef"), (1, "xyz"), (2, None)], "query_id int, text string")
    got = {r.query_id: (r.llm_calls, r.embed_calls_miss, r.injected_tokens) for r in state.schedule_costs(a, kept, ["grp"], "at").collect()}
    assert got == {1: (1, 1, 6), 2: (0, 1, 0), 3: (0, 0, 0), 4: (0, 1, 0), 5: (1, 0, 0), 6: (0, 1, 0), 7: (1, 1, 0)}
