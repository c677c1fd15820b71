"""What rounding, memory and work must be on larger tables, on small ones."""

from pyspark.sql import functions as F

from memloom.functions import scores as S


def test_decimals_of_a_cosine_stay(spark):
    """A cosine of nine places that is its own vector score gives 0.8 times itself, as in SQL, to the last bit."""
    cos = [i * 8.1e-5 + 6.25e-7 * k for i in range(200) for k in range(5)]
    got = spark.createDataFrame([(round(c, 9),) for c in cos], "cos double").select("cos", S.semantic_from_cosine(F.col("cos"), F.col("cos"), F.lit(0.0)).alias("s")).collect()
    assert all(r.s == 0.8 * r.cos for r in got) and any(0.5 * r.cos + 0.3 * r.cos != r.s for r in got)


def test_best_in_scope_equals_all_pairs(spark, sf):
    """The picks within each source are those of a ranking of all pairs, and no table of all pairs is in the plan."""
    from pyspark.sql import Window

    from memloom.operators import retrieval, scoped, scoring
    from memloom.plans import catalog

    v = catalog.View(spark, sf)
    mem = v.mem.withColumn("ts", F.when(F.col("memory_id") % 7 > 0, F.col("ts"))).withColumn("emb", F.when(F.col("memory_id") % 11 > 0, F.col("emb")))
    mem = mem.withColumn("task_tag", F.when(F.col("memory_id") % 5 > 0, F.col("task_tag")))
    every = catalog.rounded(scoring.score_full(retrieval.in_scope(v.folded, mem, v.near).withColumn("vector_score", F.col("cos"))))
    place = F.row_number().over(Window.partitionBy("query_id", "owner_node").orderBy(F.desc("final"), "seq"))
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "owner_node", "memory_id", "seq", "cos", "final").collect())
    assert rows(scoped.best_in_scope(v.folded, mem, v.near, 3)) == rows(every.withColumn("_p", place).filter("_p <= 3")) != []


def test_medians_round_as_sql(spark):
    from memloom.operators import metrics

    rows = spark.createDataFrame([("g", 1.0, 1), ("g", 1.01, 1)], "group string, latency_ms double, n_relevant_sources int")
    assert metrics.summarise(rows, ["group"]).first().p50_latency_ms == 1.0


def test_relevance_by_topic_equals_pairs(spark):
    """Metrics of a topic's memories are those of their listed pairs, also for repeated rows, nulls and lone queries."""
    from memloom.operators import metrics

    pool = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (3, 0), (4, 1), (5, None), (6, 2)], "memory_id long, owner_node long")
    asked = spark.createDataFrame([(1, 0), (4, 1), (5, None), (9, 0), (6, 3)], "query_id long, owner_node long")
    pairs = asked.join(pool, "owner_node").filter("memory_id != query_id").select("query_id", "memory_id").distinct()
    kept = spark.createDataFrame([(1, 2, 1, 0.5, 0.1), (1, 4, 2, 0.4, 0.1), (9, 3, 1, 0.3, 0.1), (4, 4, 1, 0.3, 0.1), (5, 5, 1, 0.3, 0.1)], "query_id long, memory_id long, pick_rank long, final double, bar double")
    topic = metrics.OfTopic(asked, pool)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(metrics.ranking_metrics(kept, topic, 2, asked)) == rows(metrics.ranking_metrics(kept, pairs, 2, asked))
    assert rows(metrics.candidate_hit_rate(kept, topic, asked)) == rows(metrics.candidate_hit_rate(kept, pairs, asked))
    assert rows(metrics.episode_diagnosis(kept, topic)) == rows(metrics.episode_diagnosis(kept, pairs))
    assert rows(metrics.relevant_counts(topic)) == rows(pairs.groupBy("query_id").count().withColumnRenamed("count", "n_relevant"))


def test_draws_are_the_generators(monkeypatch):
    """Draws from blocks of words are randrange's, one run at a time, and are added up in their order."""
    import random

    from memloom.operators import metrics

    for n in (2, 5, 64, 1023):
        draw = random.Random(3).randrange
        assert [p.tolist() for p in metrics._draws(3, n, 9)] == [[draw(n) for _ in range(n)] for _ in range(9)]


def test_rank_of_own_equals_all_pairs(spark):
    """Ranks over the whole pool, with ties, zero vectors and queries outside it."""
    from memloom.operators import retrieval

    pool = spark.createDataFrame([(i, i % 3, [float(i % 4), float(i % 2)] if i % 5 else None, i) for i in range(40)], "memory_id long, owner_node long, emb array<double>, seq long")
    q = pool.filter("memory_id % 4 = 1 OR memory_id = 0").select(F.col("memory_id").alias("query_id"), F.col("emb").alias("q_emb"), F.col("owner_node").alias("cur_node"))
    q = q.union(spark.createDataFrame([(99, [1.0, 1.0], 1)], q.schema))
    every = retrieval.top_k(retrieval.with_cosine(q, pool), None, "cos").filter("owner_node = cur_node").groupBy("query_id").agg(F.max("cos").alias("cos"), F.min("rank").alias("rank"))
    assert sorted(map(tuple, retrieval.rank_of_own(q, pool).collect())) == sorted(map(tuple, every.collect()))


def test_anchored_lists_a_pair_once(spark):
    """A memory of two topics that a query wants meets it once, without comparing pairs."""
    from memloom.sources import generators as G

    mem = spark.createDataFrame([(1, 0, "a b"), (1, 1, "a b"), (2, 1, "a"), (3, 2, "a b"), (4, 0, None)], "memory_id long, owner_node long, text string")
    asked = spark.createDataFrame([(7, [0, 1, 1], ["a", "b"]), (7, [1], ["a"]), (8, [2], ["b", "x"])], "query_id long, relevant_nodes array<long>, anchors array<string>")
    out = G.anchored(mem, asked, 1)
    assert sorted(map(tuple, out.collect())) == [(7, 1), (7, 2), (8, 3)]
    assert "HashAggregate(keys=[query_id" not in out._jdf.queryExecution().executedPlan().toString().split("array_intersect")[0]


def test_an_episodes_digests_serve_all_comparisons(spark):
    """Tasks give out sums by comparison, not a row for each digest of each comparison."""
    from memloom.operators import metrics

    df = spark.createDataFrame([(p, e, float(e + len(p))) for p in ("a", "bb") for e in range(9)] + [("a", None, 2.0)], "pair string, episode_id long, diff double")
    out = metrics.hashed_bootstrap(df, ["pair"], 50, 5)
    assert "sequence(0, 12" not in out._jdf.queryExecution().analyzed().toString() and {r.n for r in out.collect()} == {10, 9}


def test_a_search_holds_no_word_matrices():
    """Between rows of the index a block of queries leaves its best alone, not its matrix of words."""
    from memloom.operators import text_index as X

    order, cols = X._row(["red fox", "blue fox", "red"], 2)
    blocks: dict = {}
    for at in range(3):
        row = cols | {"m_ids": order.tolist(), "m_seq": order.tolist(), "q_ids": [at], "q_words": [["red"]], "q_idfs": [[1.0]]}
        X._best(row, blocks, 2.0, 2, 2)
    assert len(blocks) == 3 and not any(isinstance(x, X._Queries) for state in blocks.values() for x in state)
    assert sorted(blocks[0][3][0].tolist()) == [0, 2]
