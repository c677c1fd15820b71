"""Long queries over the word index, and what a task holds and gives out for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_indexes import plain_bm25, pool_of

from memloom.operators import retrieval
from memloom.operators import text_index as X


def seen(texts, asked, block=4):
    order, cols = X._row(texts, block)
    row = cols | {"m_ids": order.tolist(), "m_seq": order.tolist(), "q_ids": list(range(len(asked))), "q_words": asked, "q_idfs": [[1.0 + i for i in range(len(q))] for q in asked]}
    return order, row, X._Postings(row, X._Queries(row["q_words"], row["q_idfs"]), 2.0, block)


def test_rare_words_take_no_matrix():
    """Only words of many documents are multiplied; the matrix does not grow with the words that queries ask for."""
    texts = [" ".join(["common", *(f"w{d}x{i}" for i in range(50))]) for d in range(64)]
    _, _, p = seen(texts, [["common"] + [f"w{d}x{i}" for d in range(64) for i in range(9)]])
    assert (p.whole(np.array([0])) > 0).all() and p._whole[2].shape == (1, 64)


@pytest.mark.parametrize("most", [0, 1, 1024])
def test_both_ways_of_adding_agree(monkeypatch, most):
    monkeypatch.setattr(X, "DENSE_WORDS", most)
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 30, rng.integers(0, 20))) for _ in range(50)]
    asked = [[f"w{i}" for i in range(25)], [], ["w3", "none"], ["none"]]
    order, row, p = seen(texts, asked)
    for q, scores in enumerate(p.whole(np.arange(4))):
        for d, s in zip(order, scores, strict=True):
            words = texts[d].split()
            want = sum((1.0 + i) * X.weight(words.count(w), len(words), 2.0) for i, w in enumerate(asked[q]) if w in words)
            assert s == pytest.approx(want, abs=1e-9)
        heads, idf, bound = p.bounds(q)
        assert p.of_blocks(np.arange(p.n_blocks), heads, idf)[0] == pytest.approx(scores, abs=1e-9)
        assert all(bound[at // 4] >= s for at, s in enumerate(scores))


def test_places_count_as_the_whole_ranking():
    rng = np.random.default_rng(2)
    s, at = rng.integers(0, 6, 80) / 2, rng.permutation(80)
    marks, seqs = rng.integers(-1, 8, 30) / 2, rng.integers(0, 80, 30)
    assert X.ahead_of(s, at, marks, seqs).tolist() == [sum((-a, b) < (-m, q) for a, b in zip(s, at, strict=True)) for m, q in zip(marks, seqs, strict=True)]


@pytest.mark.parametrize("row_docs, block_docs", [(4096, 64), (20, 4)])
def test_one_pass_finds_and_tells(spark, row_docs, block_docs):
    """Long, short and empty queries: the best, the scores of given documents and the ranks are those of all pairs."""
    texts, pool = pool_of(spark)
    asked = [" ".join(f"w{i}" for i in range(30)), "w1 w2 the", "", None, "漢 字 " + " ".join(f"w{i} w{i}" for i in range(20, 40))]
    q = spark.createDataFrame([(100 + i, t) for i, t in enumerate(asked)], "query_id long, q_text string")
    index = X.build(pool, row_docs, block_docs)
    words, every = X.ask(q, index), [plain_bm25(texts, t or "") for t in asked]
    pairs = [(100 + i, j) for i in (0, 1, 2, 4) for j in range(i, len(texts), 7)]
    best, told = X.search_and_tell(words, index, 9, spark.createDataFrame(pairs, "query_id long, m_seq long"), block_docs)
    told = {(r.query_id, r.seq): r.bm25_score for r in told.collect()}
    assert told.keys() == set(pairs) and all(s == pytest.approx(every[i - 100][j], abs=2e-9) for (i, j), s in told.items())
    got = {}
    for r in best.collect():
        got.setdefault(r.query_id, []).append((-r.bm25_score, r.seq))
    for i, scores in enumerate(every):
        want = sorted((-s, j) for j, s in enumerate(scores) if s > 0)[:9]
        assert [(pytest.approx(a, abs=2e-9), b) for a, b in want] == sorted(got.get(100 + i, []))
    marks = spark.createDataFrame([(i, told[i, j], j) for i, j in pairs], "query_id long, score double, m_seq long")
    ranks = {(r.query_id, r.m_seq): r.better for r in X.ranks_of(marks, words, index, block_docs).collect()}
    assert ranks == {(i, j): sum((-x, m) < (-every[i - 100][j], j) for m, x in enumerate(every[i - 100])) for i, j in pairs}


def test_nearest_over_many_blocks(spark, monkeypatch):
    """What a task leaves out, as its earlier blocks hold k better ones, is not among the k best; ties, nulls, odd sizes."""
    monkeypatch.setattr(retrieval, "POOL_BLOCK", 5)
    rng = np.random.default_rng(4)
    vecs = [v.tolist() for v in rng.integers(-2, 3, (60, 2)).astype(float)] + [None, [0.0, 0.0]]
    pool = spark.createDataFrame([(i, 100 - i, v) for i, v in enumerate(vecs)], "memory_id long, seq long, emb array<double>").coalesce(1)
    q = spark.createDataFrame([(i, vecs[i], 0) for i in (0, 3, 60)], "query_id long, q_emb array<double>, cur_node long")
    every = retrieval.top_k(retrieval.with_cosine(q, pool), 7, "cos").select("query_id", "memory_id", "seq", "cos", "rank")
    near = retrieval.nearest(q, pool, 7)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, every.collect()))
    told = retrieval.cosines(near.select("query_id", "memory_id"), q, pool).withColumn("same", F.lit(1))
    assert told.join(near, ["query_id", "memory_id", "cos"]).count() == 21
