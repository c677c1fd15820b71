"""The written indexes and the version log, against brute force and races."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom import tables
from memloom.operators import retrieval, text_index
from memloom.operators.vector_index import VectorIndex
from memloom.sources import readers, versions, writers

WORDS = [f"w{i}" for i in range(40)] + ["the", "漢", "字"]


def pool_of(spark, n=150, seed=3):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(WORDS, rng.integers(0, 40), p=np.r_[np.full(40, 0.02), 0.1, 0.05, 0.05])) for _ in range(n)] + [None, "", "the", "Kelvin K9"]
    return texts, spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "memory_id long, seq long, text string").repartition(3)


def plain_bm25(texts, query):
    import re

    stop = set(text_index.STOPWORDS)
    words = lambda t: [w for w in re.findall("[一-鿿]|[a-z0-9]+", (t or "").lower()) if w not in stop]
    docs = [words(t) for t in texts]
    avgdl = max(1.0, np.mean([len(d) for d in docs]))
    out = []
    for d in docs:
        s = 0.0
        for w in set(words(query)):
            tf, df = d.count(w), sum(w in x for x in docs)
            s += np.log(1 + len(docs) / (1 + df)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avgdl))
        out.append(round(float(s), 9))
    return out


@pytest.mark.parametrize("row_docs, block_docs", [(4096, 64), (20, 4)])
def test_index_search_equals_brute_force(spark, row_docs, block_docs):
    texts, pool = pool_of(spark)
    asked = ["w1 w2 w3 the", "漢 w5", "nothing here", "", None, "9 k9 w7 w7"]
    q = spark.createDataFrame([(100 + i, t) for i, t in enumerate(asked)], "query_id long, q_text string")
    index = text_index.build(pool, row_docs, block_docs)
    got = {}
    for r in text_index.search(text_index.ask(q, index), index, 7, block_docs).collect():
        got.setdefault(r.query_id, []).append((-r.bm25_score, r.seq))
    for i, t in enumerate(asked):
        want = sorted((-s, j) for j, s in enumerate(plain_bm25(texts, t or "")) if s > 0)[:7]
        assert [(pytest.approx(a, abs=2e-9), b) for a, b in want] == sorted(got.get(100 + i, [])), t
    marks = [(100 + i, s, j) for i, t in enumerate(asked[:3]) for j, s in list(enumerate(plain_bm25(texts, t)))[::9]]
    ranks = {(r.query_id, r.m_seq): r.better for r in text_index.ranks_of(spark.createDataFrame(marks, "query_id long, score double, m_seq long"), text_index.ask(q, index), index, block_docs).collect()}
    for i, s, j in marks:
        every = plain_bm25(texts, asked[i - 100])
        assert abs(ranks[i, j] - sum((-x, k) < (-s, j) for k, x in enumerate(every))) == 0


def test_index_leaves_postings_unread(spark):
    # a few documents hold the rare word, all the common one
    rows = [(i, i, "common " * 3 + ("rare " * 5 if i % 100 == 7 else "") + f"own{i}") for i in range(4000)]
    index = text_index.build(spark.createDataFrame(rows, "memory_id long, seq long, text string").repartition(2))
    q = spark.createDataFrame([(1, "rare common")], "query_id long, q_text string")
    assert [r.seq for r in text_index.search(text_index.ask(q, index), index, 40).orderBy("seq").collect()] == list(range(7, 4000, 100))
    r = text_index.reading(text_index.ask(q, index), index, 2).first()
    assert r.postings_asked == 4040 and r.postings_read < 0.3 * r.postings_asked


def test_index_of_an_empty_pool(spark):
    index = text_index.build(spark.createDataFrame([], "memory_id long, seq long, text string"))
    q = spark.createDataFrame([(1, "a word")], "query_id long, q_text string")
    assert text_index.search(text_index.ask(q, index), index, 3).count() == 0


def test_fusion_equals_ranking_all_pairs(spark):
    texts, pool = pool_of(spark, 260)
    rng = np.random.default_rng(9)
    vecs = rng.integers(-2, 3, (len(texts), 3)).astype(float)  # ties and zero vectors
    pool = pool.join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "memory_id long, emb array<double>"), "memory_id")
    for own in (True, False):
        q = spark.createDataFrame([(i, texts[i], vecs[i].tolist()) for i in (0, 17, 40, 260)], "query_id long, q_text string, q_emb array<double>")
        q = q.withColumn("cur_node", F.lit(0)) if own else q
        got = {(r.query_id, r.rank): (r.memory_id, r.bm25_rank, r.vector_rank) for r in retrieval.retrieve_rrf(q, pool, 5).collect()}
        for i in (0, 17, 40, 260):
            unit = lambda v: v / (np.linalg.norm(v) or 1.0)
            ids = [j for j in range(len(texts)) if not (own and j == i)]
            cos, words = [round(float(unit(vecs[i]) @ unit(v)), 9) for v in vecs], plain_bm25(texts, texts[i])
            place = lambda s, ids=ids: {j: n for n, j in enumerate(sorted(ids, key=lambda j: (-s[j], j)), 1)}
            a, b = place(words), place(cos)
            want = sorted(ids, key=lambda j: (-round(1 / (60 + a[j]) + 1 / (60 + b[j]), 12), j))[:5]
            assert [got[i, n + 1] for n in range(5)] == [(j, a[j], b[j]) for j in want], (own, i)


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, 6))
    return [(centres[i % 12] + rng.normal(0, 0.05, 6)).tolist() for i in range(n)]


def top(vecs, q, k, ids):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    s = {i: round(float(unit(vecs[i]) @ unit(q)), 9) for i in ids}
    return sorted(ids, key=lambda i: (-s[i], i))[:k]


def test_vector_index_changes_and_stays_exact(spark, tmp_path):
    vecs = dict(enumerate(clustered(900)))
    kind = "memory_id long, seq long, emb array<double>"
    rows = [(i, i, v) for i, v in vecs.items()]
    pool = spark.createDataFrame([*rows, (2000, 2000, None), (2001, 2001, [0.0] * 6), (2002, 2002, [1.0])], kind)
    index = VectorIndex.create(pool, str(tmp_path / "ix"), pivots=12)
    q = spark.createDataFrame([(i, vecs[i]) for i in range(0, 900, 90)], "query_id long, q_emb array<double>")

    def check(ix, vecs, k=8):
        got = {}
        for r in ix.search(q, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.memory_id)
        assert got == {i: top(vecs, vecs0[i], k, list(vecs)) for i in range(0, 900, 90)}

    vecs0 = dict(vecs)
    check(index, vecs)
    read = index.skipped(q, 8).first()
    assert read.pairs == 9000 and read.compared < 0.5 * read.pairs
    put = {i: vecs[(i + 1) % 900] for i in range(0, 900, 7)} | {5000 + i: v for i, v in enumerate(clustered(30, 5))}
    gone = [i for i in range(900) if i % 5 == 1]
    after = index.change(spark.createDataFrame([(i, i, v) for i, v in put.items()], kind), spark.createDataFrame([(i,) for i in gone], "memory_id long"))
    now = {i: v for i, v in vecs.items() if i not in gone} | put
    check(after, now)
    check(index, vecs)  # the older version is as it was
    again = after.change(remove=spark.createDataFrame([(5000,), (7777,)], "memory_id long"))
    now.pop(5000)
    check(again, now)
    small = again.compact()
    check(small, now)
    assert small.rows().count() == len(now) and not small.entry["gone"]
    with pytest.raises(versions.Conflict):
        again.change(remove=spark.createDataFrame([(1,)], "memory_id long"))
    small.retire(1)
    check(VectorIndex(spark, str(tmp_path / "ix")), now)
    with pytest.raises(KeyError):
        VectorIndex(spark, str(tmp_path / "ix"), 1)


def test_vector_index_from_nothing(spark, tmp_path):
    kind = "memory_id long, seq long, emb array<double>"
    index = VectorIndex.create(spark.createDataFrame([], kind), str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q_emb array<double>")
    assert index.search(q, 3).count() == 0
    index = index.change(spark.createDataFrame([(4, 4, [1.0, 1.0]), (5, 5, [1.0, 0.1])], kind))
    assert [r.memory_id for r in index.search(q, 3).orderBy("rank").collect()] == [5, 4]


def test_one_of_two_writers_fails_and_readers_keep_their_version(spark, tmp_path):
    log, won, lost = versions.Log(spark, str(tmp_path / "log")), [], []

    def write(name):
        try:
            won.append((log.commit({"graph": name}, 0), name))
        except versions.Conflict:
            lost.append(name)

    threads = [threading.Thread(target=write, args=(f"g{i}",)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 5 and log.read(1) == {"graph": won[0][1]} and log.versions() == [1]
    nodes = spark.createDataFrame([("a", "t")], "node_id string, topic string")
    edges = spark.createDataFrame([("1", "a", "a", "references", 0.5)], "edge_id string, src string, dst string, type string, strength double")
    path = str(tmp_path / "graph")
    assert writers.write_graph(nodes, edges, path) == 1
    pinned = readers.graph_payload(spark, path, None)
    assert writers.write_graph(nodes.withColumn("topic", F.lit("u")), edges, path, after=1) == 2
    with pytest.raises(versions.Conflict):
        writers.write_graph(nodes, edges, path, after=1)
    assert "t" in {r.topic for r in pinned[0].collect()} and "u" in {r.topic for r in readers.graph_payload(spark, path, None)[0].collect()}
    writers.write_graph(nodes.withColumn("topic", F.lit("v")), edges, path)
    writers.retire_graphs(spark, path, 2)
    assert versions.Log(spark, path).versions() == [2, 3] and "u" in {r.topic for r in readers.graph_payload(spark, path, None, 2)[0].collect()}


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.range(300).select("id", F.array_repeat(F.lit(1.0), 1000).alias("v"))
    assert tables.is_small(wide) and not tables.is_small(wide, size=1 << 20) and not tables.is_small(wide, rows=299)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(tables.checked_broadcast(wide)) and not hinted(tables.checked_broadcast(wide, size=1 << 20))
    assert tables.met(spark.range(3).toDF("a"), wide).count() == 900
    nested = spark.createDataFrame([(["x" * 5000] * 100, {"k": "y" * 9000})], "a array<string>, m map<string,string>")
    assert not tables.is_small(nested, size=500_000) and tables.is_small(nested, size=600_000)


def test_search_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tables, "is_small", lambda *a, **k: False)
    pool = spark.createDataFrame([(i, i, [float(i % 7), 1.0]) for i in range(40)], "memory_id long, seq long, emb array<double>")
    q = spark.createDataFrame([(100, [3.0, 1.0])], "query_id long, q_emb array<double>")
    assert [r.memory_id for r in retrieval.nearest(q, pool, 3).orderBy("rank").collect()] == [3, 10, 17]


def test_nearest_within_values(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "POOL_BLOCK", 7)
    rng = np.random.default_rng(6)
    vecs, owner = rng.normal(0, 1, (80, 3)).round(2), [None if i % 9 == 0 else i % 5 for i in range(80)]
    pool = spark.createDataFrame([(i, i, v.tolist(), owner[i]) for i, v in enumerate(vecs)], "memory_id long, seq long, emb array<double>, owner long").repartition(3)
    asked = [(i, o) for i in (1, 2, 33) for o in (0, 3, None, 17)][: 10]
    q = spark.createDataFrame([(i, vecs[i].tolist(), o, 0) for i, o in asked], "query_id long, q_emb array<double>, owner long, cur_node int")
    got = {}
    for r in retrieval.nearest(q, pool, 4, same="owner").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.memory_id)
    for i in (1, 2, 33):
        mine = [j for j in range(80) if j != i and owner[j] is not None and (i, owner[j]) in asked]
        assert got[i] == top(dict(enumerate(vecs)), vecs[i], 4, mine)
