"""The pipeline's near-duplicate stage against all pairs."""

import random
import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_llm import DOCS, ODD

import corpus_pipeline as pipe
import memloom.llm.common as C
import memloom.llm.shingles as G
from memloom import tables


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_left(rows):
    """The least doc_id of each group of (doc_id, text) that is connected by similarities of 0.8 or more."""
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                root = [root[j] if r == root[i] else r for r in root]
    return sorted(min(i for (i, _), r in zip(rows, root, strict=True) if r == k) for k in set(root))


def edited(rng):
    """Copies of a few texts with 0 to 3 other words, all with a passage in common, and chains of edits."""
    words, shared = [f"w{i}" for i in range(2000)], [f"s{i}" for i in range(30)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(50, 120)) + shared
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(t)
        for _ in range(6):
            t = list(t)
            t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(t)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("bits", [8, 12, G.TABLE_BITS])
def test_stage_drops_edited_copies(spark, monkeypatch, bits):
    """The order of shingles, however many share a counter, changes nothing."""
    monkeypatch.setattr(G, "TABLE_BITS", bits)
    rows = edited(random.Random(bits))
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    got = pipe.drop_copies(spark, df, SF)
    left = brute_left(rows)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == left and 12 <= len(left) < len(rows) / 2


def test_stage_on_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in pipe.drop_copies(spark, df, SF).collect()) == brute_left([(r.doc_id, r.text) for r in df.collect()])


def test_stage_on_odd_texts(spark):
    df = spark.createDataFrame(ODD, DOCS)
    assert sorted(r.doc_id for r in pipe.drop_copies(spark, df, SF).collect()) == [1, 4, 5, 6, 8, 9]
    assert pipe.drop_copies(spark, df.limit(0), SF).count() == 0


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        n = int(rng.integers(1, 40))
        pool = np.unique(rng.integers(1, 1 << 63, 60, dtype=np.uint64))
        a, b = (np.sort(rng.permutation(pool[: n + 3])[:n]) for _ in range(2))
        table = rng.integers(0, 256, 64, dtype=np.uint8)
        if G.similar(a, b):
            p, q = (G.prefix(x, G.levels(x, table))[0].tolist() for x in (a, b))
            first = next(h for h in p if h in q)
            n_a, i, n_b, j = (np.array([x]) for x in (len(a), p.index(first), len(b), q.index(first)))
            assert G._may_match(n_a, i, n_b, j)[0]


def test_counters_cover_all_texts(spark, monkeypatch):
    monkeypatch.setattr(G, "TABLE_BITS", 14)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 90))) for _ in range(150)] + ["one two three four five six"] * 9 + [None, ""]
    rows = G.with_set(spark.createDataFrame([(t,) for t in texts], "text string").repartition(6))
    table = G._counted(rows)
    want = np.zeros(1 << 14, int)
    for t in set(texts):
        np.add.at(want, (G.shingles(t) >> np.uint64(50)).astype(int), 1)
    h = np.arange(1 << 14, dtype=np.uint64) << np.uint64(50)
    got = G.levels(h, table)
    assert len(table) == 1 << 12 and (got >= sum((want >= least).astype(int) for least in G.LEVELS)).all()
    once = np.ones(1 << 14, bool)
    once[(G.shingles("one two three four five six") >> np.uint64(50)).astype(int)] = False
    assert (got == sum((want >= least).astype(int) for least in G.LEVELS))[once].all()


@pytest.mark.parametrize("most", [1, 3, 1 << 15])
def test_rows_in_blocks(spark, monkeypatch, most):
    """Rows kept by bitmaps are those kept by a set, in one scan or several, with whole, partly kept and empty blocks."""
    monkeypatch.setattr(C, "MOST_BLOCKS", most)
    made = C.materialize(spark.range(30_000, numPartitions=3).withColumn("row", F.monotonically_increasing_id()))
    keep = "id % 7 = 0 OR id < 5000 OR id % 64 = 63 AND id < 20000 OR id = 29999"
    for law in (keep, "id > 25000", "false"):
        want = sorted(r.id for r in made.filter(law).collect())
        got = C.rows_in(made, C.row_blocks(made.filter(law).select("row")))
        assert got.columns == made.columns and sorted(r.id for r in got.collect()) == want


@pytest.mark.parametrize("run", [4])
def test_shingles_of_many_sets_are_dealt_in_blocks(spark, monkeypatch, run):
    """All counters at the last level, so every shingle is dealt by set, and sets are compared block by block."""
    monkeypatch.setattr(G, "TABLE_BITS", 8)
    monkeypatch.setattr(G, "RUN", run)
    rows = edited(random.Random(run))
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS).repartition(5)
    assert sorted(r.doc_id for r in pipe.drop_copies(spark, df, SF).collect()) == brute_left(rows)


@pytest.mark.parametrize("most", [1 << 17])
def test_a_set_of_many_pairs(spark, monkeypatch, most):
    """One text with hundreds of near copies: its set goes to the pairs by broadcast, unless it is too large."""
    monkeypatch.setattr(tables, "HOT_ROWS", 10)
    monkeypatch.setattr(G, "HOT_BYTES", most)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        t = list(base)
        t[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(f"y{i}_{k}" for k in range(30))) for i in range(20)]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS).repartition(3)
    assert sorted(r.doc_id for r in pipe.drop_copies(spark, df, SF).collect()) == [0, *range(1000, 1020)]


def test_sides_of_hot_pairs(spark, monkeypatch):
    """Columns of both sides, whichever of them has many pairs."""
    monkeypatch.setattr(tables, "HOT_ROWS", 5)
    pairs = [(1, k) for k in range(2, 30)] + [(k, 99) for k in range(2, 20)] + [(1, 99), (40, 41)]
    sets = [(k, f"s{k}" * (1 if k != 99 else 50)) for k in [*range(1, 30), 40, 41, 99]]
    p, s = spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(sets, "set long, name string")
    for most in (1 << 17, 10, 0):
        monkeypatch.setattr(G, "HOT_BYTES", most)
        got = G._sided(C.materialize(p), s, "name").select("u", "v", "name_u", "name_v").collect()
        by = dict(sets)
        assert sorted(map(tuple, got)) == sorted((u, v, by[u], by[v]) for u, v in pairs)
