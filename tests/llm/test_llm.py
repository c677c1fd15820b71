"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import SF, norm
from pyspark.sql import functions as F

import memloom.llm.bpe as B
import memloom.llm.langid as L
import memloom.llm.media as M
import memloom.llm.mixing as X
import memloom.llm.nets as N
import memloom.llm.pii as P
import memloom.llm.quality as Q
import memloom.llm.sharding as H
import memloom.llm.simhash as S
import memloom.llm.toolcalls as C
import memloom.llm.urlfilter as U
from memloom.llm import registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t", "en", "a", 5), (4, "word " * 30_000, "en", "a", 1), (5, "é" * 50_000, "fr", "b", 2), (6, "same text of some words here", "en", "b", 3),
    (6, "same text of some words here", "en", "b", 3), (None, "same text of some words here", "en", None, 3), (8, "x" * 20_000 + " mail a.b@c.de ", "de", "c", 9), (9, "日本語 text ½ ² Ⅷ \U0001f600 \x1c ", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert norm(got.select(*cols).collect()) == norm([tuple(r[i] for i in at) for r in want.fetchall()])


def vocab():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def reference_encoding():
    import tiktoken

    path, pattern = vocab()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_library_and_round_trips(spark, docs, odd, none):
    path, pattern = vocab()
    enc = reference_encoding()
    for df in (docs, odd.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))):
        out = B.bpe_decode(B.bpe_encode(df, path, pattern), path, pattern)
        for r in out.select("text", "ids", "decoded", B.ids_array().alias("list")).collect() if df is not docs else out.select("text", "ids", "decoded").collect():
            text = r.text or ""
            ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
            assert ids == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()
            assert df is docs or r.list == ids
    assert B.bpe_encode(none, path, pattern).count() == 0


def test_perfect_hash_and_merge():
    v = B.Vocabulary.load(*vocab())
    assert all(v.hash.get(t) == i for i, t in enumerate(v.tokens)) and sorted(v.hash.at.tolist()) == list(range(len(v.tokens))) and v.hash.get(b"not a token!") == -1
    ranks, rng = dict(zip(v.tokens, v.ids, strict=True)), random.Random(3)

    def slow(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for _ in range(300):
        piece = bytes(rng.choice(b"aehinorst \xc3\xa9") for _ in range(rng.randint(1, 30)))
        assert B.merge(piece, ranks.get) == slow(piece)


def test_quality(odd, none):
    rows = Q.quality(odd.withColumn("KEPT", F.lit("x")), stats=True).collect()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        seen = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {w for w in seen if seen.count(w) > 1} if len(words) < 1000 else set(seen)
        cover = {i + k for i, w in enumerate(seen) if w in twice for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(cover))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or "")) and r.base_failed == (len(words) < 50 or 2 * len(cover) > len(words))
        assert not (r.kept and r.base_failed)
    assert Q.quality(none).count() == 0


def test_rules_are_ordered_on_survivors():
    now = [0.0]

    def rule(name, seconds, rejects):
        def run(s):
            now[0] += seconds
            return rejects(s.text)

        return Q.Rule(name, run)

    slow, fast = rule("slow", 1.0, lambda t: "a" in t), rule("fast", 0.1, lambda t: "a" in t or "b" in t)
    rest, never = rule("rest", 0.5, lambda t: "c" in t), rule("never", 0.01, lambda t: False)
    order = Q.order_rules(["a", "b", "c", "d"], (slow, never, rest, fast), clock=lambda: now[0])
    assert [r.name for r in order] == ["fast", "rest", "slow", "never"]  # what slow rejects is gone after fast
    assert [r.name for r in Q.order_rules([])] == [r.name for r in Q.RULES]


@pytest.mark.parametrize("kind", ["words", "long"])
def test_repeated_words_paths_agree(kind):
    rng = random.Random(5)
    for _ in range(50):
        w = [str(rng.randint(0, 6)).encode() for _ in range(rng.randint(0, 60 if kind == "words" else 900))]
        seen = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        want = {i + k for i, x in enumerate(seen) if seen.count(x) > 1 for k in range(3)}
        assert Q.repeated_words(w) == len(want)


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.COM/en/7?x=://y"), (4, "http://com/en/"), (5, "http://xcom/en/"), (6, "http://example.com/en/8#f"), (7, "http://free.org/fr/1"), (8, "http://free.org/es/1"), (9, "http://b.net/de/8"), (9, "http://b.net/de/8")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(0))).collect()}
    assert got[1] == ("", "", None, "allow") == got[2]
    assert got[3] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[4][2:] == ("com/en/", "block") and got[5][2:] == (None, "allow")
    assert got[6][3] == "block" and got[7][2:] == (None, "block") and got[8][3] == "block" and got[9][2:] == ("net/de/", "block")
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_cascade_is_exact(spark):
    hosts = spark.range(20_000).select(F.concat(F.lit("h"), "id").alias("host"), (F.xxhash64("id") % 7 == 0).alias("listed"))
    levels = U.build_cascade(hosts)
    assert len(levels) > 1 and hosts.filter(U.listed_by(F.col("host"), levels) != F.col("listed")).count() == 0
    few = U.judge(spark.createDataFrame([(1, "http://a.b/x"), (2, "http://c.d/x")], "page_id long, url string"), spark.createDataFrame([("a.b",), ("a.b",), (None,)], "host string"))
    assert {r.page_id: r.verdict for r in few.collect()} == {1: "block", 2: "allow"}


def test_large_filters_stay_in_the_cascade(spark):
    hosts = spark.range(5_000_000).select(F.concat(F.lit("h"), "id").alias("host"), (F.col("id") % 10 != 0).alias("listed"))
    levels = U.build_cascade(hosts)
    assert 8 * levels[0][1] > 4 << 20 and hosts.filter(U.listed_by(F.col("host"), levels) != F.col("listed")).count() == 0


def test_hosts_are_dealt_to_several_cascades(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 900, F.lit(".com/x")).alias("url"))
    listed = spark.range(900).filter("id % 3 = 0").select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"))
    got = U.judge(pages, listed, most_bytes=64).collect()
    assert len(got) == 3000 and all((r.verdict == "block") == (r.page_id % 900 % 3 == 0) for r in got)


def test_urls_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/" + "x" * 100_000, "mine", "own", None)], "page_id long, url string, `Host` string, listed string, by int")
    row = U.judge(df).first()
    assert row.listed == "own" and row.host == "a.com" and row.verdict == "block" and len(row.path) == 100_004 and U.judge(df).columns == ["page_id", "url", "listed", "by", "host", "path", "rule", "verdict"]


def check_shards(rows, n=16):
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    return [sum(r.size for r in rows if r.shard == s) for s in range(n)]


def test_sharding(spark, odd, none, docs):
    rows = H.shard(odd).collect()
    check_shards(rows)
    assert len(rows) == len(ODD) and {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ODD}
    assert H.shard(none).count() == 0
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 20)).otherwise(F.concat(F.lit("t"), "id", F.lit(" x" * 45))).alias("text"))
    sizes = check_shards(H.shard(many).collect())
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 16
    assert sorted(map(tuple, H.shard(docs).collect())) == sorted(map(tuple, H.shard(docs).collect()))


def test_shards_follow_the_order(spark):
    rows = registry.QUERIES["op4_histogram_sharding"](spark, SF).collect()
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [(r.text_crc32, r.doc_id) for r in order] == sorted((r.text_crc32, r.doc_id) for r in rows)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()), "bytes", None) for r in rows)
    sizes, largest = check_shards(rows), max(r.size for r in rows)
    assert max(sizes) - min(sizes) <= 2 * largest


def test_splitters_off_the_tolerance_fail(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    with pytest.raises(RuntimeError):
        H.shard(many, probes=1, max_rounds=1)


def test_mixing(odd, none):
    plan = {(r.doc_id, r.source): r for r in X.mix_plan(odd.withColumn("size", F.lit("clash"))).collect()}
    assert plan[1, None].size == 0 and plan[4, "a"].size == 30_000
    spark = odd.sparkSession
    fill = lambda sizes: {r.source: r.target for r in X.fill_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert fill({"a": 10, "b": 10, "c": 10}) == pytest.approx({"a": 20.0, "b": 25 / 3, "c": 50 / 3})
    t = fill({"a": 1, "b": 50, None: 7, "z": 0})
    assert sum(t.values()) == pytest.approx(1.5 * 58) and t["z"] == 0 and t["a"] == 2 and fill({}) == {}
    rng = random.Random(0)
    for n in (1, 7, 300):
        sizes = {f"s{i:03}": int(rng.paretovariate(0.5)) for i in range(n)}
        got, weight = fill(sizes), {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
        unit = max((got[s] / weight[s] for s in sizes if got[s] < 2 * sizes[s]), default=float("inf"))
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(got[s] == pytest.approx(min(2 * sizes[s], unit * weight[s])) for s in sizes)
    copies = X.mix(odd).groupBy("doc_id", "source").count().collect()
    assert all(c["count"] == 2 * plan[c.doc_id, c.source].copies if c.doc_id == 6 else c["count"] == plan[c.doc_id, c.source].copies for c in copies) and X.mix(odd).columns == odd.columns
    assert X.mix_plan(none).count() == 0 and X.mix(none).count() == 0


def test_mix_meets_targets(spark):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    got = X.mix_plan(many).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.max("target").alias("t")).collect()
    assert all(abs(r.n - r.t) < 0.03 * r.t for r in got)


def test_media(spark, odd, none):
    for raw in (b"", b"a", bytes(200_000), random.Random(1).randbytes(300_000)):
        parts = M.chunks(raw)
        assert b"".join(parts) == raw and all(len(p) <= M.MOST for p in parts)
    shared = random.Random(2).randbytes(30_000).hex()
    more = odd.unionByName(spark.createDataFrame([(20, "intro " + shared, "en", "a", 1), (21, shared + shared + " tail", "en", "a", 1)], DOCS))
    store = M.write_store(more)
    assert store.shared_refs.count() > 5 and store.chunks.filter("kind = 1").groupBy("digest").count().filter("count > 1").count() == 0
    back = {bytes(r.medium): bytes(r.payload) for r in M.read_media(store).collect()}
    texts = {bytes(r.medium): M.payload(t) for r in store.rows.collect() for i, t, *_ in [*ODD, (20, "intro " + shared), (21, shared + shared + " tail")] if i == r.ident}
    assert back == texts
    with pytest.raises(ValueError):
        M.assemble(M.recipe([(3, hashlib.sha256(b"abc").digest())]), b"abd", {})
    assert M.read_media(M.write_store(none)).count() == 0


def test_media_query(spark):
    """Every column of op8 from the text alone."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.QUERIES["op8_media_chunks"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        ends, start = [], 0
        for i in range(1, len(pay) + 1):  # the rolling hash byte by byte
            h = 0
            if i - start >= 1024:
                for b in pay[max(0, i - 32) : i]:
                    h = (h << 1) + int(M._GEAR[b]) & 0xFFFFFFFF
            if i == len(pay) or i - start == 65536 or (i - start >= 1024 and len(pay) - start > 1024 and h >> 20 == 0):
                ends.append(i)
                start = i
        parts = [pay[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        stored = b"CDC1" + b"".join(len(c).to_bytes(4, "little") + hashlib.sha256(c).digest() for c in parts)
        x = np.frombuffer(pay, np.uint8).astype(float)
        feature = f"samples={len(pay)};chunks={len(parts)};mean={x.mean():.4f};std={x.std():.4f};zeros={(x == 0).mean():.4f}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), feature)


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    import memloom.tables as K

    monkeypatch.setattr(K, "HOT_ROWS", 10)
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 0, 8).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert sorted(K.join_hot(big, small, "k").collect()) == sorted(big.join(small, "k").collect())


def brute_groups(fps, radius=4):
    """The place of the least equal or linked fingerprint, by a union of all pairs of its own."""
    u, inv = np.unique(np.array(fps, np.uint64), return_inverse=True)
    name = np.arange(len(u))
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u) <= radius):
            low, high = sorted((name[i], name[j]))
            name[name == high] = low
    return name[inv]


def slow_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    sh = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, odd, none, docs):
    for df, n in ((odd, len(ODD)), (docs, docs.count())):
        rows = S.simhash_groups(df.withColumn("fp", F.lit(0))).collect()
        by = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
        assert len(rows) == n
        texts = {r.doc_id: r.text for r in df.collect()}
        assert all(int(fp, 16) == slow_fingerprint(texts[i]) for i, (fp, _) in by.items() if len(texts[i] or "") < 20_000)
        ids = list(by)
        root = brute_groups([int(by[i][0], 16) for i in ids])
        least = {r: min((i for i, q in zip(ids, root, strict=True) if q == r and i is not None), default=None) for r in root}
        assert all(by[i][1] == least[r] for i, r in zip(ids, root, strict=True))
    assert S.simhash_groups(none).count() == 0


def test_tiles_find_every_link(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    near = np.concatenate([base] + [base[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for _ in range(3)])
    fps = np.unique(near)
    monkeypatch.setattr(S, "TILE_ROWS", (100, 200))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in S.components(S.find_links(df)).collect()}
    root = brute_groups(fps)
    mine = [got.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len(set(zip(mine, root.tolist(), strict=True))) == len(set(mine)) == len(set(root.tolist()))


def test_components_of_paths_and_cliques(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(101, 139), (200, 200)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[x] == 100 for x in range(101, 140)) and 200 not in got


def test_tile_pairs_are_those_the_counts_allow(spark, monkeypatch):
    rng = np.random.default_rng(3)
    some, more = (rng.integers(0, 1 << 63, 400, dtype=np.uint64) for _ in range(2))
    fps = np.unique(np.concatenate([some & more & np.uint64(0xFF00FF00FFFF), some | more | np.uint64(0xFFFF0000FF00FF00)]))
    monkeypatch.setattr(S, "TILE_ROWS", (40, 60))
    tiles = S.materialize(S._tiles(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), len(fps)))
    rows = {r.tile: np.frombuffer(bytes(r.fps), np.uint64) for r in tiles.collect()}
    got = {(r.a, r.b) for r in S._tile_pairs(tiles, 4).collect()}
    assert sum(map(len, rows.values())) == len(fps) and all((t, t) in got for t in rows) and all(a <= b for a, b in got)
    near = {(min(a, b), max(a, b)) for a, x in rows.items() for b, y in rows.items() if (np.bitwise_count(x[:, None] ^ y[None, :]) <= 4).any()}
    assert near <= got and len(got) < len(rows) * (len(rows) + 1) / 2


def test_inference_is_the_forward_pass():
    rng = np.random.default_rng(4)
    for cell in (N.Gru, N.Lstm):
        net = N.Labeller.init(cell, 11, 4, 3, 2)
        x, mask = rng.integers(0, 11, (9, 5)), np.ones((9, 5), np.float32)
        mask[6:, 2] = 0
        for tag in "fb":
            c = cell(net.params, tag, tag == "b")
            assert np.allclose(c.infer(x, mask) * mask[:, None], c.forward(x, mask)[0] * mask[:, None], atol=1e-5)


def test_gradients():
    rng = np.random.default_rng(0)
    for cell in (N.Gru, N.Lstm):
        net = N.Labeller.init(cell, 9, 3, 4, 1)
        net.params = {k: v.astype("f8") for k, v in net.params.items()}
        x, y, mask = rng.integers(0, 9, (6, 4)), rng.integers(0, 4, (6, 4)), np.ones((6, 4))
        mask[4:, 1] = 0

        def loss(s):
            v, d, t = N.crf_loss(s, net.params["trans"], y, mask)  # noqa: B023
            return v, d, {"trans": t}

        _, grads = net.gradients(x, mask, loss)
        for k, g in grads.items():
            i = np.unravel_index(np.abs(g).argmax(), g.shape)
            old, e = net.params[k][i], 1e-5
            net.params[k][i] = old + e
            up = net.gradients(x, mask, loss)[0]
            net.params[k][i] = old - e
            down = net.gradients(x, mask, loss)[0]
            net.params[k][i] = old
            assert (up - down) / (2 * e) == pytest.approx(g[i], rel=1e-3, abs=1e-7)


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    s, t = rng.standard_normal((5, 3, 2)), rng.standard_normal((3, 3))
    for r in range(2):
        best = max(itertools.product(range(3), repeat=5), key=lambda p: sum(s[i, k, r] for i, k in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert N.viterbi(s, t)[:, r].tolist() == list(best)


def test_language(spark, docs, odd, none):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify(big, ~held).withColumn("held", held).collect()
    test = [r for r in rows if r.held]
    assert sum(r.lang == r.lang_pred for r in test) > 0.97 * len(test) and all(0 <= r.score <= 1 for r in rows)
    train = spark.createDataFrame([(100 + i, ("the cat sat " if i % 2 else "den hund auf ") * 20, "en" if i % 2 else "de", "a", 1) for i in range(20)], DOCS)
    got = L.identify(odd.unionByName(train).withColumn("score", F.lit("x")), F.col("doc_id") >= 100).collect()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"} and all(r.lang == r.lang_pred for r in got if (r.doc_id or 0) >= 100)
    assert {r.lang_pred for r in L.identify(odd, F.lit(False)).collect()} == {"und"} and L.identify(none, F.lit(True)).count() == 0


def test_language_labels_positions():
    net, labels = L.train([("a", L.cut(b"abab" * 16)[0].tobytes()), ("b", L.cut(b"xyxy" * 16)[0].tobytes())])
    p = L.label_positions(net, L.cut(b"ab" * 32))
    assert p.shape == (1, 64, 2) and p.argmax(axis=2).sum() == 0 and np.allclose(p.sum(axis=2), 1)
    assert np.allclose(L.pool(net, ["ab" * 32], 2), p.mean(axis=1), atol=1e-6)


def test_language_forward_pass_step_by_step():
    """pool() against gates computed one position at a time."""
    net = N.Labeller.init(N.Gru, L.PAD + 1, 5, 3, 1)
    sig = lambda v: 1 / (1 + np.exp(-v))
    text = "Größe 12, la maison; " * 9
    raw, total, n = text.encode(), np.zeros(3), 0
    for at in range(0, len(raw), L.WINDOW):
        w = raw[at : at + L.WINDOW]
        states = {}
        for tag, order in (("f", range(len(w))), ("b", range(len(w) - 1, -1, -1))):
            T_, U_, h = net.params[f"T{tag}"].astype(float), net.params[f"U{tag}"].astype(float), np.zeros(5)
            for t in order:
                a, u = T_[w[t]], U_ @ h
                z, r = sig(a[:5] + u[:5]), sig(a[5:10] + u[5:10])
                h = z * h + (1 - z) * np.tanh(a[10:] + r * u[10:])
                states[tag, t] = h
        for t in range(len(w)):
            s = net.params["V"].astype(float) @ np.concatenate([states["f", t], states["b", t]]) + net.params["c"][:, 0]
            total += np.exp(s) / np.exp(s).sum()
            n += 1
    assert np.allclose(L.pool(net, [text, None], 3), [total / n, np.zeros(3)], atol=1e-5)


def test_language_query(spark):
    rows = registry.QUERIES["op6_language_id"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    langs = {r.lang for r in docs.values()}
    assert sorted(r.doc_id for r in rows) == sorted(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", docs[r.doc_id].text or "")) and r.lang_pred in langs | {"und"} for r in rows)


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(d) <= 19 and P.luhn(d), 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_patterns_match_brute_force():
    rng = random.Random(2)
    for _ in range(8000):
        t = "".join(rng.choice("ab.@-1123+ ()é%") for _ in range(rng.randint(0, 40)))
        assert P.base_spans(t) == brute_spans(t)
    assert P.luhn("4242424242424242") and not P.luhn("4242424242424241")


def test_pii_network(spark, odd, none):
    card = "4242424242424242"
    train = spark.createDataFrame([(1000 + i, f"some words before {w} and some more after it, then text {i}", "en", "a", 1) for i, w in enumerate(["ab.c@mail.example.com", "10.20.30.40", card, "+1 (555) 010-2233", "no data", "version 2.0"] * 25)], DOCS)
    net = P.fit(train)
    rows = P.detect(odd.withColumn("spans", F.lit(1)), params=net).collect()
    for r in rows:
        want = brute_spans(r.text or "") if len(r.text or "") < 30_000 else P.base_spans(r.text)
        assert r.base_sha256 == hashlib.sha256(P._joined(want).encode()).hexdigest() and r.n_email == sum(k == 0 for _, k, _ in want)
        assert set(P._joined(want).split(",")) <= set(r.spans.split(","))
    assert P.detect(none, params=None).count() == 0 and P.train([]) is None and P.detect(none).count() == 0
    assert P.mask_text("a b@c.de +1 555 010 2233 z", P.base_spans("a b@c.de +1 555 010 2233 z")) == "a <EMAIL> <PHONE> z"
    masked = P.redact(train.withColumn("TEXT2", F.lit("x")))
    assert masked.columns == [*train.columns, "TEXT2"] and masked.filter(F.col("text").contains("example.com")).count() == 0 and masked.filter(F.col("text").contains("version 2.0")).count() == 25


def test_tool_calls(spark):
    msgs = [
        (1, 0, "user", "q"), (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "b", "name": "add", "arguments": {"y": 2, "x": 1}, "after": ["a"]}, {"id": "a", "name": "add", "arguments": {"x": "no", "z": 1}}]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"v": 1}})), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": {"v": 2}})), (1, 4, "tool", json.dumps({"tool_call_id": "lost", "content": 1})),
        (2, 0, "assistant", json.dumps({"tool_calls": [{"id": "p", "name": "nope", "arguments": {}, "after": ["q"]}, {"id": "q", "name": "add", "arguments": {"x": 1, "y": 1}, "after": ["p"]}, {"id": "r", "name": "add", "arguments": {"x": 1, "y": 1}, "after": ["q"]}]})),
        (3, 0, "assistant", None), (None, 0, "assistant", "{broken"),
    ]
    df = spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string")
    schema = {"add": {"required": ["x", "y"], "properties": {"x": {"type": "number"}, "y": {"type": "integer", "maximum": 5}}}}
    every = C.link_calls(*C.tool_messages(df), schema).collect()
    rows = {(r.conv_id, r.call_id): r for r in every if r.errors != ["further result"]}
    assert rows[1, "a"].level == 0 and rows[1, "b"].level == 1 and rows[1, "a"].result_turn == 2 and rows[1, "a"].errors == ["type:x", "missing:y", "extra:z"] and rows[1, "b"].errors == []
    assert rows[1, "b"].json == '{"arguments":{"x":1,"y":2},"call_id":"b","name":"add","result":null,"turn":1}' and json.loads(rows[1, "a"].json)["result"] == {"v": 1}
    assert rows[1, "lost"].errors == ["no call"] and not rows[1, "lost"].linked
    assert [(r.call_id, r.turn, json.loads(r.json)["result"]) for r in every if r.errors == ["further result"]] == [("a", 3, {"v": 2})]
    assert [rows[2, x].level for x in "pqr"] == [None] * 3 and rows[2, "p"].errors == ["unknown tool"]
    empty = df.limit(0)
    assert C.link_calls(*C.tool_messages(empty), schema).count() == 0 and C.link_calls(*C.dialogue_calls(empty), C.ASK).count() == 0


def test_tool_calls_repeat(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello " * 20), (1, 0, "user", "hello " * 20), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (2, 0, "user", None), (None, None, "user", "x"), (3, 0, None, "odd")], "conv_id long, turn long, role string, text string")
    rows = C.link_calls(*C.dialogue_calls(df.withColumn("level", F.lit("mine"))), C.ASK).collect()
    say = sorted(((r.conv_id or 0), r.linked, ",".join(r.errors)) for r in rows)
    assert say == [(0, False, "minimum:n_chars,missing:reply_to,missing:turn"), (1, True, "missing:reply_to"), (1, True, "missing:reply_to"), (2, False, "missing:n_chars,missing:reply_to,missing:text"), (3, False, "no call")]


def test_levels_are_longest_chains(spark):
    rng = random.Random(6)
    calls, want = [], {}
    for conv in range(8):
        n, deps = 40, {}
        for i in range(n):
            deps[i] = sorted({rng.randrange(i) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))}) if i else []
            want[conv, f"c{i}"] = max((want[conv, f"c{j}"] + 1 for j in deps[i]), default=0)
            calls.append((conv, f"c{i}", i, [f"c{j}" for j in deps[i]] + ["unknown"]))
    calls += [(9, f"c{i}", i, [f"c{i - 1}"] if i else []) for i in range(300)]  # one long chain
    want |= {(9, f"c{i}"): i for i in range(300)}
    calls += [(10, "a", 0, ["b"]), (10, "b", 1, ["c"]), (10, "c", 2, ["b"]), (10, "d", 3, []), (10, "e", 4, ["d", "a"]), (10, "f", 5, ["f"]), (None, "x", 0, []), (10, None, 0, ["d"])]
    want |= {(10, x): None for x in "abcef"} | {(10, "d"): 0}
    df = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, after array<string>")
    assert {(r.conv_id, r.call_id): r.level for r in C.order_levels(df).collect()} == want


def test_nested_arguments(spark):
    schema = {"properties": {"to": {"type": "object", "required": ["city"], "properties": {"city": {"type": "string"}, "zip": {"type": "integer"}}}, "tags": {"type": "array", "items": {"type": "string"}}}}
    texts = ['{"to": {"city": "x", "zip": 1}, "tags": ["a", "b"]}', '{"to": {"zip": "1"}, "tags": ["a", 2]}', '{"to": 5}', '{"a": 1, "a": 2}', "[]", None, "{}"]
    got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.argument_errors(F.col("t"), schema).alias("e")).collect()]
    assert got == [[], ["items:tags", "missing:to.city", "type:to.zip"], ["type:to"], ["not an object"], ["not an object"], ["not an object"], []]


def test_dialogue_has_levels_errors_and_orphans(spark):
    rows = registry.QUERIES["op5_tool_calls"](spark, "/root/testdata/sf0.01").collect()
    assert len({r.level for r in rows if r.level >= 0}) >= 3
    assert {"no call"} <= {r.errors for r in rows} and all(any(e.startswith(k) for r in rows for e in r.errors.split(",")) for k in ("missing:", "type:", "minimum:"))


def test_pipeline_matches_brute_force(spark):
    import corpus_pipeline as pipe

    raw = spark.read.parquet(f"{SF}/documents.parquet").collect()
    kept = {r.doc_id: r for r in raw if not any(rule.rejects(Q.Stats(r.text)) for rule in Q.RULES)}
    from test_shingles import brute_left

    keep = brute_left([(i, kept[i].text) for i in sorted(kept)])
    got = pipe.run(spark, SF).collect()
    counts = {}
    for r in got:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert set(counts) <= set(keep) and max(counts.values()) <= 2
    enc = reference_encoding()
    for r in got:
        text = enc.decode_bytes(np.frombuffer(bytes(r.ids), "<u4").tolist()).decode()
        spans = P.base_spans(kept[r.doc_id].text)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_tokens == len(enc.encode_ordinary(text)) and r.n_chars == len(text)
        assert not P.base_spans(text) and (text == kept[r.doc_id].text if not spans else text == P.mask_text(kept[r.doc_id].text, spans) or len(text) < len(kept[r.doc_id].text) + 10 * len(spans))


def test_bpe_memory_turns_over(monkeypatch):
    monkeypatch.setattr(B, "MEMO", 16)
    e, enc, rng = B.Encoder(B.Vocabulary.load(*vocab())), reference_encoding(), random.Random(4)
    for _ in range(60):
        text = " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 9))) for _ in range(20))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == enc.encode_ordinary(text)
    assert len(e) <= 8 and len(e.older) <= 8
