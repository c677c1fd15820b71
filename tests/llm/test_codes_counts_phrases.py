"""Vector codes, token counts and phrases against brute force, on odd, empty and clashing tables too."""

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import norm
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memloom.llm import codebooks, phrases, tokencount
from memloom.llm.registry import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# vector codes


@pytest.mark.parametrize("exact", [np.float64, np.int64])
def test_exponion_search_equals_a_full_scan(exact):
    rng = np.random.default_rng(1)
    entries = rng.integers(-40, 40, (60, 5))
    entries[20:30] = entries[5]  # equal entries
    x = np.concatenate([rng.integers(-60, 60, (3000, 5)), entries, np.repeat(entries[5:6], 50, 0)])
    d = ((x[:, None] - entries) ** 2).sum(2)
    for start in (np.zeros(len(x), np.uint16), rng.integers(0, 60, len(x)).astype(np.uint16)):
        index, best = codebooks.Codebook(entries, exact).nearest(x, start)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def plain_codes(rows, parts=4, size=256, rounds=4):
    """(ident -> (code, error), books) by full scans."""
    sound = sorted((i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v))
    x = np.array([[math.floor(1024 * c) for c in v] for _, v in sound])
    cuts = codebooks._cuts(x.shape[1], parts)
    books = [x[:size, a:b].copy() for a, b in zip(cuts, cuts[1:])]
    near = lambda p, a, b: ((x[:, None, a:b] - books[p]) ** 2).sum(2)
    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            code = near(p, a, b).argmin(1)
            for k in set(code.tolist()):
                books[p][k] = x[code == k, a:b].sum(0) // (code == k).sum()
    d = [near(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return [(i, "".join(f"{m[r].argmin():02x}" for m in d), int(sum(m[r].min() for m in d))) for r, (i, _) in enumerate(sound)], books


@pytest.mark.parametrize("dim, size", [(8, 256), (6, 5), (3, 7)])
def test_codes_equal_brute_force(spark, dim, size):
    rng = np.random.default_rng(dim)
    rows = [(i, rng.normal(0, 0.2, dim).round(3).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(40)]  # ties
    odd = [(900, None), (901, [None] + [0.0] * (dim - 1)), (902, [math.nan] * dim), (903, [math.inf] * dim)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").withColumn("CODE", F.lit("x")).withColumn("__id", F.col("vec_id") + 1).withColumn("n", F.lit(None).cast("int"))
    out, books = codebooks.compress(df, size=size)
    want, plain = plain_codes(rows, size=size)
    assert set(out.columns) == {"vec_id", "__id", "n", "code", "error"}
    got = out.collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == want and all(r["__id"] == r.vec_id + 1 and r.n is None for r in got)
    assert all((a == b).all() for a, b in zip(books, plain))


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    none, books = codebooks.compress(spark.createDataFrame([(1, None)], kind))
    assert none.collect() == [] and all(len(b) == 0 for b in books)
    rows = [(1, [1.0, 2.0, 3.0, 4.0])] * 3 + [(None, [1.0, 2.0, 3.0, 5.0]), (2, [1.0]), (3, [])]
    got = {(r.vec_id, r.code, r.error) for r in codebooks.compress(spark.createDataFrame(rows, kind), size=2)[0].collect()}
    # the two entries start as repeats of one row, so the lower takes all and the mean of the last part moves
    assert {(2, None, None), (3, None, None)} < got and len(got) == 4
    with pytest.raises(ValueError):
        codebooks.compress(spark.createDataFrame([(1, [1e30] * 4)], kind))


def test_op11_digest_and_label_errors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want, books = plain_codes([(r.vec_id, r.embedding) for r in rows])
    got = QUERIES["op11_vector_codes"](spark, sf).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == want
    text = ",".join(str(v) for b in books for v in b.ravel().tolist())
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}
    label, total = {r.vec_id: r.label for r in rows}, Counter()
    for r in got:
        total[label[r.vec_id]] += r.error
    assert all(r.label_error == total[label[r.vec_id]] for r in got)


# token counts

TEXTS = ["", " ", "   ", "a", " a ", "▁", "a▁ b", "\n", "\n\n a", "<s> </s> <unk> <0x41>", "día über 漢字 🙂🙂", "x\x00y\tz", "a" * 3000, "ab" * 2000, "word " * 900, " " * 2500, "漢" * 800, "zq́" * 700]


def test_counts_in_parts_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        model = f.read()
    for size in (1, 7, 100, 1 << 16):
        assert tokencount.piece_counter(model, size)(TEXTS) == [len(sp.encode(t)) for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aeinrst  ▁\n\t.,é漢🙂<>0123'"), max_size=80), st.integers(1, 9))
def test_any_text_in_parts(text, size):
    count = test_any_text_in_parts.__dict__.setdefault("of", {})
    if size not in count:
        with open(MODEL, "rb") as f:
            count[size] = tokencount.piece_counter(f.read(), size)
    whole = test_any_text_in_parts.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=MODEL))
    assert count[size]([text]) == [len(whole.encode(text))]


def test_counts_of_odd_tables(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, *TEXTS[:3], "many words " * 200_000])] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens string").withColumn("__counted", F.lit(7))
    out = tokencount.count_tokens(df, MODEL)
    assert tokencount.count_tokens(df.limit(0), MODEL).count() == 0
    assert "text" not in out.columns and "N_Tokens" not in out.columns
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {i: len(sp.encode(t or "")) for i, t, _ in rows}


def test_counts_of_a_tokenizers_file(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, path).collect()} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}


def test_op12_equals_the_library(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_token_counts"](spark, sf).collect())) == sorted(want)


# phrases


def plain_phrases(rows, least=30, share=80, top=2000, longest=4):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for c in ",;:!?\n\x0b\x0c\r":
            low = low.replace(c, ".")
        for piece in low.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cands.items():
        inside = lambda v, w=w: len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))
        if any(g == lang and inside(v) and 100 * b >= share * a for (g, v), b in cands.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    best, rank = [], Counter()
    for lang, score, a, p, le, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            best.append((lang, rank[lang], p.decode(), -a, le, r, n[lang], -score))
    return best


SMALL = phrases.Sizes(shard=40, block=8, mark=2, range=16, window=24)


@pytest.mark.parametrize("sizes, top", [(phrases.Sizes(), 2000), (SMALL, 2000), (SMALL, 3)])
def test_phrases_equal_brute_force(spark, sizes, top):
    rng = np.random.default_rng(3)
    pool = ["the", "The", "a", "b", "c\x01", "\x00", "d\x1f", "é", "漢字", "x-y", "'s"]
    seps = [" "] * 9 + ["\t", ".", ", ", "\n", "  ", "\r\n", ";", "\x0b", "\xa0"]
    texts = ["".join(rng.choice(pool) + rng.choice(seps) for _ in range(rng.integers(0, 60))) for _ in range(60)]
    rows = [(t, [None, "en", "de", "und", ""][i % 5]) for i, t in enumerate(texts)] + [(None, "en"), ("", None), ("the a b the a b the a b", "only"), ("...", "none")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumn("f", F.lit("mine")).withColumn("KEY", F.lit(1))
    out = phrases.collocations(df, least=3, top=top, sizes=sizes)
    assert norm(map(tuple, out.collect())) == norm(plain_phrases(rows, 3, top=top))


def test_phrases_of_empty_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_one_word_throughout_and_a_long_text(spark):
    rows = [("w " * 300_000, "en"), ("w", "en"), ("a long tail of words " * 20_000, None)]
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), sizes=phrases.Sizes(shard=1000)).collect()
    assert norm(map(tuple, got)) == norm(plain_phrases(rows))


def test_counts_beyond_64_bit_products(spark):
    big = 1 << 60
    rows = spark.createDataFrame([("en", 1, "a", big, [], "en\ta"), ("en", 1, "b", big + 3, [], "en\tb"), ("en", 2, "a b", big - 5, [big], "en\ta b")], "lang string, m int, phrase string, f long, lefts array<long>, key string")
    got = phrases.best_cuts(phrases.linked(rows, 2)).first().cut
    assert (got.score, got.k, got.l, got.r) == (2_000_000 * (big - 5) // (2 * big + 3), 1, big, big + 3)
