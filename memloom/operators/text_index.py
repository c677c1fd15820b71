"""A written inverted index for BM25 with block maxima, searched without reading postings that cannot matter.

A row of the index holds up to ROW_DOCS documents, sorted by length and cut into blocks of BLOCK_DOCS. Each
word's postings are cut likewise, and a head for each block has the word's highest frequency and shortest
document there: the weight of these two is at least that of any posting. A block is read for those queries
alone whose heads add up to the k-th best score so far or more.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import STOPWORDS, tokens
from ..tables import checked_broadcast, materialize, met

K1, B = 1.5, 0.75
#: Scores are rounded, so that the order of additions cannot swap near ties.
DIGITS = 9
#: Documents of a row and of a block; a row is closed early once its texts have so many characters.
ROW_DOCS, BLOCK_DOCS, ROW_CHARS = 4096, 64, 1 << 25
#: Blocks that are read together, at most; a search starts with one, for a score that others must reach.
TOGETHER = 16
#: Queries of more words read whole rows: the bounds of many words leave out next to nothing, and cost as much.
FEW_WORDS = 16
#: Queries whose words go through the index together, and those of one matrix product.
QUERY_BLOCK, PRODUCT = 1024, 256
#: Words that one of so many documents of a row holds, so many of them at most, are multiplied as a matrix; postings of
#: the others are added up.
DENSE, DENSE_WORDS = 16, 1024

_WORD = re.compile("[一-鿿]|[a-z0-9]+").findall


def rounded(x: np.ndarray) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    y = np.abs(x)
    y *= 10**DIGITS
    y += 0.5
    np.floor(y, out=y)
    y /= 10**DIGITS
    np.copysign(y, x, out=y)
    y += 0.0
    return y


def ahead_of(s: np.ndarray, at: np.ndarray, scores: np.ndarray, seqs: np.ndarray) -> np.ndarray:
    """How many of the rows (s, at) come before each of the marks (scores, seqs), by score descending, then place."""
    line = np.sort(s)
    lo, hi = np.searchsorted(line, scores), np.searchsorted(line, scores, "right")
    counts = len(s) - hi
    tied = hi > lo
    for score in np.unique(scores[tied]):
        of = tied & (scores == score)
        counts[of] += np.searchsorted(np.sort(at[s == score]), seqs[of])
    return counts


def weight(tf, dl, avgdl: float):
    """A posting's weight without its word's rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


class _Vocabulary(defaultdict):
    """word -> number; all stop words are 0."""

    def __init__(self):
        super().__init__()
        self.update(dict.fromkeys(STOPWORDS, 0))
        self.names = [""]
        self.default_factory = None

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        return n


def _row(texts: list[str | None], block: int) -> tuple[np.ndarray, dict]:
    """(order of the documents, an index row's columns)."""
    words = _Vocabulary()
    found = [np.fromiter(map(words.__getitem__, _WORD((t or "").lower())), np.int64) for t in texts]
    found = [f[f > 0] for f in found]
    dl = np.array([len(f) for f in found], np.int64)
    order = np.argsort(dl, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n = max(1, len(texts))
    every = np.concatenate([f * n + p for f, p in zip(found, place.tolist(), strict=True)]) if found else np.zeros(0, np.int64)
    key, tf = np.unique(every, return_counts=True)
    term, doc = key // n - 1, key % n
    sizes = np.bincount(term, minlength=len(words.names) - 1)
    head = np.flatnonzero(np.diff(term * n + doc // block, prepend=-1))  # first posting of each word in each block
    lengths = dl[order]
    cols = {
        "dl": lengths.astype("<i4"), "p_doc": doc.astype("<u2"), "p_tf": tf.astype("<i4"), "h_at": head.astype("<i4"), "h_term": term[head].astype("<i4"),
        "h_block": (doc[head] // block).astype("<u2"),
        "h_tf": (np.maximum.reduceat(tf, head) if len(head) else head).astype("<i4"), "h_dl": (np.minimum.reduceat(lengths[doc], head) if len(head) else head).astype("<i4"),
    }
    return order, {k: v.tobytes() for k, v in cols.items()} | {"words": words.names[1:], "dfs": sizes.tolist(), "n": len(texts), "sum_dl": int(dl.sum())}


def _columns(pool: DataFrame) -> T.StructType:
    kinds = {f.name: f.dataType for f in pool.schema}
    binary = ("dl", "p_doc", "p_tf", "h_at", "h_term", "h_block", "h_tf", "h_dl")
    return T.StructType(
        [T.StructField("m_ids", T.ArrayType(kinds["memory_id"])), T.StructField("m_seq", T.ArrayType(kinds["seq"])), *[T.StructField(c, T.BinaryType()) for c in binary]]
        + [T.StructField("words", T.ArrayType(T.StringType())), T.StructField("dfs", T.ArrayType(T.LongType())), T.StructField("n", T.LongType()), T.StructField("sum_dl", T.LongType())]
    )


def build(pool: DataFrame, row_docs: int = ROW_DOCS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The written index of pool(memory_id, seq, text), made where the rows are, but for pools of few files. Null texts have no words."""
    schema = _columns(pool)

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.concat_batches(held)
        order, cols = _row(b.column(2).to_pylist(), block_docs)
        cols |= {"m_ids": b.column(0).take(pa.array(order)).to_pylist(), "m_seq": b.column(1).take(pa.array(order)).to_pylist()}
        kinds = {"m_ids": pa.list_(b.schema.field(0).type), "m_seq": pa.list_(b.schema.field(1).type), "words": pa.list_(pa.string()), "dfs": pa.list_(pa.int64()), "n": pa.int64(), "sum_dl": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([cols[f.name]], kinds.get(f.name, pa.binary())) for f in schema], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, chars = [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                if docs and (docs + part.num_rows > row_docs or chars > ROW_CHARS):
                    yield rows(held)
                    held, docs, chars = [], 0, 0
                for lo in range(0, part.num_rows, row_docs):
                    held.append(part.slice(lo, row_docs))
                    docs, chars = docs + held[-1].num_rows, chars + held[-1].column(2).nbytes
                    if docs >= row_docs:
                        yield rows(held)
                        held, docs, chars = [], 0, 0
        if held:
            yield rows(held)

    docs, tasks = pool.select("memory_id", "seq", "text"), pool.sparkSession.sparkContext.defaultParallelism
    if len(docs.inputFiles()) < tasks:  # one file may be one task, however long its texts
        docs = docs.repartition(tasks)
    return materialize(docs.mapInArrow(run, schema), alone=True)


def scale(index: DataFrame) -> DataFrame:
    """One row (n, avgdl) of the whole pool."""
    mean = F.coalesce(F.sum("sum_dl") / F.sum("n"), F.lit(0.0))
    return index.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)).alias("n"), F.greatest(mean, F.lit(1.0)).alias("avgdl"))


def query_words(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, token, idf): the distinct words of each query that the pool holds."""
    words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("q_text")))).alias("token"))
    asked = checked_broadcast(words.select("token").distinct())
    df = index.select(F.explode(F.arrays_zip("words", "dfs")).alias("w")).select("w.words", "w.dfs").join(asked, F.col("words") == F.col("token"), "left_semi").groupBy(F.col("words").alias("token")).agg(F.sum("dfs").alias("df"))
    return words.join(df, "token").join(F.broadcast(scale(index))).select("query_id", "token", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))  # one row


class Asked(NamedTuple):
    """Queries as a search takes them: their words, written, and the pool's size and mean length."""

    words: DataFrame
    n: int
    avgdl: float


def ask(queries: DataFrame, index: DataFrame) -> Asked:
    """queries(query_id, q_text) made ready for any number of steps over an index."""
    size = scale(index).first()
    return Asked(materialize(query_words(queries, index)), size.n, size.avgdl)


def _query_blocks(words: DataFrame, marks: DataFrame | None = None, how: str = "left") -> DataFrame:
    """(q_ids, q_words, q_idfs, q_scores, q_seqs) of up to QUERY_BLOCK queries: their words and, with marks(query_id,
    score, m_seq), the places to count from. Queries without marks are left out, but for how = full."""
    each = words.groupBy("query_id").agg(F.collect_list("token").alias("token"), F.collect_list("idf").alias("idf"))  # a text's words
    if marks is not None:
        at = marks.groupBy("query_id").agg(F.collect_list(F.struct("score", "m_seq")).alias("marks"))  # a bounded number a query
        each = at.join(each, "query_id", how)
    else:
        each = each.withColumn("marks", F.array().cast("array<struct<score:double,m_seq:long>>"))
    kind = {f.name: f.dataType for f in each.schema}["query_id"]
    out = T.StructType([T.StructField("q_ids", T.ArrayType(kind)), T.StructField("q_words", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("q_idfs", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("q_scores", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("q_seqs", T.ArrayType(T.ArrayType(T.LongType())))])
    each = each.select("query_id", F.coalesce("token", F.array().cast("array<string>")), F.coalesce("idf", F.array().cast("array<double>")), *[F.coalesce(f"marks.{c}", F.array().cast(f"array<{t}>")).alias(c) for c, t in (("score", "double"), ("m_seq", "long"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(at, QUERY_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([c.to_pylist()], pa.list_(c.type)) for c in part.columns], names=out.names)

    return each.mapInArrow(run, out)


def _listed(x) -> list:
    return x.to_pylist() if isinstance(x, pa.Array) else x


def _array(x, kind: pa.DataType) -> pa.Array:
    return x if isinstance(x, pa.Array) else pa.array(x, kind)


def _values(b: pa.RecordBatch, r: int) -> dict:
    """A row's lists as arrays and its binaries as buffers, without a Python object for each word."""
    return {name: c[r].as_buffer() if pa.types.is_binary(c.type) else c[r].values for name, c in zip(b.schema.names, b.columns, strict=True)}


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then those of the next."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class _Queries:
    """A block of queries as runs of words: query q asks for names[number[at[q]:at[q + 1]]]."""

    def __init__(self, words, idfs):
        words, idfs = _array(words, pa.list_(pa.string())), _array(idfs, pa.list_(pa.float64()))
        coded = words.flatten().dictionary_encode()
        self.names, self.number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.idf = idfs.flatten().to_numpy(zero_copy_only=False)
        self.at = np.append(0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False)))


class _Postings:
    """A row of the index, seen by one block of queries."""

    def __init__(self, row: dict, queries: _Queries, avgdl: float, block: int):
        self._read = lambda c, kind: np.frombuffer(row[c], kind)
        self.avgdl, self.dl, self.doc, self.tf = avgdl, self._read("dl", "<i4"), self._read("p_doc", "<u2").astype(np.intp), self._read("p_tf", "<i4")
        self.n, self.n_blocks, self.queries = len(self.dl), -(-len(self.dl) // block), queries
        self.h_at, h_term = np.append(self._read("h_at", "<i4"), len(self.doc)).astype(np.intp), self._read("h_term", "<i4")
        first = np.flatnonzero(np.diff(h_term, prepend=-1))  # first head of each word
        begin = self.h_at[first]
        term = pc.fill_null(pc.index_in(queries.names, value_set=_array(row["words"], pa.string())), -1).to_numpy(zero_copy_only=False)
        here = term >= 0

        def spans(starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
            start, length = np.zeros(len(term), np.intp), np.zeros(len(term), np.intp)
            start[here] = starts[term[here]]
            length[here] = np.append(starts, end)[term[here] + 1] - start[here]
            return start, length

        #: where each of the queries' words has its postings and its heads
        self.start, self.length = spans(begin, len(self.doc))
        self.head, self.heads = spans(first, len(h_term))
        self.asked = int(self.length[queries.number].sum())
        self._whole = self._bounds = None

    def _weights(self, at: np.ndarray) -> np.ndarray:
        return weight(self.tf[at], self.dl[self.doc[at]], self.avgdl)

    def whole(self, some: np.ndarray) -> np.ndarray:
        """Queries x documents scores, not rounded, of some queries."""
        q = self.queries
        if self._whole is None:
            dense = np.argsort(-self.length, kind="stable")[:DENSE_WORDS]
            dense = dense[self.length[dense] * DENSE >= max(self.n, 1)]
            column, rare = np.full(len(self.length), -1), self.length.copy()
            column[dense], rare[dense] = np.arange(len(dense)), 0
            m, at = np.zeros((len(dense), self.n)), _runs(self.start[dense], self.length[dense])
            m[np.repeat(np.arange(len(dense)), self.length[dense]), self.doc[at]] = self._weights(at)
            self._whole = column, rare, m, self._weights(slice(None))
        column, rare, m, weights = self._whole
        asks = np.zeros((len(some), len(m)))
        mine = [slice(q.at[i], q.at[i + 1]) for i in some.tolist()]
        for i, words in enumerate(mine):
            at = column[q.number[words]]
            asks[i, at[at >= 0]] = q.idf[words][at >= 0]
        out = asks @ m
        for i, words in enumerate(mine):
            number = q.number[words]
            length = rare[number]
            at = _runs(self.start[number], length)
            if len(at):
                out[i] += np.bincount(self.doc[at], weights[at] * np.repeat(q.idf[words], length), self.n)
        return out

    def bounds(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(heads of query i's words, their rarity, at least the query's best score in each block, whatever the order of
        additions)."""
        if self._bounds is None:
            self._bounds = self._read("h_block", "<u2").astype(np.intp), weight(self._read("h_tf", "<i4"), self._read("h_dl", "<i4"), self.avgdl)
        of, tops = self._bounds
        words = slice(self.queries.at[i], self.queries.at[i + 1])
        number = self.queries.number[words]
        at, idf = _runs(self.head[number], self.heads[number]), np.repeat(self.queries.idf[words], self.heads[number])
        return at, idf, np.bincount(of[at], idf * tops[at], self.n_blocks) * (1 + 1e-9) + 10.0**-DIGITS

    def of_blocks(self, blocks: np.ndarray, heads: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, int]:
        """(scores of all documents from the postings of some blocks alone, postings read)."""
        chosen = np.zeros(self.n_blocks, bool)
        chosen[blocks] = True
        some = chosen[self._bounds[0][heads]]
        start, length = self.h_at[heads[some]], self.h_at[heads[some] + 1] - self.h_at[heads[some]]
        at = _runs(start, length)
        return np.bincount(self.doc[at], self._weights(at) * np.repeat(idf[some], length), self.n), len(at)


def _best(row: dict, blocks: dict, avgdl: float, k: int, block: int, told: list | None = None) -> tuple[int, int]:
    """Brings the k best of a block of queries up to date with a row of the index; (postings read, asked for). Only the
    best are held between rows: the matrix of a block's words takes many times as much. told takes (query, ident, seq,
    score) of the documents q_seqs that the row holds."""
    of = _listed(row["q_ids"])
    key = of[0]
    if key not in blocks:
        blocks[key] = [of, np.zeros((len(of), k)), np.full((len(of), k), np.iinfo(np.int64).max), np.full((len(of), k), None, object)]
    _, best, seq, ident = blocks[key]
    p = _Postings(row, _Queries(row["q_words"], row["q_idfs"]), avgdl, block)
    ids, seqs = np.array(_listed(row["m_ids"]), object), np.array(_listed(row["m_seq"]), np.int64)
    read, small = 0, 10.0**-DIGITS

    def merge(q: int, s: np.ndarray) -> None:
        least = max(best[q, -1], small)  # what shares no word is no hit; ties with the last so far may come before it
        new = np.flatnonzero(s >= least - small)
        if len(new) > 2 * k:
            new = new[s[new] >= np.partition(s[new], len(new) - k)[len(new) - k] - small]
        score = rounded(s[new])
        new, score = new[score >= least], score[score >= least]
        if len(new):
            every, at = np.concatenate([best[q], score]), np.concatenate([seq[q], seqs[new]])
            top = np.lexsort((at, -every))[:k]
            best[q], seq[q], ident[q] = every[top], at[top], np.concatenate([ident[q], ids[new]])[top]

    wanted = [np.array(x, np.int64) for x in _listed(row["q_seqs"])] if told is not None else [()] * len(of)
    words = np.diff(p.queries.at)
    careful = np.array([n <= FEW_WORDS and not len(x) for n, x in zip(words.tolist(), wanted, strict=True)], bool)
    for q in np.flatnonzero(careful & (words > 0)).tolist():
        heads, idf, bound = p.bounds(q)
        order = np.argsort(-bound, kind="stable")
        lo, width = 0, 1
        while lo < len(order):
            some = order[lo : lo + width]
            lo, width = lo + width, min(2 * width, TOGETHER)
            some = some[(bound[some] >= best[q, -1]) & (bound[some] > 2 * small)]
            if not len(some):
                break  # those behind have no higher bound
            s, got = p.of_blocks(some, heads, idf)
            read += got
            merge(q, s)
    place = np.argsort(seqs, kind="stable")
    line = seqs[place]
    rest = np.flatnonzero(~careful)
    for lo in range(0, len(rest), PRODUCT):
        some = rest[lo : lo + PRODUCT]
        for q, s in zip(some.tolist(), p.whole(some), strict=True):
            read += int(p.length[p.queries.number[p.queries.at[q] : p.queries.at[q + 1]]].sum())
            merge(q, s)
            if len(wanted[q]):
                there = place[_found(line, wanted[q])]
                told.append(([of[q]] * len(there), ids[there].tolist(), seqs[there].tolist(), rounded(s[there]).tolist()))
    return read, p.asked


def _found(line: np.ndarray, seqs: np.ndarray) -> np.ndarray:
    """Where the sorted line holds values of seqs."""
    lo, hi = np.searchsorted(line, seqs), np.searchsorted(line, seqs, "right")
    return _runs(lo, hi - lo)


def postings(index: DataFrame) -> DataFrame:
    return index.drop("dfs", "n", "sum_dl")


def search(asked: Asked, index: DataFrame, k: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(query_id, memory_id, seq, bm25_score) of each query's k best documents that share a word, ties by seq."""
    return _first(_searched(asked, index, k, block_docs, None), k)


def search_and_tell(asked: Asked, index: DataFrame, k: int, wanted: DataFrame, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, DataFrame]:
    """What search gives, and the same columns of all documents of wanted(query_id, m_seq), a bounded number a query, in
    one pass over the index. Those that share no word have score 0."""
    every = materialize(_searched(asked, index, k, block_docs, wanted.withColumn("score", F.lit(None).cast("double"))))
    return _first(every.filter("NOT told").drop("told"), k), every.filter("told").drop("told")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("bm25_score"), F.asc("seq")]
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def _searched(asked: Asked, index: DataFrame, k: int, block_docs: int, wanted: DataFrame | None) -> DataFrame:
    """Each task's best and, with wanted, the documents asked for, told apart by a column told."""
    kind = {f.name: f.dataType.elementType for f in index.schema if f.name in ("m_ids", "m_seq")}
    q, avgdl, tell = _query_blocks(asked.words, wanted, "full"), asked.avgdl, wanted is not None
    fields = [T.StructField("query_id", q.schema["q_ids"].dataType.elementType), T.StructField("memory_id", kind["m_ids"]), T.StructField("seq", kind["m_seq"]), T.StructField("bm25_score", T.DoubleType())]
    schema = T.StructType(fields + [T.StructField("told", T.BooleanType())] * tell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict = {}
        types = None

        def rows(cols: list[list], told: bool) -> pa.RecordBatch:
            more = [pa.array([told] * len(cols[0]), pa.bool_())] * tell
            return pa.RecordBatch.from_arrays([*[pa.array(x, t) for x, t in zip(cols, [*types, pa.float64()], strict=True)], *more], names=schema.names)

        for b in batches:
            types = types or [b.schema.field(c).type.value_type for c in ("q_ids", "m_ids", "m_seq")]
            for r in range(b.num_rows):
                told = [] if tell else None
                _best(_values(b, r), blocks, avgdl, k, block_docs, told)
                if told:
                    yield rows([[v for x in told for v in x[i]] for i in range(4)], True)
        for of, best, seq, ident in blocks.values():
            q, c = np.nonzero(best > 0)
            yield rows([[of[i] for i in q.tolist()], ident[q, c].tolist(), seq[q, c].tolist(), best[q, c].tolist()], False)

    return met(postings(index), q).mapInArrow(run, schema)


def reading(asked: Asked, index: DataFrame, k: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row (postings_read, postings_asked): what a search reads of the postings of its queries' words."""
    avgdl = asked.avgdl

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict = {}
        for b in batches:
            got = [_best(_values(b, r), blocks, avgdl, k, block_docs) for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], names=["r", "a"])

    rows = met(postings(index), _query_blocks(asked.words)).mapInArrow(run, "r long, a long")
    return rows.agg(F.sum("r").alias("postings_read"), F.sum("a").alias("postings_asked"))


def ranks_of(marks: DataFrame, asked: Asked, index: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(query_id, score, m_seq, better): how many documents come before (score descending, m_seq) in each query's
    whole ranking, those that share no word included; marks(query_id, score, m_seq) are a bounded number a query. The
    document of a mark has the mark's score, whatever the order of additions."""
    kind = marks.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("score", T.DoubleType()), T.StructField("m_seq", T.LongType()), T.StructField("better", T.LongType())])
    avgdl = asked.avgdl

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict = {}
        types = None
        for b in batches:
            types = types or b.schema.field("q_ids").type.value_type
            for r in range(b.num_rows):
                row = _values(b, r)
                of = _listed(row["q_ids"])
                if of[0] not in blocks:
                    marked = [np.array(x) for x in _listed(row["q_scores"])], [np.array(x, np.int64) for x in _listed(row["q_seqs"])]
                    blocks[of[0]] = of, *marked, [np.zeros(len(x), np.int64) for x in marked[0]]
                _, scores, seqs, counts = blocks[of[0]]
                p, at = _Postings(row, _Queries(row["q_words"], row["q_idfs"]), avgdl, block_docs), np.array(_listed(row["m_seq"]), np.int64)
                place = np.argsort(at, kind="stable")
                line = at[place]
                for lo in range(0, len(of), PRODUCT):
                    some = np.arange(lo, min(lo + PRODUCT, len(of)))
                    for q, s in zip(some.tolist(), p.whole(some), strict=True):
                        s = rounded(s)
                        for j in np.flatnonzero(np.searchsorted(line, seqs[q], "right") > np.searchsorted(line, seqs[q])).tolist():
                            s[place[_found(line, seqs[q][j : j + 1])]] = scores[q][j]
                        counts[q] += ahead_of(s, at, scores[q], seqs[q])
        for of, scores, seqs, counts in blocks.values():
            ids = [i for i, c in zip(of, counts, strict=True) for _ in range(len(c))]
            cols = [pa.array(ids, types), *[pa.array(np.concatenate([*x, np.zeros(0, kind)]), t) for x, kind, t in ((scores, float, pa.float64()), (seqs, np.int64, pa.int64()), (counts, np.int64, pa.int64()))]]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    q = _query_blocks(asked.words, marks)
    return met(postings(index), q).mapInArrow(run, schema).groupBy("query_id", "score", "m_seq").agg(F.sum("better").alias("better"))
