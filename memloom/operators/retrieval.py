"""Retrieval: queries against a memory pool, keyed by query_id.

A pool has memory_id, seq (its order of insertion) and text or emb; queries have query_id and q_text
or q_emb. Every retriever keeps the k best by (score descending, seq), and adds rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dot, l2_normalise
from ..tables import checked_broadcast, materialize, met
from . import text_index
from .text_index import DIGITS, ahead_of, rounded

RRF = 60
#: Vectors of a block: one matrix product compares a block of queries with a block of memories.
QUERY_BLOCK, POOL_BLOCK = 1024, 4096


def top_k(df: DataFrame, k: int | None, score: str, key: str = "query_id", tie: str = "seq", rank: str = "rank") -> DataFrame:
    """rank (from 1) by score descending within each key; the first k rows of each key, or all for None."""
    order = Window.partitionBy(key).orderBy(F.desc(score), tie)
    ranked = df.withColumn(rank, F.row_number().over(order).cast("long"))
    return ranked.filter(F.col(rank) <= k) if k else ranked


def _itself(queries: DataFrame) -> bool:
    """Whether the queries are memories of the pool, which each leaves itself out of."""
    return "cur_node" in queries.columns


def pairs(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Each query with each other memory; a query set seen to be small goes to the pool's tasks."""
    joined = pool.join(checked_broadcast(queries))
    return joined.filter(F.col("memory_id") != F.col("query_id")) if _itself(queries) else joined


def retrieve_full(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """The first k of the pool in its order."""
    head = pool.orderBy("seq").limit(k + 1)  # one more, as a query leaves itself out
    return top_k(pairs(queries, head).withColumn("_s", F.lit(0.0)), k, "_s").drop("_s")


def unit(df: DataFrame, vec: str, name: str) -> DataFrame:
    """df plus vec at unit length (zeros if missing), so that a pair costs one product."""
    return df.withColumn(name, F.coalesce(l2_normalise(F.col(vec)), F.array().cast("array<double>")))


def with_cosine(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs plus cos."""
    joined = pairs(unit(queries, "q_emb", "_q"), unit(pool, "emb", "_m"))
    return joined.withColumn("cos", F.round(F.coalesce(dot(F.col("_q"), F.col("_m")), F.lit(0.0)), DIGITS)).drop("_q", "_m")


def units(column: pa.ListArray) -> np.ndarray:
    """A matrix of vectors at unit length. Missing, zero and odd-sized vectors are zero vectors."""
    lengths = column.value_lengths()
    dim = pc.max(lengths).as_py() or 0
    values = column.flatten()
    if lengths.null_count == values.null_count == 0 and pc.min(lengths).as_py() == dim:
        m = values.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)
    else:
        m = np.zeros((len(column), dim))
        for i, v in enumerate(column.to_pylist()):
            if v is not None and len(v) == dim and None not in v:
                m[i] = v
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def blocks(df: DataFrame, ident: str, vec: str, size: int, tag: str, more: tuple[str, ...] = (), by: str | None = None) -> DataFrame:
    """Rows (<tag>_ids, <tag>_<more>..., <tag>_dim, <tag>_m) of up to `size` vectors at unit length, packed where
    they are. by names one of more: a block then holds rows of one of its values."""
    kinds = dict(zip(df.columns, (f.dataType for f in df.schema), strict=True))
    lists = [(f"{tag}_ids", ident), *[(f"{tag}_{m}", m) for m in more]]
    schema = T.StructType([T.StructField(n, T.ArrayType(kinds[c])) for n, c in lists] + [T.StructField(f"{tag}_dim", T.IntegerType()), T.StructField(f"{tag}_m", T.BinaryType())])

    def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        runs = [b]
        if by and b.num_rows:
            column = b.column(1 + more.index(by))
            codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            runs = [b.take(pa.array(at)) for at in np.split(np.argsort(codes, kind="stable"), np.flatnonzero(np.diff(np.sort(codes))) + 1)]
        for some in runs:
            for at in range(0, some.num_rows, size):
                yield some.slice(at, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b):
                m = units(part.column(len(lists)))
                cols = [pa.array([part.column(i).to_pylist()], pa.list_(part.column(i).type)) for i in range(len(lists))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=schema.names)

    return df.select(*[c for _, c in lists], vec).mapInArrow(run, schema)


def nearest(queries: DataFrame, pool: DataFrame, k: int, differ: str | None = None, same: str | None = None) -> DataFrame:
    """(query_id, memory_id, seq, cos, rank): the k memories most similar to each query, exactly.

    Blocks of queries meet blocks of memories, each pair in one matrix product that keeps k rows a query;
    the queries' blocks are broadcast if seen to be few. A task gives out what could still be among its k best.
    differ names a column of both: a query leaves out memories of its own value (nulls are one) and of its own id.
    same names a column of both: a query, which may stand there with several values, meets memories of these alone
    (nulls meet none), block by block.
    """
    more = tuple(c for c in (differ, same) if c)
    q = blocks(queries, "query_id", "q_emb", QUERY_BLOCK, "q", more, same)
    m = blocks(pool, "memory_id", "emb", POOL_BLOCK, "m", ("seq", *more), same)
    keep = k + 1 if _itself(queries) else k  # one more, as a query leaves itself out
    kinds = [dict(zip(d.columns, (f.dataType for f in d.schema), strict=True))[c] for d, c in ((queries, "query_id"), (pool, "memory_id"), (pool, "seq"))]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(("query_id", "memory_id", "seq"), kinds, strict=True)] + [T.StructField("cos", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict = {}  # the best scores of each block of queries, without whose they are
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1).to_pylist()[0]
                n_q, n_m = len(row["q_ids"]), len(row["m_ids"])
                a, c = (np.frombuffer(row[f"{t}_m"]).reshape(n, -1) for t, n in (("q", n_q), ("m", n_m)))
                cos = a @ c.T if row["q_dim"] == row["m_dim"] else np.zeros((n_q, n_m))
                if differ:
                    equal = lambda x, y: np.array(x, object)[:, None] == np.array(y, object)
                    cos[equal(row[f"q_{differ}"], row[f"m_{differ}"]) | equal(row["q_ids"], row["m_ids"])] = -np.inf
                place = np.argsort(np.argsort(np.array(row["m_seq"], object) if isinstance(row["m_seq"][0], str) else np.array(row["m_seq"]), kind="stable"))
                tops = so_far.setdefault(tuple(row["q_ids"]), np.full((n_q, keep), -np.inf))
                at, scores = [[], []], [np.zeros(0)]
                for i in range(n_q):
                    some = np.flatnonzero(cos[i] >= tops[i, 0] - 10.0**-DIGITS)
                    s = rounded(cos[i, some])
                    if len(some) > keep:
                        least = np.partition(s, len(s) - keep)[len(s) - keep]
                        some, s = some[s >= least], s[s >= least]
                    best = np.lexsort((place[some], -s))[:keep]
                    best = best[(s[best] >= tops[i, 0]) & (s[best] > -np.inf)]
                    every = np.concatenate([tops[i], s[best]])
                    tops[i] = np.partition(every, len(every) - keep)[len(every) - keep :]  # the least first
                    at[0] += [i] * len(best)
                    at[1] += some[best].tolist()
                    scores.append(s[best])
                cols = [[row["q_ids"][i] for i in at[0]], [row["m_ids"][j] for j in at[1]], [row["m_seq"][j] for j in at[1]], np.concatenate(scores).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (b.schema.field("q_ids").type.value_type, b.schema.field("m_ids").type.value_type, b.schema.field("m_seq").type.value_type, pa.float64()), strict=True)], names=schema.names)

    if same:
        value = lambda df, tag: df.withColumn("_same", F.get(f"{tag}_{same}", F.lit(0))).filter("_same IS NOT NULL")
        both = value(m, "m").join(checked_broadcast(value(q, "q")), "_same").drop("_same")
    else:
        both = met(m, q)
    found = both.mapInArrow(run, schema)
    found = found.filter(F.col("memory_id") != F.col("query_id")) if _itself(queries) else found
    return top_k(found, k, "cos")


def retrieve_vector(queries: DataFrame, pool: DataFrame, k: int | None, parity: bool = False) -> DataFrame:
    """By cosine; missing and zero vectors score 0. Queries without a q_emb column are ranked by the pool's
    stored vector_score. parity takes the k best of the whole pool before a column `visible` filters them, as
    the original does; otherwise what is not visible does not compete."""
    if "q_emb" not in queries.columns:
        return top_k(pairs(queries, pool).withColumn("cos", F.coalesce("vector_score", F.lit(0.0))), k, "cos")
    if "visible" in pool.columns and not parity:
        pool = pool.filter("visible")
    if k is None:
        out = top_k(with_cosine(queries, pool), k, "cos")
    else:
        hits = materialize(nearest(queries, pool, k))  # k rows a query
        out = pool.drop("seq").join(checked_broadcast(hits), "memory_id").join(checked_broadcast(queries), "query_id")
    if "visible" in pool.columns and parity:
        out = out.filter("visible")
    return out.withColumn("vector_score", F.col("cos"))


def retrieve_bm25(queries: DataFrame, pool: DataFrame, k: int, index: DataFrame | None = None, asked: text_index.Asked | None = None) -> DataFrame:
    """By BM25 over the visible pool, through its inverted index (built here unless given). Where fewer than k
    share a token, memories without one follow in the pool's order: they lie among the pool's first 2k + 1, so no
    other zero scores are formed."""
    keep = k + 1 if _itself(queries) else k
    index = index or text_index.build(pool)
    return _with_head(text_index.search(asked or text_index.ask(queries, index), index, keep), queries, pool, k)


def _with_head(best: DataFrame, queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """The k best of hits and, behind them, of the pool's first."""
    head = pool.orderBy("seq").limit(2 * k + 1).select("memory_id", "seq")
    rest = pairs(queries, head).select("query_id", "memory_id", "seq", F.lit(0.0).alias("bm25_score"))
    # a memory of the head that is a hit stands in both; its hit counts, or lies behind the k best anyway
    every = best.unionByName(rest).groupBy("query_id", "memory_id", "seq").agg(F.max("bm25_score").alias("bm25_score"))
    if _itself(queries):
        every = every.filter("query_id != memory_id")
    return top_k(every, k, "bm25_score")


def cosines(wanted: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, memory_id, cos) of the pairs wanted(query_id, memory_id)."""
    rows = pool.select("memory_id", "emb").join(checked_broadcast(wanted), "memory_id").join(checked_broadcast(queries.select("query_id", "q_emb")), "query_id")
    schema = T.StructType([wanted.schema["query_id"], wanted.schema["memory_id"], T.StructField("cos", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = units(b.column(2)), units(b.column(3))
            cos = rounded(np.einsum("ij,ij->i", a, c)) if a.shape == c.shape else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cos)], names=schema.names)

    return rows.select("query_id", "memory_id", "q_emb", "emb").mapInArrow(run, schema)


def vector_ranks(marks: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, score, m_seq, better): how many memories come before (cos descending, m_seq) in each query's whole
    ranking; marks(query_id, score, m_seq) are a bounded number a query. Blocks are counted where they meet."""
    lists = marks.groupBy("query_id").agg(F.collect_list("score").alias("score"), F.collect_list("m_seq").alias("m_seq"))  # a bounded number
    q = blocks(queries.join(lists, "query_id"), "query_id", "q_emb", QUERY_BLOCK, "q", ("score", "m_seq"))
    m = blocks(pool, "seq", "emb", POOL_BLOCK, "m")
    schema = T.StructType([T.StructField("query_id", marks.schema["query_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("m_seq", T.LongType()), T.StructField("better", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1).to_pylist()[0]
                n_q, n_m, at = len(row["q_ids"]), len(row["m_ids"]), np.array(row["m_ids"], np.int64)
                a, c = (np.frombuffer(row[f"{t}_m"]).reshape(n, -1) for t, n in (("q", n_q), ("m", n_m)))
                cos = a @ c.T if row["q_dim"] == row["m_dim"] else np.zeros((n_q, n_m))
                counts = [ahead_of(rounded(s), at, np.array(scores), np.array(seqs, np.int64)) for s, scores, seqs in zip(cos, row["q_score"], row["q_m_seq"], strict=True)]
                ids = [i for i, x in zip(row["q_ids"], row["q_score"], strict=True) for _ in x]
                cols = [pa.array(ids, b.schema.field("q_ids").type.value_type), *[pa.array([v for x in row[c] for v in x], t) for c, t in (("q_score", pa.float64()), ("q_m_seq", pa.int64()))], pa.array(np.concatenate(counts), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return met(m, q).mapInArrow(run, schema).groupBy("query_id", "score", "m_seq").agg(F.sum("better").alias("better"))


def rank_of_own(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, cos, rank): the best memory of each query's own node, the query itself left out, and its rank over the
    whole pool. What comes before it is counted block by block; no table of all pairs is formed."""
    own = nearest(queries.withColumn("owner_node", F.col("cur_node")), pool, 1, same="owner_node")
    best = materialize(own.select("query_id", F.col("cos").alias("score"), F.col("seq").alias("m_seq")))  # a row a query
    ahead = vector_ranks(best, queries, pool)
    # the counts hold the query's own memory, which has no rank
    itself = unit(pool.join(best.select(F.col("query_id").alias("memory_id")), "memory_id", "left_semi"), "emb", "_m")
    itself = itself.select(F.col("memory_id").alias("query_id"), F.col("seq").alias("_own"), F.round(F.coalesce(dot(F.col("_m"), F.col("_m")), F.lit(0.0)), DIGITS).alias("_cos"))
    first = F.col("_own").isNotNull() & ((F.col("_cos") > F.col("score")) | ((F.col("_cos") == F.col("score")) & (F.col("_own") < F.col("m_seq"))))
    return ahead.join(itself, "query_id", "left").select("query_id", F.col("score").alias("cos"), (F.col("better") - first.cast("long") + 1).alias("rank"))


def retrieve_rrf(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of the whole BM25 and vector rankings, exactly, from the first ranks of either.

    The k first of one ranking score 1 / (RRF + k) or more; what neither ranking has among its first 2k + RRF scores
    less, so it cannot be among the k best. The ranks of those candidates in the other ranking are counted block
    by block; no table of all pairs is formed."""
    depth, own = 2 * k + RRF, _itself(queries)
    queries, pool = materialize(queries), materialize(pool)  # each is read many times
    index = text_index.build(pool)
    asked = text_index.ask(queries, index)
    near = materialize(nearest(queries, pool, depth).withColumnRenamed("rank", "vector_rank"))
    wanted = near.select("query_id", F.col("seq").alias("m_seq"))
    if own:  # a query's own memory has no rank, but the counts below hold it
        wanted = wanted.unionByName(pool.join(checked_broadcast(queries.select(F.col("query_id").alias("memory_id"))), "memory_id").select(F.col("memory_id").alias("query_id"), F.col("seq").alias("m_seq")))
    hits, told = text_index.search_and_tell(asked, index, depth + 1 if own else depth, wanted)
    words = _with_head(hits, queries, pool, depth).withColumnRenamed("rank", "bm25_rank")

    # both scores of all candidates, then their ranks where the ranking does not hold them among its first
    first = near.unionByName(words, allowMissingColumns=True).unionByName(told, allowMissingColumns=True)
    first = materialize(first.groupBy("query_id", "memory_id").agg(*[F.max(c).alias(c) for c in ("seq", "cos", "bm25_score", "vector_rank", "bm25_rank")]))
    cos = cosines(first.filter("cos IS NULL").select("query_id", "memory_id"), queries, pool).withColumnRenamed("cos", "_cos")
    both = materialize(first.join(cos, ["query_id", "memory_id"], "left").withColumn("cos", F.coalesce("cos", "_cos")).drop("_cos"))
    mine, found = both.filter("query_id = memory_id"), both.filter("query_id != memory_id") if own else both
    marks = lambda rank, score: found.filter(F.col(rank).isNull()).select("query_id", F.col(score).alias("score"), F.col("seq").alias("m_seq")).distinct()
    no_vector, no_word = marks("vector_rank", "cos"), marks("bm25_rank", "bm25_score")
    by_vector = vector_ranks(no_vector, queries, pool).select("query_id", F.col("score").alias("cos"), F.col("m_seq").alias("seq"), F.col("better").alias("_v"))
    by_words = text_index.ranks_of(no_word, asked, index).select("query_id", F.col("score").alias("bm25_score"), F.col("m_seq").alias("seq"), F.col("better").alias("_w"))
    found = found.join(by_vector, ["query_id", "cos", "seq"], "left").join(by_words, ["query_id", "bm25_score", "seq"], "left")
    if own:
        mine = mine.select("query_id", F.col("seq").alias("_own"), F.col("cos").alias("_own_cos"), F.col("bm25_score").alias("_own_bm25"))
        found = found.join(checked_broadcast(mine), "query_id", "left")
        ahead = lambda s, o: (F.col("_own").isNotNull() & ((F.col(o) > F.col(s)) | ((F.col(o) == F.col(s)) & (F.col("_own") < F.col("seq"))))).cast("long")
        found = found.withColumns({"_v": F.col("_v") - ahead("cos", "_own_cos"), "_w": F.col("_w") - ahead("bm25_score", "_own_bm25")})
    ranked = found.withColumns({"vector_rank": F.coalesce("vector_rank", F.col("_v") + 1), "bm25_rank": F.coalesce("bm25_rank", F.col("_w") + 1)})
    fused = ranked.withColumn("rrf_score", F.round(1.0 / (RRF + F.col("bm25_rank")) + 1.0 / (RRF + F.col("vector_rank")), 12))
    best = top_k(fused.select("query_id", "memory_id", "seq", "cos", "bm25_score", "bm25_rank", "vector_rank", "rrf_score"), k, "rrf_score")
    return pool.drop("seq").join(checked_broadcast(materialize(best)), "memory_id").join(checked_broadcast(queries), "query_id").withColumn("vector_score", F.col("cos"))


def isolated(pool: DataFrame, user_id=None, session_id=None) -> DataFrame:
    """The memories that a user's session may see; filtering precedes recall."""
    for name, value in (("user_id", user_id), ("session_id", session_id)):
        if value is not None:
            pool = pool.filter(F.col(name) == value)
    return pool


def get(pool: DataFrame, memory_id) -> DataFrame:
    """The row of one memory."""
    return pool.filter(F.col("memory_id") == memory_id)


def put(pool: DataFrame, changes: DataFrame) -> DataFrame:
    """pool with changes (whole rows, one for each memory_id) added or put in place of their namesakes."""
    return pool.join(changes.select("memory_id"), "memory_id", "left_anti").unionByName(changes, allowMissingColumns=True)


def remove(pool: DataFrame, gone: DataFrame) -> DataFrame:
    """pool without the memories of gone(memory_id)."""
    return pool.join(gone.select("memory_id").distinct(), "memory_id", "left_anti")


def indexed(pool: DataFrame) -> DataFrame:
    """The memories that vector search may return: those with a vector that is not zero."""
    return pool.filter(F.exists("emb", lambda x: x != 0))


def in_scope(queries: DataFrame, pool: DataFrame, sources: DataFrame) -> DataFrame:
    """Pairs of queries and all memories of their sources(query_id, node_id), plus cos."""
    own = sources.select("query_id", F.col("node_id").alias("owner_node")).distinct()
    rows = unit(pool, "emb", "_m").join(checked_broadcast(own), "owner_node").join(checked_broadcast(unit(queries, "q_emb", "_q")), "query_id")
    rows = rows.filter(F.col("memory_id") != F.col("query_id"))
    return rows.withColumn("cos", F.round(F.coalesce(dot(F.col("_q"), F.col("_m")), F.lit(0.0)), DIGITS)).drop("_q", "_m")


def scoped_recall(queries: DataFrame, pool: DataFrame, sources: DataFrame, k: int, fallback_all: bool = True, include_self: bool = False) -> DataFrame:
    """The k most similar memories within each query's scope: those of its sources, with include_self also of its
    own node. A query whose scope holds no memory searches the whole pool if fallback_all."""
    scope = sources.select("query_id", "node_id")
    if include_self:
        scope = scope.unionByName(queries.select("query_id", F.col("cur_node").alias("node_id")))
    usable = scope.join(pool.select(F.col("owner_node").alias("node_id")).distinct(), "node_id", "left_semi")
    asked = queries.join(usable.select("query_id", F.col("node_id").alias("owner_node")).distinct(), "query_id")
    hits = materialize(nearest(asked, pool, k, same="owner_node"))  # k rows a query
    rows = pool.drop("seq").join(checked_broadcast(hits), "memory_id").join(checked_broadcast(queries), "query_id").withColumn("vector_score", F.col("cos"))
    if not fallback_all:
        return rows
    lost = materialize(queries.join(usable.select("query_id").distinct(), "query_id", "left_anti"))
    return rows.unionByName(retrieve_vector(lost, pool, k)) if lost.limit(1).count() else rows


RETRIEVERS = {"full": retrieve_full, "bm25": retrieve_bm25, "vector": retrieve_vector, "rrf": retrieve_rrf, "reme": retrieve_full}


def get_retriever(name: str):
    """By name, with or without the prefix 'retriever.'; KeyError if unknown."""
    return RETRIEVERS[name.removeprefix("retriever.")]
