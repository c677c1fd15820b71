"""Each query's best and first memories within each of its sources, without a table of all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import FREQUENCY_RATE, HEAD, TIME_DECAY
from ..schema import DEFAULT_WEIGHTS, DIMS
from ..tables import checked_broadcast
from .retrieval import POOL_BLOCK, QUERY_BLOCK, blocks
from .text_index import rounded

#: What a score needs besides the vectors.
_QUERY, _MEMORY = ("now", "q_task", "owner_node"), ("seq", "ts", "access_count", "task_tag", "owner_node")


def _number(xs: list) -> np.ndarray:
    return np.array([np.nan if x is None else x for x in xs], float)


def finals(cos: np.ndarray, now: list, q_task: list, ts: list, count: list, tag: list) -> np.ndarray:
    """score_full's final of a block of queries with a block of memories, rounded, from their rounded cosines that are
    also their vector scores."""
    hours = (_number(now)[:, None] - _number(ts)) / 3600.0
    time = np.exp(-TIME_DECAY * np.where(hours > 0, hours, 0.0))  # unknown times count as now
    code = {x: i for i, x in enumerate(dict.fromkeys([*q_task, *tag]))}
    a, b = (np.array([-1 if x is None else code[x] for x in xs]) for xs in (q_task, tag))
    task = np.where((a[:, None] < 0) | (b < 0), 0.5, np.where(a[:, None] == b, 1.0, 0.3))
    scores = {"time": time, "semantic": (HEAD[0] + HEAD[1]) * cos, "frequency": 1.0 - np.exp(-FREQUENCY_RATE * _number(count)), "task": task}
    total = sum(DEFAULT_WEIGHTS[d] for d in DIMS)
    return rounded(sum(DEFAULT_WEIGHTS[d] * scores[d] for d in DIMS) / total)


def best_in_scope(queries: DataFrame, pool: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """(query_id, memory_id, owner_node, seq, cos, final): of each of a query's sources(query_id, node_id) the k memories
    of the highest final by score_full, ties by seq, the query itself left out. Blocks of queries meet blocks of
    memories of their sources, each pair in one matrix product that keeps k rows a query."""
    own = sources.select("query_id", F.col("node_id").alias("owner_node")).distinct()
    q = blocks(queries.select("query_id", "q_emb", "now", "q_task").join(own, "query_id"), "query_id", "q_emb", QUERY_BLOCK, "q", _QUERY, "owner_node")
    m = blocks(pool, "memory_id", "emb", POOL_BLOCK, "m", _MEMORY, "owner_node")
    kinds = [dict(zip(d.columns, (f.dataType for f in d.schema), strict=True))[c] for d, c in ((queries, "query_id"), (pool, "memory_id"), (pool, "owner_node"), (pool, "seq"))]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(("query_id", "memory_id", "owner_node", "seq"), kinds, strict=True)] + [T.StructField(n, T.DoubleType()) for n in ("cos", "final")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [b.schema.field(c).type.value_type for c in ("q_ids", "m_ids", "m_owner_node", "m_seq")]
            for r in range(b.num_rows):
                row = b.slice(r, 1).to_pylist()[0]
                n_q, n_m = len(row["q_ids"]), len(row["m_ids"])
                x, y = (np.frombuffer(row[f"{t}_m"]).reshape(n, -1) for t, n in (("q", n_q), ("m", n_m)))
                cos = rounded(x @ y.T) if row["q_dim"] == row["m_dim"] else np.zeros((n_q, n_m))
                final = finals(cos, row["q_now"], row["q_q_task"], row["m_ts"], row["m_access_count"], row["m_task_tag"])
                at = {m: j for j, m in enumerate(row["m_ids"])}
                place = np.argsort(np.argsort(np.array(row["m_seq"]), kind="stable"))
                i_s, j_s = [], []
                for i, s in enumerate(final):
                    if row["q_ids"][i] in at:
                        s[np.array([m == row["q_ids"][i] for m in row["m_ids"]])] = -np.inf
                    some = np.flatnonzero(s >= np.partition(s, n_m - k)[n_m - k]) if n_m > k else np.arange(n_m)
                    best = some[np.lexsort((place[some], -s[some]))[:k]]
                    best = best[s[best] > -np.inf]
                    i_s += [i] * len(best)
                    j_s += best.tolist()
                cols = [[row["q_ids"][i] for i in i_s], *[[row[c][j] for j in j_s] for c in ("m_ids", "m_owner_node", "m_seq")]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array(cos[i_s, j_s]), pa.array(final[i_s, j_s])], names=schema.names)

    value = lambda df, tag: df.withColumn("_same", F.get(f"{tag}_owner_node", F.lit(0))).filter("_same IS NOT NULL")
    found = value(m, "m").join(checked_broadcast(value(q, "q")), "_same").drop("_same").mapInArrow(run, schema)
    order = Window.partitionBy("query_id", "owner_node").orderBy(F.desc("final"), "seq")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def first_of_each(pool: DataFrame, k: int) -> DataFrame:
    """The first k + 1 memories of each source in writing order: k of them stand for any query, which leaves itself out."""
    order = Window.partitionBy("owner_node").orderBy("seq")
    return pool.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).drop("_r")
