"""A written index for exact vector search that changes by commits.

Vectors at unit length lie in blocks: shells of like angle around the nearest of some pivots. By the triangle
inequality no vector of a shell is nearer to a query than the query's own distance from the shell, so a block
is compared with those queries alone whose k-th best so far it can reach. Additions are blocks of a new
version, removals marks on rows of blocks; a search reads a version's blocks without the marked rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.versions import Log
from ..tables import checked_broadcast, is_small, materialize, met
from .text_index import rounded

#: Pivots at most, drawn from the first pool by a hash of its ids; vectors of a block; queries of a block.
PIVOTS, BLOCK, QUERY_BLOCK = 256, 512, 512
#: Angles are taken to be this much nearer than they come out.
SLACK = 1e-9


def _units(vectors: list, dim: int) -> np.ndarray:
    """Rows at unit length; missing, zero, odd-sized and broken vectors are zeros."""
    m = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim and None not in v:
            m[i] = v
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _drawn(pool: DataFrame, pivots: int) -> dict:
    """Pivots, vectors of the pool at unit length, and their length."""
    real = pool.filter(F.exists("emb", lambda x: x != 0))
    drawn = [r.emb for r in real.orderBy(F.xxhash64("memory_id"), "memory_id").limit(pivots).select("emb").collect()]
    dim = len(drawn[0]) if drawn else 0
    return {"pivots": _units([v for v in drawn if len(v) == dim], dim).tolist(), "dim": dim}


def _pivots(entry: dict) -> np.ndarray:
    return np.array(entry["pivots"], float).reshape(len(entry["pivots"]), entry["dim"])


def _angles(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


class VectorIndex:
    """The index in a folder that driver and executors share, at one version."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.log = spark, Log(spark, path)
        self.version = self.log.latest() if version is None else version
        self.entry = self.log.read(self.version)

    @classmethod
    def create(cls, pool: DataFrame, path: str, pivots: int = PIVOTS) -> VectorIndex:
        """An index of pool(memory_id, seq, emb). Vectors that are missing, zero or not as long as the pivots are
        no part of it."""
        spark = pool.sparkSession
        log = Log(spark, path)
        entry = _drawn(pool, pivots) | {"parts": [], "gone": []}
        entry["parts"] = [_write(pool, entry, log.fresh(), 0)]
        log.commit(entry, 0)
        return cls(spark, path)

    def change(self, put: DataFrame | None = None, remove: DataFrame | None = None) -> VectorIndex:
        """The index at a new version: put(memory_id, seq, emb) added or in place of their namesakes, the memories
        of remove(memory_id) gone. What is written grows with the change, not with the index. Fails with Conflict
        if another change came first."""
        entry = dict(self.entry)
        at = len(entry["parts"])
        ids = [d.select("memory_id") for d in (put, remove) if d is not None]
        if ids:
            out = materialize(ids[0].unionByName(ids[1]).distinct() if len(ids) > 1 else ids[0].distinct())
            rows = self.blocks().select("block", F.posexplode("m_ids").alias("place", "memory_id"))
            marks = rows.join(checked_broadcast(out), "memory_id", "left_semi").groupBy("block").agg(F.collect_list("place").alias("places"))  # a block's rows
            folder = self.log.fresh()
            marks.write.parquet(folder)
            entry["gone"] = [*entry["gone"], folder]
        if put is not None:
            if not entry["dim"]:  # nothing has been indexed yet
                entry |= _drawn(put, PIVOTS)
            entry["parts"] = [*entry["parts"], _write(put, entry, self.log.fresh(), at)]
        return VectorIndex(self.spark, self.log.path, self.log.commit(entry, self.version))

    def compact(self) -> VectorIndex:
        """The same memories at a new version of one part, without marks."""
        entry = {**self.entry, "parts": [], "gone": []}
        live = self.rows()
        entry["parts"] = [_write(live, entry, self.log.fresh(), 0)]
        return VectorIndex(self.spark, self.log.path, self.log.commit(entry, self.version))

    def retire(self, keep: int = 1) -> list[str]:
        """Deletes all versions but the last `keep`, and what only they read."""
        return self.log.retire(keep, lambda e: [*e["parts"], *e["gone"]])

    def blocks(self) -> DataFrame:
        """All parts' blocks, with the places of rows that are gone."""
        every = self.spark.read.parquet(*self.entry["parts"])
        if not self.entry["gone"]:
            return every.withColumn("places", F.array().cast("array<int>"))
        marks = self.spark.read.parquet(*self.entry["gone"]).groupBy("block").agg(F.flatten(F.collect_list("places")).alias("places"))
        return every.join(checked_broadcast(marks), "block", "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))

    def rows(self) -> DataFrame:
        """(memory_id, seq, emb) of what the index holds; vectors are at unit length."""
        of = self.blocks()
        kinds = {n: of.schema[n].dataType.elementType for n in ("m_ids", "m_seq")}
        schema = T.StructType([T.StructField("memory_id", kinds["m_ids"]), T.StructField("seq", kinds["m_seq"]), T.StructField("emb", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    row = b.slice(r, 1).to_pylist()[0]
                    keep = np.setdiff1d(np.arange(len(row["m_ids"])), row["places"]).tolist()
                    m = np.frombuffer(row["m"]).reshape(len(row["m_ids"]), -1)[keep].tolist()
                    yield pa.RecordBatch.from_pylist([{"memory_id": row["m_ids"][i], "seq": row["m_seq"][i], "emb": v} for i, v in zip(keep, m, strict=True)], schema=pa.schema([("memory_id", b.schema.field("m_ids").type.value_type), ("seq", b.schema.field("m_seq").type.value_type), ("emb", pa.list_(pa.float64()))]))

        return of.select("m_ids", "m_seq", "m", "places").mapInArrow(run, schema)

    def _scan(self, of: DataFrame, queries: DataFrame, k: int, near_only: bool) -> DataFrame:
        """Candidates (query_id, memory_id, seq, cos) that hold each query's k best of the blocks `of`, and a row
        without memory for each task, with the pairs compared as seq and all pairs as cos. queries have q_least,
        a score that their k-th best reaches. near_only: only blocks of a query's nearest pivot."""
        pivots, dim = _pivots(self.entry), self.entry["dim"]
        q_kind = queries.schema["query_id"].dataType
        packed = T.StructType([T.StructField("q_ids", T.ArrayType(q_kind)), T.StructField("q_least", T.ArrayType(T.DoubleType())), T.StructField("q_m", T.BinaryType())])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, QUERY_BLOCK):
                    part = b.slice(at, QUERY_BLOCK)
                    m = _units(part.column(2).to_pylist(), dim)
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.schema.field(0).type)), pa.array([part.column(1).to_pylist()], pa.list_(pa.float64())), pa.array([m.tobytes()], pa.binary())], names=packed.names)

        q = queries.select("query_id", "q_least", "q_emb").mapInArrow(pack, packed)
        schema = T.StructType([T.StructField("query_id", q_kind), T.StructField("memory_id", of.schema["m_ids"].dataType.elementType), T.StructField("seq", T.LongType()), T.StructField("cos", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: dict = {}
            compared = pairs = 0
            types = None
            for b in batches:
                types = types or [b.schema.field(c).type.value_type for c in ("q_ids", "m_ids")]
                for r in range(b.num_rows):
                    row = b.slice(r, 1).to_pylist()[0]
                    key = row["q_ids"][0]
                    if key not in state:
                        n = len(row["q_ids"])
                        units = np.frombuffer(row["q_m"]).reshape(n, dim)
                        to_pivots = _angles(units @ pivots.T)
                        least = np.array([-2.0 if x is None else x for x in row["q_least"]])
                        state[key] = [row["q_ids"], units, to_pivots, to_pivots.argmin(1), least, np.full((n, k), -2.0), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), None, object)]
                    ids, units, to_pivots, nearest, least, best, seq, who = state[key]
                    live = np.setdiff1d(np.arange(len(row["m_ids"])), row["places"])
                    pairs += len(ids) * len(live)
                    far = to_pivots[:, row["pivot"]]
                    bound = np.cos(np.clip(np.maximum(row["lo"] - far, far - row["hi"]) - SLACK, 0.0, np.pi)) + 10.0**-8
                    # a query without direction has cosine 0 with everything
                    bound = np.where((units != 0).any(1), bound, 1.0)
                    alive = np.flatnonzero(nearest == row["pivot"] if near_only else bound >= np.maximum(least, best[:, -1]))
                    if not len(alive) or not len(live):
                        continue
                    compared += len(alive) * len(live)
                    m = np.frombuffer(row["m"]).reshape(len(row["m_ids"]), dim)[live]
                    cos = rounded(units[alive] @ m.T)
                    every = np.concatenate([best[alive], cos], 1)
                    at = np.concatenate([seq[alive], np.broadcast_to(np.array(row["m_seq"], np.int64)[live], cos.shape)], 1)
                    names = np.concatenate([who[alive], np.broadcast_to(np.array(row["m_ids"], object)[live], cos.shape)], 1)
                    top = np.lexsort((at, -every), axis=1)[:, :k]
                    best[alive], seq[alive], who[alive] = (np.take_along_axis(x, top, 1) for x in (every, at, names))
            for ids, *_, best, seq, who in state.values():
                i, j = np.nonzero(best > -2.0)
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i.tolist()], types[0]), pa.array(who[i, j].tolist(), types[1]), pa.array(seq[i, j], pa.int64()), pa.array(best[i, j], pa.float64())], names=schema.names)
            if types:
                yield pa.RecordBatch.from_arrays([pa.array([None], types[0]), pa.array([None], types[1]), pa.array([compared], pa.int64()), pa.array([float(pairs)], pa.float64())], names=schema.names)

        return met(of.select("pivot", "lo", "hi", "m_ids", "m_seq", "m", "places"), q).mapInArrow(run, schema)

    def _found(self, queries: DataFrame, k: int) -> DataFrame:
        own = "cur_node" in queries.columns
        keep = k + 1 if own else k  # one more, as a query leaves itself out
        asked = queries.select("query_id", "q_emb")
        near = self._scan(self.blocks(), asked.withColumn("q_least", F.lit(None).cast("double")), keep, True).filter("query_id IS NOT NULL")
        reach = near.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos")))).filter(F.col("_r") == keep).select("query_id", F.col("cos").alias("q_least"))
        return self._scan(self.blocks(), asked.join(checked_broadcast(materialize(reach)), "query_id", "left"), keep, False)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, memory_id, seq, cos, rank): the k memories of the index most similar to each query(query_id,
        q_emb), exactly, ties by seq. Queries with a cur_node are memories, which leave themselves out. The
        blocks around each query's nearest pivot come first; their k-th best bounds what others must reach."""
        rows = self._found(queries, k).filter("query_id IS NOT NULL")
        if "cur_node" in queries.columns:
            rows = rows.filter("query_id != memory_id")
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "seq")).cast("long")).filter(F.col("rank") <= k)

    def skipped(self, queries: DataFrame, k: int) -> DataFrame:
        """One row (compared, pairs): the pairs of queries and vectors that a search multiplies, of all there are,
        after the first blocks."""
        return self._found(queries, k).filter("query_id IS NULL").agg(F.sum("seq").alias("compared"), F.sum("cos").cast("long").alias("pairs"))


def _write(rows: DataFrame, entry: dict, folder: str, part: int) -> str:
    """rows as blocks of a new folder. They are sorted by nearest pivot and angle, ranges of which go to tasks, so
    any number of equal vectors is cut into blocks as well."""
    pivots, dim = _pivots(entry), entry["dim"]
    kinds = {n: rows.schema[n].dataType for n in ("memory_id", "seq")}
    placed = T.StructType([T.StructField(n, t) for n, t in kinds.items()] + [T.StructField("pivot", T.IntegerType()), T.StructField("far", T.DoubleType()), T.StructField("v", T.BinaryType())])
    out = T.StructType([T.StructField("block", T.StringType()), T.StructField("pivot", T.IntegerType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("m_ids", T.ArrayType(kinds["memory_id"])), T.StructField("m_seq", T.ArrayType(kinds["seq"])), T.StructField("m", T.BinaryType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _units(b.column(2).to_pylist(), dim)
            real = np.flatnonzero((m != 0).any(1))
            cos = m[real] @ pivots.T
            pivot = cos.argmax(1) if len(real) else np.zeros(0, np.int64)
            far = _angles(cos[np.arange(len(real)), pivot])
            at = pa.array(real)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(pivot, pa.int32()), pa.array(far, pa.float64()), pa.array([v.tobytes() for v in m[real]], pa.binary())], names=placed.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        def block(held: list[dict]) -> pa.RecordBatch:
            cols = [[f"{part}-{uuid4().hex}"], [held[0]["pivot"]], [held[0]["far"]], [held[-1]["far"]], [[r["memory_id"] for r in held]], [[r["seq"] for r in held]], [b"".join(r["v"] for r in held)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=out.names)

        held: list[dict] = []
        for b in batches:
            types = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.list_(b.schema.field(0).type), pa.list_(b.schema.field(1).type), pa.binary()]
            for row in b.to_pylist():
                if held and (row["pivot"] != held[0]["pivot"] or len(held) == BLOCK):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    sorted_rows = rows.select("memory_id", "seq", "emb").mapInArrow(place, placed)
    placed_rows = materialize(sorted_rows)
    if is_small(placed_rows, rows=4 * BLOCK):  # a small change makes few blocks
        ranges = placed_rows.repartition(1)
    else:
        ranges = placed_rows.repartitionByRange("pivot", "far", F.xxhash64("memory_id"))
    ranges.sortWithinPartitions("pivot", "far").mapInArrow(cut, out).write.parquet(folder)
    return folder
