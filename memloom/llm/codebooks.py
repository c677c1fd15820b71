"""Vector codes: each of a vector's parts is replaced by the index of its nearest codebook entry.

Codebooks come from rounds of assignment and means over integer components, so every number is exact and
reruns agree. The nearest entry is found by exponion search: from the entry of the round before, whose
neighbours are sorted by distance, only those inside a ball that must hold every nearer entry are scanned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, discard, hide, join_hot, materialize

#: A component x becomes floor(SCALE * x).
SCALE = 1024
#: Vectors assigned together hold about so many components.
STEP = 1 << 20
#: Neighbours scanned at a time: doubled from the first number on.
FIRST_SCAN = 16


class Codebook:
    """Entries (n x d integers) of one part, with each entry's neighbours sorted by distance."""

    def __init__(self, entries: np.ndarray, exact: type):
        self.c = entries.astype(exact)
        self.norm = (self.c * self.c).sum(1)
        apart = self.norm[:, None] + self.norm[None, :] - 2 * (self.c @ self.c.T)
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the entry nearest to each row of x, ties to the lower index; start: an
        entry for each row to search from.

        An entry no farther from x than the best so far is at most |x - start| + best away from start. The
        radius is rounded up, and rows are scanned in runs of equal start.
        """
        x = x.astype(self.c.dtype)
        xx = (x * x).sum(1)
        own = self.c[start]
        first = xx + self.norm[start] - 2 * (x * own).sum(1)
        best, index = first.copy(), start.astype(np.int64).copy()
        order = np.argsort(start, kind="stable")
        starts, begins = np.unique(start[order], return_index=True)
        for a, rows in zip(starts.tolist(), np.split(order, begins[1:]), strict=True):
            near, apart, at, width = self.near[a], self.apart[a], 0, FIRST_SCAN
            while len(rows) and at < len(near):
                some = np.sort(near[at : at + width])  # so that the first least is the lowest index
                d = xx[rows, None] + self.norm[some] - 2 * (x[rows] @ self.c[some].T)
                k = d.argmin(1)
                least, which = d[np.arange(len(rows)), k], some[k]
                better = (least < best[rows]) | ((least == best[rows]) & (which < index[rows]))
                best[rows[better]], index[rows[better]] = least[better], which[better]
                at, width = at + width, 2 * width
                if at < len(near):
                    radius = np.sqrt(first[rows].astype(float)) + np.sqrt(best[rows].astype(float))
                    rows = rows[apart[at] <= radius * radius * (1 + 1e-9) + 1]
        return index, best


def _books(entries: list[np.ndarray], most: int) -> list[Codebook]:
    """Double precision holds all sums exactly below 2**53 and multiplies faster; long integers hold the rest."""
    return [Codebook(e, np.float64 if max(1, e.shape[1]) * (2 * most + 2) ** 2 < 1 << 53 else np.int64) for e in entries]


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length as rows of numbers, without a copy."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return raw.view(kind).reshape(len(column), -1) if len(raw) else np.zeros((len(column), 0), kind)


def _cuts(dim: int, parts: int) -> list[int]:
    """Where parts begin and end: equal if dim allows, else one longer at the front."""
    return np.cumsum([0, *[dim // parts + (p < dim % parts) for p in range(parts)]]).tolist()


def _packed(rows: DataFrame, vec: str, dim: int, kind: str) -> DataFrame:
    """rows with vec as the bytes of its integers."""
    schema = T.StructType([T.StructField(vec, T.BinaryType()) if f.name == vec else f for f in rows.schema])
    at = rows.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.floor(b.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(kind)
            raw = m.reshape(b.num_rows, dim).tobytes()
            width = dim * m.itemsize
            offsets = pa.py_buffer((np.arange(b.num_rows + 1, dtype=np.int64) * width).astype(np.int32).tobytes())
            cols = [*b.columns]
            cols[at] = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, offsets, pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least `rows` rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _assigned(rows: DataFrame, entries: list[np.ndarray], dim: int, kind: str, most: int) -> DataFrame:
    """rows(..., __v, __code) with the codes of the nearest entries, searched from the codes so far (null: the
    first entry), and __error, the squared distances summed over parts."""
    code = len(rows.columns) - 1
    schema = T.StructType([*rows.schema.fields, T.StructField("__error", T.LongType())])
    cuts = _cuts(dim, len(entries))
    step = max(1024, STEP // max(1, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(entries, most)
        for b in _gathered(batches, step):
            x, n = _matrix(b.column(code - 1), kind), b.num_rows
            before = np.zeros((n, len(books)), np.uint16) if b.column(code).null_count else _matrix(b.column(code), "<u2")
            found = [book.nearest(x[:, lo:hi], before[:, p]) for p, (book, lo, hi) in enumerate(zip(books, cuts, cuts[1:], strict=False))]
            codes = np.stack([i for i, _ in found], 1).astype("<u2")
            error = np.sum([d.astype(np.int64) for _, d in found], axis=0)
            offsets = pa.py_buffer((np.arange(n + 1) * 2 * len(books)).astype(np.int32).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*b.columns[:code], packed, pa.array(error, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _means(rows: DataFrame, entries: list[np.ndarray], dim: int, kind: str) -> list[np.ndarray]:
    """Each entry replaced by the floored mean of its parts; unused entries stay. A task adds up what it reads
    and gives one row for each entry and component; the driver sees their sums, as many as the codebooks hold."""
    cuts = _cuts(dim, len(entries))
    size = len(entries[0])
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("place", "total", "n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, dim), np.int64), np.zeros((size, len(entries)), np.int64)
        for b in batches:
            x, codes = _matrix(b.column(0), kind), _matrix(b.column(1), "<u2")
            for p, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                order = np.argsort(codes[:, p], kind="stable")
                used, at = np.unique(codes[order, p], return_index=True)
                if len(used):
                    total[used, lo:hi] += np.add.reduceat(x[order, lo:hi].astype(np.int64), at, axis=0)
                    n[:, p] += np.bincount(codes[:, p], minlength=size)
        each = np.repeat(n, np.diff(cuts), axis=1)
        place = np.flatnonzero(each)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (place, total.ravel()[place], each.ravel()[place])], names=schema.names)

    sums = rows.select("__v", "__code").mapInArrow(run, schema).groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    out = np.concatenate(entries, axis=1)
    if sums.num_rows:
        place, total, n = (sums.column(c).to_numpy() for c in ("place", "total", "n"))
        out.ravel()[place] = total // n  # floors down
    return [out[:, lo:hi].copy() for lo, hi in zip(cuts, cuts[1:], strict=False)]


def compress(df: DataFrame, ident: str = "vec_id", vec: str = "embedding", parts: int = 4, size: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """(df without vec plus code and error, final codebooks).

    code: the index of each part's nearest entry, two hex digits each (as many as size needs); error: the
    squared distances summed over parts. Codebooks start as the parts of the `size` rows of the least
    idents, fewer if df holds fewer. Rows whose vector is null or holds null or non-finite components are
    dropped. Vectors as long as most others are kept too, all others get null code and error. Null idents
    come last; rows of one ident are taken by their vectors' order, and repeated rows get equal codes. A
    dimension that parts do not divide gives the first parts one component more. Empty tables give empty results
    and empty codebooks. Components beyond 2**28 / SCALE fail, as distances would pass 64 bits. Columns of df named
    code or error (in any case) are replaced, all others stay.
    """
    spark = df.sparkSession
    bound_batches(spark)
    stays = [c for c in df.columns if c.lower() not in ("code", "error")]
    rows, _ = hide(df.select(*[F.col(f"`{c}`") for c in stays]), __id=ident, __v=vec)
    others = [(c, h) for c, h in zip(stays, rows.columns, strict=True) if h != "__v"]
    sound = F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.filter(sound)
    by_dim = rows.groupBy(F.size("__v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("__v", lambda x: F.abs(x.cast("double"))))).alias("most"))
    usual = by_dim.orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, most = (usual[0].dim, int(np.floor((usual[0].most or 0) * SCALE)) + 1) if usual else (0, 1)
    if max(1, dim) * (2 * most + 2) ** 2 >= 1 << 62:
        raise ValueError(f"components of {vec} are too large for exact 64-bit distances")
    kind = "<i2" if most < 1 << 15 else "<i4"

    fits = F.size("__v") == dim
    now = materialize(_packed(rows.filter(fits).withColumn("__v", F.col("__v").cast("array<double>")).select(*[h for _, h in others], "__v"), "__v", dim, kind).withColumn("__code", F.lit(None).cast("binary")))
    head = now.orderBy(F.asc_nulls_last("__id"), "__v").limit(size).select("__v").collect()
    first = np.array([np.frombuffer(r[0], kind) for r in head], np.int64).reshape(len(head), dim)
    cuts = _cuts(dim, parts)
    books = [first[:, lo:hi].copy() for lo, hi in zip(cuts, cuts[1:], strict=False)]
    for _ in range(rounds if len(head) else 0):
        after = materialize(_assigned(now, books, dim, kind, most).drop("__error"))
        discard(now)
        now = after
        books = _means(now, books, dim, kind)
    digits = max(2, len(f"{size - 1:x}"))
    # a code's little-endian bytes become digits in the order of parts
    two = [F.hex(F.concat(F.substring("__code", 2 * p + 2, 1), F.substring("__code", 2 * p + 1, 1))) for p in range(parts)]
    code = F.lower(F.concat(*[F.substring(d, 5 - digits, digits) for d in two]))
    out = _assigned(now, books, dim, kind, most).select(*[h for _, h in others], code.alias("code"), F.col("__error").alias("error"))
    odd = rows.filter(~fits).select(*[h for _, h in others], F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return out.unionByName(odd).toDF(*[c for c, _ in others], "code", "error"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def op11(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    # a label's key; nulls have one of their own
    coded = materialize(coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))))
    total = coded.groupBy("key").agg(F.sum("error").alias("label_error"))
    return join_hot(coded, total, "key").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Assignments and means round by round, over parts as lists of numbers that double precision holds exactly."""
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS s FROM kept, range(4) AS parts(p))",
        "c0 AS MATERIALIZED (SELECT p, i, s FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM kept QUALIFY i < 256) JOIN x USING (vec_id))",
    ]
    for r in range(5):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, x.p, x.s, min((list_inner_product(x.s, x.s) + list_inner_product(c.s, c.s) - 2 * list_inner_product(x.s, c.s))::HUGEINT * 256 + c.i) AS best FROM x JOIN c{r} c ON x.p = c.p GROUP BY ALL)"
        )
        if r < 4:
            steps.append(f"m{r} AS (SELECT p, best % 256 AS i, j, floor(sum(s[j]) / count(*)) AS y FROM a{r}, range(1, len(s) + 1) AS g(j) GROUP BY ALL)")
            steps.append(f"l{r} AS (SELECT p, i, list(y ORDER BY j) AS s FROM m{r} GROUP BY p, i)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.i, coalesce(l.s, c.s) AS s FROM c{r} c LEFT JOIN l{r} l ON c.p = l.p AND c.i = l.i)")
    steps += [
        "coded AS (SELECT vec_id, string_agg(printf('%02x', (best % 256)::BIGINT), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM a4 GROUP BY vec_id)",
        "books AS (SELECT sha256(string_agg(array_to_string(list_transform(s, lambda y: y::BIGINT), ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM c4)",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books"


QUERIES = {"op11_vector_codes": op11}
ORACLES = {"op11_vector_codes": _sql()}
