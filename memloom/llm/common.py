"""What the operators share: bounded Arrow batches and column handling."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import discard, join_hot, materialize, numbered, scratch, scratch_dir  # noqa: F401

#: Bytes that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches sent to Python are cut at this many bytes, so very long texts do not pile up.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096

#: Rows of a block of row_blocks are 2 ** BLOCK_BITS; so many blocks are broadcast at once (about a kilobyte each).
BLOCK_BITS, MOST_BLOCKS = 12, 1 << 15


def hide(df: DataFrame, **needs: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with the columns named in needs under their keys and all others under names no operator uses,
    and a function that gives a frame made from it df's own names, order and columns back."""
    low = [c.lower() for c in df.columns]
    at = {(df.columns.index(c) if c in df.columns else low.index(c.lower())): key for key, c in needs.items()}
    inner = [at.get(i, f"__carried_{i}") for i in range(len(df.columns))]
    return df.toDF(*inner), lambda out: out.select(*inner).toDF(*df.columns)


def bound_batches(spark: SparkSession) -> None:
    """Cap the session's Arrow batches by bytes and rows unless they are capped lower already. The caps
    hold from then on, as plans made here run after this call; they bound memory and change no result."""
    for key, most in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
    ):
        now = spark.conf.get(key).rstrip("b")
        now = int(now) if now.isdigit() else 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without columns whose names clash (in any case) with names an operator adds."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def arrow_columns(
    df: DataFrame,
    make: Callable[..., Sequence[pa.Array]],
    inputs: Sequence[str],
    outputs: Sequence[T.StructField],
) -> DataFrame:
    """df plus the columns that make(*input arrays) returns, batch by batch in Python workers.

    Columns of df that clash with an output are dropped; all others pass through unread.
    """
    bound_batches(df.sparkSession)
    names = [f.name for f in outputs]
    at = [df.columns.index(c) for c in inputs]
    stay = [i for i, c in enumerate(df.columns) if c.lower() not in {n.lower() for n in names}]
    schema = T.StructType([df.schema[i] for i in stay] + list(outputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(make(*[b.column(i) for i in at]))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in stay] + made, names=[b.schema.names[i] for i in stay] + names
            )

    return df.mapInArrow(run, schema)


def field(name: str, kind: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, kind, nullable)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_BLOCK = f"shiftright(row, {BLOCK_BITS})"
_WORD = f"cast(shiftright(row, 6) & {(1 << BLOCK_BITS - 6) - 1} AS int)"
_BIT = "cast(row & 63 AS int)"


def row_blocks(kept: DataFrame) -> DataFrame:
    """kept(row) as a written table (block, words) of bitmaps, one row for each block of row numbers."""
    bits = kept.groupBy(F.expr(_BLOCK).alias("block"), F.expr(_WORD).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {_BIT})")).alias("bits"))
    return materialize(bits.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words")))


def rows_in(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of df, a written table, whose row is in blocks; the bitmaps go to the scan, so no row moves.

    Row numbers come from monotonically_increasing_id, so they rise within each file. Where there are more
    than MOST_BLOCKS blocks, as many scans as needed each read a range of row numbers (other files are
    skipped by their statistics) with the blocks of that range.
    """

    def scan(rows: DataFrame, some: DataFrame) -> DataFrame:
        hit = f"(shiftrightunsigned(try_element_at(words, {_WORD}), {_BIT}) & 1) = 1"
        return rows.withColumn("block", F.expr(_BLOCK)).join(F.broadcast(some), "block").filter(hit).select(df.columns)

    parts = -(-blocks.count() // MOST_BLOCKS)
    if parts <= 1:
        return scan(df, blocks)
    at = [k / parts for k in range(1, parts)]
    cuts = sorted(set(blocks.agg(F.percentile_approx("block", at, 100 * parts)).first()[0]))
    out = None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        rows, some = df, blocks
        if lo is not None:
            rows, some = rows.filter(F.col("row") >= lo << BLOCK_BITS), some.filter(F.col("block") >= lo)
        if hi is not None:
            rows, some = rows.filter(F.col("row") < hi << BLOCK_BITS), some.filter(F.col("block") < hi)
        out = scan(rows, some) if out is None else out.unionByName(scan(rows, some))
    return out
