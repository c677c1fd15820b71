"""Tables written on the way: lineage that ends at files, joins on hot keys, ranks without one task.

Intermediate tables live in the folder that spark.checkpoint.dir names, which the driver and all
executors share; a scope deletes those that nothing reads any more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only on a local master that names no shared folder (tests).
LOCAL_SCRATCH = "/tmp/checkpoints"

#: The HOT most frequent keys of more than HOT_ROWS rows are hot, so any key that holds more than 1 / HOT of very many rows is.
HOT, HOT_ROWS = 256, 4096
#: A table is broadcast only if it has been seen to hold so many rows, of so many bytes in all, at most.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Only a local master may do without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = LOCAL_SCRATCH
    return path.rstrip("/")


_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialized inside are deleted at the end, but for those given to the function yielded here.

    Those a lazy result still reads are kept; an enclosing scope may delete them in turn.
    """
    outer, kept = _made.get(), []
    token = _made.set([])

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        made = _made.get()
        _made.reset(token)
        for df in made:
            if not any(df is k for k in kept):
                discard(df)
            elif outer is not None:
                outer.append(df)


def materialize(df: DataFrame, alone: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive executors. alone: rows of many
    MB, each a row group of its own, as a reader holds up to 4,096 rows of one in memory."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.row.count.limit", 1) if alone else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _made.get() is not None:
        _made.get().append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that no later plan reads."""
    spark, path = df.sparkSession, df.scratch_path
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _size(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(value) + 16
    if isinstance(kind, T.StructType):
        return sum((F.coalesce(_size(value[f.name], f.dataType), F.lit(0)) for f in kind), F.lit(16))
    if isinstance(kind, T.MapType):
        return _size(F.map_keys(value), T.ArrayType(kind.keyType)) + _size(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            return F.aggregate(value, F.lit(16).cast("long"), lambda s, x: s + F.coalesce(_size(x, kind.elementType), F.lit(0)))
        return F.size(value) * 8 + 16
    return F.lit(8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a look at rows + 1 of df's rows shows no more than rows and no more than size bytes."""
    each = sum((F.coalesce(_size(F.col(f"`{f.name}`"), f.dataType), F.lit(0)) for f in df.schema), F.lit(0)).cast("long")
    n, total = df.select(each.alias("size")).limit(rows + 1).agg(F.count(F.lit(1)), F.sum("size")).first()
    return n <= rows and (total or 0) <= size


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS, size: int | None = None) -> DataFrame:
    """df, to be broadcast if it is seen to be small."""
    return F.broadcast(df) if is_small(df, most, BROADCAST_BYTES if size is None else size) else df


def met(big: DataFrame, small: DataFrame) -> DataFrame:
    """Rows of big, blocks, each with every row of small: broadcast if seen to be small, else both are written and
    meet piece by piece, so that neither is made twice."""
    if is_small(small):
        return big.crossJoin(F.broadcast(small))
    return materialize(big).crossJoin(materialize(small))


def join_hot(big: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Inner join on a key that small holds once and few keys of big may hold most rows of.

    The rows of small for the hot keys of big, the HOT most frequent ones of more than HOT_ROWS rows, are
    broadcast; all others meet in a shuffle. big is read twice or more, so it should be a written table.
    """
    counts = big.groupBy(on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS)
    hot = [r[0] for r in counts.orderBy(F.desc("n")).limit(HOT).select(on).collect()]
    if not hot:
        return big.join(small, on)
    is_hot = F.col(on).isin(hot)
    return big.filter(is_hot).join(F.broadcast(small.filter(is_hot)), on).unionByName(big.filter(~is_hot).join(small.filter(~is_hot), on))


def numbered(df: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """df in sorted pieces, with columns piece and at, and a table (piece, before).

    before + at numbers all rows from 0 in the given order. Rows move once, by ranges of the order; what
    is gathered is one row for each piece, of which there are as many as shuffle partitions.
    """
    ids = F.monotonically_increasing_id()
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"piece": F.shiftright(ids, 33).cast("int"), "at": ids.bitwiseAND(F.lit((1 << 33) - 1))}))
    pieces = placed.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return placed, pieces.select("piece", (F.sum("n").over(Window.orderBy("piece")) - F.col("n")).alias("before"))
