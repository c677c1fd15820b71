"""Sharding by histogram sort.

Rows are ordered by a byte key. Splitters that cut the order into shards of near equal bytes are
found by counting, over all partitions, the exact bytes below candidate boundaries; each round
draws new candidates from the rows inside the brackets that are still too wide, until every splitter
is within tolerance. Only then do rows move, once.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, documents, field, materialize, scratch

#: Candidate boundaries drawn for each open bracket in a round.
PROBES = 32
#: A splitter may be off by this share of a shard's bytes (or by one row, if rows are larger).
TOLERANCE = 0.002
MAX_ROUNDS = 60


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc(text: Column) -> Column:
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")


def _bucket(keys: pa.Array, cuts: np.ndarray) -> pa.Array:
    """How many cuts are at or below each key."""
    width = cuts.dtype.itemsize
    k = np.array(keys.to_pylist(), dtype=f"S{width}") if len(keys) else np.array([], f"S{width}")
    return pa.array(np.searchsorted(cuts, k, side="right").astype("i4"), pa.int32())


def _with_bucket(keyed: DataFrame, cuts: list[bytes], name: str) -> DataFrame:
    if not cuts:
        return keyed.withColumn(name, F.lit(0))
    table = np.array(cuts, dtype=f"S{len(cuts[0])}")
    return arrow_columns(keyed, lambda k: [_bucket(k, table)], ["key"], [field(name, T.IntegerType())])


def find_splitters(keyed: DataFrame, n_shards: int, tolerance: float = TOLERANCE, probes: int = PROBES, max_rounds: int = MAX_ROUNDS) -> list[bytes]:
    """n_shards - 1 keys (fewer for few rows) that cut keyed(key, size, uid) into near equal bytes.

    A bracket is what lies between the two nearest counted candidates around a target. Each round draws
    new candidates from the rows in the brackets still too wide and counts the exact bytes below every
    candidate. The driver holds about probes candidates for each splitter, whatever the number of rows.
    Fails if some splitter is still off after max_rounds.
    """
    total, rows = keyed.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not rows:
        return []
    targets = [total * i / n_shards for i in range(1, n_shards)]
    allowed = max(1.0, tolerance * total / n_shards)
    cuts: list[bytes] = []
    below: list[int] = []  # bytes below each cut
    counts = [rows]  # rows between neighbouring cuts
    wanted = {0: probes * n_shards}
    for round_no in range(max_rounds):
        share = F.create_map(*[x for b, n in wanted.items() for x in (F.lit(b), F.lit(min(1.0, n / max(1, counts[b]))))])
        # a row is drawn by a hash of its number, so a lost task draws the same rows again
        draw = F.pmod(F.xxhash64(F.lit(round_no), F.col("uid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = _with_bucket(keyed, cuts, "bucket").filter(draw < F.coalesce(share[F.col("bucket")], F.lit(0.0)))
        cuts = sorted({bytes(r.key) for r in drawn.select("key").collect()} | set(cuts))
        got = {r.bucket: (r.b, r.n) for r in _with_bucket(keyed, cuts, "bucket").groupBy("bucket").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
        counts = [got.get(i, (0, 0))[1] for i in range(len(cuts) + 1)]
        below = np.cumsum([got.get(i, (0, 0))[0] for i in range(len(cuts))], dtype=object).tolist()
        near = {t: [j for j in (bisect_left(below, t) - 1, bisect_left(below, t)) if 0 <= j < len(below)] for t in targets}
        best = {t: min(near[t], key=lambda j, t=t: abs(below[j] - t), default=None) for t in targets}
        # a bracket of one row cannot be cut further
        open_ = {bisect_left(below, t) for t in targets if (best[t] is None or abs(below[best[t]] - t) > allowed) and counts[bisect_left(below, t)] > 1}
        if not open_:
            return sorted(cuts[best[t]] if best[t] is not None else b"" for t in targets)
        # of the candidates only those next to a target have work left
        keep = sorted({j for js in near.values() for j in js})
        edges = [-1, *keep, len(cuts)]
        wanted = {k: probes for k in range(len(keep) + 1) if any(edges[k] < i <= edges[k + 1] for i in open_)}
        counts = [sum(counts[edges[k] + 1 : edges[k + 1] + 1]) for k in range(len(edges) - 1)]
        cuts, below = [cuts[j] for j in keep], [below[j] for j in keep]
    raise RuntimeError(f"splitters miss the tolerance after {max_rounds} rounds")


def shard(df: DataFrame, n_shards: int = 16, text: str = "text", ident: str = "doc_id", probes: int = PROBES, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(ident, size, text_crc32, shard, slot) for every row of df, in shards of near equal bytes.

    The order is (CRC of the text, ident, row number), so equal texts stand together and a group of
    copies larger than a shard is still cut. slot counts from 0 without gaps in this order. Rows move
    once, by ranges of the order, in as many sort tasks as the session has shuffle partitions; of each
    task and shard one row counts where its slots begin. Null texts have size 1 and CRC 0; null idents
    come first among equal texts; repeated rows each get a slot; a text of any length is one row of its
    size; an empty table gives an empty result; other columns of df are ignored.
    """
    keyed = df.select(
        F.col(f"`{ident}`").alias("ident"), text_size(F.col(f"`{text}`")).alias("size"), text_crc(F.col(f"`{text}`")).alias("crc"),
        F.monotonically_increasing_id().alias("uid"),
    )
    wide = lambda c, n: F.lpad(F.hex(c), n, "0")
    sign = F.lit(-(1 << 63)).cast("long")
    ident_key = F.when(F.col("ident").isNull(), F.lit("0" * 16)).otherwise(wide(F.col("ident").cast("long").bitwiseXOR(sign), 16))
    # 01 at the end keeps zero bytes significant where fixed-width byte strings are compared
    keyed = keyed.withColumn("key", F.unhex(F.concat(wide(F.col("crc"), 8), F.when(F.col("ident").isNull(), F.lit("00")).otherwise(F.lit("01")), ident_key, wide(F.col("uid"), 16), F.lit("01"))))
    with scratch() as keep:
        keyed = materialize(keyed)
        cuts = find_splitters(keyed, n_shards, probes=probes, max_rounds=max_rounds)
        sharded = _with_bucket(keyed, cuts, "shard")
        place = F.monotonically_increasing_id()  # the task, then the row's place in it
        placed = sharded.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key").withColumns({"piece": F.shiftright(place, 33).cast("int"), "at": place.bitwiseAND(F.lit((1 << 33) - 1))})
        placed = keep(materialize(placed.drop("key", "uid")))
    runs = placed.groupBy("shard", "piece").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("shard", "piece", (before - F.col("begin")).alias("shift"))
    # one row for each sort task and shard: spark.sql.shuffle.partitions + n_shards at most
    return placed.join(F.broadcast(starts), ["shard", "piece"]).select(
        F.col("ident").alias(ident), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") + F.col("shift")).alias("slot"),
    )


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op4_histogram_sharding": op4_sharding}
ORACLES: dict[str, str] = {}
