"""SimHash near-duplicates by exact comparison of tiles.

A text's fingerprint is a 64-bit majority vote over its shingles. Distinct fingerprints are sorted by
the population counts of their bytes and packed into tiles; a pair of tiles, and inside it a pair of
blocks, is compared (exclusive-or and bit count in numpy) unless the bounds of those counts prove that
all its members differ in more bits than the radius. Each comparison returns a spanning forest of the
links it found, never all pairs, and the forests are joined into components by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, bound_batches, discard, documents, field, join_hot, materialize, numbered, scratch

SEED = 42
#: Words of a shingle; links join fingerprints that differ in at most RADIUS bits.
SHINGLE, RADIUS = 4, 4
#: A tile holds about a TILES-th of the fingerprints, within these bounds, and is compared in blocks.
TILES, TILE_ROWS, BLOCK = 32, (4096, 262_144), 256
#: Comparisons of fingerprints that make a task; a pair of tiles is never parted.
TASK_WORK = 1 << 27
#: From so many shingles on, votes are counted by byte histograms.
HISTOGRAM = 1500

_POP = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int16)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    starts = (stop - size)[: len(words) - width + 1].tolist()
    return majority(np.array([digest(line[a:b], SEED) for a, b in zip(starts, stop[width - 1 :].tolist(), strict=True)], np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of h."""
    raw = h.view(np.uint8).reshape(-1, 8)
    if len(h) < HISTOGRAM:
        votes = np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        votes = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fp", width: int = SHINGLE) -> DataFrame:
    """df plus the fingerprint as a signed long of the same bits."""

    def make(col: pa.Array):
        fps = np.array([fingerprint(t, width) for t in col.to_pylist()], np.uint64)
        return [pa.array(fps.view(np.int64), pa.int64())]

    return arrow_columns(df, make, [text], [field(name, T.LongType())])


def _boxes(fps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest population count of each byte in the runs of fps that begin at starts."""
    pops = _POP[fps.view(np.uint8).reshape(-1, 8)]
    return np.minimum.reduceat(pops, starts, axis=0), np.maximum.reduceat(pops, starts, axis=0)


def _apart(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """A lower bound of the differing bits between any members of two boxes, for all pairs of boxes."""
    out = np.zeros((len(lo_a), len(lo_b)), np.int16)
    for k in range(8):
        gap = np.maximum(lo_a[:, None, k] - hi_b[None, :, k], lo_b[None, :, k] - hi_a[:, None, k])
        out += np.maximum(gap, 0)
    return out


class Forest:
    """Union by least index over arrays of links; edges collects one link for each union."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                return r
            r = up

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.roots(u), self.roots(v)
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low < high
            if not open_.any():
                return
            u, v, low, high = u[open_], v[open_], low[open_], high[open_]
            order = np.lexsort((low, high))
            first = order[np.r_[True, np.diff(high[order]) > 0]]
            self.parent[high[first]] = low[first]
            self.edges.append((high[first], low[first]))
            self.parent[u], self.parent[v] = self.roots(u), self.roots(v)


def compare(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of fingerprints) that connect what a and b connect; b None compares a with itself."""
    own = b is None
    b = a if own else b
    sa, sb = np.arange(0, len(a), BLOCK), np.arange(0, len(b), BLOCK)
    near = np.argwhere(_apart(*_boxes(a, sa), *_boxes(b, sb)) <= radius)
    both = a if own else np.concatenate([a, b])
    forest, shift = Forest(len(both)), 0 if own else len(a)
    for i, j in near:
        if own and j < i:
            continue
        x, y = a[sa[i] : sa[i] + BLOCK], b[sb[j] : sb[j] + BLOCK]
        hit = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
        if own and i == j:
            hit = np.triu(hit, 1)
        if hit.any():
            u, v = np.nonzero(hit)
            forest.link(u + sa[i], v + sb[j] + shift)
    if not forest.edges:
        return both[:0], both[:0]
    u, v = (np.concatenate(x) for x in zip(*forest.edges, strict=True))
    return both[u], both[v]


def _tiles(distinct: DataFrame, rows: int) -> DataFrame:
    """Tiles (tile, n, lo, hi, least, most, fps) of equal numbers of fingerprints that are alike in byte counts,
    however many partitions there are; lo and hi bound the population count of each byte, least and most
    that of the whole."""
    size = min(TILE_ROWS[1], max(TILE_ROWS[0], -(-rows // TILES)))
    pops = {f"p{k}": F.bit_count(F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255))) for k in range(8)}
    placed, pieces = numbered(distinct.select("fp").withColumns(pops), *pops, "fp")
    # one row for each sort task: spark.sql.shuffle.partitions at most
    ranked = placed.join(F.broadcast(pieces), "piece").select(F.floor((F.col("at") + F.col("before")) / size).cast("long").alias("tile"), "fp")
    schema = "tile long, n int, lo array<int>, hi array<int>, least int, most int, fps binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for b in batches:
            names, fps = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(names)) + 1):
                if len(part) and names[part[0]] != tile:
                    if held:
                        yield packed(tile, held)
                    tile, held = names[part[0]], []
                held.append(fps[part])
        if held:
            yield packed(tile, held)

    def packed(tile: int, held: list[np.ndarray]) -> pa.RecordBatch:
        fps = np.concatenate(held).astype(np.int64).view(np.uint64)
        pop = _POP[fps.view(np.uint8).reshape(-1, 8)]
        fps = fps[np.lexsort((fps, *pop.T[::-1]))]
        lo, hi = _boxes(fps, np.array([0]))
        whole = np.bitwise_count(fps)
        cols = [[int(tile)], [len(fps)], lo.tolist(), hi.tolist(), [int(whole.min())], [int(whole.max())], [fps.tobytes()]]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["tile", "n", "lo", "hi", "least", "most", "fps"])

    bound_batches(distinct.sparkSession)
    return ranked.repartition("tile").sortWithinPartitions("tile").mapInArrow(pack, schema)


def _tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """(pair, a, b, work), a <= b: the pairs of tiles whose population counts allow a link.

    Tiles meet on the least whole population count that both span, widened by the radius on one side; the
    bounds by byte decide.
    """
    box = tiles.select("tile", "n", "lo", "hi", "least", "most")
    side = lambda x, wide: box.select(F.col("tile").alias(x), F.col("n").cast("long").alias(f"n_{x}"), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"), (F.col("least") - wide).alias(f"least_{x}"), F.explode(F.sequence(F.col("least") - wide, F.col("most") + wide)).alias("count"))
    gaps = [F.greatest(F.col("lo_a")[k] - F.col("hi_b")[k], F.col("lo_b")[k] - F.col("hi_a")[k], F.lit(0)) for k in range(8)]
    near = side("a", radius).join(side("b", 0), "count").filter("a <= b AND count = greatest(least_a, least_b)").filter(sum(gaps[1:], gaps[0]) <= radius)
    return near.select("a", "b", (F.col("n_a") * F.col("n_b")).alias("work")).withColumn("pair", F.monotonically_increasing_id())


def find_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links that connect exactly the fingerprints connected by differences up to radius.

    distinct holds each fingerprint (fp, long) once. The list of tile pairs is a table; each tile goes
    to the pairs it belongs to in one exchange, and a task holds two tiles at a time. The driver sees
    numbers of rows only.
    """
    tiles = materialize(_tiles(distinct, distinct.count()))
    pairs = materialize(_tile_pairs(tiles, radius))
    ends = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    sides = pairs.select("pair", F.posexplode(ends).alias("side", "tile"))
    work = sides.join(tiles.select("tile", "fps"), "tile").select("pair", "side", "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, first, alone = None, None, True
        for batch in batches:
            for r in range(batch.num_rows):
                fps = np.frombuffer(batch.column(2)[r].as_buffer(), np.uint64)
                if batch.column(0)[r].as_py() == pair:
                    alone = False
                    yield from found(compare(first, fps, radius))
                else:
                    if pair is not None and alone:
                        yield from found(compare(first, None, radius))
                    pair, first, alone = batch.column(0)[r].as_py(), fps, True
        if pair is not None and alone:
            yield from found(compare(first, None, radius))

    def found(links: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(links[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in links], names=["u", "v"])

    many, comparisons = pairs.agg(F.count(F.lit(1)), F.sum("work")).first()
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, (comparisons or 0) // TASK_WORK)
    dealt = work.repartition(max(1, min(many, tasks)), "pair").sortWithinPartitions("pair", "side")
    return dealt.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links(u, v): root is the least node its component holds.

    Large-star and small-star steps alternate until nothing changes; each step only keeps a node's
    least neighbour and moves the other neighbours to it, so no neighbourhood is gathered in a task;
    the joins on a node are plain ones of small rows, which adaptive execution splits where they are skewed.
    """
    now = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = materialize(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = materialize(small.select("e.*").filter("u > v").distinct())
        got = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 32))).first()
        discard(large)
        discard(now)
        now = new
        if got == state or not got[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = got


def near_groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """rows(ident, fp), a written table, plus component_id, the least ident of the fingerprint's component."""
    with scratch() as keep:
        distinct = materialize(rows.groupBy("fp").agg(F.min("ident").alias("rep")))
        links = components(find_links(distinct, radius))
        rooted = links.select(F.col("node").alias("fp"), "root").union(links.select(F.col("root").alias("fp"), "root").distinct())
        member = materialize(rooted.join(distinct, "fp"))
        least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
        linked = join_hot(member, least, "root").select("fp", "component_id")
        alone = distinct.join(member.select("fp"), "fp", "left_anti").select("fp", F.col("rep").alias("component_id"))
        named = keep(materialize(linked.union(alone)))
        return join_hot(rows, named, "fp")


def simhash_groups(df: DataFrame, ident: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(ident, fingerprint, component_id) for each row of df.

    Null texts and texts without words have fingerprint zero, linked like any other; very long texts
    are read whole; repeated rows each get their row; a null ident never becomes a component_id unless
    its component has no other; an empty table gives an empty result; other columns of df are ignored.
    """
    rows = df.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{text}`").alias("text"))
    rows = materialize(with_fingerprint(rows).drop("text"))
    out = near_groups(rows, radius)
    return out.select(F.col("ident").alias(ident), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
