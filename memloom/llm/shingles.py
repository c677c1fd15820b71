"""Near-duplicates by SimHash and, where fingerprints miss, by the Jaccard similarity of word shingles.

A text is the set of hashes of its shingles, and the set has a SimHash fingerprint. Links between
fingerprints, found by the tiled comparison and confirmed on the whole sets, give the first components.
Texts with a similarity of SIMILAR may lie some ten bits apart, beyond any radius that skips tiles, so
what the fingerprints miss is found exactly between those components: in one order of all shingles,
rare ones first, two sets as similar as SIMILAR share one of their first few (a fifth of each, plus one),
so only sets that meet in such a prefix are candidates; the place of the shared shingle in both bounds
what can still be shared behind it. Shingles are counted over all texts in a table of hashed counters, so
one that stands alone is known to, and most texts have no candidate at all. Each candidate is confirmed on
the whole sets. Where a shingle is shared by many, its sets are first compared with the one in whose
prefix it comes first, then only across the components so found; a shingle of very many sets is dealt to
tasks by set, and compared block by block. The order decides what is compared, never what is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import tables
from .common import arrow_columns, bound_batches, field, hide, join_hot, materialize, row_blocks, rows_in, scratch
from .simhash import RADIUS, components, find_links, majority

#: Words of a shingle; sets with SIMILAR[0] / SIMILAR[1] or more of their union in common are linked.
SHINGLE, SIMILAR = 5, (4, 5)
#: Shingles are counted in 2 ** TABLE_BITS counters, in RANGES parts. A counter's level is how many of LEVELS it reaches.
TABLE_BITS, RANGES, LEVELS = 27, 64, (2, 8, 64)
#: Shingles of a set are counted in so many buckets.
BUCKETS = 256
#: A shingle of the last level is dealt to tasks in SALTS parts; sets that share one are compared in blocks of RUN.
SALTS, RUN = 64, 8192
#: A set of many pairs is broadcast if its columns take no more bytes.
HOT_BYTES = 1 << 17

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = (h ^ (h >> np.uint64(29))) * _STEP + w[k : k + len(h)]
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return np.unique(h ^ (h >> np.uint64(33)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are as similar as SIMILAR."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


def levels(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The levels of shingles' counters, two bits each in a table of 2 ** k of them; level 0 stands alone."""
    at = h >> np.uint64(64 - (4 * len(table) - 1).bit_length())
    return table[at >> np.uint64(2)] >> (2 * (at & np.uint64(3))).astype(np.uint8) & 3


def prefix(h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a sorted set in the order (level, hash), and their levels."""
    order = np.argsort(level, kind="stable")[: len(h) - -(-len(h) * SIMILAR[0] // SIMILAR[1]) + 1]
    return h[order], level[order]


def _may_match(na, pa_, nb, pb):
    """Whether sets of na and nb shingles whose first shared one is at pa_ and pb can be similar; for arrays or columns."""
    least = F.least if not isinstance(na, np.ndarray) else np.minimum
    # shared >= s / (1 + s) of both sizes together
    return least(na - pa_, nb - pb) * (SIMILAR[0] + SIMILAR[1]) >= (na + nb) * SIMILAR[0]


def _groups(h: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array begin."""
    return np.flatnonzero(np.r_[True, h[1:] != h[:-1]])


def _by_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first column, cut so that no run of it is parted."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held and cols[0][-1] == held[0][0][-1]:
            held.append(cols)
            continue
        cut = np.searchsorted(cols[0], cols[0][-1])
        done = [*held, [c[:cut] for c in cols]]
        yield [np.concatenate(c) for c in zip(*done, strict=True)]
        held = [[c[cut:] for c in cols]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _counted(rows: DataFrame) -> np.ndarray:
    """The table of levels over all texts. A task counts a set once; each part of the table is added up in one
    task, in the memory of its counters. The driver sees the table, 2 ** TABLE_BITS / 4 bytes."""
    part_bits = TABLE_BITS - (RANGES - 1).bit_length()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # at most a scan task's rows
        for b in batches:
            new = [t for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if not (s in seen or seen.add(s))]
            has = [shingles(t) for t in new]
            if not sum(map(len, has)):
                continue
            at, n = np.unique(np.concatenate(has) >> np.uint64(64 - TABLE_BITS), return_counts=True)
            cuts = np.searchsorted(at, np.arange(RANGES + 1, dtype=np.uint64) << np.uint64(part_bits))
            # gaps of sorted places are small numbers, so exchanges compress them
            blobs = [(np.diff(at[a:z], prepend=np.uint64(k << part_bits)).astype("<u4").tobytes(), np.minimum(n[a:z], 255).astype(np.uint8).tobytes()) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), *(pa.array([x[k] for x in blobs], pa.binary()) for k in (0, 1))], names=["part", "gaps", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for b in batches:
            for k, gaps, n in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if k != part:
                    if part is not None:
                        yield packed(part, total)
                    part, total = k, np.zeros(1 << part_bits, np.uint8)
                at = np.cumsum(np.frombuffer(gaps, "<u4"), dtype=np.int64)
                total[at] = np.minimum(total[at].astype(np.int32) + np.frombuffer(n, np.uint8), 255)
        if part is not None:
            yield packed(part, total)

    def packed(part: int, total: np.ndarray) -> pa.RecordBatch:
        level = sum((total >= least).astype(np.uint8) for least in LEVELS).reshape(-1, 4)
        two = level[:, 0] | level[:, 1] << 2 | level[:, 2] << 4 | level[:, 3] << 6
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([two.astype(np.uint8).tobytes()], pa.binary())], names=["part", "levels"])

    bound_batches(rows.sparkSession)
    counted = rows.select("set", "text").mapInArrow(count, "part int, gaps binary, n binary")
    parts = counted.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, levels binary")
    table = np.zeros((RANGES, 1 << (part_bits - 2)), np.uint8)
    for r in parts.collect():  # RANGES rows
        table[r.part] = np.frombuffer(r.levels, np.uint8)
    return table.ravel()


def _meetings(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """(h, set, n, pos, lead, lead_n, lead_pos, many): distinct sets that share shingle h of their prefixes with
    another, of those the one where it comes first, and how many they are.

    A shingle below the last level has fewer sets than that level asks for, so they meet in one task. The others'
    sets are dealt by set, and their firsts found by partial minima."""
    schema = "h long, set long, n int, pos int, hot boolean"
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # at most a scan task's rows
        for b in batches:
            made = []
            for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s in seen:
                    continue
                seen.add(s)
                h = shingles(t)
                p, level = prefix(h, levels(h, shared.value))
                pos = np.flatnonzero(level)  # what stands alone meets nothing
                made.append((p[pos], np.full(len(pos), s), np.full(len(pos), len(h), np.int32), pos.astype(np.int32), level[pos] == len(LEVELS)))
            if made:
                h, *rest = (np.concatenate(c) for c in zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *map(pa.array, rest)], names=["h", "set", "n", "pos", "hot"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, sets, n, pos, hot in _by_shingle(batches):
            # runs of several rows only, then one row a set; a hot shingle's other sets may be elsewhere
            size = np.diff(np.r_[_groups(h), len(h)])
            several = np.repeat(size > 1, size) | hot
            if not several.any():
                continue
            h, sets, n, pos, hot = (x[several] for x in (h, sets, n, pos, hot))
            order = np.lexsort((sets, pos, h))
            h, sets, n, pos, hot = (x[order] for x in (h, sets, n, pos, hot))
            one = np.r_[True, (h[1:] != h[:-1]) | (sets[1:] != sets[:-1])]
            h, sets, n, pos, hot = (x[one] for x in (h, sets, n, pos, hot))
            start = _groups(h)
            size = np.diff(np.r_[start, len(h)])
            several, many, lead = np.repeat(size > 1, size) | hot, np.repeat(size, size), np.repeat(start, size)
            if several.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (h, sets, n, pos, hot, sets[lead], n[lead], pos[lead], many)], names=["h", "set", "n", "pos", "hot", "lead", "lead_n", "lead_pos", "many"])

    bound_batches(rows.sparkSession)
    emitted = rows.select("text", "set").mapInArrow(emit, schema)
    dealt = emitted.repartition(F.col("h"), F.when(F.col("hot"), F.pmod("set", F.lit(SALTS))).otherwise(F.lit(0))).sortWithinPartitions("h")
    met = materialize(dealt.mapInArrow(meet, f"{schema}, lead long, lead_n int, lead_pos int, many long"))
    hot = met.filter("hot").select("h", "set", "n", "pos")
    first = hot.groupBy("h").agg(F.min(F.struct("pos", "set", "n")).alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    first = materialize(first.select("h", F.col("first.set").alias("lead"), F.col("first.n").alias("lead_n"), F.col("first.pos").alias("lead_pos"), "many"))
    return met.filter("NOT hot").drop("hot").unionByName(materialize(join_hot(hot, first, "h")))


def _sided(pairs: DataFrame, sets: DataFrame, *sizes: str) -> DataFrame:
    """pairs(u, v), a written table, with the columns of sets(set, ...) for u, as <name>_u, and for v, as <name>_v.

    What sets hold of a set with many pairs goes to them by broadcast, instead of with each of them through an
    exchange; sizes are its columns whose bytes are looked at before.
    """
    side = lambda name, some: some.select(F.col("set").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in some.columns if c != "set"])
    many = pairs.select(F.explode(F.array("u", "v")).alias("set")).groupBy("set").agg(F.count(F.lit(1)).alias("pairs")).filter(F.col("pairs") > tables.HOT_ROWS)
    hot = [r[0] for r in many.orderBy(F.desc("pairs")).limit(tables.HOT).select("set").collect()]
    if hot:
        size = sum((F.octet_length(c) for c in sizes), F.lit(0))
        hot = [r[0] for r in sets.filter(F.col("set").isin(hot) & (size <= HOT_BYTES)).select("set").collect()]
    if not hot:
        return pairs.join(side("u", sets), "u").join(side("v", sets), "v")
    few, at_u, at_v = sets.filter(F.col("set").isin(hot)), F.col("u").isin(hot), F.col("v").isin(hot)
    parts = [
        pairs.filter(at_u).join(side("v", sets), "v").join(F.broadcast(side("u", few)), "u"),
        pairs.filter(~at_u & at_v).join(side("u", sets), "u").join(F.broadcast(side("v", few)), "v"),
        pairs.filter(~at_u & ~at_v).join(side("u", sets), "u").join(side("v", sets), "v"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _may_be_similar(pairs: DataFrame, sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs (u, v) of sets in different components whose counts by bucket do not prove that too few
    shingles are shared."""
    counts, root = sets.select("set", "n", "counts"), F.col("set")
    if roots is not None:
        counts, root = counts.join(roots.select(F.col("node").alias("set"), "root"), "set", "left"), F.coalesce("root", "set")
    counts = counts.select("set", "n", "counts", root.alias("root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for k in (4, 5))
                n = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
                # what differs is at most (1 - s) / (1 + s) of both sizes together
                hit = np.abs(a - c).sum(axis=1, dtype=np.int64) * (SIMILAR[1] + SIMILAR[0]) <= n * (SIMILAR[1] - SIMILAR[0])
                yield pa.RecordBatch.from_arrays(b.filter(pa.array(hit)).columns[:2], names=["u", "v"])

    both = _sided(materialize(pairs.distinct()), counts, "counts").filter("root_u != root_v")
    return materialize(both.select("u", "v", "n_u", "n_v", "counts_u", "counts_v").mapInArrow(run, "u long, v long"))


def _whole(rows: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set, has): the shingles of each set in pairs (u, v), from the first row of its text. These rows are marked in
    bitmaps that go to the scan, so no other text is read by Python and none moves."""
    need = pairs.select(F.explode(F.array("u", "v")).alias("set")).distinct()
    marked = row_blocks(sets.select("set", "row").join(need, "set", "left_semi").select("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            has = pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), has], names=["set", "has"])

    bound_batches(rows.sparkSession)
    return materialize(rows_in(rows.select("row", "set", "text"), marked).select("set", "text").mapInArrow(run, "set long, has binary"))


def _confirm(pairs: DataFrame, rows: DataFrame, sets: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(u, v): the pairs (u, v) of sets in different components that are similar, by the whole sets."""
    pairs = _may_be_similar(pairs, sets, roots)
    both = _sided(pairs, _whole(rows, sets, pairs), "has")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [similar(*(np.frombuffer(b.column(k)[r].as_buffer(), np.uint64) for k in (2, 3))) for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(hit, pa.bool_())).columns[:2], names=["u", "v"])

    return materialize(both.select("u", "v", "has_u", "has_v").mapInArrow(run, "u long, v long"))


def _across(meetings: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): pairs of sets that meet, may be similar and are in different components (node, root). Where only two
    meet, one is the lead, and they have been compared. Sets that share a shingle with more than RUN others, not
    all of one component, are dealt into blocks, and each two blocks are compared in one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sets, n, pos, root, own, two in _by_shingle(batches):
            start = _groups(key)
            stop = np.r_[start[1:], len(key)]
            apart = np.minimum.reduceat(root, start) < np.maximum.reduceat(root, start)
            for s, e in zip(start[apart].tolist(), stop[apart].tolist(), strict=True):
                place = np.arange(s, e)
                for i in place[own[s:e]].tolist():
                    j = place[~own[s:e]] if two[s] else np.arange(i + 1, e)
                    j = j[(root[j] != root[i]) & _may_match(n[i : i + 1], pos[i : i + 1], n[j], pos[j])]
                    if len(j):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sets[j], sets[i])), pa.array(np.maximum(sets[j], sets[i]))], names=["u", "v"])

    named = meetings.filter("many > 2").join(roots.select(F.col("node").alias("set"), "root"), "set", "left").select("h", "set", "n", "pos", F.coalesce("root", "set").alias("root"), "many")
    one = named.filter(F.col("many") <= RUN).select(F.col("h").alias("key"), "set", "n", "pos", "root", F.lit(True).alias("own"), F.lit(False).alias("two"))
    wide = materialize(named.filter(F.col("many") > RUN))
    parted = wide.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("h")
    n_blocks = F.ceil(F.col("many") / RUN).cast("int")
    wide = join_hot(wide, materialize(parted), "h").withColumn("block", F.pmod(F.xxhash64("set"), n_blocks).cast("int"))
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    pair = F.xxhash64("h", F.least("block", "other"), F.greatest("block", "other"))
    wide = wide.select(pair.alias("key"), "set", "n", "pos", "root", (F.col("block") <= F.col("other")).alias("own"), (F.col("block") != F.col("other")).alias("two"))
    return one.unionByName(wide).repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """(u, v): pairs of sets that connect those with equal fingerprints or fingerprints RADIUS or fewer bits apart."""
    sets = materialize(rows.select("fp", "set").distinct())
    lead = materialize(sets.groupBy("fp").agg(F.min("set").alias("lead")))
    links = materialize(find_links(lead.select("fp")))
    ends = join_hot(links, lead.select(F.col("fp").alias("u"), F.col("lead").alias("a")), "u")
    ends = join_hot(materialize(ends), lead.select(F.col("fp").alias("v"), F.col("lead").alias("b")), "v")
    equal = join_hot(sets, lead, "fp").select(F.col("set").alias("a"), F.col("lead").alias("b"))
    return ends.select("a", "b").union(equal).filter("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def similar_sets(rows: DataFrame) -> DataFrame:
    """(node, root) for each set of rows(row, set, fp, n, counts, text), a written table, that is linked to others,
    directly or through some."""
    sets = materialize(rows.groupBy("set").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("counts").alias("counts")))
    close = _confirm(_by_fingerprint(rows), rows, sets)
    meetings = _meetings(rows, _counted(rows))
    star = meetings.filter(F.col("set") != F.col("lead")).filter(_may_match(F.col("n"), F.col("pos"), F.col("lead_n"), F.col("lead_pos")))
    links = close.unionByName(_confirm(star.select(F.least("set", "lead").alias("u"), F.greatest("set", "lead").alias("v")), rows, sets, components(close)))
    roots = components(links)
    return components(links.unionByName(_confirm(_across(meetings, roots), rows, sets, roots)))


def with_set(df: DataFrame, text: str = "text") -> DataFrame:
    """df plus a hash of the set of shingles (equal for equal sets), its fingerprint, size and counts by bucket."""

    def make(col: pa.Array):
        has = [shingles(t) for t in col.to_pylist()]
        ident, fp = (np.array(x, np.uint64).view(np.int64) for x in ([xxhash.xxh64_intdigest(h.tobytes()) for h in has], [majority(h) if len(h) else 0 for h in has]))
        counts = [np.minimum(np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes() for h in has]
        return [pa.array(ident, pa.int64()), pa.array(fp, pa.int64()), pa.array([len(h) for h in has], pa.int32()), pa.array(counts, pa.binary())]

    return arrow_columns(df, make, [text], [field("set", T.LongType()), field("fp", T.LongType()), field("n", T.IntegerType()), field("counts", T.BinaryType())])


def drop_near_duplicates(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, one of each group, with all of df's columns as they are.

    Groups are connected by similarities of SIMILAR or more between whole texts, however long. Of a
    group the row with the least ident stays (null idents come last; of rows equal in ident, so of
    repeated rows, any one); null texts and texts without words are one group; an empty table gives an
    empty result.
    """
    rows, show = hide(df, ident=ident, text=text)
    with scratch() as keep:
        made = keep(materialize(with_set(rows.withColumn("row", F.monotonically_increasing_id()))))
        found = similar_sets(made.select("row", "set", "fp", "n", "counts", "text"))
        member = made.select("row", "ident", "set").join(found, F.col("set") == F.col("node"), "left")
        first = F.min(F.struct(F.col("ident").isNull().alias("last"), "ident", "row"))["row"].alias("row")
        best = member.groupBy(F.coalesce("root", "set").alias("root")).agg(first).select("row")
        return show(rows_in(made, keep(row_blocks(best))))
