"""Phrases whose words stand together more often than apart.

Each task counts its texts' word sequences in a trie of bounded depth and writes it sorted, in blocks of
entries. Ranges of the entries' order then gather all tries' blocks, which are merged; walking the merged
trie gives every phrase with the counts of its beginnings, and links from a phrase to itself without its
first word give the counts of its endings.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import checked_broadcast
from .common import bound_batches, documents, join_hot, materialize

#: Bytes that end a piece of text; no phrase goes across them.
ENDS = b".,;:!?\n\x0b\x0c\r"


class Sizes(NamedTuple):
    """Bounds of memory; they change no result."""

    shard: int = 1 << 22  # words that a task's trie takes before it is written
    block: int = 1 << 15  # entries of a block
    mark: int = 1 << 10  # one entry in so many is a mark
    range: int = 1 << 20  # entries of a range, about
    window: int = 1 << 22  # entries merged at once, about


#: Ranges at most (beyond, ranges grow and are merged in windows); marks drawn for each.
MOST_RANGES, DRAWN = 1 << 13, 32
#: Text is cut into words so many bytes at a time.
SLICE = 1 << 20
#: Top lists are first taken in so many parts of each language.
PARTS = 64

_TABLE = bytes(ord(".") if b in ENDS else ord(" ") if b == 9 else b for b in range(256))
# words hold no blank, so they can do without byte 0, which then sorts a shorter phrase before its extensions
_UP = bytes.maketrans(bytes(range(33)), bytes([*range(1, 33), 0]))
_DOWN = bytes.maketrans(bytes([*range(1, 33), 0]), bytes(range(33)))


class Words(defaultdict):
    """word -> number in order of appearance; 0 is the end of a piece."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__
        self[b"."]  # noqa: B018

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of text's words and ends of pieces, and a last end."""
        raw = text.encode().lower().translate(_TABLE)  # bytes lower-case A-Z alone
        out, at = [], 0
        while at < len(raw):
            stop = raw.find(b" ", at + SLICE)
            stop = len(raw) if stop < 0 else stop
            words = raw[at:stop].replace(b".", b" . ").split()
            out.append(np.fromiter(map(self.__getitem__, words), np.uint32, len(words)))
            at = stop
        return np.concatenate([*out, np.zeros(1, np.uint32)])


def _sort_keys(w: np.ndarray, most: int) -> list[np.ndarray]:
    """Columns of numbers up to most packed into as few 64-bit keys as hold them, first columns first."""
    bits = max(1, int(most).bit_length())
    each = 64 // bits
    keys = []
    for at in range(0, w.shape[1], each):
        key = np.zeros(len(w), np.uint64)
        for c in range(at, min(at + each, w.shape[1])):
            key = key << np.uint64(bits) | w[:, c].astype(np.uint64)
        keys.append(key)
    return keys


def _counted(w: np.ndarray, n: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of w in order, and the sums of n (or their number). Runs that are sorted already merge."""
    if not len(w):
        return w, np.zeros(0, np.int64)
    keys = _sort_keys(w, most)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(w), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    totals = np.add.reduceat(n[order], starts) if n is not None else np.diff(np.append(starts, len(w)))
    return w[order[starts]], totals.astype(np.int64)


class Block:
    """Sorted entries of a trie: w, numbers (from 1) into sorted words, 0 where a piece has ended; n, counts."""

    def __init__(self, words: list[bytes], w: np.ndarray, n: np.ndarray):
        self.words, self.w, self.n = words, w, n

    def key(self, i: int) -> bytes:
        """Bytes that sort as entries do."""
        return b"\0".join([self.words[x - 1] for x in self.w[i].tolist() if x])

    def below(self, key: bytes) -> int:
        """How many entries lie before key."""
        return bisect_left(range(len(self.n)), key, key=self.key)

    def cut(self, lo: int, hi: int) -> Block:
        """Entries lo to hi with their own words only."""
        used, w = np.unique(self.w[lo:hi], return_inverse=True)
        zero = int(len(used) > 0 and used[0] == 0)
        return Block([self.words[x - 1] for x in used[zero:].tolist()], w.reshape(hi - lo, -1) + (1 - zero), self.n[lo:hi])

    def pack(self) -> bytes:
        names = b"\0".join(self.words)
        head = np.array([len(names), len(self.n), self.w.shape[1], 2 if len(self.words) < 1 << 16 else 4], "<u4")
        body = np.ascontiguousarray(self.w.T, "<u2" if head[3] == 2 else "<u4").tobytes()
        return zstandard.compress(head.tobytes() + names + body + self.n.astype("<i8").tobytes(), 1)

    @classmethod
    def unpack(cls, raw: bytes) -> Block:
        raw = zstandard.decompress(raw)
        size, rows, depth, width = np.frombuffer(raw, "<u4", 4).tolist()
        at = 16 + size
        w = np.frombuffer(raw, f"<u{width}", rows * depth, at).reshape(depth, rows).T
        return cls(raw[16:at].split(b"\0") if size else [], w, np.frombuffer(raw, "<i8", rows, at + rows * depth * width))


def merged(blocks: list[Block], depth: int) -> Block:
    """One block of all entries, equal ones added up."""
    words = sorted(set().union(*[b.words for b in blocks]))
    at = dict(zip(words, range(1, len(words) + 1), strict=True))
    w = [np.array([0, *map(at.__getitem__, b.words)], np.uint32)[b.w] for b in blocks]
    w, n = _counted(np.concatenate([np.zeros((0, depth), np.uint32), *w]), np.concatenate([np.zeros(0, np.int64), *[b.n for b in blocks]]), len(words))
    return Block(words, w, n)


def _tries(docs: DataFrame, depth: int, sizes: Sizes) -> DataFrame:
    """(lang, first, marks, n, block): each task's sorted trie in blocks; marks are keys of one entry in sizes.mark."""
    schema = T.StructType.fromDDL("lang string, first binary, marks array<binary>, n long, block binary")

    def written(words: Words, texts: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names = [w.translate(_UP) for w in list(words)[1:]]
        order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        rank = np.zeros(len(names) + 1, np.uint32)
        rank[order + 1] = np.arange(1, len(names) + 1, dtype=np.uint32)
        ordered = [names[i] for i in order.tolist()]
        for lang in sorted(texts):
            seq = rank[np.concatenate([*texts[lang], np.zeros(depth, np.uint32)])]
            at = np.flatnonzero(seq)
            w = np.zeros((len(at), depth), np.uint32)
            alive = np.ones(len(at), bool)
            for d in range(depth):
                x = seq[at + d]
                alive &= x != 0
                w[:, d] = np.where(alive, x, 0)
            whole = Block(ordered, *_counted(w, None, len(ordered)))
            for lo in range(0, len(whole.n), sizes.block):
                part = whole.cut(lo, min(lo + sizes.block, len(whole.n)))
                marks = [part.key(i) for i in range(sizes.mark // 2, len(part.n), sizes.mark)]
                yield pa.RecordBatch.from_pylist([{"lang": lang, "first": part.key(0), "marks": marks, "n": len(part.n), "block": part.pack()}], schema=_arrow(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, texts, held = Words(), {}, 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = words.numbers(text)
                texts.setdefault(lang, []).append(ids)
                held += len(ids)
                if held >= sizes.shard:
                    yield from written(words, texts)
                    words, texts, held = Words(), {}, 0
        yield from written(words, texts)

    return docs.mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


def _ranges(tries: DataFrame, sizes: Sizes) -> list[tuple[str, bytes]]:
    """Where ranges of about sizes.range entries begin, all but the first, from marks drawn at random. They only
    balance the work; what is merged where changes no count."""
    total = tries.agg(F.sum("n")).first()[0] or 0
    n = min(MOST_RANGES, -(-total // sizes.range))
    if n < 2:
        return []
    share = DRAWN * n * sizes.mark / total  # of all marks, so that about DRAWN a range come to the driver
    drawn = tries.select("lang", F.explode("marks").alias("mark")).filter(F.rand(0) < share).collect()
    keys = sorted((r.lang, bytes(r.mark)) for r in drawn)
    return sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []


def _dealt(tries: DataFrame, starts: list[tuple[str, bytes]]) -> DataFrame:
    """Blocks cut where ranges begin, each part in its range's partition, sorted by first entries."""
    schema = T.StructType.fromDDL("range int, lang string, first binary, block binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lang, first = r["lang"], r["first"]
                at = bisect_right(starts, (lang, first))
                block = Block.unpack(r["block"])
                if at == len(starts) or starts[at] > (lang, block.key(len(block.n) - 1)):
                    yield pa.RecordBatch.from_pylist([{"range": at, "lang": lang, "first": first, "block": r["block"]}], schema=_arrow(schema))
                    continue
                lo = 0
                while lo < len(block.n):
                    hi = block.below(starts[at][1]) if at < len(starts) and starts[at][0] == lang else len(block.n)
                    if hi > lo:
                        yield pa.RecordBatch.from_pylist([{"range": at, "lang": lang, "first": block.key(lo), "block": block.cut(lo, hi).pack()}], schema=_arrow(schema))
                    lo, at = hi, at + 1

    cut = tries.select("lang", "first", "block").mapInArrow(run, schema)
    return cut.repartitionById(len(starts) + 1, F.col("range")).sortWithinPartitions("lang", "first")


def _walked(dealt: DataFrame, depth: int, least: int, sizes: Sizes) -> DataFrame:
    """(lang, m, phrase, f, lefts, edge): phrases of m words with counts f from least on, and the counts of
    their first 1 to m - 1 words. The paths at either end of a window may go on in another: their counts
    are parts, marked as edges, whatever their size. A row of m = 0 counts a window's words."""
    schema = T.StructType.fromDDL("lang string, m int, phrase string, f long, lefts array<long>, edge boolean")

    def nodes(lang: str, t: Block) -> Iterator[pa.RecordBatch]:
        rows = [(0, "", int(t.n.sum()), [], True)]
        names = [w.translate(_DOWN) for w in t.words]
        new = np.zeros(len(t.n), bool)
        new[:1] = True
        run_of, totals = [], []
        for d in range(1, depth + 1):
            new[1:] |= t.w[1:, d - 1] != t.w[:-1, d - 1]
            starts = np.flatnonzero(new)
            run_of.append(np.cumsum(new) - 1)
            totals.append(np.add.reduceat(t.n, starts))
            edge = np.zeros(len(starts), bool)
            if d < depth:
                edge[[0, -1]] = True
            keep = np.flatnonzero((t.w[starts, d - 1] != 0) & (edge | (totals[-1] >= least)))
            lefts = np.stack([totals[k][run_of[k][starts[keep]]] for k in range(d - 1)], 1).tolist() if d > 1 else [[]] * len(keep)
            for path, f, left, e in zip(t.w[starts[keep], :d].tolist(), totals[-1][keep].tolist(), lefts, edge[keep].tolist(), strict=True):
                rows.append((d, b" ".join([names[x - 1] for x in path]).decode(), f, left, e))
        for at in range(0, len(rows), 1 << 14):
            m, phrase, f, left, edge = zip(*rows[at : at + (1 << 14)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(m)), pa.array(m, pa.int32()), pa.array(phrase), pa.array(f, pa.int64()), pa.array(left, pa.list_(pa.int64())), pa.array(edge)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for lang, first, raw in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                if held and lang != now:
                    yield from nodes(now, merged(held, depth))
                    held = []
                elif sum(len(x.n) for x in held) >= sizes.window:  # no later block holds anything below first
                    cuts = [x.below(first) for x in held]
                    if any(cuts):
                        yield from nodes(now, merged([x.cut(0, c) for x, c in zip(held, cuts, strict=True) if c], depth))
                    held = [x.cut(c, len(x.n)) for x, c in zip(held, cuts, strict=True) if c < len(x.n)]
                now = lang
                held.append(Block.unpack(raw))
        if held:
            yield from nodes(now, merged(held, depth))

    return dealt.mapInArrow(run, schema)


def _key(phrase: Column) -> Column:
    return F.concat(F.col("lang"), F.lit("\t"), phrase)  # phrases hold no tab, so no two pairs share a key


def _rest() -> Column:
    """A phrase without its first word."""
    return F.expr("substring(phrase, instr(phrase, ' ') + 1)")



def frequent(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, sizes: Sizes = Sizes()) -> tuple[DataFrame, DataFrame]:
    """((lang, m, phrase, f, lefts, key), (lang, n)): phrases of 1 to longest words that stand `least` times or more
    in pieces of df's texts of a language, with the counts of their beginnings, and each language's words."""
    bound_batches(df.sparkSession)
    docs = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    tries = materialize(_tries(docs, longest, sizes))
    found = materialize(_walked(_dealt(tries, _ranges(tries, sizes)), longest, least, sizes))
    ends = materialize(found.filter("edge").groupBy("lang", "m", "phrase").agg(F.sum("f").alias("f")))
    every = found.filter("NOT edge").drop("edge").unionByName(ends.filter("m > 0").withColumn("lefts", F.array_repeat(F.lit(0).cast("long"), F.col("m") - 1)))
    every = every.filter(F.col("f") >= least)
    for k in range(1, longest):  # what an edge begins has its whole count from the edges' sums
        whole = ends.filter(F.col("m") == k).select("lang", F.col("phrase").alias("_first"), F.col("f").alias("_f"))
        every = every.withColumn("_first", F.when(F.col("m") > k, F.substring_index("phrase", " ", k))).join(checked_broadcast(whole), ["lang", "_first"], "left")
        every = every.withColumn("lefts", F.when(F.col("_f").isNull(), F.col("lefts")).otherwise(F.expr(f"transform(lefts, (x, i) -> if(i = {k - 1}, _f, x))"))).drop("_first", "_f")
    rows = materialize(every.withColumn("key", _key(F.col("phrase"))))
    return rows, ends.filter("m = 0").select("lang", F.col("f").alias("n")).filter("n > 0")


def linked(rows: DataFrame, longest: int = 4) -> DataFrame:
    """rows of two words and more plus rights: the counts of their last m - 1 to 1 words, each taken over from
    the phrase without the first word."""
    done = rows.filter("m = 1").select("key", F.col("f").alias("_f"), F.array().cast("array<long>").alias("_r"))
    out = None
    for m in range(2, longest + 1):
        some = rows.filter(F.col("m") == m).withColumnRenamed("key", "own").withColumn("key", _key(_rest()))
        some = materialize(join_hot(some, done, "key").withColumn("rights", F.concat(F.array("_f"), "_r")).drop("key", "_f", "_r").withColumnRenamed("own", "key"))
        out = some if out is None else out.unionByName(some)
        done = some.select("key", F.col("f").alias("_f"), F.col("rights").alias("_r"))
    return out


#: Counts as decimals, so that products pass 64 bits.
_WIDE = "decimal(20,0)"


def best_cuts(rows: DataFrame) -> DataFrame:
    """rows plus cut: (score, k, l, r) of the lowest-scoring cut after k words, the smallest k among equals."""
    score = f"cast(2000000 as decimal(8,0)) * cast(f as {_WIDE}) div (cast(lefts[k - 1] as {_WIDE}) + cast(rights[k - 1] as {_WIDE}))"
    return rows.withColumn("cut", F.expr(f"array_min(transform(sequence(1, m - 1), k -> named_struct('score', {score}, 'k', k, 'l', lefts[k - 1], 'r', rights[k - 1])))"))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, share: int = 80, top: int = 2000, sizes: Sizes = Sizes()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to longest words.

    a: how often a phrase stands within pieces of texts, `least` or more. Of its cuts into a first part (l times)
    and a rest (r times) the one of the lowest score floor(2000000 a / (l + r)) counts, the shortest first
    part among equals. A phrase is left out if a longer one that holds it has `share` percent of a or more.
    Order: score and a descending, phrase ascending by bytes. n: the language's words.
    Null texts have no words; a null language is 'und'; empty texts and tables give no rows; very long texts
    are counted whole; repeated rows count each time; other columns of df are not looked at.
    """
    rows, words = frequent(df, text, lang, longest, least, sizes)
    every = linked(rows, longest)
    scored = best_cuts(every)
    # an extension by one word stands at least as often as any longer one
    within = every.filter("m > 2").select("lang", "f", F.explode(F.array(F.expr("array_join(slice(split(phrase, ' '), 1, m - 1), ' ')"), _rest())).alias("phrase"))
    within = within.groupBy("lang", "phrase").agg(F.max("f").alias("_more"))
    kept = scored.join(within, ["lang", "phrase"], "left").filter(f"_more IS NULL OR {share} * cast(f as {_WIDE}) > 100 * cast(_more as {_WIDE})")
    kept = kept.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("_part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top).drop("_part")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(checked_broadcast(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir).select("lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS MATERIALIZED (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM words, range(1, 5) AS size(m), range(1, len(w) - m + 2) AS place(i) GROUP BY ALL
), cands AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, g.f AS l, h.f AS r, (2000000::HUGEINT * c.a) // (g.f + h.f) AS score
  FROM cands c, range(1, c.m) AS cut(k)
  JOIN grams g ON g.lang = c.lang AND g.phrase = array_to_string(c.w[1:k], ' ')
  JOIN grams h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[k + 1:], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS more
  FROM cands, range(2, m) AS size(s), range(1, m - s + 2) AS place(i) GROUP BY ALL
), kept AS (SELECT b.* FROM best b LEFT JOIN inner_parts p ON p.lang = b.lang AND p.phrase = b.phrase WHERE p.more IS NULL OR 100::HUGEINT * p.more < 80::HUGEINT * b.a),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

QUERIES = {"op13_collocations": op13}
ORACLES = {"op13_collocations": SQL}
