"""Byte-level BPE over Spark columns.

A text is cut into pre-tokens by the tokenizer's pattern. A minimal perfect hash over the vocabulary
resolves pre-tokens that are vocabulary entries as a whole; all others are merged from single bytes
with a heap of candidate pairs over a linked list.
"""

from __future__ import annotations

import base64
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, documents, field

#: Pre-tokens a worker remembers, in two halves: when the newer half is full, the older is forgotten.
MEMO = 200_000


class PerfectHash:
    """Minimal perfect hash by displacement: n keys on n slots, the key's bytes checked on lookup.

    Keys fall into buckets by a first hash. Large buckets search a seed that sends all their keys to
    free slots; buckets of one key store a free slot itself, as -slot - 1.
    """

    def __init__(self, keys: list[bytes]):
        n = max(1, len(keys))
        self.n, self.keys = n, keys
        self.seed = np.zeros(n, np.int32)
        self.at = np.full(n, -1, np.int32)
        buckets: dict[int, list[int]] = {}
        for i, k in enumerate(keys):
            buckets.setdefault(xxhash.xxh64_intdigest(k, 0) % n, []).append(i)
        free = np.ones(n, bool)
        single = []
        for b, members in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                single.append((b, members[0]))
                continue
            d = 1
            while True:
                slots = [xxhash.xxh64_intdigest(keys[i], d) % n for i in members]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self.seed[b] = d
            for i, s in zip(members, slots, strict=True):
                free[s], self.at[s] = False, i
        for (b, i), s in zip(single, np.flatnonzero(free).tolist(), strict=False):
            self.seed[b], self.at[s] = -s - 1, i

    def get(self, key: bytes) -> int:
        """The key's index, or -1."""
        d = int(self.seed[xxhash.xxh64_intdigest(key, 0) % self.n])
        slot = -d - 1 if d < 0 else xxhash.xxh64_intdigest(key, d) % self.n
        i = int(self.at[slot])
        return i if i >= 0 and self.keys[i] == key else -1


class Vocabulary:
    """Token bytes in rank order with their hash; ids are the ranks of the file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = sorted(ranks, key=ranks.get)
        self.ids = [ranks[t] for t in self.tokens]
        self.pattern = pattern
        self.hash = PerfectHash(self.tokens)

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """From a file of lines 'base64 rank'."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return cls(ranks, pattern)


def merge(piece: bytes, rank) -> list[bytes]:
    """Parts of piece after all merges, lowest rank first, leftmost among equals; rank(bytes) is None for no merge."""
    n = len(piece)
    if n < 2:
        return [piece] if n else []
    end = list(range(1, n + 1))  # end of the part that starts here; 0 once it is swallowed
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two parts has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            prev[stop] = i
            if (r := rank(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
            heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = end[i]
    return out


#: The public pattern, and a form of it for the standard library that agrees on texts of SIMPLE characters only.
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SIMPLE_PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
#: ASCII without the separators 0x1C-0x1F, and the letters and signs of Latin-1 and Latin Extended-A that both engines class alike.
NOT_SIMPLE = re.compile("[^\\x00-\\x1b\\x20-\\x7f\\xa1-\\xa9\\xab-\\xb1\\xb4\\xb6-\\xb8\\xbb\\xbf-\\u017f\\u2010-\\u2027\\u20ac]")


def splitter(pattern: str):
    """text -> pre-tokens."""
    full = regex.compile(pattern).findall
    if pattern != GPT_PATTERN:
        return full
    quick, odd = re.compile(SIMPLE_PATTERN).findall, NOT_SIMPLE.search
    return lambda text: full(text) if odd(text) else quick(text)


class Encoder(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit integers, remembered up to MEMO of them."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.split = splitter(vocab.pattern)
        self.find = vocab.hash.get
        self.four = [i.to_bytes(4, "little") for i in vocab.ids]
        # merging asks for pieces of the same few tokens again and again: a plain dictionary of ranks
        self.rank = dict(zip(vocab.tokens, vocab.ids, strict=True)).get
        self.code = dict(zip(vocab.tokens, self.four, strict=True))

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            raw = piece.encode()
            i = self.find(raw)
            out = self.four[i] if i >= 0 else b"".join([self.code[p] for p in merge(raw, self.rank)])
        if len(self) >= MEMO // 2:  # words in use have moved to the newer half by now
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = out
        return out

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text))) if text else b""


_encoders: dict = {}  # of this worker, by vocabulary


def _cached(kind: str, key: str, vocab, make):
    if (kind, key) not in _encoders:
        _encoders[kind, key] = make(vocab.value)
    return _encoders[kind, key]


_vocabularies: dict = {}  # of this driver: what has been sent to the executors, by application and vocabulary


def _shared(df: DataFrame, path: str, pattern: str):
    """The vocabulary, read by the driver and sent once to each executor; its size is the file's."""
    spark, name = df.sparkSession.sparkContext, f"{path}\0{pattern}"
    if (spark.applicationId, name) not in _vocabularies:
        _vocabularies[spark.applicationId, name] = spark.broadcast(Vocabulary.load(path, pattern))
    return _vocabularies[spark.applicationId, name], name


def bpe_encode(df: DataFrame, path: str, pattern: str = GPT_PATTERN, text: str = "text", ids: str = "ids") -> DataFrame:
    """df plus ids: the token ids of each whole text, packed as little-endian unsigned 32-bit integers.

    Special tokens' strings are ordinary text. Null and empty texts have no ids; very long texts are
    encoded whole; repeated rows are encoded alike; an empty table gives an empty result; a column of df
    named ids (in any case) is replaced, all others stay.
    """
    vocab, key = _shared(df, path, pattern)

    def make(col: pa.Array):
        encode = _cached("encode", key, vocab, Encoder).encode
        return [pa.array([encode(t) for t in col.to_pylist()], pa.binary())]

    return arrow_columns(df, make, [text], [field(ids, T.BinaryType())])


def bpe_decode(df: DataFrame, path: str, pattern: str = GPT_PATTERN, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df plus decoded: the bytes that packed ids stand for. Null and empty ids
    give no bytes; unknown ids fail; repeated rows, long ids, empty tables and clashes as in bpe_encode."""
    vocab, key = _shared(df, path, pattern)

    def make(col: pa.Array):
        table = _cached("decode", key, vocab, lambda v: dict(zip(v.ids, v.tokens, strict=True)))
        return [pa.array([b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in col.to_pylist()], pa.binary())]

    return arrow_columns(df, make, [ids], [field(decoded, T.BinaryType())])


def ids_array(ids: str = "ids") -> Column:
    """Packed ids as an array of longs."""
    four = lambda i, k: F.conv(F.hex(F.substring(F.col(ids), i * 4 + k, 1)), 16, 10).cast("long")
    each = lambda i: four(i, 1) + four(i, 2) * 256 + four(i, 3) * 65536 + four(i, 4) * 16777216
    n = (F.octet_length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), each)).otherwise(F.array().cast("array<bigint>"))


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe_decode(bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), path, pattern).drop("text"), path, pattern)
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op1_byte_bpe": op1_bpe}
ORACLES: dict[str, str] = {}
