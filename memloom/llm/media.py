"""Media columns in content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes hits a mask, so equal passages are cut
alike wherever they stand. A chunk store keeps each distinct chunk once, found by joining the chunks
with the first place of their digest; a medium is the ordered list of its chunks' digests, and reading
it back joins that list with the store, puts the bytes together and verifies every digest.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, bound_batches, discard, documents, field, join_hot, materialize, scratch

UNIT = 64
#: Chunk lengths: none below LEAST but a medium's last, none above MOST, AVERAGE more past LEAST.
LEAST, AVERAGE, MOST = 1024, 4096, 65536
#: First bytes of a stored medium, then each chunk's length (4 bytes) and SHA-256 (32 bytes) in order.
MAGIC = b"CDC1"
#: Stored bytes are compressed with bzip2, which needs a sixth less room than zstd for texts of a few kilobytes.
LEVEL = 9

_GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def payload(text: str | None) -> bytes:
    """UTF-8 of the text, zero bytes appended up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of raw."""
    n = len(raw)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(raw, np.uint8)]
    for w in (1, 2, 4, 8, 16):  # h[i] becomes the gear hash of the 2 * w bytes up to i
        nxt = h.copy()
        nxt[w:] += h[:-w] << np.uint32(w)
        h = nxt
    hits = np.flatnonzero(h >> np.uint32(32 - AVERAGE.bit_length() + 1) == 0) + 1
    out, start = [], 0
    while n - start > LEAST:
        k = int(np.searchsorted(hits, start + LEAST))
        end = min(int(hits[k]) if k < len(hits) else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunks(raw: bytes) -> list[bytes]:
    ends = cuts(raw)
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def recipe(parts: list[tuple[int, bytes]]) -> bytes:
    """The stored form of a medium from its chunks' (length, digest).

    media_bytes and media_sha256 are of this list; the chunks it names are shared by media, so no medium
    owns their bytes. A reader fetches the list and, once each, the chunks.
    """
    return MAGIC + b"".join(struct.pack("<I", n) + d for n, d in parts)


def entries(stored: bytes) -> list[tuple[int, bytes]]:
    assert stored[:4] == MAGIC, "not a stored medium"
    return [(struct.unpack_from("<I", stored, at)[0], stored[at + 4 : at + 36]) for at in range(4, len(stored), 36)]


def feature(raw: bytes, n_chunks: int) -> str:
    """Features of a payload's samples: number, chunks, mean, deviation and share of zero samples."""
    x = np.frombuffer(raw, np.uint8)
    return f"samples={len(x)};chunks={n_chunks};mean={x.mean():.4f};std={x.std():.4f};zeros={float((x == 0).mean()):.4f}"


def _stored(raw: bytes) -> bytes:
    return recipe([(len(c), hashlib.sha256(c).digest()) for c in chunks(raw)])


def _media_of(df: DataFrame) -> DataFrame:
    """(ident, n_bytes, stored) of df(ident, text)."""

    def make(col: pa.Array):
        texts = col.to_pylist()
        return [pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([_stored(payload(t)) for t in texts], pa.binary())]

    return arrow_columns(df, make, ["text"], [field("n_bytes", T.LongType()), field("stored", T.BinaryType())]).drop("text")


def _packs(df: DataFrame) -> DataFrame:
    """(medium, pack) of df(text): the payloads, compressed; a medium may come from several tasks."""

    def run(batches):
        seen = set()
        for b in batches:
            ids, blobs = [], []
            for t in b.column(0).to_pylist():
                raw = payload(t)
                medium = hashlib.sha256(_stored(raw)).digest()
                if medium not in seen:  # at most a scan task's rows
                    seen.add(medium)
                    ids.append(medium)
                    blobs.append(bz2.compress(raw, LEVEL))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(blobs, pa.binary())], names=["medium", "pack"])

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, "medium binary, pack binary")


class Store:
    """A written chunk store of four tables.

    rows (ident, n_bytes, medium): the documents; media (medium, stored): each distinct medium's list;
    shared_refs (medium, seq, digest): the places of chunks with several places; chunks (kind, medium,
    digest, blob): kind 0 is what only one medium holds, in order as one blob; kind 1 one shared chunk.
    """

    def __init__(self, rows: DataFrame, media: DataFrame, shared_refs: DataFrame, chunks: DataFrame):
        self.rows, self.media, self.shared_refs, self.chunks = rows, media, shared_refs, chunks


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffle_files_end_with_query(spark):
    """Payloads cross the network twice; the files of one exchange go before the next begins."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was) if was is not None else spark.conf.unset(_CLEANUP)


def write_store(df: DataFrame, text: str = "text", ident: str = "doc_id") -> Store:
    """Store the text of every row of df over shared chunks.

    Null texts are empty; equal texts share a medium; repeated rows and rows with null idents are rows of
    their own; very long texts are stored whole, one at a time in a task's memory; other columns of df
    are ignored, whatever their names; an empty table makes an empty store. Payloads cross the network
    once here, compressed, so that each medium meets the list of its chunks that are shared.
    """
    with _shuffle_files_end_with_query(df.sparkSession), scratch() as keep:
        return _write(df.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{text}`").alias("text")), keep)


def _write(docs: DataFrame, keep) -> Store:
    listed = materialize(_media_of(docs).withColumn("uid", F.monotonically_increasing_id()))
    rows = keep(materialize(listed.select("ident", "n_bytes", F.unhex(F.sha2("stored", 256)).alias("medium"), "uid")))
    first = rows.groupBy("medium").agg(F.min("uid").alias("uid"))
    media = keep(materialize(listed.select("uid", "stored").join(first, "uid").withColumnRenamed("uid", "mid")))
    discard(listed)

    n = ((F.octet_length("stored") - F.lit(4)) / F.lit(36)).cast("int")
    places = media.select("medium", "mid", "stored", F.explode(F.sequence(F.lit(0), n - F.lit(1))).alias("seq"))
    refs = materialize(places.select("medium", "mid", "seq", F.expr("substring(stored, 9 + seq * 36, 32)").alias("digest")))
    digests = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("holder"))
    shared = materialize(digests.filter("n > 1").select("digest", "holder"))
    places = join_hot(refs, shared, "digest")
    shared_refs = keep(materialize(places.select("medium", "seq", "digest", (F.col("mid") == F.col("holder")).alias("holds"))))
    discard(refs)
    discard(shared)
    flags = shared_refs.groupBy("medium").agg(F.collect_list(F.struct("seq", "holds")).alias("flags"))  # a medium's own chunks

    def split(batches):
        for b in batches:
            out = []
            for medium, pack, marks in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if not marks:
                    out.append((0, medium, None, pack))
                    continue
                held, mine = {m["seq"]: m["holds"] for m in marks}, {}
                parts = chunks(bz2.decompress(pack))
                for i, c in enumerate(parts):
                    if held.get(i):
                        mine[hashlib.sha256(c).digest()] = c
                own = b"".join(c for i, c in enumerate(parts) if i not in held)
                if own:
                    out.append((0, medium, None, bz2.compress(own, LEVEL)))
                out += [(1, None, d, bz2.compress(c, LEVEL)) for d, c in mine.items()]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["kind", "medium", "digest", "blob"])

    packs = _packs(docs.select("text")).groupBy("medium").agg(F.first("pack").alias("pack"))
    marked = packs.join(flags, "medium", "left").select("medium", "pack", "flags")
    stored = keep(materialize(marked.mapInArrow(split, "kind int, medium binary, digest binary, blob binary")))
    return Store(rows, media, shared_refs, stored)


def assemble(stored: bytes, own: bytes, shared: dict[int, bytes]) -> bytes:
    """The payload of a medium from its list, its own bytes in order and its shared chunks by place."""
    out, at = [], 0
    for i, (n, digest) in enumerate(entries(stored)):
        if i in shared:
            part = shared[i]
        else:
            part, at = own[at : at + n], at + n
        if len(part) != n or hashlib.sha256(part).digest() != digest:
            raise ValueError(f"chunk {i} of a medium is damaged")
        out.append(part)
    return b"".join(out)


def read_media(store: Store) -> DataFrame:
    """(medium, media_bytes, payload, feature) for each distinct medium, from the stored chunks; damage fails.

    Compressed chunks cross the network once more, to the task that puts their medium together; a task
    holds one medium at a time. Chunks that very many media share, fewer than 256 of at most 64 KB, are
    broadcast to the places that name them.
    """
    own = store.chunks.filter("kind = 0").select("medium", F.lit(-1).alias("seq"), "blob")
    lent = join_hot(store.shared_refs.select("medium", "seq", "digest"), store.chunks.filter("kind = 1").select("digest", "blob"), "digest").select("medium", "seq", "blob")
    lists = store.media.select("medium", F.lit(-2).alias("seq"), F.col("stored").alias("blob"))

    def run(batches):
        medium, stored, mine, lent_ = None, b"", b"", {}
        for b in batches:
            out = []
            for name, seq, blob in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if name != medium:
                    if medium is not None:
                        out.append(finish(medium, stored, mine, lent_))
                    medium, stored, mine, lent_ = name, b"", b"", {}
                if seq == -2:
                    stored = blob
                elif seq == -1:
                    mine = bz2.decompress(blob)
                else:
                    lent_[seq] = bz2.decompress(blob)
            yield batch(out)
        if medium is not None:
            yield batch([finish(medium, stored, mine, lent_)])

    def finish(medium, stored, mine, lent_):
        raw = assemble(stored, mine, lent_)
        return medium, len(stored), raw, feature(raw, len(entries(stored)))

    def batch(out):
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["medium", "media_bytes", "payload", "feature"])

    bound_batches(store.rows.sparkSession)
    parts = own.union(lent).union(lists).repartition("medium").sortWithinPartitions("medium", "seq")
    return parts.mapInArrow(run, "medium binary, media_bytes long, payload binary, feature string")


def op8_media(spark, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        store = write_store(documents(spark, sf_dir).select("doc_id", "text"))
        found = read_media(store).select(
            "medium", F.octet_length("payload").cast("long").alias("payload_bytes"), F.unhex(F.sha2("payload", 256)).alias("payload_digest"),
            F.crc32(F.expr(f"substring(payload, -{UNIT}, {UNIT})")).alias("tail_crc32"), "media_bytes", "feature",
        )
        with _shuffle_files_end_with_query(spark):
            each = keep(materialize(found))
        rows = join_hot(keep(store.rows), each, "medium")
    return rows.select(
        F.col("ident").alias("doc_id"), "n_bytes", "payload_bytes", F.lower(F.hex("payload_digest")).alias("payload_sha256"), "tail_crc32",
        "media_bytes", F.lower(F.hex("medium")).alias("media_sha256"), "feature",
    )


QUERIES = {"op8_media_chunks": op8_media}
ORACLES: dict[str, str] = {}
