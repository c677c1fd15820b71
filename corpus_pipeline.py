"""Raw documents to token ids: quality, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
documents; the last returns their ids. A stage's result is written as Parquet and read again, so a
lost executor costs tasks of one stage only. Every stage keeps all columns of docs as they are, whatever
their names, and makes of an empty table an empty one; very long texts are worked on whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.bpe import bpe_decode, bpe_encode
from memloom.llm.common import documents, hide, materialize, scratch, without
from memloom.llm.mixing import mix
from memloom.llm.pii import redact
from memloom.llm.quality import quality
from memloom.llm.shingles import drop_near_duplicates


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have no words and go; repeated rows
    go or stay together; nulls in other columns change nothing."""
    rows, show = hide(docs, text="text")
    return show(quality(rows).filter("kept"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies (five-word shingles, Jaccard similarity 0.8 or
    more): that of the least doc_id, null doc_ids last, any one of repeated rows. Null texts and texts
    without words are one group."""
    return drop_near_duplicates(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked; n_chars follows the text. Null texts stay null, and so
    does their n_chars; repeated rows are masked alike; null doc_ids are drawn for training together."""
    rows, show = hide(redact(docs), text="text", **({"n_chars": "n_chars"} if "n_chars" in docs.columns else {}))
    return show(rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for. Null sources are one source, the last; a
    source without words is not taken; rows that repeat a doc_id are drawn alike."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without text, plus the ids of each text, packed as little-endian unsigned 32-bit integers,
    their number and the digest of what they decode to. Null and empty texts have no ids; repeated rows
    are encoded alike; columns of docs named ids, n_tokens, decoded or decoded_sha256
    are replaced."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = without(docs, ["ids", "n_tokens", "decoded", "decoded_sha256"])
    out = bpe_decode(bpe_encode(rows, path, public_tokenizers.PATTERN).drop("text"), path, public_tokenizers.PATTERN)
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("quality rules", keep_quality),
    ("SimHash near-dedup", drop_copies),
    ("PII", mask_private),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Shingle sets, the network and the encoder have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. A stage's scratch tables go once its result is written."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
