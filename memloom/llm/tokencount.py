"""Token counts of whole texts, without the tokens.

Texts are encoded in batches of about equal bytes inside Arrow functions; only lengths leave them. A long
text is cut where no token of the vocabulary can reach across, so that its parts' counts add up to its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, documents, without

#: Texts of more characters are cut into parts of about so many.
PART_CHARS = 1 << 16
#: Characters that one call of a library encodes, about.
BATCH_CHARS = 1 << 20
#: A character that stands before all parts but the first; a token of its own in vocabularies of pieces.
LEAD = "\n"


def piece_pairs(pieces: list[str]) -> set[tuple[str, str]]:
    """Neighbouring characters within pieces. Merging joins two pieces into a piece, so no token of a text
    holds two neighbours that are not in this set."""
    return {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}


def safe_parts(text: str, pairs: set[tuple[str, str]], size: int = PART_CHARS) -> list[str]:
    """text cut before the first character from every `size` on that no piece holds after the one before it.
    A run without such a place stays whole."""
    out, start, n = [], 0, len(text)
    while n - start > size:
        at = start + size
        while at < n and (text[at - 1].replace(" ", "▁"), text[at].replace(" ", "▁")) in pairs:
            at += 1
        out.append(text[start:at])
        start = at
    return [*out, text[start:]] if start < n or not out else out


def piece_counter(model: bytes, size: int = PART_CHARS) -> Callable[[list[str]], list[int]]:
    """Counts of a sentencepiece model, without begin and end.

    Texts are cut only for models that merge pieces, take characters as they are and keep all blanks, and
    in which LEAD is in no piece: then LEAD before a part adds what it adds to an empty one.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    spec = sentencepiece_model_pb2.ModelProto.FromString(model)
    rules = spec.normalizer_spec
    pieces = [p.piece for p in spec.pieces if p.type == p.NORMAL]
    plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces
    merges = spec.trainer_spec.model_type == spec.trainer_spec.BPE and not spec.trainer_spec.treat_whitespace_as_suffix
    own = [p for p in spec.pieces if p.type in (p.USER_DEFINED, p.UNUSED)]
    cuts = plain and merges and not own and spec.trainer_spec.byte_fallback and not any(LEAD in p for p in pieces)
    pairs, lead = piece_pairs(pieces), len(sp.encode(LEAD))

    def lengths(texts: list[str]) -> list[int]:
        return [len(ids) for ids in sp.encode(texts, num_threads=1)]

    def count(texts: list[str]) -> list[int]:
        if not cuts:
            return _in_batches(lengths, texts)
        parts, owner, extra = [], [], []
        for i, t in enumerate(texts):
            for k, part in enumerate(safe_parts(t, pairs, size) if len(t) > size else [t]):
                parts.append(LEAD + part if k else part)
                owner.append(i)
                extra.append(lead if k else 0)
        out = np.zeros(len(texts), np.int64)
        np.add.at(out, owner, np.asarray(_in_batches(lengths, parts), np.int64) - np.asarray(extra, np.int64))
        return out.tolist()

    return count


def json_counter(model: bytes) -> Callable[[list[str]], list[int]]:
    """Counts of a tokenizers file; texts stay whole, as its rules may look at any character."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_buffer(model)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: _in_batches(lambda some: [len(e.ids) for e in tok.encode_batch(some, add_special_tokens=False)], texts)


def _in_batches(lengths: Callable[[list[str]], list[int]], texts: list[str]) -> list[int]:
    """lengths(texts), called on runs of texts with about equally many bytes, at most about BATCH_CHARS."""
    if not texts:
        return []
    ends = np.cumsum([len(t.encode()) + 1 for t in texts])
    calls = -(-int(ends[-1]) // BATCH_CHARS)
    cuts = np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, calls) / calls)).tolist()
    return [n for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True) if a < b for n in lengths(texts[a:b])]


_counters: dict = {}  # of this worker, by model
_models: dict = {}  # of this driver: what has been sent to the executors, by application and path


def count_tokens(df: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """df without text plus n_tokens: how many tokens the library of the tokenizer at path (sentencepiece for
    .model, tokenizers for .json) makes of each whole text, without begin, end or added special tokens.

    The model's file is read by the driver and sent once to each executor. Null and empty texts have 0
    tokens; very long texts are counted in parts; repeated rows count alike; an empty table gives an empty
    result; a column of df named n_tokens (in any case) is replaced, all others stay.
    """
    spark = df.sparkSession
    bound_batches(spark)
    if (key := (spark.sparkContext.applicationId, path)) not in _models:
        with open(path, "rb") as f:
            _models[key] = spark.sparkContext.broadcast(f.read())
    model, make = _models[key], json_counter if path.endswith(".json") else piece_counter
    rows = without(df, [n_tokens]).withColumn("__counted", F.col(f"`{text}`"))
    stay = [i for i, c in enumerate(rows.columns) if c.lower() not in (text.lower(), "__counted")]
    schema = T.StructType([rows.schema[i] for i in stay] + [T.StructField(n_tokens, T.LongType())])
    rows = rows.select(*[F.col(f"`{rows.columns[i]}`") for i in stay], "__counted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if path not in _counters:
                _counters[path] = make(model.value)
            n = _counters[path]([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


#: A text of more tokens is over the limit.
LIMIT = 4096


def op12(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op12_token_counts": op12}
ORACLES: dict[str, str] = {}
