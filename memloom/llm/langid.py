"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of WINDOW bytes. The network labels every position of every window; a
document's probabilities are the mean over all its positions. It is trained in numpy by
backpropagation through time on a bounded sample of labelled documents.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, bound_batches, documents, field
from .nets import Adam, Gru, Labeller, softmax

WINDOW, HIDDEN, PAD = 64, 8, 256
#: Bounds of the training sample: documents a language, windows a document, steps and rows a step.
TRAIN_DOCS, TRAIN_WINDOWS, STEPS, ROWS = 150, 24, 160, 160
#: Windows that one pass of the network holds.
PASS_ROWS = 2048
SEED = 7

_LETTER = regex.compile(r"\p{L}")


def cut(raw: bytes) -> np.ndarray:
    """Windows (n, WINDOW) of a text's bytes; the last is padded."""
    n = -(-len(raw) // WINDOW)
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def sample_windows(df: DataFrame, text: str, lang: str, ident: str) -> DataFrame:
    """(lang, ident, window): windows of about TRAIN_DOCS documents of each language, drawn by a hash of ident."""
    counts = {r[0]: r[1] for r in df.filter(F.col(lang).isNotNull()).groupBy(lang).agg(F.count(F.lit(1))).collect()}
    if not counts:
        return df.sparkSession.createDataFrame([], "lang string, ident string, window binary")
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col(ident)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, TRAIN_DOCS / n)))])
    drawn = df.filter(F.col(lang).isNotNull() & (draw < share[F.col(lang)])).select(F.col(lang).alias("lang"), F.col(ident).cast("string").alias("ident"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            rows = []
            for la, i, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                w = cut((t or "").encode())
                for k in sorted({int(x) for x in np.linspace(0, len(w) - 1, min(len(w), TRAIN_WINDOWS))}):
                    rows.append((la, i, w[k].astype("<i2").tobytes()))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.binary()), strict=True)], names=["lang", "ident", "window"])

    bound_batches(df.sparkSession)
    return drawn.mapInArrow(run, "lang string, ident string, window binary")


def train(rows: list[tuple[str, bytes]]) -> tuple[Labeller, list[str]] | None:
    """The network and its labels, from (language, window); None without rows."""
    if not rows:
        return None
    labels = sorted({la for la, _ in rows})
    x = np.array([np.frombuffer(w, "<i2") for _, w in rows]).astype(np.int64)
    y = np.array([labels.index(la) for la, _ in rows])
    net = Labeller.init(Gru, PAD + 1, HIDDEN, len(labels), SEED)
    adam, rng = Adam(net.params, 0.02), np.random.default_rng(SEED)
    by = [np.flatnonzero(y == k) for k in range(len(labels))]
    for step in range(STEPS):
        adam.rate = 0.02 * (1 - step / STEPS) + 0.001
        at = np.concatenate([rng.choice(b, max(1, ROWS // len(labels))) for b in by])
        xs = np.ascontiguousarray(x[at].T)
        mask = (xs != PAD).astype(np.float32)
        want = (np.arange(len(labels))[:, None] == y[at][None, :]).astype(np.float32)

        def loss(s, mask=mask, want=want):
            p, n = softmax(s), float(mask.sum()) or 1.0
            value = -float((np.log(p + 1e-9) * want[None] * mask[:, None, :]).sum()) / n
            return value, (p - want[None]) * mask[:, None, :] / n, {}

        _, grads = net.gradients(xs, mask, loss)
        adam.step(grads)
    return net, labels


def label_positions(net: Labeller, windows: np.ndarray) -> np.ndarray:
    """Probabilities (n, WINDOW, labels) of every position."""
    x = np.ascontiguousarray(windows.T.astype(np.int64))
    return softmax(net.scores(x, (x != PAD).astype(np.float32))).transpose(2, 0, 1)


def pool(net: Labeller, texts: list[str | None], n_labels: int) -> np.ndarray:
    """Mean probabilities of each text over all its positions; zeros for texts without bytes."""
    cuts = [cut((t or "").encode()) for t in texts]
    sums, owner = np.zeros((len(texts), n_labels)), np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
    flat = np.concatenate(cuts) if cuts else np.empty((0, WINDOW), np.int16)
    for i in range(0, len(flat), PASS_ROWS):
        x = np.ascontiguousarray(flat[i : i + PASS_ROWS].T.astype(np.intp))
        mask = (x != PAD).astype(np.float32)
        p = softmax(net.scores(x, mask))
        if not mask.all():
            p *= mask[:, None, :]
        each, own = p.sum(axis=0).T, owner[i : i + PASS_ROWS]
        starts = np.flatnonzero(np.r_[True, np.diff(own) > 0])
        sums[own[starts]] += np.add.reduceat(each, starts, axis=0)
    size = np.array([max(1, len((t or "").encode())) for t in texts], float)
    return sums / size[:, None]


def identify(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", ident: str = "doc_id") -> DataFrame:
    """df plus lang_pred and score, by a network trained on the rows of df where learn holds.

    lang is read from learning rows only and is no input of a prediction. A null text, or one without
    a letter, is 'und' with score 0; so is every text if no labelled row may be learnt from. Very long
    texts are labelled whole, window by window; equal texts, so repeated rows, are labelled alike; of
    labels with equal probabilities the first by code point is given; null idents are drawn for the
    sample together; an empty table gives an empty result; clashing columns are replaced.
    """
    rows = sample_windows(df.filter(learn), text, lang, ident).collect()  # bounded: TRAIN_DOCS * TRAIN_WINDOWS a language
    model = train([(r.lang, bytes(r.window)) for r in sorted(rows, key=lambda r: (r.lang, r.ident, bytes(r.window)))])
    blob = pickle.dumps(model and (model[0].params, model[1]))

    def make(col: pa.Array):
        texts = col.to_pylist()
        got = pickle.loads(blob)  # some kilobytes
        lettered = [t if t and _LETTER.search(t) else None for t in texts]
        if got is None:
            return [pa.array(["und"] * len(texts), pa.string()), pa.array([0.0] * len(texts), pa.float64())]
        p = pool(Labeller(Gru, got[0]), lettered, len(got[1]))
        best = p.argmax(axis=1)
        said = ["und" if t is None else got[1][k] for t, k in zip(lettered, best, strict=True)]
        score = [0.0 if t is None else min(1.0, float(x)) for t, x in zip(lettered, p.max(axis=1), strict=True)]
        return [pa.array(said, pa.string()), pa.array(score, pa.float64())]

    return arrow_columns(df, make, [text], [field("lang_pred", T.StringType()), field("score", T.DoubleType())])


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    return identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language}
ORACLES: dict[str, str] = {}
