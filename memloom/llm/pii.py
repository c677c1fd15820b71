"""Personal data: fixed patterns plus a character-level bidirectional LSTM with CRF transitions.

The patterns' spans always stand. The network is trained in numpy on a bounded sample of windows: with
spans the patterns find there, and with spans planted in the documents' own words, also in forms that no
pattern matches (a phone without a plus, a defanged address, an email with (at), a card in odd groups or
next to another number). It scores every character of every text in overlapping windows, the scores of
overlaps are pooled, and one best path of the CRF is decoded for the whole text. Runs of a label are
spans if they pass the checks of their kind (digits, Luhn, parts); patterns' spans are cut off them.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, bound_batches, documents, field, hide
from .nets import Adam, Labeller, Lstm, crf_loss, viterbi

KINDS = ("email", "ip", "card", "phone")

#: Texts are scored in windows of WINDOW characters of which neighbours share OVERLAP.
WINDOW, OVERLAP = 256, 32
HIDDEN, OTHER, PAD = 8, 128, 129
#: Bounds of the training sample: documents drawn, windows of each, characters of a window, steps and rows a step.
TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_CHARS, STEPS, ROWS = 4000, 6, 112, 420, 100
#: Characters of the texts, or of one longer text, labelled at a time; windows of one pass; segments of one decoding.
PASS_CHARS, PASS_ROWS, DECODE_ROWS = 1 << 19, 1024, 1024
SEED = 11

_TRIGGER = re.compile("[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _ip_ok(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str | None) -> list[Span]:
    """Spans of the patterns, by start and kind.

    Each kind is matched leftmost without overlap in time linear in the text: emails from their @
    outwards, addresses by fours along each maximal dotted run.
    """
    if not text or not _TRIGGER.search(text):
        return []
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, pos = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            end = pos + sum(map(len, parts[k : k + 4])) + 3
            if _ip_ok(parts[k : k + 4]):
                out.append((pos, 1, end))
            pos = end + 1
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m.group()))
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


_AT, _DOT = re.compile(r"\s?[\[(]at[\])]\s?|\s?@\s?"), re.compile(r"\s?[\[(](?:dot|\.)[\])]\s?|\s\.\s")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")
_ANY_CARD = re.compile(r"[0-9](?:[ ./-]{0,2}[0-9])+")
_ANY_PHONE = re.compile(r"(?:\+|00)?[ (]?[0-9][0-9 ()./-]*[0-9]")


def valid(kind: int, found: str) -> bool:
    """Whether a span of the network is one of its kind, however written: [at], (at), [.] and (dot) count as
    the signs they stand for; cards may be grouped by . and / too; a phone needs a leading + or 00, an area
    code in brackets, or two separators."""
    digits = "".join(_DIGITS.findall(found))
    if kind == 0:
        return bool(_EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", found))))
    if kind == 1:
        plain = _DOT.sub(".", found)
        return bool(_IP.fullmatch(plain)) and _ip_ok(plain.split("."))
    if kind == 2:
        return bool(_ANY_CARD.fullmatch(found)) and 12 <= len(digits) <= 19 and luhn(digits)
    marked = found[0] == "+" or found[:2] == "00" or "(" in found or len(re.findall(r"[0-9][ ./-]+(?=[0-9])", found)) >= 2
    return bool(_ANY_PHONE.fullmatch(found)) and 9 <= len(digits) <= 15 and marked and not _IP.fullmatch(found)


def codes(text: str) -> np.ndarray:
    """A code for each character: ASCII its own, all others one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.minimum(points, OTHER).astype(np.int64)


def with_luhn(rng, n: int) -> str:
    """n digits that pass Luhn."""
    head = "".join(map(str, rng.integers(0, 10, n - 1)))
    return next(head + c for c in "0123456789" if luhn(head + c))


def invent(rng, kind: int) -> str:
    """Personal data of a kind in one of its forms; about half are such as the patterns find."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda a, b: "".join(pick(*"abcdefghijklmnopqrstuvwxyz") for _ in range(rng.integers(a, b)))
    if kind == 0:
        at, dot = pick(("@", "."), ("@", "."), ("@", "."), (" @ ", "."), ("(at)", "."), (" [at] ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "))
        name = pick(word(2, 9), word(2, 7) + pick(".", "_", "-") + word(2, 8), word(2, 8) + n(2), n(int(rng.integers(2, 4))))
        return name + at + pick(word(3, 9), word(2, 6) + n(1)) + pick("", dot + word(3, 8)) + dot + pick("com", "org", "net", "de", "fr", "es", "io")
    if kind == 1:
        return pick(".", ".", ".", "[.]", " . ").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        d, sep = with_luhn(rng, pick(16, 16, 16, 15, 13, 19)), pick("", "", " ", "-", ".", "/", "  ")
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    a, b, c = n(3), n(3), n(4)
    return pick(f"+{n(1)} ({a}) {b}-{c}", f"+{n(1)} ({a}) {b}-{c}", f"+{n(2)} {a} {b} {c}", f"+{n(2)}-{a}-{n(5)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{n(2)} {a} {b} {c}", f"+{n(2)}/{a}/{n(6)}")


def distract(rng) -> str:
    """Digits that are no personal data."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    forms = (f"{n(1)}.{n(1)}", f"{n(1)}.{n(1)}.{n(1)}", f"20{n(2)}-{n(2)}-{n(2)}", f"{n(2)}:{n(2)}", f"{n(1)},{n(3)}.{n(2)}", n(4), f"#{n(5)}", rng.bytes(20).hex(), f"{n(3)}-{n(2)}", f"@{n(2)}x")
    return forms[int(rng.integers(len(forms)))]


def plant(rng, words: str) -> tuple[str, list[Span]]:
    """words with invented data, sometimes two numbers in a row, or a distraction put between two of them."""
    at = int(rng.choice([0, len(words), *[m.end() for m in re.finditer(" ", words)]]))
    out, spans = words[:at] + (" " if at and words[at - 1] != " " else ""), []
    if rng.random() < 0.15:
        out += distract(rng)
    else:
        for kind in rng.integers(0, 4, 2 if rng.random() < 0.25 else 1).tolist():
            out += " " if spans else ""
            found = invent(rng, kind)
            spans.append((len(out), kind, len(out) + len(found)))
            out += found
    return out + ("" if at == len(words) else str(rng.choice([" ", " ", ", ", ". "]))) + words[at:], spans


def training_windows(df: DataFrame, text: str, ident: str) -> DataFrame:
    """(ident, codes, labels): windows of about TRAIN_DOCS rows drawn by a hash of ident.

    Some hold what the patterns find in the document, some what is planted in words of its own, by a
    generator seeded with ident. A window with a long digit run that no pattern accepts is left out: its
    characters look like a card, and only the Luhn check decides.
    """
    rows = df.select(ident).count()
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col(ident)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = df.filter(draw < min(1.0, TRAIN_DOCS / max(1, rows))).filter(F.length(text) > 0)

    def windows(i: str, t: str) -> Iterator[tuple[str, bytes, bytes]]:
        rng = np.random.default_rng(xxhash.xxh64_intdigest(i, SEED))
        y, spans = np.zeros(len(t), np.int8), base_spans(t)
        for s, k, e in spans:
            y[s:e] = k + 1
        doubtful = np.zeros(len(t), bool)
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 12 and not y[m.start() : m.end()].all():
                doubtful[m.start() : m.end()] = True
        top = max(1, len(t) - TRAIN_CHARS + 1)
        near = sorted({min(top - 1, max(0, s - int(rng.integers(20, TRAIN_CHARS - 20)))) for s, _, _ in spans[:TRAIN_WINDOWS]})
        x = codes(t)
        for s in [*near, int(rng.integers(top))]:
            if not doubtful[s : s + TRAIN_CHARS].any():
                yield i, x[s : s + TRAIN_CHARS].astype("<i2").tobytes(), y[s : s + TRAIN_CHARS].tobytes()
        for _ in range(2):
            s = int(rng.integers(top))
            words = t[s : s + int(rng.integers(10, 70))]
            if _TRIGGER.search(words):
                continue
            made, found = plant(rng, words)
            z = np.zeros(len(made), np.int8)
            for a, k, e in found:
                z[a:e] = k + 1
            yield i, codes(made)[:TRAIN_CHARS].astype("<i2").tobytes(), z[:TRAIN_CHARS].tobytes()

    def run(batches):
        for b in batches:
            got = [w for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in windows(str(i), t)]
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.binary(), pa.binary()), strict=True)], names=["ident", "x", "y"])

    bound_batches(df.sparkSession)
    return drawn.select(ident, text).mapInArrow(run, "ident string, x binary, y binary")


def _padded(windows: list[np.ndarray], fill: int, size: int) -> np.ndarray:
    out = np.full((len(windows), size), fill, np.int64)
    for i, w in enumerate(windows):
        out[i, : len(w)] = w
    return np.ascontiguousarray(out.T)


def train(rows: list[tuple[bytes, bytes]]) -> dict[str, np.ndarray] | None:
    """Parameters of the network from (codes, labels); None unless some window holds a span."""
    xs = [np.frombuffer(x, "<i2").astype(np.int64) for x, _ in rows]
    ys = [np.frombuffer(y, np.int8).astype(np.int64) for _, y in rows]
    by = [[i for i, y in enumerate(ys) if (y == k + 1).any()] for k in range(len(KINDS))]
    none = [i for i, y in enumerate(ys) if not y.any()]
    groups = [g for g in (*by, none) if g]
    if not any(by):
        return None
    net = Labeller.init(Lstm, PAD + 1, HIDDEN, len(KINDS) + 1, SEED)
    adam, rng = Adam(net.params, 0.02), np.random.default_rng(SEED)
    for step in range(STEPS):
        adam.rate = 0.02 * (1 - step / STEPS) + 0.001
        at = [int(g[j]) for g in groups for j in rng.integers(0, len(g), max(1, ROWS // len(groups)))]
        x, y = _padded([xs[i] for i in at], PAD, TRAIN_CHARS), _padded([ys[i] for i in at], 0, TRAIN_CHARS)
        mask = (x != PAD).astype(np.float32)

        def loss(s, y=y, mask=mask):
            value, ds, dt = crf_loss(s, net.params["trans"], y, mask)
            return value, ds, {"trans": dt}

        _, grads = net.gradients(x, mask, loss)
        adam.step(grads)
    return net.params


def certain_margin(trans: np.ndarray) -> float:
    """How much 'other' must outscore every other label at a position to be on the best path whatever its
    neighbours are: the most that two transitions can gain by another label there."""
    open_ = np.vstack([trans, np.zeros((1, trans.shape[1]))])  # the last row: no neighbour before
    shut = np.hstack([trans, np.zeros((trans.shape[0], 1))])  # the last column: none behind
    gain = open_[:, None, 1:] - open_[:, None, :1] + (shut[1:] - shut[:1]).T[None]
    return float(gain.max()) + 1e-3


def may_hold_spans(scores: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Whether the best path of a segment between two positions of 'other' may leave 'other'.

    To leave and return costs at least the best two such transitions; what a path can gain on the way is
    at most, at each position, the best other score and transition over those of 'other'.
    """
    over = trans - trans[0, 0]
    gain = np.maximum(0, scores[:, 1:].max(axis=1) - scores[:, 0] + max(0.0, float(over[1:, 1:].max())))
    return np.add.reduceat(gain.astype(np.float64), first) + over[0, 1:].max() + over[1:, 0].max() > -1e-3


def uncertain(params: dict[str, np.ndarray], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, scores) of all characters that are not surely 'other', in order.

    Every character is scored. Where two windows overlap, scores are pooled by how far into each window
    the character lies.
    """
    net, margin, step = Labeller(Lstm, params), certain_margin(params["trans"]), WINDOW - OVERLAP
    weight = (np.arange(1, OVERLAP + 1) / (OVERLAP + 1)).astype(np.float32)[:, None, None]
    starts = [range(0, max(1, len(t) - OVERLAP), step) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    start = np.concatenate([np.asarray(s) for s in starts]) if texts else np.empty(0, int)
    whole, x_of = np.array([len(t) for t in texts]), (-1, None)
    out, tail = [], None
    for at in range(0, len(start), PASS_ROWS):
        own, begin, rows = owner[at : at + PASS_ROWS], start[at : at + PASS_ROWS], []
        for i, s in zip(own.tolist(), begin.tolist(), strict=True):
            if x_of[0] != i:
                x_of = i, codes(texts[i])
            rows.append(x_of[1][s : s + WINDOW])
        x = _padded(rows, PAD, WINDOW)
        scores = net.scores(x, (x != PAD).astype(np.float32))
        # each window gives its characters up to the next window's; those it shares with the one before are pooled
        tails = scores[step:].copy()
        before = np.concatenate([tails[:, :, :1] if tail is None else tail, tails[:, :, :-1]], axis=2)
        pooled = scores[:OVERLAP] * weight + before * (1 - weight)
        scores[:OVERLAP] = np.where(begin > 0, pooled, scores[:OVERLAP])
        tail = tails[:, :, -1:]
        last = begin + WINDOW >= whole[own]
        mine = (np.arange(WINDOW)[:, None] < np.where(last, whole[own] - begin, step)[None, :])
        r, t = np.nonzero((mine & (scores[:, 0] - scores[:, 1:].max(axis=1) <= margin)).T)
        out.append((own[r], begin[r] + t, scores[t, :, r]))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty((0, len(KINDS) + 1), np.float32)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def label_texts(params: dict[str, np.ndarray], texts: list[str]) -> list[np.ndarray]:
    """Labels of every character: for each whole text the one best path over the pooled scores.

    A character that is surely 'other' cuts the path exactly, as no best path goes elsewhere there; what
    lies between two such characters is decoded with them as its ends, unless nothing there can outweigh
    the transitions that leave 'other' and return.
    """
    out = [np.zeros(len(t), np.int8) for t in texts]
    text, pos, scores = uncertain(params, texts)
    if not len(text):
        return out
    trans, whole = params["trans"], np.array([len(t) for t in texts])
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (pos[1:] != pos[:-1] + 1)])
    size = np.diff(np.r_[first, len(text)])
    ends = (pos[first] == 0) | (pos[first + size - 1] + 1 == whole[text[first]])
    order = np.flatnonzero(ends | may_hold_spans(scores, first, trans))
    order = order[np.argsort(size[order], kind="stable")]
    for at in range(0, len(order), DECODE_ROWS):
        part = order[at : at + DECODE_ROWS]
        f, n = first[part], size[part]
        index = np.minimum(f[None, :] + np.arange(n.max())[:, None], (f + n - 1)[None, :])
        opens, ends = pos[f] == 0, pos[f + n - 1] + 1 == whole[text[f]]
        path = viterbi(scores[index].transpose(0, 2, 1), trans, np.where(opens, 0, trans[0][:, None]), np.where(ends, 0, trans[:, 0][:, None]), n)
        for r, (a, m) in enumerate(zip(f.tolist(), n.tolist(), strict=True)):
            out[text[a]][pos[a] : pos[a] + m] = path[:m, r]
    return out


#: Most digits of a card and of a phone number; a run of more may hold several.
_MOST_DIGITS = {2: 19, 3: 15}
_GROUP = re.compile(r"[^ .,;:/-]+")


def _pieces(text: str, a: int, b: int, k: int) -> Iterator[Span]:
    """Valid spans of a kind in a run [a, b): the run itself, or else parts of it cut at separators, the
    longest from the left. A run that could be one number but fails its check is left alone."""
    fits = lambda s, e: not (text[s - 1 : s].isalnum() or text[e : e + 1].isalnum()) and valid(k, text[s:e])
    at = [(a + m.start(), a + m.end()) for m in _GROUP.finditer(text[a:b])]
    if at and fits(at[0][0], at[-1][1]):
        yield at[0][0], k, at[-1][1]
        return
    digits = [sum(c in "0123456789" for c in text[s:e]) for s, e in at]
    most = _MOST_DIGITS.get(k)
    if most and sum(digits) <= most:
        return
    i = 0
    while i < len(at):
        ends, n = [], 0
        for j in range(i, len(at)):
            n += digits[j]
            if n > (most or 1 << 30) or not most and " " in text[at[i][0] : at[j][1]]:
                break
            ends.append(j)
        hit = next((j for j in reversed(ends) if fits(at[i][0], at[j][1])), None)
        if hit is not None:
            yield at[i][0], k, at[hit][1]
        i = i + 1 if hit is None else hit + 1


def spans_of(text: str, labels: np.ndarray, base: list[Span]) -> list[Span]:
    """The network's valid spans beside the base spans. Runs of a label are widened to whole words and a
    leading + or bracket; base spans are cut off."""
    taken = np.zeros(len(text) + 1, bool)
    for s, _, e in base:
        taken[s:e] = True
    labels = np.where(taken[:-1], 0, labels)
    edges = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1], True])
    out, done = [], 0
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        kind = int(labels[a]) - 1
        a = max(a, done)
        if kind < 0 or b <= a:
            continue
        while a > done and not taken[a - 1] and (text[a - 1].isalnum() or text[a - 1] in "+("):
            a -= 1
        while b < len(text) and not taken[b] and text[b].isalnum():
            b += 1
        found = list(_pieces(text, a, b, kind))
        out += found
        done = max([done, *[e for _, _, e in found]])
    return out


def find(params, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text. The network works on a few texts at a time, for memory's sake."""
    out, at = [], 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end] or "") <= PASS_CHARS):
            chars += len(texts[end] or "")
            end += 1
        part = [t or "" for t in texts[at:end]]
        labels = label_texts(params, part) if params is not None else [None] * len(part)
        for t, y in zip(part, labels, strict=True):
            base = base_spans(t)
            out.append((base, sorted(base + spans_of(t, y, base)) if y is not None and y.any() else base))
        at = end
    return out


def fit(df: DataFrame, text: str = "text", ident: str = "doc_id") -> dict[str, np.ndarray] | None:
    """Parameters of the network, from a bounded sample of df; None for a table without spans to learn."""
    rows = training_windows(df, text, ident).collect()  # bounded: about TRAIN_DOCS * (TRAIN_WINDOWS + 3) windows
    return train([(bytes(r.x), bytes(r.y)) for r in sorted(rows, key=lambda r: (r.ident, bytes(r.x)))])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(df: DataFrame, text: str = "text", ident: str = "doc_id", params=False) -> DataFrame:
    """df plus n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end, comma-joined).

    The counts and the digest are of the patterns' spans; spans holds the network's too. Offsets are
    code points, ends exclusive. A null text is empty; null idents are drawn for training together; very
    long texts are decoded whole; equal texts, so repeated rows, have equal spans; an empty table gives
    an empty result, and without anything to learn from the patterns stand alone; clashing columns are
    replaced.
    """
    blob = pickle.dumps(fit(df, text, ident) if params is False else params)

    def make(col: pa.Array):
        net, rows = pickle.loads(blob), []  # some tens of kilobytes
        for base, every in find(net, col.to_pylist()):
            n = [sum(k == kind for _, k, _ in base) for kind in range(4)]
            rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return [pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2, strict=True)]

    out = [field(f"n_{k}", T.LongType()) for k in KINDS] + [field("base_sha256", T.StringType()), field("spans", T.StringType())]
    return arrow_columns(df, make, [text], out)


def mask_text(text: str | None, spans: list[Span]) -> str | None:
    """text with each run of overlapping spans replaced by the first one's kind in angle brackets."""
    if not spans:
        return text
    out, done, end = [], 0, -1
    for s, k, e in spans:
        if s >= end:
            out += [text[done:s], f"<{KINDS[k].upper()}>"]
        end = done = max(end, e)
    return "".join(out) + text[done:]


def redact(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """df with personal data in text masked and all other columns as they are. Null texts stay null, texts
    without any stay as they are; very long texts, repeated rows, null idents, empty tables as in detect."""
    rows, show = hide(df, text=text, ident=ident)
    blob = pickle.dumps(fit(rows, "text", "ident"))

    def make(col: pa.Array):
        texts = col.to_pylist()
        return [pa.array([mask_text(t, every) for t, (_, every) in zip(texts, find(pickle.loads(blob), texts), strict=True)], pa.string())]

    return show(arrow_columns(rows, make, ["text"], [field("text", T.StringType())]))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
