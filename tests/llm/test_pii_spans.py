"""Spans of the network that the patterns do not find."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import memloom.llm.nets as N
import memloom.llm.pii as P

CARD = "4242424242424242"


def spans(text, *runs):
    labels = np.zeros(len(text), np.int8)
    for part, k in runs:
        labels[text.index(part) : text.index(part) + len(part)] = k + 1
    return [(text[s:e], k) for s, k, e in P.spans_of(text, labels, P.base_spans(text))]


def test_run_of_several_cards_is_split():
    for card in (CARD, "4242 4242 4242 4242"):
        text = f"pay {card} {card} now"
        assert P.base_spans(text) == [] and spans(text, (f"{card} {card}", 2)) == [(card, 2)] * 2


def test_base_spans_are_trimmed_off_a_run():
    text = f"ids {CARD} {CARD}x a.b@c.de, {CARD} {CARD} end"
    assert [k for _, k, _ in P.base_spans(text)] == [0]
    assert spans(text, (f"a.b@c.de, {CARD} {CARD}", 2)) == [(CARD, 2)] * 2


def test_runs_are_widened_to_words():
    text = "call +1 (826) 555-4081 97.51.17.173 now"
    assert [k for _, k, _ in P.base_spans(text)] == [1]  # the phone's pattern runs into the address and fails
    assert spans(text, ("1 (826) 555-40", 3)) == [("+1 (826) 555-4081", 3)]


def test_numbers_that_fail_stay():
    assert spans("no 4242 4242 4242 4241 end", ("4242 4242 4242 4241", 2)) == []
    assert spans(f"no x{CARD} end", (CARD, 2)) == []
    assert spans("on 2024-11-26 and 12", ("2024-11-26", 3)) == []


@pytest.mark.parametrize("kind, found", [(0, "ann (at) mail [dot] org"), (0, "ann[at]mail.org"), (1, "10[.]0[.]0[.]1"), (2, "4242.4242.4242.4242"), (3, "(826) 555-4081"), (3, "0049 30 1234567"), (3, "826-555-4081")])
def test_forms_beyond_the_patterns(kind, found):
    assert P.valid(kind, found) and not any(k == kind for _, k, _ in P.base_spans(found))


def noise(rng, K=5):
    """Scores as a network gives: mostly sure of 'other', here and there in doubt."""
    n = int(rng.integers(1, 400))
    s = rng.normal(0, 1.5, (n, K)).astype(np.float32)
    s[:, 0] += np.where(rng.random(n) < 0.7, 9, 1)
    return s


def test_decoding_in_parts_is_decoding_the_whole(monkeypatch):
    """label_texts against one uncut decoding of each text."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        trans = rng.normal(0, 1.5, (5, 5)).astype(np.float32)
        scores = [noise(rng) for _ in range(6)]
        margin = P.certain_margin(trans)

        def doubtful(params, texts, scores=scores, margin=margin):
            at = [np.flatnonzero(s[:, 0] - s[:, 1:].max(axis=1) <= margin) for s in scores]
            return np.repeat(np.arange(len(scores)), [len(a) for a in at]), np.concatenate(at), np.concatenate([s[a] for s, a in zip(scores, at, strict=True)])

        monkeypatch.setattr(P, "uncertain", doubtful)
        got = P.label_texts({"trans": trans}, ["x" * len(s) for s in scores])
        assert all((g == N.viterbi(s[:, :, None], trans)[:, 0]).all() for g, s in zip(got, scores, strict=True))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text != ''")


@pytest.fixture(scope="module")
def net(docs):
    return P.fit(docs.filter("doc_id % 3 != 0"))


def test_planted_spans_of_other_documents_are_found(docs, net):
    """Held-out documents with invented data: what the network adds is nearly all of what the patterns miss."""
    rng, texts, wants = np.random.default_rng(5), [], []
    for r in docs.filter("doc_id % 3 = 0").orderBy("doc_id").collect():
        for _ in range(4):
            at = int(rng.integers(max(1, len(r.text) - 400)))
            words = r.text[at : at + 400]
            if not P._TRIGGER.search(words):
                text, want = P.plant(rng, words)
                texts.append(text)
                wants.append(set(want))
    found = P.find(net, texts)
    n = lambda sets: sum(map(len, sets))
    hits = n(w & set(a) for w, (_, a) in zip(wants, found, strict=True))
    assert hits >= 0.88 * n(wants) and hits >= 0.94 * n(a for _, a in found)
    hidden, added = [w - set(b) for w, (b, _) in zip(wants, found, strict=True)], [set(a) - set(b) for b, a in found]
    assert n(hidden) > 200 and n(h & a for h, a in zip(hidden, added, strict=True)) >= 0.8 * n(hidden)
    assert n(h & a for h, a in zip(hidden, added, strict=True)) >= 0.9 * n(added)


def test_clean_documents_stay_clean(docs, net):
    texts = [r.text for r in docs.filter(~F.col("text").rlike("[0-9@]")).collect()]
    assert len(texts) > 500 and all(not a for _, a in P.find(net, texts))


def test_very_long_text_is_one_decoding(net):
    words = "und der stand " * 9000
    text = words[:60_000] + "mail ann(at)host.example.org oder (826) 555-4081 " + words[60_000:]
    scores = []
    keep = P.uncertain
    labels = P.label_texts(net, [text])[0]
    try:
        P.certain_margin, margin = (lambda trans: 1e9), P.certain_margin  # every character takes part
        scores = keep(net, [text])[2]
    finally:
        P.certain_margin = margin
    assert len(scores) == len(text) and (labels == N.viterbi(scores[:, :, None], net["trans"])[:, 0]).all()
    assert {text[s:e] for s, _, e in P.find(net, [text])[0][1]} >= {"ann(at)host.example.org"}


def test_scores_of_overlaps_are_pooled(net):
    """A text's scores window by window, by the plain forward pass."""
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("ab 1.@-(é"), 700))
    x, step = P.codes(text), P.WINDOW - P.OVERLAP
    total, weight = np.zeros((len(text), 5)), np.zeros(len(text))
    lab = N.Labeller(N.Lstm, net)
    starts = list(range(0, len(text) - P.OVERLAP, step))
    for s in starts:
        part = x[s : s + P.WINDOW][:, None]
        mask = np.ones(part.shape, np.float32)
        f, b = (N.Lstm(net, tag, tag == "b").forward(part, mask)[0] for tag in "fb")
        one = (np.matmul(net["V"], np.concatenate([f, b], axis=1)) + lab.params["c"])[:, :, 0]
        w = np.ones(len(part))
        ramp = np.arange(1, P.OVERLAP + 1) / (P.OVERLAP + 1)
        if s:
            w[: P.OVERLAP] = ramp[: len(w)]
        if s + P.WINDOW < len(text):
            w[-P.OVERLAP :] = np.minimum(w[-P.OVERLAP :], ramp[::-1])
        total[s : s + len(w)] += one * w[:, None]
        weight[s : s + len(w)] += w
    keep = P.certain_margin
    try:
        P.certain_margin = lambda trans: 1e9
        _, pos, got = P.uncertain(net, [text])
    finally:
        P.certain_margin = keep
    assert pos.tolist() == list(range(len(text))) and np.allclose(got, total / weight[:, None], atol=1e-3)
