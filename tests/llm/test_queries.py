"""The queries of the encoder and of personal data over a whole table, against the library and plain patterns."""

import base64
import hashlib
import re

import public_tokenizers
import tiktoken

from memloom.llm.registry import QUERIES


def test_op1_equals_the_library(spark, sf):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha((r.text or "").encode())))
    got = QUERIES["op1_byte_bpe"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def luhn(digits):
    odd = digits[::-1]
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(odd)) % 10 == 0


def plain_spans(text):
    """Base spans as the contract words them: leftmost matches that do not overlap, those that fail dropped."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    laws = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    found = [(m.start(), list(laws).index(k), f"{k}:{m.start()}:{m.end()}") for k, (p, ok) in laws.items() for m in re.finditer(p, text) if ok(m.group())]
    return [s for *_, s in sorted(found)]


def test_op10_base_spans_over_all_documents(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = plain_spans(r.text or "")
        n = [sum(s.startswith(f"{k}:") for s in spans) for k in ("email", "ip", "card", "phone")]
        want[r.doc_id] = (*n, hashlib.sha256(",".join(spans).encode()).hexdigest(), spans)
    got = QUERIES["op10_pii"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        *base, spans = want[r.doc_id]
        every = r.spans.split(",") if r.spans else []
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == base and set(spans) <= set(every)
