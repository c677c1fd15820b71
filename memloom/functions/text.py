"""Text expressions."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tokens leave out.
STOPWORDS = (
    "的", "了", "是", "在", "和", "有", "我", "你", "他", "她", "它", "与", "就", "都", "而", "及", "着", "或",
    "the", "a", "an", "is", "are", "was", "were", "to", "of", "in", "and", "or", "for", "on", "with", "at", "by", "from", "as",
)

# Signs of an API error's class, in the order they are tried.
API_ERRORS = (
    ("balance", ("402", "insufficient balance", "余额", "quota", "额度", "overlimit")),
    ("auth", ("401", "invalid_api_key", "authentication", "鉴权", "apikey")),
    ("forbidden", ("403", "forbidden", "permission", "无权")),
    ("rate_limit", ("429", "rate", "limit", "限流", "throttl")),
    ("network", ("timeout", "timed out", "connection", "网络", "connect", "resolve")),
)

CJK = r"[一-鿿]"


def _token_pattern() -> str:
    """CJK characters and whole runs of a-z0-9, unless they are stop words: the pattern leaves those out
    itself, so that no lambda runs over the tokens."""
    cjk = "".join(w for w in STOPWORDS if not w.isascii())
    words = "|".join(w for w in STOPWORDS if w.isascii())
    return f"[一-鿿&&[^{cjk}]]|(?<![a-z0-9])(?!(?:{words})(?![a-z0-9]))[a-z0-9]+"


def tokens(text: Column) -> Column:
    """CJK characters and runs of a-z0-9 of the lower-cased text, without stop words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_token_pattern()), F.lit(0))


def prior_key(query: Column, condition: Column) -> Column:
    """The cache key of a query under a condition."""
    q = F.trim(F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"\s+", " "))
    return F.sha1(F.concat(q, F.lit("||"), F.coalesce(condition, F.lit(""))).cast("binary"))


def api_error_class(code: Column, message: Column) -> Column:
    s = F.lower(F.concat_ws(" ", code.cast("string"), message))
    out = F.lit("other")
    for name, signs in reversed(API_ERRORS):
        hit = F.lit(False)
        for sign in signs:
            hit = hit | s.contains(sign)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def cost_tokens(chars: Column) -> Column:
    """Tokens that a number of characters costs."""
    return F.floor(chars / F.lit(1.5)).cast("long")


def trace_tokens(text: Column) -> Column:
    """CJK characters, plus words, plus a quarter of what else there is."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(t, F.lit(CJK))
    words = F.regexp_count(t, F.lit("[A-Za-z0-9]+"))
    inside = F.length(F.regexp_replace(t, "[^A-Za-z0-9]+", ""))
    return (cjk + words + F.floor(F.greatest(F.lit(0), F.length(t) - inside) / 4)).cast("long")


def hash_vector(text: str | None, dim: int = 128) -> list[float]:
    """Counts of character bigrams by md5 bucket, at unit length; zeros for blank text."""
    t, counts = (text or "").strip(), [0.0] * dim
    if not t:
        return counts
    for gram, n in Counter(t[i : i + 2] for i in range(max(len(t) - 1, 1))).items():
        counts[int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % dim] += n
    size = math.sqrt(sum(x * x for x in counts))
    return [x / size for x in counts]


def hash_embedding(text: Column, dim: int = 128) -> Column:
    """hash_vector as a column, in Arrow batches: one pass over a text, where lambdas would make dim."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_vector(t, dim))

    return embed(text)


def placeholder_embedding(text: Column, dim: int) -> Column:
    """A unit vector drawn by a generator that the text's digest seeds; zeros for blank text."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return [0.0] * dim
            v = np.random.default_rng(int(hashlib.sha256(t.encode()).hexdigest()[:8], 16)).normal(0, 1, dim).astype(np.float32)
            return (v / np.linalg.norm(v)).tolist()

        return texts.map(one)

    return embed(text)


def grams(text: str) -> list[str]:
    """Runs of a-z0-9 and single CJK characters of the lower-cased text, and each two neighbours joined."""
    words = re.findall("[a-z0-9]+|[一-鿿]", text.lower())
    return words + [a + b for a, b in zip(words, words[1:], strict=False)]


def gram_embedding(text: Column, dim: int = 96) -> Column:
    """A unit vector that texts with common grams share: the sum of a vector for each gram, drawn by a generator that
    the gram's digest seeds. Zeros for texts without grams."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        drawn: dict[str, np.ndarray] = {}  # of this batch

        def one(t):
            total = np.zeros(dim)
            for g in grams(t or ""):
                if g not in drawn:
                    drawn[g] = np.random.default_rng(int(hashlib.md5(g.encode()).hexdigest()[:8], 16)).normal(size=dim)
                total += drawn[g]
            length = np.linalg.norm(total)
            return (total / length if length > 0 else total).tolist()

        return texts.map(one)

    return embed(text)


def infer_edge_type(similarity: Column) -> Column:
    from ..schema import EDGE_FALLBACK, EDGE_FROM_SIMILARITY

    out = F.lit(EDGE_FALLBACK)
    for name, least in reversed(EDGE_FROM_SIMILARITY):
        out = F.when(similarity >= least, F.lit(name)).otherwise(out)
    return out


def base_strength(edge_type: Column) -> Column:
    from ..schema import EDGE_STRENGTH

    out = F.lit(0.3)
    for name, s in EDGE_STRENGTH.items():
        out = F.when(edge_type == name, F.lit(s)).otherwise(out)
    return out


def memory_lines(text: Column) -> Column:
    """Candidate memory lines of a note: bullets removed, split at semicolons and full stops, 8 to 160 characters."""
    lines = F.split(F.regexp_replace(text, r"(?m)^\s*(?:[-*•]|\d+[.)、])\s*", ""), "[\\n；;。]+")
    return F.filter(F.transform(lines, F.trim), lambda x: F.length(x).between(8, 160))


def short_title(text: Column, n: int = 8) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)
