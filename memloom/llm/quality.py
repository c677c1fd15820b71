"""Quality rules as a short-circuit cascade.

Every rule rejects or passes a text. Each rule's cost and rejection rate are measured on a bounded
sample; rules then run in the order of rejections per cost, and a text leaves at its first rejection.
The order only saves time: a text is kept exactly if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_columns, documents, field

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: ASCII bytes that are neither letters nor separate words.
NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha() and c not in SPACE)
#: Costs and rejection rates are estimated on so many texts of at most so many bytes each (25 MB in all).
SAMPLE_ROWS, SAMPLE_BYTES = 400, 1 << 16
#: From so many words on, windows are counted in numpy.
NUMPY_WORDS = 256


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words which the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if n < NUMPY_WORDS:
        seen: dict[tuple, list] = {}
        windows = list(zip(*(words[i:] for i in range(width)), strict=False))
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        if len(seen) == n:
            return 0
        twice = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    else:
        code: dict[bytes, int] = {}
        ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
        key = ids[:n]
        for i in range(1, width):
            if i > 1:  # renumber, so products stay below 2**63 in texts of any length
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(code) + ids[i : n + i]
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = count[at] > 1
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : n + i] |= twice
    return int(covered.sum())


class Stats:
    """Measures of one text, each computed when first asked for. Null is an empty text."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # at exactly the six bytes of SPACE

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def alpha_words(self) -> int:
        return len(self.raw.translate(None, NO_LETTERS).split())  # words with a letter outlive the deletion


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Stats], bool]


#: The production rules. Limits are fixed parameters of the method.
RULES = (
    Rule("few_words", lambda s: s.n_words < 50),
    Rule("repeated_windows", lambda s: 100 * s.n_repeat_words > 50 * s.n_words),
    Rule("word_length", lambda s: not 2 * s.n_words <= s.word_chars <= 15 * s.n_words),
    Rule("symbols", lambda s: 10 * s.n_symbols > 3 * s.n_words),
    Rule("duplicate_lines", lambda s: 10 * s.n_dup_lines > 7 * len(s.lines)),
    Rule("alphabetic_words", lambda s: 10 * s.alpha_words < 6 * s.n_words),
)
BASE = ("few_words", "repeated_windows")


def order_rules(texts: list[str | None], rules=RULES, clock=time.perf_counter) -> list[Rule]:
    """Rules by rejections per second, each measured on the texts that the rules before it let through.

    Every rule starts without what others computed. Ties and an empty sample keep the given order.
    """
    left, out, texts = list(rules), [], list(texts)
    while left:
        worth = []
        for r in left:
            began = clock()
            rejected = [r.rejects(Stats(t)) for t in texts]
            worth.append((sum(rejected) / max(clock() - began, 1e-9), rejected))
        k = max(range(len(left)), key=lambda i: worth[i][0])
        texts = [t for t, gone in zip(texts, worth[k][1], strict=True) if not gone]
        out.append(left.pop(k))
    return out


STATS = [field(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]


def quality(df: DataFrame, text: str = "text", rules=RULES, stats: bool = False, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """df plus kept and rejected_by (the first rule of the cascade that rejects, else null).

    stats=True adds the base measures and base_failed for every row, rejected or not. Null and empty
    texts have no words and are rejected; very long texts are judged whole; repeated rows are judged
    alike; an empty table gives an empty result; clashing columns are replaced. The sample is the first
    sample_rows rows the scan meets whose texts have SAMPLE_BYTES at most; it sets the order of rules,
    never a verdict. As the order follows measured times, rejected_by may name another of several
    rejecting rules in a rerun; kept never differs.
    """
    small = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) <= SAMPLE_BYTES
    sample = [r[0] for r in df.filter(small).select(F.col(f"`{text}`")).limit(sample_rows).collect()]
    cascade = order_rules(sample, rules)

    def make(col: pa.Array):
        rows = []
        for t in col.to_pylist():
            s = Stats(t)
            by = next((r.name for r in cascade if r.rejects(s)), None)
            if stats:
                base = s.n_words < 50 or 100 * s.n_repeat_words > 50 * s.n_words
                rows.append((by is None, by, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, base))
            else:
                rows.append((by is None, by))
        cols = list(zip(*rows, strict=True)) or [()] * (8 if stats else 2)
        kinds = [pa.bool_(), pa.string(), *[pa.int64()] * 5, pa.bool_()]
        return [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]

    out = [field("kept", T.BooleanType()), field("rejected_by", T.StringType())]
    if stats:
        out += [*STATS, field("base_failed", T.BooleanType())]
    return arrow_columns(df, make, [text], out)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    out = quality(documents(spark, sf_dir).select("doc_id", "text"), stats=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT rid, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM d
), g AS (
  SELECT rid, i, w1, lead(w1) OVER (PARTITION BY rid ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY rid ORDER BY i) AS w3 FROM p
), c AS (
  SELECT rid, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w1, w2, w3) > 1 AS twice FROM g
), k AS (
  SELECT rid, twice OR coalesce(lag(twice) OVER (PARTITION BY rid ORDER BY i), false) OR coalesce(lag(twice, 2) OVER (PARTITION BY rid ORDER BY i), false) AS hit FROM c
), r AS (
  SELECT rid, count(*) FILTER (hit) AS n_repeat_words FROM k GROUP BY rid
), l AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS alpha_words
  FROM d LEFT JOIN l USING (rid) LEFT JOIN r USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= 3 * n_words
       AND 10 * n_dup_lines <= 7 * n_lines AND 10 * alpha_words >= 6 * n_words AS kept
FROM b
"""

QUERIES = {"op2_quality_cascade": op2_quality}
ORACLES = {"op2_quality_cascade": ORACLE_SQL}
