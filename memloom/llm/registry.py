"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, codebooks, langid, media, mixing, phrases, pii, quality, sharding, simhash, tokencount, toolcalls, urlfilter

MODULES = (bpe, quality, sharding, langid, mixing, simhash, pii, urlfilter, media, toolcalls, codebooks, tokencount, phrases)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
