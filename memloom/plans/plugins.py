"""Plug-in contracts: what a part of a schedule must be, and a registry that holds parts by kind and name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieval, scoring, selection, weights
from ..schema import DIMS
from .presets import PRESETS, SchedulingConfig


class Retriever(Protocol):
    def __call__(self, queries: DataFrame, pool: DataFrame, k: int) -> DataFrame: ...


class Attention(Protocol):
    def __call__(self, candidates: DataFrame, weights: dict | None = None, enabled: tuple[str, ...] = ()) -> DataFrame: ...


class Selector(Protocol):
    def __call__(self, scored: DataFrame, k: int) -> DataFrame: ...


class Reward(Protocol):
    def __call__(self, like: Column) -> Column: ...


class Weight(Protocol):
    """(query_id, struct of four weights that sum to 1) for queries with q_emb and a condition."""

    def __call__(self, queries: DataFrame) -> DataFrame: ...


class Embedding(Protocol):
    """A vector for each text, as a column of one dimension."""

    dim: int

    def __call__(self, text: Column) -> Column: ...


class Model(Protocol):
    """(query_id, answer) for prompts(query_id, prompt): a model's raw answers, wherever they come from."""

    name: str

    def __call__(self, prompts: DataFrame) -> DataFrame: ...


class Factory(Protocol):
    """A schedule's configuration for a role (main, sub, reviewer)."""

    def __call__(self, role: str, **options) -> object: ...


class HashEmbedding:
    """Counts of character bigrams by digest, at unit length."""

    def __init__(self, dim: int = 128):
        self.dim = dim

    def __call__(self, text: Column) -> Column:
        return tx.hash_embedding(text, self.dim)


class PlaceholderEmbedding(HashEmbedding):
    """A vector drawn by a generator that the text's digest seeds: for want of a model."""

    def __call__(self, text: Column) -> Column:
        return tx.placeholder_embedding(text, self.dim).cast("array<double>")


class GramEmbedding(HashEmbedding):
    """The sum of a drawn vector for each gram, at unit length."""

    def __call__(self, text: Column) -> Column:
        return tx.gram_embedding(text, self.dim)


def prior_prompt(queries: DataFrame) -> DataFrame:
    """(query_id, prompt): asks for the four dimensions' weights of a query as a JSON object."""
    ask = f"Give weights of {', '.join(DIMS)} for recalling memories, as one JSON object of four numbers. Query: "
    return queries.select("query_id", F.concat(F.lit(ask), F.coalesce("q_text", F.lit(""))).alias("prompt"))


class PriorWeight:
    """Weights by a model's answers, the preset's where an answer holds none."""

    def __init__(self, model: Model, preset: str = "full"):
        self.model, self.preset = model, weights.PRESETS[preset]

    def __call__(self, queries: DataFrame) -> DataFrame:
        told = self.model(prior_prompt(queries)).select("query_id", weights.parse_prior(F.col("answer")).alias("weights"))
        fall = F.struct(*[F.lit(float(self.preset[d])).alias(d) for d in DIMS])
        return queries.select("query_id").join(told, "query_id", "left").select("query_id", F.coalesce("weights", fall).alias("weights"))


def role_preset(role: str, **options) -> SchedulingConfig:
    """The main role schedules over the graph, a sub role over the whole pool, a reviewer takes the best as they are."""
    base = {"main": "graph_g4", "sub": "full_ours", "reviewer": "baseline_reme"}
    return replace(PRESETS[base[role]], **options)


KINDS = ("retriever", "attention", "weight", "selector", "reward", "embed", "model", "factory")


class Registry:
    """Parts by 'kind.name'. A name is registered once; an unknown one is a KeyError."""

    def __init__(self):
        self._parts: dict[str, object] = {}

    def register(self, name: str, part=None):
        """Register part under name, or decorate with it; ValueError for an unknown kind or a name in use."""
        if part is None:
            return lambda f: self.register(name, f)
        if name.partition(".")[0] not in KINDS or not name.partition(".")[2]:
            raise ValueError(f"{name!r} does not name a part of one of {', '.join(KINDS)}")
        if name in self._parts:
            raise ValueError(f"{name!r} is registered already")
        self._parts[name] = part
        return part

    def get(self, name: str):
        return self._parts[name]

    def names(self, kind: str | None = None) -> list[str]:
        return sorted(n for n in self._parts if kind is None or n.startswith(f"{kind}."))


def standard() -> Registry:
    """A registry of the engine's own parts."""
    out = Registry()
    for kind, parts in (("retriever", retrieval.RETRIEVERS), ("attention", scoring.SCORERS), ("selector", selection.SELECTORS), ("weight", weights.PRESETS), ("reward", weights.REWARDS)):
        for name, part in parts.items():
            out.register(f"{kind}.{name}", part)
    for name, part in (("embed.hash", HashEmbedding), ("embed.placeholder", PlaceholderEmbedding), ("embed.grams", GramEmbedding), ("weight.prior", PriorWeight), ("factory.roles", role_preset)):
        out.register(name, part)
    return out


#: What a schedule reports to its callbacks: the stage's name and its lazy result.
Callback = Callable[[str, DataFrame], None]
STAGES = ("sources", "candidates", "scored", "selected")
