"""The four score dimensions and their combination, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DIMS
from .vectors import cosine

TIME_DECAY, FREQUENCY_RATE = 0.01, 0.1
HEAD = (0.5, 0.3, 0.2)


def time_score(now: Column, ts: Column, decay: Column | float = TIME_DECAY) -> Column:
    decay = F.lit(decay) if isinstance(decay, float) else decay
    return F.exp(-decay * F.greatest(F.lit(0.0), (now - ts) / 3600.0))


def semantic_score(q_emb: Column, emb: Column, vector: Column, bm25: Column) -> Column:
    return semantic_from_cosine(cosine(q_emb, emb), vector, bm25)


def semantic_from_cosine(cos: Column, vector: Column, bm25: Column) -> Column:
    """Weighted sum; a vector score that is the cosine adds its weight to it before one product, so that decimals of
    the cosine stay what they are and halves round as in SQL."""
    a, b, c = HEAD
    x, y = F.coalesce(cos, F.lit(0.0)), F.coalesce(vector, F.lit(0.0))
    return F.when(x == y, (a + b) * x).otherwise(a * x + b * y) + c * F.coalesce(bm25, F.lit(0.0))


def frequency_score(count: Column) -> Column:
    return 1.0 - F.exp(-FREQUENCY_RATE * count)


def task_score(wanted: Column, given: Column) -> Column:
    return F.when(wanted.isNull() | given.isNull(), F.lit(0.5)).when(wanted == given, F.lit(1.0)).otherwise(F.lit(0.3))


def masked(weights: dict[str, float], enabled: tuple[str, ...] = ()) -> dict[str, float]:
    """Weights with disabled dimensions at 0; an empty choice enables all."""
    on = enabled or DIMS
    return {d: (weights[d] if d in on else 0.0) for d in DIMS}


def final_score(scores: dict[str, Column], weights: dict[str, Column | float]) -> Column:
    """Weighted mean of the dimensions; weights that sum to 0 count as 1."""
    w = {d: F.lit(float(x)) if isinstance(x, (int, float)) else x for d, x in weights.items()}
    total = sum((w[d] for d in DIMS[1:]), w[DIMS[0]])
    value = sum((w[d] * scores[d] for d in DIMS[1:]), w[DIMS[0]] * scores[DIMS[0]])
    return value / F.when(total == 0, F.lit(1.0)).otherwise(total)
