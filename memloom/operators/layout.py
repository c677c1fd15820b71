"""Two-dimensional layout of vectors by their principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum, sum of outer products) of the vectors; each task sends one sum, d * d numbers."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, c = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                x = np.stack(b[vec].to_list())
                n, s, c = n + len(x), s + x.sum(axis=0), c + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "c": [c.ravel().tolist()]})

    each = df.select(vec).filter(F.col(vec).isNotNull()).mapInPandas(part, "n long, s array<double>, c array<double>")
    long = each.select("n", F.posexplode(F.concat("s", "c")).alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("i").collect()
    if not long:
        return 0, np.zeros(0), np.zeros((0, 0))
    x = np.array([r.x for r in long])
    d = round((np.sqrt(1 + 4 * len(x)) - 1) / 2)
    return long[0].n, x[:d], x[d:].reshape(d, d)


def pca_layout(df: DataFrame, vec: str = "emb") -> DataFrame:
    """df plus x and y in [0, 1]: the first two principal components, scaled to the range of all rows.

    A component's sign is fixed by its largest entry. Rows without a vector, and tables of fewer than two
    vectors, are put in the middle.
    """
    n, s, c = moments(df, vec)
    middle = {"x": F.lit(0.5), "y": F.lit(0.5)}
    if n < 2:
        return df.withColumns(middle)
    _, v = np.linalg.eigh(c / n - np.outer(s / n, s / n))
    axes = [a * np.sign(a[np.abs(a).argmax()]) for a in v[:, ::-1].T[:2]]
    mean = s / n
    proj = {k: F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(w)) for w in a]), lambda p, w: p * w), F.lit(float(-mean @ a)), lambda t, p: t + p) for k, a in zip("xy", axes, strict=False)}
    out = df.withColumns(proj)
    ends = out.agg(*[f(k).alias(f"_{n_}{k}") for k in proj for n_, f in (("lo", F.min), ("hi", F.max))])
    out = out.join(F.broadcast(ends))  # one row
    scale = lambda k: F.coalesce(F.when(F.col(f"_hi{k}") > F.col(f"_lo{k}"), (F.col(k) - F.col(f"_lo{k}")) / (F.col(f"_hi{k}") - F.col(f"_lo{k}"))), F.lit(0.5))
    return out.withColumns({k: scale(k) for k in proj} | {k: e for k, e in middle.items() if k not in proj}).drop(*[c for c in ends.columns])


def grid_layout(df: DataFrame, order: str, width: int = 8) -> DataFrame:
    """df plus cell coordinates in rows of `width`."""
    i = F.row_number().over(Window.orderBy(order)) - 1
    return df.withColumn("_i", i).withColumns({"gx": F.col("_i") % width, "gy": F.floor(F.col("_i") / width)}).drop("_i")
