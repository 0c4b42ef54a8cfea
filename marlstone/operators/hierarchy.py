"""Hierarchies of topics from their similarities: linkage, flat cuts, elbow data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Topics that one linkage takes, at most: it is a matrix on one machine.
MOST_TOPICS = 5_000
METHODS = ("single", "complete", "average", "weighted", "ward")


def linkage(distance: np.ndarray, method: str = "average") -> np.ndarray:
    """Merges (a, b, distance, size) of a distance matrix, by the Lance-Williams update; ties go to the smaller indices."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    n = len(distance)
    d = distance.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    names, size, out = list(range(n)), np.ones(n), np.empty((max(0, n - 1), 4))
    alive = np.ones(n, bool)
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        a, b, dij = size[i], size[j], d[i, j]
        lo, hi = sorted((names[i], names[j]))
        out[step] = lo, hi, dij, a + b
        di, dj = d[i], d[j]
        if method == "single":
            new = np.minimum(di, dj)
        elif method == "complete":
            new = np.maximum(di, dj)
        elif method == "average":
            new = (a * di + b * dj) / (a + b)
        elif method == "weighted":
            new = (di + dj) / 2
        else:
            new = np.sqrt(np.maximum(((a + size) * di**2 + (b + size) * dj**2 - size * dij**2) / (a + b + size), 0))
        alive[j] = False
        new = np.where(alive, new, np.inf)
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i], names[i] = a + b, n + step
    return out


def flat_cut(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels 1.. of at most k flat clusters: the first n - k merges are kept; numbered by first member."""
    root = list(range(2 * n - 1))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for step in range(max(0, n - max(1, k))):
        for side in merges[step, :2]:
            root[find(int(side))] = n + step
    names: dict[int, int] = {}
    return np.array([names.setdefault(find(i), len(names) + 1) for i in range(n)])


def _matrix(pairs: pd.DataFrame, topics: list) -> np.ndarray:
    at = {t: i for i, t in enumerate(topics)}
    d = np.ones((len(topics), len(topics)))
    for a, b, s in zip(pairs["a"], pairs["b"], pairs["similarity"]):
        d[at[a], at[b]] = d[at[b], at[a]] = 1 - s
    np.fill_diagonal(d, 0)
    return d


def _bounded(topics: DataFrame, column: str) -> list:
    rows = [r[0] for r in topics.select(column).distinct().orderBy(column).limit(MOST_TOPICS + 1).collect()]
    if len(rows) > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics")
    return rows


def topic_linkage(topics: DataFrame, pairs: DataFrame, column: str = "cluster", method: str = "average") -> DataFrame:
    """``step, a, b, distance, size`` rows; topics number at most ``MOST_TOPICS``."""
    names = _bounded(topics, column)
    z = linkage(_matrix(pairs.toPandas(), names), method)
    rows = [(i, int(a), int(b), round(float(x), 6), int(s)) for i, (a, b, x, s) in enumerate(z)]
    return topics.sparkSession.createDataFrame(rows, "step int, a int, b int, distance double, size int")


def topic_cuts(topics: DataFrame, pairs: DataFrame, words: DataFrame, column: str = "cluster", sizes: range | None = None) -> DataFrame:
    """``k, topic, label, diversity``: flat cuts of several sizes with the distinct share of each cut's words."""
    names = _bounded(topics, column)
    z = linkage(_matrix(pairs.toPandas(), names))
    spark, n = topics.sparkSession, len(names)
    rows = [(k, t, int(x)) for k in (sizes or range(10, max(11, min(n, 40)))) for t, x in zip(names, flat_cut(z, n, k))]
    cuts = spark.createDataFrame(rows, f"k int, {column} {topics.schema[column].dataType.simpleString()}, label int")
    spread = cuts.join(words.select(column, "term").distinct(), column).groupBy("k").agg(F.round(F.count_distinct("term") / F.count_distinct("label", "term"), 6).alias("diversity"))
    return cuts.join(spread, "k", "left")
