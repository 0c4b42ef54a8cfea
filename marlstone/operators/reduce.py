"""Embedding and reduction: offline embedder, principal components, and a neighbour layout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.sampling import exact_sample

Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedder(dim: int = 64, seed: int = 42) -> Embedder:
    """Offline stand-in for a sentence model: hashed words, random signs, unit length."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode(), seed)
                out[i, h % dim] += 1 if (h >> 16) & 1 else -1
                out[i, (h >> 8) % dim] += 1 if (h >> 17) & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


def embed_posts(posts: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """``id, embedding`` (array<float>) of every post, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "embedding": list(embedder(pdf[text].tolist()))})

    return posts.select("id", text).mapInPandas(run, "id string, embedding array<float>")


def fit_or_load(spark: SparkSession, path: str | None, fit: Callable[[], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Arrays of a model by name: those saved under ``path`` if there are any, else fitted and saved; nothing is kept without a path."""
    if path is not None:
        try:
            rows = spark.read.parquet(path).collect()  # one row for each array of the model
            return {r["name"]: np.array(r["values"], np.float64).reshape(r["shape"]) for r in rows}
        except AnalysisException:
            pass
    model = fit()
    if path is not None:
        rows = [(k, list(map(int, v.shape)), v.astype(float).ravel().tolist()) for k, v in model.items()]
        spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)
    return model


def principal_components(vectors: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """``id, reduced``: projections on the k leading components; moments are summed per task, one small matrix each."""
    dim_row = vectors.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).first()
    if dim_row is None:
        return vectors.select(F.col(key).alias("id"), F.lit(None).cast("array<double>").alias("reduced")).limit(0)
    dim = dim_row["d"]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, outer, n = np.zeros(dim), np.zeros((dim, dim)), 0
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), np.float64)
                total, outer, n = total + x.sum(0), outer + x.T @ x, n + len(x)
        yield pd.DataFrame({"n": [n], "total": [total], "outer": [outer.ravel()]})

    usable = vectors.filter(F.size(vector) == dim).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(~F.exists("v", lambda x: F.isnan(x) | x.isNull()))
    parts = usable.select("v").mapInPandas(moments, "n long, total array<double>, outer array<double>").collect()
    n = sum(p["n"] for p in parts)
    mean = sum(np.array(p["total"]) for p in parts) / n
    cov = sum(np.array(p["outer"]) for p in parts).reshape(dim, dim) / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    axes = axes[:, np.argsort(-values)[:k]]
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), dim)
            yield pd.DataFrame({"id": pdf["id"], "reduced": list((x - mean) @ axes)})

    return usable.mapInPandas(project, f"id {usable.schema['id'].dataType.simpleString()}, reduced array<double>")


def neighbour_layout(x: np.ndarray, k: int = 5, dim: int = 5, epochs: int = 100, negative: int = 5, seed: int = 42) -> np.ndarray:
    """Coordinates that keep neighbours near: fuzzy neighbour weights, principal start, seeded sampled descent."""
    n = len(x)
    if n <= dim + 1:
        return np.zeros((n, dim))
    rng = np.random.default_rng(seed)
    square = (x**2).sum(1)
    heads, tails, weights = [], [], []
    k = min(k, n - 1)
    for i in range(n):
        d = np.sqrt(np.maximum(square + square[i] - 2 * x @ x[i], 0))
        d[i] = np.inf
        near = np.argpartition(d, k - 1)[:k]
        gap = d[near] - d[near].min()
        scale = max(gap.mean(), 1e-6)
        heads += [i] * k
        tails += near.tolist()
        weights += np.exp(-gap / scale).tolist()
    heads_a, tails_a, w = np.array(heads), np.array(tails), np.array(weights)
    centred = x - x.mean(0)
    y = centred @ np.linalg.svd(centred, full_matrices=False)[2][:dim].T
    y = y / max(np.abs(y).max(), 1e-9) * 10
    for e in range(epochs):
        rate = 1.0 - e / epochs
        pick = rng.random(len(w)) < w
        a, b = heads_a[pick], tails_a[pick]
        diff = y[a] - y[b]
        sq = (diff**2).sum(1, keepdims=True)
        pull = np.clip(-2 * diff / (1 + sq), -4, 4) * rate
        np.add.at(y, a, pull)
        np.add.at(y, b, -pull)
        a2, c = np.repeat(a, negative), rng.integers(0, n, len(a) * negative)
        diff = y[a2] - y[c]
        sq = (diff**2).sum(1, keepdims=True)
        np.add.at(y, a2, np.clip(2 * diff / ((0.001 + sq) * (1 + sq)), -4, 4) * rate / negative)
    return y


def reduce_by_layout(vectors: DataFrame, key: str, vector: str, dim: int = 5, neighbours: int = 5, fraction: float = 0.1, seed: str = "42") -> DataFrame:
    """``id, reduced``: a layout fitted on ``fraction`` of the rows (200 at least), other rows at the weighted mean of their nearest fitted rows."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vec")).filter(F.col("vec").isNotNull())
    n = rows.count()
    sample = exact_sample(rows, "id", min(1.0, max(fraction, 200 / max(1, n))), seed).collect()
    base = np.array([r["vec"] for r in sample], np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((base, neighbour_layout(base, neighbours, dim) if len(base) else np.zeros((0, dim))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, places = shared.value
        square = (base * base).sum(1)
        for pdf in batches:
            x = np.array(pdf["vec"].tolist(), np.float64).reshape(len(pdf), base.shape[1])
            out = np.empty((len(x), places.shape[1]))
            step = max(1, 4_000_000 // max(1, len(base)))
            for at in range(0, len(x), step):
                part = x[at : at + step]
                d = np.sqrt(np.maximum((part * part).sum(1)[:, None] + square - 2 * part @ base.T, 0))
                near = np.argsort(d, axis=1, kind="stable")[:, :neighbours]
                w = 1 / (np.take_along_axis(d, near, 1) + 1e-9)
                out[at : at + step] = (places[near] * (w / w.sum(1, keepdims=True))[:, :, None]).sum(1)
            yield pd.DataFrame({"id": pdf["id"], "reduced": list(out)})

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, reduced array<double>")
