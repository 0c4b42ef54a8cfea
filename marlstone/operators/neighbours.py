"""Exact nearest neighbours of a bounded query set against all rows, in blocks.

Rows are cut into blocks of matrix rows; a block of queries travels to every task, scans its
rows with numpy and returns its k best; the best of all tasks are merged. Memory per task is a
block of each side, whatever the table's size. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.vectors import distance

#: Query rows that travel at once.
BLOCK = 4096


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "vec", block: int = BLOCK) -> DataFrame:
    """``id, rank, other, distance``: the k nearest rows of each query row, itself left out (Euclidean)."""
    out: DataFrame | None = None
    kind = rows.schema[key].dataType.simpleString()
    ddl = f"id {kind}, other {kind}, distance double"
    batch: list = []

    def scan(part: list) -> DataFrame:
        ids = [r[0] for r in part]
        q = np.array([r[1] for r in part], np.float64)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.array(pdf[vector].tolist(), np.float64)
                other = pdf[key].to_numpy()
                order = np.argsort(other, kind="stable")
                x, other = x[order], other[order]
                found = []
                for i, own in enumerate(ids):
                    d = np.sqrt(((x - q[i]) ** 2).sum(1))
                    d[other == own] = np.inf
                    best = np.argsort(np.round(d, 9), kind="stable")[:k]
                    found += [(own, other[j], float(d[j])) for j in best if np.isfinite(d[j])]
                yield pd.DataFrame(found, columns=["id", "other", "distance"])

        return rows.select(key, vector).mapInPandas(run, ddl)

    for r in queries.select(key, vector).filter(F.col(vector).isNotNull()).toLocalIterator():
        batch.append(r)
        if len(batch) == block:
            out = scan(batch) if out is None else out.unionByName(scan(batch))
            batch = []
    if batch or out is None:
        out = scan(batch) if out is None else out.unionByName(scan(batch))
    w = Window.partitionBy("id").orderBy(F.round("distance", 9), "other")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("id", "rank", "other", "distance")


def core_distances(neighbours: DataFrame, k: int) -> DataFrame:
    """``id, core``: distance to the k-th neighbour."""
    return neighbours.filter(F.col("rank") == k).select("id", F.col("distance").alias("core"))


def ranks_of(rows: DataFrame, pairs: DataFrame, key: str = "id", vector: str = "vec", block: int = BLOCK) -> DataFrame:
    """``id, other, rank`` of given pairs: the place of ``other`` among all rows by distance from ``id``.

    Tasks only count the rows that are nearer than each wanted one; counts are added up, so no
    more rows come out than pairs went in for each task.
    """
    kind = rows.schema[key].dataType.simpleString()
    left = rows.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    right = rows.select(F.col(key).alias("other"), F.col(vector).alias("w"))
    far = pairs.select("id", "other").join(left, "id").join(right, "other").withColumn("d", F.round(distance(F.col("v"), F.col("w")), 9))
    wanted = far.groupBy("id").agg(F.first("v").alias("v"), F.collect_list(F.struct("d", "other")).alias("wanted"))

    def scan(part: list) -> DataFrame:
        asked = [(r["id"], np.array(r["v"], np.float64), [x["other"] for x in r["wanted"]], [x["d"] for x in r["wanted"]]) for r in part]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                x, ids = np.array(pdf[vector].tolist(), np.float64), pdf[key].to_numpy()
                out = []
                for own, v, others, limits in asked:
                    d = np.round(np.sqrt(((x - v) ** 2).sum(1)), 9)
                    keep = ids != own
                    for o, limit in zip(others, limits):
                        out.append((own, o, int((((d < limit) | ((d == limit) & (ids < o))) & keep).sum())))
                yield pd.DataFrame(out, columns=["id", "other", "nearer"])

        return rows.select(key, vector).filter(F.col(vector).isNotNull()).mapInPandas(run, f"id {kind}, other {kind}, nearer long")

    out, batch = None, []
    for r in wanted.toLocalIterator():
        batch.append(r)
        if len(batch) == block:
            out = scan(batch) if out is None else out.unionByName(scan(batch))
            batch = []
    if batch or out is None:
        out = scan(batch) if out is None else out.unionByName(scan(batch))
    return out.groupBy("id", "other").agg((F.sum("nearer") + 1).alias("rank"))


def trustworthiness(ranks: DataFrame, n: int, k: int) -> DataFrame:
    """``trust``: 1 minus the scaled excess of full-space ranks of the pairs that are neighbours in the reduced space."""
    excess = F.coalesce(F.sum(F.greatest(F.col("rank") - k, F.lit(0))), F.lit(0))
    return ranks.agg((1 - F.lit(2.0 / (n * k * (2 * n - 3 * k - 1))) * excess).alias("trust"))
