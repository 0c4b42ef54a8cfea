"""Comparing and judging clusterings: contingency, matching, ARI, DBCV, relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(left: DataFrame, right: DataFrame) -> DataFrame:
    """``l1, l2, n`` from two ``id, label`` tables."""
    joined = left.select("id", F.col("label").alias("l1")).join(right.select("id", F.col("label").alias("l2")), "id")
    return joined.groupBy("l1", "l2").agg(F.count(F.lit(1)).alias("n"))


def best_overlap(table: DataFrame) -> DataFrame:
    """``l1, l2, n``: for each left label the right label with most common members (ties: the smallest)."""
    w = Window.partitionBy("l1").orderBy(F.desc("n"), "l2")
    return table.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def relabelled(left: DataFrame, matches: DataFrame) -> DataFrame:
    """``id, label, matched`` of ``id, label`` rows: the label of the other side that theirs overlaps most, null without a match."""
    return left.join(F.broadcast(matches.select(F.col("l1").alias("label"), F.col("l2").alias("matched"))), "label", "left").select("id", "label", "matched")


def rand_index_by(table: DataFrame, by: str) -> DataFrame:
    """``by, ari`` of many contingency tables at once (``by, l1, l2, n``); degenerate ones give 1."""
    pairs = lambda x: x * (x - 1) / 2
    cells = table.groupBy(by).agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    rows = table.groupBy(by, "l1").agg(F.sum("n").alias("m")).groupBy(by).agg(F.sum(pairs(F.col("m"))).alias("a"))
    cols = table.groupBy(by, "l2").agg(F.sum("n").alias("m")).groupBy(by).agg(F.sum(pairs(F.col("m"))).alias("b"))
    expected = F.try_divide(F.col("a") * F.col("b"), pairs(F.col("t")))
    half = (F.col("a") + F.col("b")) / 2
    return cells.join(rows, by).join(cols, by).select(by, F.coalesce(F.try_divide(F.col("s") - expected, half - expected), F.lit(1.0)).alias("ari"))


def rand_index(table: DataFrame) -> DataFrame:
    """``ari`` of a contingency table; degenerate cases give 1."""
    pairs = lambda x: x * (x - 1) / 2
    cells = table.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    rows = table.groupBy("l1").agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias("a"))
    cols = table.groupBy("l2").agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias("b"))
    one = cells.join(F.broadcast(rows)).join(F.broadcast(cols))  # single rows
    expected = F.col("a") * F.col("b") / pairs(F.col("t"))
    half = (F.col("a") + F.col("b")) / 2
    return one.select(F.coalesce(F.try_divide(F.col("s") - expected, half - expected), F.lit(1.0)).alias("ari"))


def relabel_subclusters(raw: DataFrame) -> DataFrame:
    """``cluster, sub, label``: raw sub-labels made unique over all clusters, in cluster order; noise stays -1.

    The running offset is a window over one row per cluster, not over posts.
    """
    sizes = raw.filter("sub >= 0").groupBy("cluster").agg((F.max("sub") + 1).alias("k"))
    w = Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("cluster", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("offset"))
    labels = raw.select("cluster", "sub").distinct().join(offsets, "cluster", "left")
    return labels.select("cluster", "sub", F.when(F.col("sub") < 0, -1).otherwise(F.col("sub") + F.col("offset")).cast("long").alias("label"))


def dbcv(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` of a clustering from its minimum spanning tree edges (``a, b, distance``) and ``id, label``.

    Edges between noise only count for the largest distance. A cluster's sparseness is its longest
    inner edge, its separation the shortest edge to another cluster; a cluster without such an
    edge takes twice the largest distance (alone: twice the least distance to noise).
    """
    e = edges.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    both, one = (F.col("la") >= 0) & (F.col("lb") >= 0), (F.col("la") >= 0) != (F.col("lb") >= 0)
    inner = e.filter(both & (F.col("la") == F.col("lb"))).groupBy(F.col("la").alias("label")).agg(F.max("distance").alias("dsc"))
    across = e.filter(both & (F.col("la") != F.col("lb"))).select(F.explode(F.array("la", "lb")).alias("label"), "distance").groupBy("label").agg(F.min("distance").alias("dspc"))
    whole = e.agg(F.max("distance").alias("far"), F.min(F.when(one, F.col("distance"))).alias("noise_gap"))
    sizes = labels.filter("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    total = labels.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") < 0).alias("noise"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("k"))
    rows = sizes.join(inner, "label", "left").join(across, "label", "left").join(F.broadcast(whole)).join(F.broadcast(total))
    gap = F.coalesce("dspc", F.when(F.col("k") == 1, 2 * F.coalesce("noise_gap", "far")).otherwise(2 * F.col("far")))
    dsc = F.coalesce("dsc", F.lit(0.0))
    value = F.try_divide(gap - dsc, F.greatest(gap, dsc))
    return rows.agg(F.sum(F.col("size") * value / F.col("total") * (F.col("total") - F.col("noise")) / F.col("total")).alias("score"))
