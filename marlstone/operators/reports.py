"""Reports over time, communities and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), key).limit(n) if n else out


def top_per_group(counts: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """``group, item, n, rank`` of the n most frequent items, ties by item."""
    w = Window.partitionBy(group).orderBy(F.desc("n"), item)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def monthly_mean(df: DataFrame, time: Column, value: str) -> DataFrame:
    """``month, mean`` of every month from first to last; months without rows are there with null."""
    rows = df.select(F.date_trunc("month", time).alias("month"), F.col(value).alias("_v")).filter(F.col("month").isNotNull())
    means = rows.groupBy("month").agg(F.avg("_v").alias("mean"))
    span = means.agg(F.min("month").alias("a"), F.max("month").alias("b")).filter("a is not null")
    months = span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return months.join(means, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.round("mean", 4).alias("mean"))


def equal_width_bins(df: DataFrame, value: str, n: int = 25) -> DataFrame:
    """``bin, n, middle`` of n right-closed bins of equal width; the least value is in bin 1, empty bins are there."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("lo is not null")
    width = (F.col("hi") - F.col("lo")) / n
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.lit(n), F.greatest(F.lit(1), F.ceil((F.col(value) - F.col("lo")) / width)))).cast("int")
    counts = df.filter(F.col(value).isNotNull()).select(value).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = ends.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.col("lo") + width * (F.col("bin") - 0.5), 2).alias("middle"))


def yearly_top(df: DataFrame, year: Column, item: str) -> DataFrame:
    """``year, item, n, growth``: each year's most frequent item and its change since the year before it appears in."""
    counts = df.groupBy(year.alias("year"), item).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(Window.partitionBy(item).orderBy("year"))
    grown = counts.withColumn("growth", F.col("n") - before)
    w = Window.partitionBy("year").orderBy(F.desc("n"), item)
    return grown.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def runs(df: DataFrame, value: str, block: int = 1 << 20) -> DataFrame:
    """``first, last, n``: runs of consecutive whole numbers (gaps and islands).

    Runs are found within blocks of numbers; only runs that touch a block's edge are then put
    in one order and joined, at most two for each block.
    """
    v = df.select(F.col(value).cast("long").alias("v")).filter("v is not null").distinct().withColumn("b", F.floor(F.col("v") / block))
    marked = v.withColumn("g", F.col("v") - F.row_number().over(Window.partitionBy("b").orderBy("v")))
    parts = marked.groupBy("b", "g").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count(F.lit(1)).alias("n"))
    edge = (F.pmod("first", F.lit(block)) == 0) | (F.pmod(F.col("last") + 1, F.lit(block)) == 0)
    inside = parts.filter(~edge).select("first", "last", "n")
    order = Window.orderBy("first")
    chained = parts.filter(edge).withColumn("new", F.coalesce(F.col("first") != F.lag("last").over(order) + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    joined = chained.groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("run")
    return inside.unionByName(joined)
