"""Deterministic samples: rows in the order of a hash of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: str, *ids: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *ids))


def exact_sample(df: DataFrame, key: str, fraction: float, seed: str) -> DataFrame:
    """Exactly floor(n * fraction) rows: the first by hash; ids must be unique.

    Rows are counted by the first four digits of the hash (at most 65,536 counts reach the driver).
    Whole buckets below the limit are taken as they are; only the bucket at the limit is sorted.
    """
    keyed = df.withColumn("_h", order_key(seed, F.col(key).cast("string")))
    bucket = F.substring("_h", 1, 4)
    counts = {r["b"]: r["n"] for r in keyed.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    left = int(sum(counts.values()) * fraction)
    edge = ""
    for b in sorted(counts):
        edge = b
        if counts[b] > left:
            break
        left -= counts[b]
    else:
        return df
    below = keyed.filter(bucket < edge).drop("_h")
    at = keyed.filter(bucket == edge).orderBy("_h", key).limit(left).drop("_h")
    return below.unionByName(at)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """At most ``n`` rows of each group, first by hash; Spark drops the rest before the shuffle."""
    w = Window.partitionBy(group).orderBy(order_key(seed, F.col(key).cast("string")), F.col(key))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def chunk_numbers(df: DataFrame, key: str, size: int, seed: str = "42") -> DataFrame:
    """``df`` with ``chunk``: the number of the chunk of ``size`` distinct keys in hash order that a row's key is in.

    No global sort: keys are numbered inside buckets of the hash's first four digits, and the
    counts of earlier buckets (65,536 at most) are added. Rows without a key have no chunk.
    """
    keys = df.select(F.col(key).alias("_k")).filter("_k is not null").distinct().withColumn("_h", order_key(seed, F.col("_k").cast("string"))).withColumn("_b", F.substring("_h", 1, 4))
    counts = keys.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    at = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "_k")) - 1
    numbered = keys.withColumn("_r", at).join(F.broadcast(before), "_b").select("_k", F.floor((F.col("_o") + F.col("_r")) / size).cast("int").alias("chunk"))
    return df.join(numbered, F.col(key) == F.col("_k"), "left").drop("_k")


def one_per_bin(df: DataFrame, bin: str, item: str, seed: str = "42") -> DataFrame:
    """``bin, item``: one member of each bin, the first by hash; null members are none."""
    rows = df.filter(F.col(item).isNotNull())
    return rows.groupBy(bin).agg(F.min_by(item, F.struct(order_key(seed, F.col(item).cast("string")), F.col(item))).alias(item))
