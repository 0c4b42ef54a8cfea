"""Vector expressions on arrays of numbers, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, pos, value``: mean of each position; pre-aggregated, so a large group costs a few rows per task."""
    cells = df.filter(F.col(key).isNotNull()).select(key, F.posexplode(vector).alias("pos", "v"))
    return cells.groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("value"))


def assembled(cells: DataFrame, key: str, name: str = "centroid") -> DataFrame:
    """``key`` and an array from ``key, pos, value`` rows."""
    return cells.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias(name))
