"""The posts of a submission table: one row per id with the best known text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bodies that only mark a removal.
REMOVAL_MARKERS = ("[removed]", "[deleted]")


def is_marker(text: Column) -> Column:
    """Whether a body is nothing but a removal marker."""
    return F.coalesce(F.trim(text).isin(*REMOVAL_MARKERS), F.lit(False))


def distinct_posts(submissions: DataFrame) -> DataFrame:
    """``id, title, selftext`` of each distinct id; null ids yield no post.

    The body comes from a row that is not a bare removal marker if there is one; a null body
    counts as less than any text. Rows are reduced before the shuffle, so an id with any number
    of copies costs one row per task.
    """
    rank = F.when(F.col("selftext").isNull(), 0).when(is_marker(F.col("selftext")), 1).otherwise(2)
    best = F.max(F.struct(rank.alias("r"), F.col("selftext").alias("selftext"), F.col("title").alias("title"))).alias("b")
    return submissions.filter(F.col("id").isNotNull()).groupBy("id").agg(best).select("id", "b.title", "b.selftext")
