"""Filters, projections and exports of the post table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.config import DEFAULT, Config

COLUMNS = ["author", "id", "title", "selftext", "score", "num_comments", "subreddit", "created_utc", "media"]
#: Bodies with one of these anywhere are dropped.
REMOVED = ("[deleted]", "[removed]")


def wanted(c: Config = DEFAULT) -> Column:
    """The ingest predicate. Null bodies and null media drop out, as in SQL; all bounds are open."""
    p = (F.length("title") > c.min_length) & (F.col("score") > c.min_score) & (F.col("media") == F.lit(False))
    for marker in REMOVED:
        p = p & ~F.col("selftext").like(f"%{marker}%")
    return p & (F.col("created_utc") > c.start) & (F.col("created_utc") < c.end)


def filter_posts(df: DataFrame, c: Config = DEFAULT) -> DataFrame:
    return df.filter(wanted(c)).select(*COLUMNS)


def embeddable(c: Config = DEFAULT) -> Column:
    """The counting predicate: title and body together, and the score."""
    return (F.length("title") + F.length("selftext") > c.min_length) & (F.col("score") > c.min_score)


def text(title: str = "title", body: str = "selftext") -> Column:
    """Title and body with a blank between; null if either is null."""
    return F.concat(F.col(title), F.lit(" "), F.col(body))


def permalink(c: Config = DEFAULT) -> Column:
    return F.concat(F.lit(c.link_base), F.col("subreddit"), F.lit("/comments/"), F.col("id"), F.lit("/"))


def post_texts(df: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Distinct ``id, title, selftext`` of wanted posts."""
    return filter_posts(df, c).select("id", "title", "selftext").distinct()


def assignments(df: DataFrame) -> DataFrame:
    """Distinct ``id, cluster, subcluster`` of fitted rows; joined by id, never by position."""
    return df.filter(F.col("clusters").isNotNull()).select(F.col("ids").alias("id"), F.col("clusters").alias("cluster"), F.col("subclusters").alias("subcluster")).distinct()


def clustered_posts(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct posts with their cluster, noise kept."""
    return posts.join(labels, "id").distinct()


def exports(posts: DataFrame, labels: DataFrame, c: Config = DEFAULT) -> dict[str, DataFrame]:
    """The three exports of one join: ``main`` without noise, ``url`` and ``text`` with it."""
    joined = clustered_posts(posts, labels)
    return {
        "main": joined.filter(F.col("cluster") != -1).select("id", "subreddit", "created_utc", "author", "cluster", "subcluster").distinct(),
        "url": joined.select("id", "subreddit", permalink(c).alias("url")).distinct(),
        "text": joined.select("id", "subreddit", "title", "selftext").distinct(),
    }
