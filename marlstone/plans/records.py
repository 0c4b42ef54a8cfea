"""Queries of the general record operators: drifting schemas and skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import drift, skew
from marlstone.plans.registry import Registry
from marlstone.session import cut, table

registry = Registry()

#: Columns of the consistent post table.
POST_FIELDS = {
    "author": "string",
    "id": "string",
    "title": "string",
    "selftext": "string",
    "score": "bigint",
    "num_comments": "bigint",
    "subreddit": "string",
    "created_utc": "bigint",
    "media": "boolean",
}
#: Share of all rows from which a key is heavy.
HEAVY_SHARE = 0.05


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return cut(drift.file_profiles(table(spark, d, "raw_lines")), "profiles")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return cut(drift.schema_changes(_profiles(spark, d)), "changes")


@registry.add("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every addition, removal, renaming and change of type of a top-level field between files of a mirror."""
    return drift.change_report(_changes(spark, d))


@registry.add("p1_posts")
def p1_posts(spark: SparkSession, d: str) -> DataFrame:
    """The consistent post table over all mirrors and files."""
    profiles = _profiles(spark, d)
    return drift.unified_table(table(spark, d, "raw_lines"), cut(drift.schema_changes(profiles), "changes"), POST_FIELDS, profiles)


@registry.add("p1_scripts")
def p1_scripts(spark: SparkSession, d: str) -> DataFrame:
    """All steps of the edit scripts, nested fields and moves included."""
    return _changes(spark, d)


def _community_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "submissions").select(skew.community_key(F.col("subreddit")).alias("key_value"), "id", "score")
    return skew.balanced_stats(rows, "key_value", "id", {"mean_score": "mean:score"})


def _cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "final_dataframe").select(F.col("cluster").cast("string").alias("key_value"), "id", "created_utc")
    return skew.balanced_stats(rows, "key_value", "id", {"first_created": "min:created_utc", "last_created": "max:created_utc"})


#: The key of a subreddit, as SQL.
_KEY_SQL = r"regexp_replace(regexp_replace(regexp_replace(lower(subreddit), '^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$', '', 'g'), '^/?r/', ''), '^[\s\p{Z}\p{Cf}]+', '')"


@registry.add(
    "p4_communities",
    f"""SELECT {_KEY_SQL} AS key_value, count(*) AS n_rows, count(DISTINCT id) AS n_members, round(avg(score), 6) AS mean_score
    FROM submissions GROUP BY 1""",
)
def p4_communities(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct ids and mean score of each subreddit."""
    stats = _community_stats(spark, d)
    return stats.select("key_value", "n_rows", "n_members", F.round("mean_score", 6).alias("mean_score"))


@registry.add(
    "p4_clusters",
    """SELECT CAST(cluster AS VARCHAR) AS key_value, count(*) AS n_rows, count(DISTINCT id) AS n_members,
    min(created_utc) AS first_created, max(created_utc) AS last_created FROM final_dataframe GROUP BY 1""",
)
def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct ids and first and last time of each cluster."""
    return _cluster_stats(spark, d).drop("shards")


@registry.add(
    "p4_topic_posts",
    """SELECT f.id, f.subreddit, f.created_utc, f.cluster, f.subcluster, t.topic FROM final_dataframe f
    LEFT JOIN (SELECT cluster, min(topic) AS topic FROM topic_names GROUP BY cluster) t ON f.cluster = t.cluster""",
)
def p4_topic_posts(spark: SparkSession, d: str) -> DataFrame:
    """Every post of the final frame with its topic; topics are copied to the shards of large clusters only."""
    posts = table(spark, d, "final_dataframe").select("id", "subreddit", "created_utc", "cluster", "subcluster")
    topics = table(spark, d, "topic_names").groupBy("cluster").agg(F.min("topic").alias("topic"))
    return skew.balanced_join(posts, topics, "cluster", ["id", "created_utc"], "left")


@registry.add(
    "p4_found",
    f"""WITH s AS (SELECT {_KEY_SQL} AS key_value, count(*) AS n FROM submissions GROUP BY 1),
    f AS (SELECT CAST(cluster AS VARCHAR) AS key_value, count(*) AS n FROM final_dataframe GROUP BY 1)
    SELECT 'submissions' AS table_name, key_value FROM s WHERE key_value IS NOT NULL AND n >= {HEAVY_SHARE} * (SELECT sum(n) FROM s)
    UNION ALL
    SELECT 'final_dataframe', key_value FROM f WHERE key_value IS NOT NULL AND n >= {HEAVY_SHARE} * (SELECT sum(n) FROM f)""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Subreddits and clusters with at least a twentieth of the rows of their table."""
    parts = (("submissions", _community_stats), ("final_dataframe", _cluster_stats))
    found = [skew.heavy_keys(stats(spark, d), "key_value", HEAVY_SHARE).select(F.lit(name).alias("table_name"), "key_value") for name, stats in parts]
    return found[0].unionByName(found[1])
