"""Queries of the post table: filters, projections, joins, exports, samples, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.config import DEFAULT as C
from marlstone.functions import sampling
from marlstone.functions.text import month
from marlstone.operators import posts, reports
from marlstone.plans.registry import Registry
from marlstone.session import table
from marlstone.sources import archive

registry = Registry()

WANTED_SQL = f"""length(title) > {C.min_length} AND score > {C.min_score} AND selftext NOT LIKE '%[deleted]%' AND selftext NOT LIKE '%[removed]%'
    AND media = FALSE AND created_utc > {C.start} AND created_utc < {C.end}"""
TEXTS_SQL = f"texts AS (SELECT DISTINCT id, title, selftext FROM submissions WHERE {WANTED_SQL})"
LABELS_SQL = "labels AS (SELECT DISTINCT ids AS id, clusters AS cluster, subclusters AS subcluster FROM reddit_data WHERE clusters IS NOT NULL)"
MONTH_SQL = "strftime(make_timestamp(created_utc * 1000000), '%Y-%m')"


def _subs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "submissions")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return posts.assignments(table(spark, d, "reddit_data"))


def _final(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "final_dataframe")


@registry.add("filter_posts", f"SELECT {', '.join(posts.COLUMNS)} FROM submissions WHERE {WANTED_SQL}")
def filter_posts(spark: SparkSession, d: str) -> DataFrame:
    return posts.filter_posts(_subs(spark, d))


@registry.add("count_total_vs_embeddable", f"SELECT count(*) AS total, count(*) FILTER (WHERE length(title) + length(selftext) > {C.min_length} AND score > {C.min_score}) AS embeddable FROM submissions")
def count_total_vs_embeddable(spark: SparkSession, d: str) -> DataFrame:
    return _subs(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(posts.embeddable()).alias("embeddable"))


@registry.add(
    "null_semantics_like",
    "SELECT selftext IS NULL AS no_body, media IS NULL AS no_media, count(*) AS n, count(*) FILTER (WHERE selftext NOT LIKE '%[deleted]%' AND selftext NOT LIKE '%[removed]%' AND media = FALSE) AS kept FROM submissions GROUP BY 1, 2",
)
def null_semantics_like(spark: SparkSession, d: str) -> DataFrame:
    kept = ~F.col("selftext").like("%[deleted]%") & ~F.col("selftext").like("%[removed]%") & (F.col("media") == F.lit(False))
    return _subs(spark, d).groupBy(F.col("selftext").isNull().alias("no_body"), F.col("media").isNull().alias("no_media")).agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept"))


@registry.add("concat_text_length", "SELECT id, retrieved_at, length(title || ' ' || selftext) AS n_chars FROM submissions")
def concat_text_length(spark: SparkSession, d: str) -> DataFrame:
    return _subs(spark, d).select("id", "retrieved_at", F.length(posts.text()).alias("n_chars"))


@registry.add("permalink", f"SELECT DISTINCT id, '{C.link_base}' || subreddit || '/comments/' || id || '/' AS url FROM submissions")
def permalink(spark: SparkSession, d: str) -> DataFrame:
    return _subs(spark, d).select("id", posts.permalink().alias("url")).distinct()


@registry.add(
    "lang_filter_en",
    """WITH l AS (SELECT id, arg_max(coalesce(lang, ''), (labelled_at, coalesce(lang, ''))) AS lang FROM language_labels GROUP BY id)
    SELECT DISTINCT s.id, s.title FROM submissions s JOIN l ON s.id = l.id WHERE regexp_matches(lower(trim(l.lang)), '^(en|eng|english)([-_].*)?$')""",
)
def lang_filter_en(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "language_labels").groupBy("id").agg(F.max_by(F.coalesce("lang", F.lit("")), F.struct("labelled_at", F.coalesce("lang", F.lit("")))).alias("lang"))
    english = labels.filter(F.lower(F.trim("lang")).rlike("^(en|eng|english)([-_].*)?$"))
    return _subs(spark, d).join(english, "id").select("id", "title").distinct()


@registry.add("posts_join_assignment", f"WITH {LABELS_SQL} SELECT DISTINCT s.id, s.subreddit, s.created_utc, cluster, subcluster FROM submissions s JOIN labels l ON s.id = l.id")
def posts_join_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _subs(spark, d).select("id", "subreddit", "created_utc").join(_labels(spark, d), "id").distinct()


@registry.add(
    "posts_left_enrich",
    """SELECT f.id, f.cluster, t.words, t.topic FROM final_dataframe f LEFT JOIN
    (SELECT cluster, max(words) AS words, max(topic) AS topic FROM topic_names GROUP BY cluster) t ON f.cluster = t.cluster""",
)
def posts_left_enrich(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "topic_names").groupBy("cluster").agg(F.max("words").alias("words"), F.max("topic").alias("topic"))
    return _final(spark, d).select("id", "cluster").join(names, "cluster", "left").select("id", "cluster", "words", "topic")


@registry.add("semi_join_ids", "SELECT id, title FROM submissions WHERE id IN (SELECT ids FROM reddit_data)")
def semi_join_ids(spark: SparkSession, d: str) -> DataFrame:
    return _subs(spark, d).select("id", "title").join(table(spark, d, "reddit_data").select(F.col("ids").alias("id")), "id", "left_semi")


@registry.add("drop_noise_export", f"WITH {LABELS_SQL} SELECT DISTINCT s.id, subreddit, created_utc, author, cluster, subcluster FROM submissions s JOIN labels l ON s.id = l.id WHERE cluster <> -1")
def drop_noise_export(spark: SparkSession, d: str) -> DataFrame:
    return posts.exports(_subs(spark, d), _labels(spark, d))["main"]


@registry.add("export_url_keep_noise", f"WITH {LABELS_SQL} SELECT DISTINCT s.id, subreddit, '{C.link_base}' || subreddit || '/comments/' || s.id || '/' AS url FROM submissions s JOIN labels l ON s.id = l.id")
def export_url_keep_noise(spark: SparkSession, d: str) -> DataFrame:
    return posts.exports(_subs(spark, d), _labels(spark, d))["url"]


@registry.add("export_text_keep_noise", f"WITH {LABELS_SQL} SELECT DISTINCT s.id, subreddit, title, selftext FROM submissions s JOIN labels l ON s.id = l.id")
def export_text_keep_noise(spark: SparkSession, d: str) -> DataFrame:
    return posts.exports(_subs(spark, d), _labels(spark, d))["text"]


@registry.add("distinct_posts", "SELECT DISTINCT id, subreddit, created_utc, author, cluster, subcluster FROM final_dataframe")
def distinct_posts(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, d).select("id", "subreddit", "created_utc", "author", "cluster", "subcluster").distinct()


@registry.add("duplicate_key_check", "SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(*) - count(DISTINCT id) AS repeated FROM final_dataframe")
def duplicate_key_check(spark: SparkSession, d: str) -> DataFrame:
    n, ids = F.count(F.lit(1)), F.count_distinct("id")
    return _final(spark, d).agg(n.alias("n_rows"), ids.alias("n_ids"), (n - ids).alias("repeated"))


@registry.add("group_ids_by_cluster", f"WITH {LABELS_SQL}, u AS (SELECT DISTINCT cluster, id FROM labels) SELECT cluster, count(*) AS n, md5(string_agg(id, ',' ORDER BY id)) AS ids_md5 FROM u GROUP BY cluster")
def group_ids_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_join(F.sort_array(F.collect_list("id")), ",")
    return _labels(spark, d).select("cluster", "id").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.md5(ids).alias("ids_md5"))


@registry.add("group_two_level", f"WITH {LABELS_SQL} SELECT cluster, count(DISTINCT subcluster) AS n_sub, count(*) AS n, max(k) AS largest FROM (SELECT *, count(*) OVER (PARTITION BY cluster, subcluster) AS k FROM labels) GROUP BY cluster")
def group_two_level(spark: SparkSession, d: str) -> DataFrame:
    two = _labels(spark, d).groupBy("cluster", "subcluster").agg(F.count(F.lit(1)).alias("k"))
    return two.groupBy("cluster").agg(F.count_distinct("subcluster").alias("n_sub"), F.sum("k").alias("n"), F.max("k").alias("largest"))


@registry.add(
    "concat_per_cluster_md5",
    f"WITH {TEXTS_SQL}, f AS (SELECT DISTINCT id, cluster FROM final_dataframe) SELECT cluster, md5(string_agg(title || ' ' || selftext, ' ' ORDER BY texts.id, title, selftext)) AS text_md5 FROM texts JOIN f ON texts.id = f.id GROUP BY cluster",
)
def concat_per_cluster_md5(spark: SparkSession, d: str) -> DataFrame:
    joined = posts.post_texts(_subs(spark, d)).join(_final(spark, d).select("id", "cluster").distinct(), "id")
    parts = F.sort_array(F.collect_list(F.struct("id", "title", "selftext")))
    return joined.groupBy("cluster").agg(F.md5(F.array_join(F.transform(parts, lambda x: F.concat(x["title"], F.lit(" "), x["selftext"])), " ")).alias("text_md5"))


@registry.add(
    "sample_n_per_cluster_md5",
    f"WITH u AS (SELECT DISTINCT cluster, id FROM final_dataframe) SELECT cluster, id FROM (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY md5('{C.seed}|' || id), id) AS k FROM u) WHERE k <= 20",
)
def sample_n_per_cluster_md5(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_per_group(_final(spark, d).select("cluster", "id").distinct(), "cluster", "id", 20, C.seed)


@registry.add(
    "exact_fraction_sample_md5",
    f"WITH u AS (SELECT DISTINCT id FROM submissions), n AS (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) AS k FROM u) SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5('{C.seed}|' || id), id) AS r FROM u) WHERE r <= (SELECT k FROM n)",
)
def exact_fraction_sample_md5(spark: SparkSession, d: str) -> DataFrame:
    return sampling.exact_sample(_subs(spark, d).select("id").distinct(), "id", 0.1, C.seed)


@registry.add("gaps_and_islands_runs", "SELECT min(row_no) AS first, max(row_no) AS last, count(*) AS n FROM (SELECT row_no, row_no - row_number() OVER (ORDER BY row_no) AS g FROM reddit_data WHERE clusters IS NOT NULL) GROUP BY g")
def gaps_and_islands_runs(spark: SparkSession, d: str) -> DataFrame:
    return reports.runs(table(spark, d, "reddit_data").filter(F.col("clusters").isNotNull()), "row_no")


@registry.add("month_range_filter", f"SELECT id, {MONTH_SQL} AS month FROM final_dataframe WHERE {MONTH_SQL} BETWEEN '2012-03' AND '2016-10'")
def month_range_filter(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, d).select("id", month(F.col("created_utc")).alias("month")).filter(F.col("month").between("2012-03", "2016-10"))


@registry.add("icontains_negated", "SELECT cluster, topic FROM topic_names WHERE NOT contains(lower(topic), 'a')")
def icontains_negated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topic_names").select("cluster", "topic").filter(~F.lower("topic").contains("a"))


@registry.add("json_prop_extract", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_prop_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "json_missing_vs_null",
    r"""WITH r AS (SELECT file_name, line, TRY_CAST(line AS JSON) AS j FROM raw_lines), o AS (SELECT * FROM r WHERE json_type(j) = 'OBJECT' AND NOT regexp_matches(line, ',\s*[}\]]'))
    SELECT file_name, count(*) AS n, count(*) FILTER (WHERE NOT list_contains(json_keys(j), 'media')) AS missing, count(*) FILTER (WHERE json_type(j, '$.media') = 'NULL') AS nulls FROM o GROUP BY file_name""",
)
def json_missing_vs_null(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_lines").select("file_name", F.try_parse_json("line").alias("j")).filter(F.schema_of_variant("j").startswith("OBJECT"))
    v = F.variant_get("j", "$.media", "variant")
    return r.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("missing"), F.count_if(F.is_variant_null(v)).alias("nulls"))


@registry.add("ingest_valid_posts")
def ingest_valid_posts(spark: SparkSession, d: str) -> DataFrame:
    return archive.ingest(table(spark, d, "raw_lines"), "line")


@registry.add("ingest_bad_share")
def ingest_bad_share(spark: SparkSession, d: str) -> DataFrame:
    return archive.bad_share(table(spark, d, "raw_lines"), "line")


@registry.add(
    "archive_stats_projection",
    r"""WITH r AS (SELECT file_name, line, TRY_CAST(line AS JSON) AS j FROM raw_lines), o AS (SELECT * FROM r WHERE json_type(j) = 'OBJECT' AND NOT regexp_matches(line, ',\s*[}\]]')),
    s AS (SELECT file_name, coalesce(json_type(j, '$.media'), 'NULL') <> 'NULL' AS has_media, coalesce(json_extract_string(j, '$.title'), '') AS title, coalesce(json_extract_string(j, '$.selftext'), '') AS body FROM o)
    SELECT CAST(regexp_extract(file_name, 'RS_(\d{4})-(\d{2})', 1) AS INT) AS year, CAST(regexp_extract(file_name, 'RS_(\d{4})-(\d{2})', 2) AS INT) AS month, has_media, count(*) AS n,
    sum(length(title || CASE WHEN has_media THEN '' ELSE body END)) AS chars FROM s GROUP BY 1, 2, 3""",
)
def archive_stats_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = archive.statistics(table(spark, d, "raw_lines"), "line", "file_name")
    return rows.groupBy("year", "month", "has_media").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("chars"))
