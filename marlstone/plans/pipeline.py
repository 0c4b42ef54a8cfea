"""Queries of labels over several runs, quizzes, sub-topics, chunks and sampled statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.config import DEFAULT as C
from marlstone.functions import sampling
from marlstone.functions.text import decoded, subset_size
from marlstone.operators import agreement, naming, posts, tfidf
from marlstone.plans.posts import LABELS_SQL, _final, _labels, _subs
from marlstone.plans.registry import Registry
from marlstone.plans.topics import _TWO_SQL, _centres, _docs, _table, _top
from marlstone.session import cut, table
from marlstone.sources import archive

registry = Registry()


# ---------------------------------------------------------------- labels of two runs


@registry.add(
    "relabelled_by_match",
    f"""WITH {_TWO_SQL}, m AS (SELECT l1, l2 FROM (SELECT *, row_number() OVER (PARTITION BY l1 ORDER BY n DESC, l2) AS r FROM ct) WHERE r = 1)
    SELECT a.id, a.label, m.l2 AS matched FROM a LEFT JOIN m ON a.label = m.l1""",
)
def relabelled_by_match(spark: SparkSession, d: str) -> DataFrame:
    """Labels of one run with those of the other run that they overlap most; each run's labels keep a column of their own."""
    left = _labels(spark, d).groupBy("id").agg(F.max("cluster").alias("label"))
    return agreement.relabelled(left, agreement.best_overlap(_table(spark, d)))


@registry.add(
    "rand_index_per_year",
    f"""WITH {LABELS_SQL}, a AS (SELECT id, max(cluster) AS label FROM labels GROUP BY id),
    b AS (SELECT id, max(year(make_timestamp(created_utc * 1000000))) AS year, max(cluster) AS label FROM final_dataframe GROUP BY id),
    ct AS (SELECT year, a.label AS l1, b.label AS l2, count(*) AS n FROM a JOIN b USING (id) GROUP BY 1, 2, 3),
    s AS (SELECT year, sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM ct GROUP BY year),
    a2 AS (SELECT year, sum(m * (m - 1) / 2) AS a FROM (SELECT year, l1, sum(n) AS m FROM ct GROUP BY 1, 2) GROUP BY year),
    b2 AS (SELECT year, sum(m * (m - 1) / 2) AS b FROM (SELECT year, l2, sum(n) AS m FROM ct GROUP BY 1, 2) GROUP BY year),
    e AS (SELECT year, s, a, b, CASE WHEN t > 1 THEN a * b / (t * (t - 1) / 2) END AS x FROM s JOIN a2 USING (year) JOIN b2 USING (year))
    SELECT year, round(coalesce(CASE WHEN (a + b) / 2 - x <> 0 THEN (s - x) / ((a + b) / 2 - x) END, 1), 6) AS ari FROM e""",
)
def rand_index_per_year(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two runs for the posts of each year."""
    left = _labels(spark, d).groupBy("id").agg(F.max("cluster").alias("l1"))
    right = _final(spark, d).groupBy("id").agg(F.max(F.year(F.timestamp_seconds("created_utc"))).alias("year"), F.max("cluster").alias("l2"))
    cells = left.join(right, "id").groupBy("year", "l1", "l2").agg(F.count(F.lit(1)).alias("n"))
    return agreement.rand_index_by(cut(cells, "contingency"), "year").withColumn("ari", F.round("ari", 6))


# ---------------------------------------------------------------- posts


@registry.add("nonempty_titles", "SELECT DISTINCT id FROM submissions WHERE length(title) > 0")
def nonempty_titles(spark: SparkSession, d: str) -> DataFrame:
    return _subs(spark, d).filter(F.length("title") > 0).select("id").distinct()


@registry.add("interval_members", "SELECT id, created_utc FROM final_dataframe WHERE created_utc BETWEEN 1325376000 AND 1388534400")
def interval_members(spark: SparkSession, d: str) -> DataFrame:
    """Posts of an interval, both ends included."""
    return _final(spark, d).select("id", "created_utc").filter(F.col("created_utc").between(1325376000, 1388534400))


@registry.add(
    "one_member_per_bin",
    f"""SELECT subreddit, arg_min(id, (md5('{C.seed}|' || id), id)) AS id FROM submissions WHERE id IS NOT NULL GROUP BY subreddit""",
)
def one_member_per_bin(spark: SparkSession, d: str) -> DataFrame:
    """One post of each community, picked by hash."""
    return sampling.one_per_bin(_subs(spark, d).select("subreddit", "id"), "subreddit", "id", C.seed)


@registry.add(
    "chunk_numbers",
    f"""WITH k AS (SELECT id, CAST((row_number() OVER (ORDER BY md5('{C.seed}|' || id), id) - 1) // 1000 AS INT) AS chunk FROM (SELECT DISTINCT id FROM submissions WHERE id IS NOT NULL))
    SELECT k.chunk, count(*) AS n_rows, count(DISTINCT s.id) AS n_ids, min(s.id) AS first_id FROM submissions s JOIN k ON s.id = k.id GROUP BY k.chunk""",
)
def chunk_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 1,000 ids each, as they are exported."""
    rows = sampling.chunk_numbers(_subs(spark, d).select("id"), "id", 1000, C.seed).filter("chunk is not null")
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id"))


@registry.add("decoded_ids", "SELECT DISTINCT ids AS id FROM reddit_data")
def decoded_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids read as bytes and decoded."""
    return table(spark, d, "reddit_data").select(decoded(F.encode("ids", "UTF-8")).alias("id")).distinct()


@registry.add("subset_sizes", "SELECT * FROM (VALUES ('keywords_0.01.json', 0.01), ('tfidf_1e-05.json', 1e-05), ('tfidf_1.0', 1.0), ('all.json', NULL)) t(name, share)")
def subset_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Shares that file names carry."""
    rows = spark.createDataFrame([("keywords_0.01.json",), ("tfidf_1e-05.json",), ("tfidf_1.0",), ("all.json",)], "name string")
    return rows.select("name", subset_size(F.col("name")).alias("share"))


@registry.add("head_rows", "SELECT id, subreddit, created_utc FROM (SELECT DISTINCT id, subreddit, created_utc FROM final_dataframe) ORDER BY created_utc, id, subreddit LIMIT 5")
def head_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first five posts by time (a preview)."""
    return _final(spark, d).select("id", "subreddit", "created_utc").distinct().orderBy("created_utc", "id", "subreddit").limit(5)


@registry.add("sampled_archive_statistics")
def sampled_archive_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of a tenth of the archive's lines by hash (a sampling operator)."""
    rows = archive.sampled_statistics(table(spark, d, "raw_lines"), "line", "file_name", 0.1)
    return rows.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"), F.avg("score").alias("mean_score"))


# ---------------------------------------------------------------- topics


@registry.add("name_subtopics")
def name_subtopics(spark: SparkSession, d: str) -> DataFrame:
    """Names of all sub-clusters."""
    counts = cut(tfidf.group_terms(_docs(spark, d), ["cluster", "subcluster"]), "terms")
    words = tfidf.top_terms(tfidf.tfidf(counts, ["cluster", "subcluster"], within=["cluster"]), ["cluster", "subcluster"])
    return naming.name_subtopics(words, naming.TopWordNamer())


@registry.add("cv_coherence")
def cv_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Coherence c_v of each cluster's top words over sliding windows of the posts."""
    words = cut(_top(spark, d).select("cluster", "term"), "words")
    texts = cut(_docs(spark, d).select("id", "text").distinct(), "texts")
    return tfidf.cv_coherence(words, texts, "cluster").withColumn("coherence", F.round("coherence", 6))


_RUNS_SQL = f"""usable AS (SELECT DISTINCT id, cluster FROM labels WHERE cluster <> -1 AND id IN (SELECT id FROM submissions WHERE length(title) > 0)),
    picks AS (SELECT run, id, cluster FROM (SELECT run, id, cluster, row_number() OVER (PARTITION BY run ORDER BY md5('{C.seed}|' || CAST(run AS VARCHAR) || '|' || id), id, cluster) AS r
    FROM usable, (SELECT unnest(range({C.quiz_runs})) AS run)) WHERE r <= {C.quiz_size})"""


@registry.add("quiz_questions", f"WITH {LABELS_SQL}, {_RUNS_SQL} SELECT CAST(run AS INT) AS run, id, cluster FROM picks")
def quiz_questions(spark: SparkSession, d: str) -> DataFrame:
    """The posts asked in each run of the quiz; posts without a title are not asked. The smallest tables have fewer than are wanted."""
    return naming.quiz_questions(_labels(spark, d), _subs(spark, d), C.quiz_size, C.quiz_runs, strict=False)


@registry.add("quiz_runs")
def quiz_runs(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of each run of the quiz with its mean and half width over the runs; options shrink where there are few topics."""
    picked = cut(quiz_questions(spark, d), "questions")
    names = cut(table(spark, d, "topic_names").groupBy("cluster").agg(F.coalesce(F.max("topic"), F.lit("Error")).alias("topic")), "names")
    near = cut(naming.nearest_topics(cut(_centres(spark, d), "centres"), C.quiz_options - 1), "near")
    quiz = naming.quiz_options(picked.select("id", "cluster").distinct(), near, names)
    texts = _subs(spark, d).groupBy("id").agg(F.max(posts.text("title", "selftext")).alias("both"), F.max("title").alias("title")).select("id", F.coalesce("both", "title").alias("text"))
    solved = naming.solve_quiz(quiz, texts, naming.OverlapSolver()).withColumn("right", F.coalesce(F.col("given") == F.col("answer"), F.lit(False)).cast("int"))
    right = solved.groupBy("id").agg(F.max("right").alias("right"))
    runs = cut(picked.join(right, "id", "left").groupBy("run").agg(F.avg(F.coalesce("right", F.lit(0))).alias("accuracy")), "runs")
    return runs.join(F.broadcast(naming.confidence(runs, "accuracy", [])))  # one row
