"""Queries of topics: terms, centroids, agreement, hierarchy, naming, quiz, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.config import DEFAULT as C
from marlstone.functions import vectors
from marlstone.functions.text import STOP_SQL, is_stop_word, month, terms
from marlstone.operators import agreement, density, hierarchy, naming, neighbours, posts, reduce, reports, tfidf
from marlstone.plans.posts import LABELS_SQL, MONTH_SQL, TEXTS_SQL, _final, _labels, _subs
from marlstone.plans.registry import Registry
from marlstone.session import cut, table

registry = Registry()

_EXTRACT = r"regexp_extract_all(lower(title || ' ' || selftext), '[\p{L}\p{N}_]{2,}')"
_DOCS_SQL = f"""{TEXTS_SQL}, f AS (SELECT DISTINCT id, cluster, subcluster FROM final_dataframe),
docs AS (SELECT f.cluster, f.subcluster, texts.id, {_EXTRACT} AS w FROM texts JOIN f ON texts.id = f.id)"""


def _counts_sql(group: str) -> str:
    return f"c AS (SELECT {group}, term, count(*) AS n FROM (SELECT {group}, unnest(w) AS term FROM docs) WHERE term NOT IN ({STOP_SQL}) GROUP BY {group}, term)"


_SCORES_SQL = f"""WITH {_DOCS_SQL}, {_counts_sql('cluster')},
v AS (SELECT term, sum(n) AS total, count(*) AS df FROM c GROUP BY term ORDER BY total DESC, term LIMIT {C.max_features}),
g AS (SELECT count(DISTINCT cluster) AS groups FROM c),
x AS (SELECT cluster, term, n * (ln((1 + groups) / (1 + df)) + 1) AS v FROM c JOIN v USING (term), g),
s AS (SELECT cluster, term, v / sqrt(sum(v * v) OVER (PARTITION BY cluster)) AS score FROM x)"""
_TOP_SQL = f"{_SCORES_SQL}, top AS (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) AS rank, term, round(score, 6) AS score FROM s)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    texts = posts.post_texts(_subs(spark, d)).select("id", posts.text().alias("text"))
    return texts.join(_final(spark, d).select("id", "cluster", "subcluster").distinct(), "id")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.tfidf(cut(tfidf.group_terms(_docs(spark, d), ["cluster"]), "terms"), ["cluster"])


def _top(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.top_terms(_scores(spark, d), ["cluster"])


@registry.add("token_counts", f"WITH {_DOCS_SQL} SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM docs) WHERE term NOT IN ({STOP_SQL}) GROUP BY term")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(F.explode(terms(F.col("text"))).alias("term")).filter(~is_stop_word(F.col("term")))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@registry.add("tf_df_vocab_topk", f"WITH {_DOCS_SQL}, {_counts_sql('cluster')} SELECT term, sum(n) AS total, count(*) AS df FROM c GROUP BY term ORDER BY total DESC, term LIMIT 500")
def tf_df_vocab_topk(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.vocabulary(tfidf.group_terms(_docs(spark, d), ["cluster"]), 500)


@registry.add("tfidf_top_terms", f"{_TOP_SQL} SELECT * FROM top WHERE rank <= {C.top_words}")
def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d)


@registry.add(
    "tfidf_subcluster_top_terms",
    f"""WITH {_DOCS_SQL}, {_counts_sql('cluster, subcluster')},
    v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY total DESC, term) AS r FROM (SELECT cluster, term, sum(n) AS total, count(*) AS df FROM c GROUP BY cluster, term)) WHERE r <= {C.max_features}),
    g AS (SELECT cluster, count(DISTINCT coalesce(subcluster, -99)) AS groups FROM c GROUP BY cluster),
    x AS (SELECT c.cluster, c.subcluster, c.term, n * (ln((1 + groups) / (1 + df)) + 1) AS v FROM c JOIN v ON c.cluster = v.cluster AND c.term = v.term JOIN g ON c.cluster = g.cluster),
    s AS (SELECT cluster, subcluster, term, v / sqrt(sum(v * v) OVER (PARTITION BY cluster, subcluster)) AS score FROM x)
    SELECT cluster, subcluster, rank, term, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cluster, subcluster ORDER BY round(score, 9) DESC, term) AS rank FROM s) WHERE rank <= {C.top_words}""",
)
def tfidf_subcluster_top_terms(spark: SparkSession, d: str) -> DataFrame:
    counts = cut(tfidf.group_terms(_docs(spark, d), ["cluster", "subcluster"]), "terms")
    return tfidf.top_terms(tfidf.tfidf(counts, ["cluster", "subcluster"], within=["cluster"]), ["cluster", "subcluster"])


_ADJ_SQL = f"{_SCORES_SQL}, adj AS (SELECT a.cluster AS a, b.cluster AS b, sum(a.score * b.score) AS similarity FROM s a JOIN s b ON a.term = b.term AND a.cluster < b.cluster GROUP BY 1, 2)"


@registry.add("tfidf_adjacency", f"{_ADJ_SQL} SELECT a, b, round(similarity, 6) AS similarity FROM adj")
def tfidf_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.adjacency(cut(_scores(spark, d), "scores"), "cluster").withColumn("similarity", F.round("similarity", 6))


@registry.add("cosine_distance_condensed", f"{_ADJ_SQL} SELECT a, b, round(1 - similarity, 6) AS distance FROM adj")
def cosine_distance_condensed(spark: SparkSession, d: str) -> DataFrame:
    pairs = tfidf.adjacency(cut(_scores(spark, d), "scores"), "cluster")
    return pairs.select("a", "b", F.round(1 - F.col("similarity"), 6).alias("distance"))


@registry.add("topic_diversity", f"{_TOP_SQL}, w AS (SELECT term, count(*) AS n FROM top WHERE rank <= {C.top_words} GROUP BY term ORDER BY n DESC, term LIMIT 25) SELECT count(DISTINCT term) / 25.0 AS diversity FROM w")
def topic_diversity(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.word_diversity(_top(spark, d))


@registry.add("topic_diversity_distinct_ratio", f"{_TOP_SQL} SELECT round(count(DISTINCT term) / count(*), 9) AS diversity FROM top WHERE rank <= {C.top_words}")
def topic_diversity_distinct_ratio(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.distinct_ratio(_top(spark, d)).withColumn("diversity", F.round("diversity", 9))


@registry.add(
    "npmi_coherence",
    f"""{_TOP_SQL}, w AS (SELECT cluster, term FROM top WHERE rank <= {C.top_words}), dt AS (SELECT DISTINCT id, unnest(w) AS term FROM docs),
    m AS (SELECT count(DISTINCT id) AS n FROM docs), one AS (SELECT term, count(*) AS c FROM dt WHERE term IN (SELECT term FROM w) GROUP BY term),
    p AS (SELECT a.cluster, a.term AS x, b.term AS y FROM w a JOIN w b ON a.cluster = b.cluster AND a.term < b.term),
    q AS (SELECT x, y, count(*) AS xy FROM (SELECT DISTINCT x, y FROM p) p JOIN dt a ON a.term = x JOIN dt b ON b.term = y AND a.id = b.id GROUP BY x, y)
    SELECT cluster, round(avg(CASE WHEN xy IS NULL THEN -1.0 WHEN xy = n THEN 1.0 ELSE ln((xy / n) * n / ox.c * n / oy.c) / -ln(xy / n) END), 6) AS coherence
    FROM p LEFT JOIN q USING (x, y) LEFT JOIN one ox ON ox.term = x LEFT JOIN one oy ON oy.term = y, m GROUP BY cluster""",
)
def npmi_coherence(spark: SparkSession, d: str) -> DataFrame:
    words = cut(_top(spark, d).select("cluster", "term"), "words")
    texts = cut(_docs(spark, d).select("id", "text").distinct(), "texts")
    return tfidf.npmi(words, texts, "cluster").withColumn("coherence", F.round("coherence", 6))


# ---------------------------------------------------------------- vectors and clusters

_CENTRE_SQL = """cells AS (SELECT clusters AS cluster, generate_subscripts(dimensional_reduction, 1) - 1 AS pos, CAST(unnest(dimensional_reduction) AS DOUBLE) AS v
    FROM reddit_data WHERE clusters IS NOT NULL AND clusters <> -1 AND dimensional_reduction IS NOT NULL), ce AS (SELECT cluster, pos, avg(v) AS value FROM cells GROUP BY 1, 2)"""


def _centres(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "reddit_data").filter("clusters <> -1").withColumnRenamed("clusters", "cluster")
    return vectors.centroids(rows, "cluster", "dimensional_reduction")


@registry.add("centroids", f"WITH {_CENTRE_SQL} SELECT cluster, pos, round(value, 6) AS value FROM ce")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    return _centres(spark, d).withColumn("value", F.round("value", 6))


_NEAR_SQL = f"""{_CENTRE_SQL}, pr AS (SELECT a.cluster, b.cluster AS other, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS distance FROM ce a JOIN ce b ON a.pos = b.pos AND a.cluster <> b.cluster GROUP BY 1, 2),
    near AS (SELECT * FROM (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY round(distance, 9), other) AS rank, other, round(distance, 6) AS distance FROM pr) WHERE rank <= 4)"""


@registry.add("nearest_centroids_topk", f"WITH {_NEAR_SQL} SELECT * FROM near")
def nearest_centroids_topk(spark: SparkSession, d: str) -> DataFrame:
    return naming.nearest_topics(cut(_centres(spark, d), "centres"), C.quiz_options - 1)


@registry.add("non_noise_share", "SELECT round(avg(CASE WHEN clusters <> -1 THEN 1 ELSE 0 END), 6) AS share FROM reddit_data WHERE clusters IS NOT NULL")
def non_noise_share(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reddit_data").filter("clusters is not null").agg(F.round(F.avg((F.col("clusters") != -1).cast("int")), 6).alias("share"))


@registry.add("cluster_count_with_without_noise", "SELECT count(DISTINCT clusters) AS with_noise, count(DISTINCT clusters) FILTER (WHERE clusters <> -1) AS without_noise, count(*) FILTER (WHERE subclusters = -1) AS sub_noise FROM reddit_data")
def cluster_count_with_without_noise(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("clusters")
    return table(spark, d, "reddit_data").agg(F.count_distinct(c).alias("with_noise"), F.count_distinct(F.when(c != -1, c)).alias("without_noise"), F.count_if(F.col("subclusters") == -1).alias("sub_noise"))


@registry.add(
    "subcluster_relabel_offset",
    """WITH raw AS (SELECT DISTINCT clusters AS cluster, subclusters AS sub FROM reddit_data WHERE clusters >= 0 AND subclusters IS NOT NULL),
    k AS (SELECT cluster, max(sub) + 1 AS k FROM raw WHERE sub >= 0 GROUP BY cluster),
    o AS (SELECT cluster, coalesce(sum(k) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM k)
    SELECT raw.cluster, sub, CAST(CASE WHEN sub < 0 THEN -1 ELSE sub + o END AS BIGINT) AS label FROM raw LEFT JOIN o ON raw.cluster = o.cluster""",
)
def subcluster_relabel_offset(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "reddit_data").filter("clusters >= 0 and subclusters is not null")
    return agreement.relabel_subclusters(rows.select(F.col("clusters").alias("cluster"), F.col("subclusters").alias("sub")))


_EDGE_SQL = """pts AS (SELECT row_no, coalesce(clusters, -1) AS label, coalesce(CAST(dimensional_reduction[1] AS DOUBLE), 0) AS x FROM reddit_data),
    e AS (SELECT a.label AS la, b.label AS lb, abs(a.x - b.x) AS distance FROM pts a JOIN pts b ON b.row_no = a.row_no + 1)"""


@registry.add(
    "mst_dbcv_from_edges",
    f"""WITH {_EDGE_SQL}, i AS (SELECT la AS label, max(distance) AS dsc FROM e WHERE la >= 0 AND la = lb GROUP BY 1),
    x AS (SELECT label, min(distance) AS dspc FROM (SELECT unnest([la, lb]) AS label, distance FROM e WHERE la >= 0 AND lb >= 0 AND la <> lb) GROUP BY label),
    w AS (SELECT max(distance) AS far, min(distance) FILTER (WHERE (la >= 0) <> (lb >= 0)) AS gap FROM e),
    t AS (SELECT count(*) AS total, count(*) FILTER (WHERE label < 0) AS noise, count(DISTINCT label) FILTER (WHERE label >= 0) AS k FROM pts),
    s AS (SELECT label, count(*) AS size FROM pts WHERE label >= 0 GROUP BY label),
    r AS (SELECT size, coalesce(dsc, 0) AS dsc, coalesce(dspc, CASE WHEN k = 1 THEN 2 * coalesce(gap, far) ELSE 2 * far END) AS sep, total, noise FROM s LEFT JOIN i USING (label) LEFT JOIN x USING (label), w, t)
    SELECT round(sum(size * ((sep - dsc) / greatest(sep, dsc)) / total * (total - noise) / total), 6) AS score FROM r""",
)
def mst_dbcv_from_edges(spark: SparkSession, d: str) -> DataFrame:
    """The score's formula on given edges: a chain along one coordinate, which SQL can build; ``hdbscan_dbcv`` scores real trees."""
    pts = table(spark, d, "reddit_data").select(F.col("row_no").alias("id"), F.coalesce("clusters", F.lit(-1)).alias("label"), F.coalesce(F.col("dimensional_reduction")[0].cast("double"), F.lit(0.0)).alias("x"))
    after = pts.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("x").alias("y"))
    edges = pts.select(F.col("id").alias("a"), "x").join(after, "a").select("a", "b", F.abs(F.col("x") - F.col("y")).alias("distance"))
    return agreement.dbcv(edges, pts.select("id", "label")).withColumn("score", F.round("score", 6))


_TWO_SQL = f"""{LABELS_SQL}, a AS (SELECT id, max(cluster) AS label FROM labels GROUP BY id), b AS (SELECT id, max(cluster) AS label FROM final_dataframe GROUP BY id),
    ct AS (SELECT a.label AS l1, b.label AS l2, count(*) AS n FROM a JOIN b USING (id) GROUP BY 1, 2)"""


def _table(spark: SparkSession, d: str) -> DataFrame:
    left = _labels(spark, d).groupBy("id").agg(F.max("cluster").alias("label"))
    right = _final(spark, d).groupBy("id").agg(F.max("cluster").alias("label"))
    return agreement.contingency(left, right)


@registry.add("cluster_contingency", f"WITH {_TWO_SQL} SELECT * FROM ct")
def cluster_contingency(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d)


@registry.add("best_overlap_match", f"WITH {_TWO_SQL} SELECT l1, l2, n FROM (SELECT *, row_number() OVER (PARTITION BY l1 ORDER BY n DESC, l2) AS r FROM ct) WHERE r = 1")
def best_overlap_match(spark: SparkSession, d: str) -> DataFrame:
    return agreement.best_overlap(_table(spark, d))


@registry.add(
    "adjusted_rand_index",
    f"""WITH {_TWO_SQL}, s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM ct), a2 AS (SELECT sum(m * (m - 1) / 2) AS a FROM (SELECT sum(n) AS m FROM ct GROUP BY l1)),
    b2 AS (SELECT sum(m * (m - 1) / 2) AS b FROM (SELECT sum(n) AS m FROM ct GROUP BY l2))
    SELECT round((s - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari FROM s, a2, b2""",
)
def adjusted_rand_index(spark: SparkSession, d: str) -> DataFrame:
    return agreement.rand_index(cut(_table(spark, d), "contingency")).withColumn("ari", F.round("ari", 6))


_DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)))"
_KNN_SQL = f"""pr AS (SELECT a.vec_id AS id, b.vec_id AS other, {_DIST} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    kn AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), other) AS rank, other, distance FROM pr)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@registry.add("knn_graph", f"WITH {_KNN_SQL} SELECT id, rank, other, round(distance, 6) AS distance FROM kn WHERE rank <= 5")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return neighbours.nearest(v, v, C.neighbours).withColumn("distance", F.round("distance", 6))


@registry.add("core_distance", f"WITH {_KNN_SQL} SELECT id, round(distance, 6) AS core FROM kn WHERE rank = 5")
def core_distance(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return neighbours.core_distances(neighbours.nearest(v, v, C.min_samples), C.min_samples).withColumn("core", F.round("core", 6))


@registry.add("trustworthiness_k")
def trustworthiness_k(spark: SparkSession, d: str) -> DataFrame:
    """Trustworthiness of a principal reduction: full-space ranks of reduced neighbours."""
    full = cut(_vectors(spark, d), "full")
    n, k = full.count(), 30
    reduced = cut(reduce.principal_components(full, "id", "vec", 5).withColumnRenamed("reduced", "vec"), "reduced")
    near = cut(neighbours.nearest(reduced, reduced, k), "near")
    return neighbours.trustworthiness(neighbours.ranks_of(full, near), n, k).withColumn("trust", F.round("trust", 6))


@registry.add("pca_reduce")
def pca_reduce(spark: SparkSession, d: str) -> DataFrame:
    return reduce.principal_components(table(spark, d, "reddit_data").filter(F.size("embeddings") == 64), "row_no", "embeddings", C.reduced_dim)


@registry.add("umap_like_reduce")
def umap_like_reduce(spark: SparkSession, d: str) -> DataFrame:
    return reduce.reduce_by_layout(_vectors(spark, d), "id", "vec", C.reduced_dim, C.neighbours)


@registry.add("hdbscan_labels")
def hdbscan_labels(spark: SparkSession, d: str) -> DataFrame:
    return density.cluster(table(spark, d, "reddit_data"), "row_no", "dimensional_reduction", C.min_cluster_size, C.min_samples)


@registry.add("hdbscan_partial_predict")
def hdbscan_partial_predict(spark: SparkSession, d: str) -> DataFrame:
    labels = density.cluster(table(spark, d, "reddit_data"), "row_no", "dimensional_reduction", C.min_cluster_size, C.min_samples, fraction=0.3)
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@registry.add("hdbscan_grid")
def hdbscan_grid(spark: SparkSession, d: str) -> DataFrame:
    """Clusters and density validity of a fit on all rows for each pair of parameters."""
    return density.grid_scores(table(spark, d, "reddit_data"), "row_no", "dimensional_reduction", [C.min_cluster_size, 2 * C.min_cluster_size], [C.min_samples, 2 * C.min_samples])


@registry.add("hdbscan_dbcv")
def hdbscan_dbcv(spark: SparkSession, d: str) -> DataFrame:
    """The best pair of parameters by density validity on the spanning tree; ties go to the smaller values."""
    return hdbscan_grid(spark, d).groupBy().agg(F.min_by(F.struct("least", "samples", "clusters", "score"), F.struct(-F.col("score"), "least", "samples")).alias("b")).select("b.*")


@registry.add("subclusters_per_cluster")
def subclusters_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "reddit_data")
    return density.subclusters(rows, "row_no", "clusters", "dimensional_reduction")


@registry.add("linkage_average")
def linkage_average(spark: SparkSession, d: str) -> DataFrame:
    scores = cut(_scores(spark, d), "scores")
    return hierarchy.topic_linkage(scores, tfidf.adjacency(scores, "cluster"))


@registry.add("flat_cut_maxclust")
def flat_cut_maxclust(spark: SparkSession, d: str) -> DataFrame:
    scores = cut(_scores(spark, d), "scores")
    return hierarchy.topic_cuts(scores, tfidf.adjacency(scores, "cluster"), tfidf.top_terms(scores, ["cluster"]))


@registry.add("offline_embedding")
def offline_embedding(spark: SparkSession, d: str) -> DataFrame:
    texts = posts.post_texts(_subs(spark, d)).select("id", posts.text().alias("text"))
    return reduce.embed_posts(texts, "text", reduce.hashed_embedder())


# ---------------------------------------------------------------- names and quizzes

_QUIZ_SQL = f"""names AS (SELECT cluster, coalesce(max(topic), 'Error') AS topic FROM topic_names GROUP BY cluster),
    pick AS (SELECT id, cluster FROM (SELECT id, cluster, row_number() OVER (ORDER BY md5('{C.seed}|' || id), id, cluster) AS r FROM (SELECT DISTINCT id, cluster FROM labels WHERE cluster <> -1)) WHERE r <= {C.quiz_size}),
    op AS (SELECT id, cluster, cluster AS choice FROM pick UNION ALL SELECT p.id, p.cluster, n.other FROM pick p JOIN near n ON p.cluster = n.cluster),
    q AS (SELECT id, op.cluster, choice, topic, row_number() OVER (PARTITION BY id, op.cluster ORDER BY md5('{C.seed}|' || id || '|' || CAST(choice AS VARCHAR))) AS k FROM op JOIN names ON names.cluster = choice)"""


def _quiz(spark: SparkSession, d: str) -> DataFrame:
    labelled = _labels(spark, d).filter("cluster <> -1").select("id", "cluster").distinct()
    picked = labelled.orderBy(naming.order_key(C.seed, F.col("id")), "id", "cluster").limit(C.quiz_size)
    names = table(spark, d, "topic_names").groupBy("cluster").agg(F.coalesce(F.max("topic"), F.lit("Error")).alias("topic"))
    return naming.quiz_options(picked, naming.nearest_topics(cut(_centres(spark, d), "centres"), C.quiz_options - 1), names)


@registry.add("quiz_options", f"WITH {LABELS_SQL}, {_NEAR_SQL}, {_QUIZ_SQL} SELECT id, cluster, list(topic ORDER BY k) AS options, max(CASE WHEN choice = cluster THEN chr(CAST(64 + k AS INT)) END) AS answer FROM q GROUP BY id, cluster")
def quiz_options(spark: SparkSession, d: str) -> DataFrame:
    return _quiz(spark, d)


@registry.add("quiz_accuracy_stub")
def quiz_accuracy_stub(spark: SparkSession, d: str) -> DataFrame:
    texts = _subs(spark, d).groupBy("id").agg(F.max(F.concat_ws(" ", "title", "selftext")).alias("text"))
    return naming.accuracy(naming.solve_quiz(_quiz(spark, d), texts, naming.OverlapSolver()))


_LISTS_SQL = f"{_TOP_SQL}, lists AS (SELECT cluster, list(term ORDER BY rank) AS words FROM top WHERE rank <= {C.top_words} AND cluster <> -1 GROUP BY cluster)"


@registry.add("name_topics", f"{_LISTS_SQL} SELECT cluster, words, trim(array_to_string(words[1:2], ' ')) AS topic FROM lists")
def name_topics(spark: SparkSession, d: str) -> DataFrame:
    return naming.name_topics(_top(spark, d), naming.TopWordNamer())


@registry.add(
    "topic_name_parse",
    """SELECT * FROM (VALUES ('{"topic": "Bread"}', 'Bread'), ('{"name": "x"}', 'Error'), ('no json', 'Error'), ('{"topic": "a, b"}', 'a, b')) t(answer, topic)""",
)
def topic_name_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([('{"topic": "Bread"}',), ('{"name": "x"}',), ("no json",), ('{"topic": "a, b"}',)], "answer string")
    return rows.select("answer", naming.parsed_topic(F.col("answer")).alias("topic"))


@registry.add(
    "accuracy_ci",
    """SELECT cluster, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(1.96 * stddev_pop(score) / sqrt(count(score)), 6) AS ci
    FROM (SELECT cluster, CAST(score AS DOUBLE) AS score FROM final_dataframe f JOIN (SELECT id, max(score) AS score FROM submissions GROUP BY id) s ON f.id = s.id) GROUP BY cluster""",
)
def accuracy_ci(spark: SparkSession, d: str) -> DataFrame:
    scores = _subs(spark, d).groupBy("id").agg(F.max("score").cast("double").alias("score"))
    return naming.confidence(_final(spark, d).select("id", "cluster").join(scores, "id"), "score", ["cluster"])


# ---------------------------------------------------------------- reports

_NAMED_SQL = "nm AS (SELECT cluster, max(topic) AS topic FROM topic_names GROUP BY cluster), fd AS (SELECT f.*, coalesce(nm.topic, 'Error') AS topic FROM final_dataframe f LEFT JOIN nm ON f.cluster = nm.cluster)"


def _named(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "topic_names").groupBy("cluster").agg(F.max("topic").alias("topic"))
    return _final(spark, d).join(names, "cluster", "left").withColumn("topic", F.coalesce("topic", F.lit("Error")))


@registry.add("value_counts_topk", f"WITH {_NAMED_SQL} SELECT topic, count(*) AS n FROM fd GROUP BY topic ORDER BY n DESC, topic LIMIT 20")
def value_counts_topk(spark: SparkSession, d: str) -> DataFrame:
    return reports.value_counts(_named(spark, d), "topic", 20)


@registry.add("monthly_topic_counts", f"WITH {_NAMED_SQL} SELECT topic, {MONTH_SQL} AS month, count(*) AS n FROM fd GROUP BY 1, 2")
def monthly_topic_counts(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).groupBy("topic", month(F.col("created_utc")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


_MEAN_SQL = """m AS (SELECT date_trunc('month', o_orderdate) AS month, avg(o_totalprice) AS mean FROM orders GROUP BY 1),
    g AS (SELECT unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS month),
    mm AS (SELECT strftime(g.month, '%Y-%m') AS month, round(mean, 4) AS mean FROM g LEFT JOIN m ON g.month = m.month)"""


def _means(spark: SparkSession, d: str) -> DataFrame:
    return reports.monthly_mean(table(spark, d, "orders"), F.col("o_orderdate"), "o_totalprice")


@registry.add("monthly_mean_gapfilled", f"WITH {_MEAN_SQL} SELECT month, mean FROM mm")
def monthly_mean_gapfilled(spark: SparkSession, d: str) -> DataFrame:
    return _means(spark, d)


@registry.add(
    "monthly_counts_vs_mean_full_join",
    f"WITH {_MEAN_SQL}, c AS (SELECT {MONTH_SQL} AS month, count(*) AS n FROM final_dataframe GROUP BY 1) SELECT coalesce(mm.month, c.month) AS month, n, mean FROM mm FULL JOIN c ON mm.month = c.month",
)
def monthly_counts_vs_mean_full_join(spark: SparkSession, d: str) -> DataFrame:
    counts = _final(spark, d).groupBy(month(F.col("created_utc")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return _means(spark, d).join(counts, "month", "full").select("month", "n", "mean")


@registry.add("community_topics_topk", f"WITH {_NAMED_SQL}, c AS (SELECT subreddit, topic, count(*) AS n FROM fd GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY n DESC, topic) AS rank FROM c) WHERE rank <= 15")
def community_topics_topk(spark: SparkSession, d: str) -> DataFrame:
    counts = _named(spark, d).groupBy("subreddit", "topic").agg(F.count(F.lit(1)).alias("n"))
    return reports.top_per_group(counts, "subreddit", "topic", 15)


@registry.add("communities_per_topic", f"WITH {_NAMED_SQL} SELECT topic, count(*) AS n_posts, count(DISTINCT subreddit) AS n_communities FROM fd GROUP BY topic")
def communities_per_topic(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).groupBy("topic").agg(F.count(F.lit(1)).alias("n_posts"), F.count_distinct("subreddit").alias("n_communities"))


@registry.add("topics_per_community", f"WITH {_NAMED_SQL} SELECT subreddit, count(DISTINCT topic) AS n_topics FROM fd GROUP BY subreddit")
def topics_per_community(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).groupBy("subreddit").agg(F.count_distinct("topic").alias("n_topics"))


@registry.add("authors_per_topic", f"WITH {_NAMED_SQL} SELECT topic, count(DISTINCT author) AS n_authors FROM fd GROUP BY topic")
def authors_per_topic(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).groupBy("topic").agg(F.count_distinct("author").alias("n_authors"))


@registry.add(
    "yearly_top_topic_growth",
    f"WITH {_NAMED_SQL}, c AS (SELECT year(make_timestamp(created_utc * 1000000)) AS year, topic, count(*) AS n FROM fd GROUP BY 1, 2), g AS (SELECT *, n - lag(n) OVER (PARTITION BY topic ORDER BY year) AS growth FROM c) SELECT year, topic, n, growth FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, topic) AS r FROM g) WHERE r = 1",
)
def yearly_top_topic_growth(spark: SparkSession, d: str) -> DataFrame:
    return reports.yearly_top(_named(spark, d), F.year(F.timestamp_seconds("created_utc")), "topic")


@registry.add(
    "prolific_author_topics",
    f"WITH {_NAMED_SQL}, a AS (SELECT author, count(*) AS k FROM fd WHERE author IS NOT NULL AND author <> '[deleted]' GROUP BY 1 ORDER BY k DESC, author LIMIT 20) SELECT fd.author, topic, count(*) AS n FROM fd JOIN a ON fd.author = a.author GROUP BY 1, 2",
)
def prolific_author_topics(spark: SparkSession, d: str) -> DataFrame:
    rows = _named(spark, d).filter("author is not null and author <> '[deleted]'")
    top = reports.value_counts(rows, "author", 20)
    return rows.join(top.select("author"), "author").groupBy("author", "topic").agg(F.count(F.lit(1)).alias("n"))


_EVENTS = [("first", 1388534400), ("second", 1451606400), ("third", 1514764800)]


@registry.add(
    "event_window_counts",
    f"WITH ev(event, t0) AS (VALUES {', '.join(str(x) for x in _EVENTS)}) SELECT event, cluster, count(*) FILTER (WHERE created_utc < t0) AS before, count(*) FILTER (WHERE created_utc >= t0) AS after FROM final_dataframe JOIN ev ON created_utc BETWEEN t0 - 7776000 AND t0 + 7775999 GROUP BY 1, 2",
)
def event_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Posts in the 90 days before and after given dates; each post meets few windows, found by array instead of a range join."""
    windows = F.array(*[F.struct(F.lit(n).alias("event"), F.lit(t).alias("at")) for n, t in _EVENTS])
    rows = _final(spark, d).select("cluster", "created_utc", F.explode(windows).alias("e")).filter(F.col("created_utc").between(F.col("e.at") - 7776000, F.col("e.at") + 7775999))
    return rows.groupBy(F.col("e.event").alias("event"), "cluster").agg(F.count_if(F.col("created_utc") < F.col("e.at")).alias("before"), F.count_if(F.col("created_utc") >= F.col("e.at")).alias("after"))


@registry.add(
    "equal_width_bins25",
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT unnest(generate_series(1, 25)) AS bin),
    c AS (SELECT CAST(least(25, greatest(1, ceil((o_totalprice - lo) / ((hi - lo) / 25)))) AS INT) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
    SELECT CAST(b.bin AS INT) AS bin, coalesce(n, 0) AS n, round(lo + (hi - lo) / 25 * (b.bin - 0.5), 2) AS middle FROM b LEFT JOIN c ON b.bin = c.bin, e""",
)
def equal_width_bins25(spark: SparkSession, d: str) -> DataFrame:
    return reports.equal_width_bins(table(spark, d, "orders"), "o_totalprice")


@registry.add("daily_event_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_event_counts(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.streaming.incremental import daily_counts

    return daily_counts(table(spark, d, "events"), "ts", "event_type")
