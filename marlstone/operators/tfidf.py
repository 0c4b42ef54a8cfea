"""TF-IDF over groups of posts: smooth idf, raw counts, unit length, vocabulary by corpus frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.config import DEFAULT
from marlstone.functions.text import is_stop_word, terms


def group_terms(texts: DataFrame, group: list[str], text: str = "text") -> DataFrame:
    """``group, term, n``: term counts per group without stop words; nothing is concatenated."""
    rows = texts.select(*group, F.explode(terms(F.col(text))).alias("term")).filter(~is_stop_word(F.col("term")))
    return rows.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, limit: int = DEFAULT.max_features, within: list[str] | None = None) -> DataFrame:
    """``term, total, df``: the ``limit`` most frequent terms (ties by term), over all groups or within some columns."""
    within = within or []
    stats = counts.groupBy(*within, "term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df"))
    if not within:
        return stats.orderBy(F.desc("total"), "term").limit(limit)
    w = Window.partitionBy(*within).orderBy(F.desc("total"), "term")
    return stats.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def tfidf(counts: DataFrame, group: list[str], limit: int = DEFAULT.max_features, within: list[str] | None = None) -> DataFrame:
    """``group, term, score``. ``within`` names the columns of ``group`` inside which documents are compared."""
    within = within or []
    vocab = vocabulary(counts, limit, within)
    sizes = counts.select(*group).distinct().groupBy(*within).agg(F.count(F.lit(1)).alias("groups"))
    rows = counts.join(vocab, [*within, "term"])
    rows = rows.join(sizes, within) if within else rows.join(F.broadcast(sizes))  # one row
    weight = F.col("n") * (F.log((1 + F.col("groups")) / (1 + F.col("df"))) + 1)
    w = Window.partitionBy(*group)
    scored = rows.withColumn("_v", weight).withColumn("_l", F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(w)))
    return scored.select(*group, "term", (F.col("_v") / F.col("_l")).alias("score"))


def top_terms(scores: DataFrame, group: list[str], n: int = DEFAULT.top_words) -> DataFrame:
    """``group, rank, term, score``: the highest scores of each group, ties by term."""
    w = Window.partitionBy(*group).orderBy(F.desc(F.round("score", 9)), "term")
    ranked = scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return ranked.select(*group, "rank", "term", F.round("score", 6).alias("score"))


def adjacency(scores: DataFrame, group: str) -> DataFrame:
    """``a, b, similarity`` of groups (a < b) with a common term, joined on the term; other pairs are 0."""
    left, right = (scores.select(F.col(group).alias(x), "term", F.col("score").alias(f"s{x}")) for x in "ab")
    return left.join(right, "term").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("sa") * F.col("sb")).alias("similarity"))


def word_diversity(words: DataFrame, topics: int = 25) -> DataFrame:
    """``diversity``: distinct among the ``topics`` most common words, over ``topics``."""
    common = words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(topics)
    return common.agg((F.count_distinct("term") / F.lit(topics)).alias("diversity"))


def distinct_ratio(words: DataFrame) -> DataFrame:
    """``diversity``: distinct words over all words of all topics."""
    return words.agg(F.try_divide(F.count_distinct("term"), F.count(F.lit(1))).alias("diversity"))


def npmi(words: DataFrame, texts: DataFrame, group: str) -> DataFrame:
    """``group, coherence``: mean NPMI of the group's word pairs over documents; pairs never met count -1."""
    docs = texts.select("id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(words.select("term").distinct(), "term", "left_semi")
    n = texts.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    single = docs.groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    left, right = (words.select(group, F.col("term").alias(x)) for x in ("x", "y"))
    pairs = left.join(right, group).filter("x < y")
    wanted = pairs.select("x", "y").distinct()
    met = docs.withColumnRenamed("term", "x").join(wanted, "x").join(docs.withColumnRenamed("term", "y"), ["id", "y"]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("xy"))
    rows = pairs.join(met, ["x", "y"], "left").join(single.withColumnRenamed("term", "x").withColumnRenamed("c", "cx"), "x", "left").join(single.withColumnRenamed("term", "y").withColumnRenamed("c", "cy"), "y", "left").join(F.broadcast(n))
    p = F.col("xy") / F.col("n")
    value = F.when(F.col("xy").isNull(), -1.0).when(F.col("xy") == F.col("n"), 1.0).otherwise(F.log(p * F.col("n") / F.col("cx") * F.col("n") / F.col("cy")) / -F.log(p))
    return rows.groupBy(group).agg(F.avg(value).alias("coherence"))


def cv_coherence(words: DataFrame, texts: DataFrame, group: str, window: int = 110) -> DataFrame:
    """``group, coherence``: c_v of Röder et al. (2015) of ranked words, over sliding windows of the texts.

    Words meet in a window of ``window`` terms (a shorter text is one window). Each word's vector holds its NPMI with every word of
    the group, itself included (1); coherence is the mean cosine between a word's vector and the sum of all. Windows are
    counted as the places where a pair is within reach, so none is written out: only places of wanted words are joined, within one text.
    """
    wanted = words.select(group, "term").distinct()
    split = texts.select("id", terms(F.col("text")).alias("w")).filter(F.size("w") > 0)
    span = F.greatest(F.size("w") - window + 1, F.lit(1))
    total = split.agg(F.sum(span).alias("n"))
    placed = split.select("id", span.alias("spans"), F.posexplode("w").alias("at", "term")).join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
    # The windows that hold a place are a run of numbers; runs of one term in a text are merged before they are counted.
    runs = placed.select("id", "term", F.greatest(F.col("at") - window + 1, F.lit(0)).alias("a"), F.least("at", F.col("spans") - 1).alias("b"))
    order = Window.partitionBy("id", "term").orderBy("a", "b")
    upto = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("a") > upto + 1, F.lit(True)).cast("int")
    merged = runs.withColumn("new", fresh).withColumn("run", F.sum("new").over(order)).groupBy("id", "term", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")
    single = merged.groupBy("term").agg(F.sum(F.col("b") - F.col("a") + 1).alias("c"))
    left, right = (wanted.select(group, F.col("term").alias(x)) for x in "xy")
    pairs = left.join(right, group)
    asked = pairs.filter("x < y").select("x", "y").distinct()
    one = merged.select("id", F.col("term").alias("x"), F.col("a").alias("xa"), F.col("b").alias("xb"))
    two = merged.select("id", F.col("term").alias("y"), F.col("a").alias("ya"), F.col("b").alias("yb"))
    common = F.least("xb", "yb") - F.greatest("xa", "ya") + 1
    met = one.join(F.broadcast(asked), "x").join(two, ["id", "y"]).withColumn("k", common).filter("k > 0").groupBy("x", "y").agg(F.sum("k").alias("xy"))
    met = met.unionByName(met.select(F.col("y").alias("x"), F.col("x").alias("y"), "xy"))
    rows = pairs.join(met, ["x", "y"], "left").join(single.select(F.col("term").alias("x"), F.col("c").alias("cx")), "x", "left").join(single.select(F.col("term").alias("y"), F.col("c").alias("cy")), "y", "left").join(F.broadcast(total))
    tiny = F.lit(1e-12)
    p = F.coalesce(F.col("xy"), F.lit(0)) / F.col("n") + tiny
    npmi_ = F.when(F.col("x") == F.col("y"), 1.0).when(F.col("cx").isNull() | F.col("cy").isNull(), 0.0).otherwise(F.try_divide(F.log(p / (F.col("cx") / F.col("n") * F.col("cy") / F.col("n"))), -F.log(p)))
    cells = rows.select(group, "x", "y", F.coalesce(npmi_, F.lit(0.0)).alias("v"))
    whole = cells.groupBy(group, "y").agg(F.sum("v").alias("s"))
    dots = cells.join(whole, [group, "y"]).groupBy(group, "x").agg(F.sum(F.col("v") * F.col("s")).alias("d"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("lv"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("ls"))
    return dots.groupBy(group).agg(F.avg(F.coalesce(F.try_divide(F.col("d"), F.col("lv") * F.col("ls")), F.lit(0.0))).alias("coherence"))
