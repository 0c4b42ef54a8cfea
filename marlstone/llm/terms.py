"""How distinctive a term is per record: divergence from randomness.

Weight of a term in a record = information content of its normalised frequency under a
geometric collection model, times the Laplace after-effect (Amati and van Rijsbergen 2002):

    tfn   = tf * log2(1 + mean length / length)
    info  = log2(1 + rate) + tfn * log2((1 + rate) / rate),  rate = cf / n_posts
    score = info / (1 + tfn)

Null and empty texts give no terms; such posts still count as posts of the collection.
Terms that a large share of all posts use are joined by broadcast (their number is bounded),
all others by shuffle, so no term loads one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut

#: A term: a maximal run of letters of any script, digits or underscores, two or more.
TERM = r"[\p{L}\p{N}_]{2,}"
#: A term is common if it makes up more than 1 / COMMON of all (post, term) rows: fewer than COMMON terms are.
COMMON = 4000


def term_counts(posts: DataFrame) -> DataFrame:
    """``id, term, tf, length`` of posts with unique ids; ``length`` counts all terms of the post.

    Terms are counted inside the row's own partition: posts arrive partitioned by id.
    """
    text = F.lower(F.concat_ws(" ", F.col("title"), F.col("selftext")))
    words = posts.select("id", F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("words"))
    rows = words.select("id", F.size("words").alias("length"), F.explode("words").alias("term"))
    return rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def distinctiveness(posts: DataFrame) -> DataFrame:
    """``id, term, tf, df, score`` of every term of every post."""
    counts = cut(term_counts(posts), "term_counts")
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    stats = cut(stats, "term_stats")
    whole = posts.groupBy().agg(F.count(F.lit(1)).alias("n_posts"))
    sums = stats.groupBy().agg(F.sum("df").alias("n_rows"), F.sum("cf").alias("n_terms"))
    n_posts = whole.first()["n_posts"]
    total = sums.first()
    if not total["n_rows"]:
        return counts.select("id", "term", "tf", F.lit(0).cast("long").alias("df"), F.lit(0.0).alias("score"))
    mean = total["n_terms"] / n_posts
    common = F.col("df") > F.lit(total["n_rows"] / COMMON)
    # Which terms are common is part of their statistics, so each row finds its term on one side only.
    often = counts.join(F.broadcast(stats.filter(common)), "term")
    rest = counts.join(F.broadcast(stats.filter(common).select("term")), "term", "left_anti")
    seldom = rest.join(stats.filter(~common), "term")
    joined = often.unionByName(seldom)
    tfn = F.col("tf") * F.log2(1 + F.lit(float(mean)) / F.col("length"))
    rate = F.col("cf") / F.lit(float(n_posts))
    info = F.log2(1 + rate) + tfn * F.log2((1 + rate) / rate)
    return joined.select("id", "term", "tf", "df", (info / (1 + tfn)).alias("score"))


def distinctive_terms(scores: DataFrame, min_tf: int = 3, min_df: int = 2, max_df: int = 6) -> DataFrame:
    """Terms used at least ``min_tf`` times in their post and by ``min_df`` to ``max_df`` posts, with a positive score."""
    return scores.filter((F.col("tf") >= min_tf) & F.col("df").between(min_df, max_df) & (F.col("score") > 0))
