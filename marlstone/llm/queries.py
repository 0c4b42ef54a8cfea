"""Queries of the text and vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import abuse, language, leaks, personal, similar, spans, terms, tokens
from marlstone.llm.posts import distinct_posts
from marlstone.operators.skew import community_key
from marlstone.plans.registry import Registry
from marlstone.session import cut, spread, table

registry = Registry()

#: Distinct posts as SQL: the body that is no bare removal marker wins, then the greater text.
POSTS_SQL = """posts AS (SELECT id, title, selftext FROM (SELECT id, title, selftext, row_number() OVER (PARTITION BY id
    ORDER BY CASE WHEN selftext IS NULL THEN 0 WHEN trim(selftext) IN ('[removed]', '[deleted]') THEN 1 ELSE 2 END DESC,
    selftext DESC NULLS LAST, title DESC NULLS LAST) AS k FROM submissions WHERE id IS NOT NULL) WHERE k = 1)"""


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return distinct_posts(table(spark, d, "submissions"))


# ---------------------------------------------------------------- 2: similarity groups


@registry.add("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Group number of every id whose vector lies in a group."""
    members = cut(similar.similarity_groups(table(spark, d, "reddit_data")), "members")
    return members.join(similar.named_groups(members), "grp").select("id", "cluster")


@registry.add("p2_groups")
def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members of each group."""
    return similar.typical_members(cut(similar.similarity_groups(table(spark, d, "reddit_data")), "members"))


# ---------------------------------------------------------------- 5: distinctive terms

_TERMS_SQL = f"""WITH {POSTS_SQL},
words AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', title, selftext)), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM posts),
tf AS (SELECT id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM words) GROUP BY id, term),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
k AS (SELECT (SELECT count(*) FROM posts) AS n_posts, (SELECT sum(tf) FROM tf) AS n_terms),
scored AS (SELECT id, term, tf, df, cf / n_posts AS rate, tf * log2(1 + n_terms / n_posts / n) AS tfn FROM tf JOIN st USING (term), k)
"""


@registry.add("p5_scores", _TERMS_SQL + "SELECT id, term, tf, df, round((log2(1 + rate) + tfn * log2((1 + rate) / rate)) / (1 + tfn), 5) AS score FROM scored")
def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every term of every post."""
    scores = terms.distinctiveness(_posts(spark, d))
    return scores.withColumn("score", F.round("score", 5))


@registry.add("p5_found", _TERMS_SQL + "SELECT id, term FROM scored WHERE tf >= 3 AND df BETWEEN 2 AND 6")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms used three times or more in a post and by two to six posts."""
    return terms.distinctive_terms(terms.distinctiveness(_posts(spark, d))).select("id", "term")


# ---------------------------------------------------------------- 8: token ids


@registry.add("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return tokens.encode_corpus(spread(docs))


@registry.add("p8_totals")
def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and distinct ids of the corpus."""
    return tokens.token_totals(p8_ids(spark, d))


# ---------------------------------------------------------------- 9: evaluation leaks

#: Words of a text as SQL.
_WORDS_SQL = r"regexp_extract_all(lower(regexp_replace(nfc_normalize(text), '[\p{Cf}\p{Mn}]+', '', 'g')), '[\p{L}\p{N}]+')"
_LEAKS_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM eval_items),
dw AS (SELECT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
iw AS (SELECT item_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return leaks.hits_table(table(spark, d, "documents"), table(spark, d, "eval_items"))


@registry.add("p9_found", _LEAKS_SQL)
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items of which they hold twelve consecutive words."""
    return leaks.verbatim_leaks(leaks.template_hits(table(spark, d, "documents"), table(spark, d, "eval_items")))


@registry.add("p9_templates")
def p9_templates(spark: SparkSession, d: str) -> DataFrame:
    """All template hits, with the number of verbatim and of re-parameterised windows."""
    return leaks.template_hits(table(spark, d, "documents"), table(spark, d, "eval_items"))


@registry.add("p9_items")
def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with their numbers of documents."""
    return leaks.leaked_items(_hits(spark, d))


# ---------------------------------------------------------------- 10: shared spans


#: Hashes of all windows of 400 characters, as SQL.
_SPANS_SQL = """WITH w AS (SELECT doc_id, k, md5(substr(text, k, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS k FROM documents WHERE length(text) >= 400))"""


@registry.add("p10_found", f"{_SPANS_SQL}, g AS (SELECT DISTINCT doc_id, h FROM w) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with a stretch of 400 characters in common."""
    return spans.shared_pairs(table(spark, d, "documents"))


@registry.add(
    "p10_shares",
    f"""{_SPANS_SQL}, held AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
    places AS (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS nxt FROM (SELECT DISTINCT doc_id, k FROM w JOIN held USING (h))),
    s AS (SELECT doc_id, sum(least(400, coalesce(nxt - k, 400))) AS chars FROM places GROUP BY doc_id),
    c AS (SELECT text, count(DISTINCT doc_id) AS copies FROM documents WHERE length(text) >= 400 GROUP BY text),
    r AS (SELECT d.doc_id, coalesce(length(d.text), 0) AS n_chars, coalesce(s.chars, 0) AS shared_chars, coalesce(c.copies, 1) AS copies FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN c ON d.text = c.text)
    SELECT doc_id, n_chars, shared_chars, round(CASE WHEN n_chars > 0 THEN shared_chars / n_chars ELSE 0 END, 6) AS share, copies FROM r""",
)
def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of each document's text that occurs in other documents too."""
    return spans.shared_share(table(spark, d, "documents"))


@registry.add("p10_spans")
def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    """Maximal shared spans, once for each class of equal texts."""
    return spans.shared_stretches(table(spark, d, "documents"))


# ---------------------------------------------------------------- 6: languages


def _segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    posts = cut(_posts(spark, d), "posts")
    labels = cut(language.latest_labels(table(spark, d, "language_labels")), "labels")
    model = language.fit_languages(posts, labels)
    return language.language_segments(spread(posts), model), labels


@registry.add("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of whole sentences of a post that its label does not name."""
    return language.unlabelled_languages(*_segments(spark, d))


@registry.add("p6_segments")
def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every post with its language and confidence."""
    return _segments(spark, d)[0]


@registry.add("p6_posts")
def p6_posts(spark: SparkSession, d: str) -> DataFrame:
    """Main language of every post."""
    return language.post_languages(_segments(spark, d)[0])


# ---------------------------------------------------------------- 3: personal information


def _personal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    posts = spread(cut(_posts(spark, d), "posts"))
    return posts, personal.personal_spans(posts)


@registry.add("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of personal information with its kind and place."""
    return _personal(spark, d)[1].select("id", "field_name", "kind", "start_pos")


@registry.add("p3_masked")
def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    """Posts with typed placeholders instead of personal information."""
    posts, spans = _personal(spark, d)
    return personal.masked_posts(posts, cut(spans, "pii_spans"))


# ---------------------------------------------------------------- 7: abusive content


def _content(spark: SparkSession, d: str) -> DataFrame:
    posts = spread(cut(_posts(spark, d).join(language.latest_labels(table(spark, d, "language_labels")), "id", "left"), "posts"))
    labelled = abuse.labelled_posts(posts, table(spark, d, "review_labels")).join(posts.select("id", "label"), "id", "left").orderBy("id").collect()
    model = abuse.fit_classifier([(r["title"], r["selftext"], r["verdicts"]) for r in labelled], [r["label"] or "" for r in labelled])
    return abuse.content_scores(posts, model, "label")


@registry.add("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts and the kinds of abusive content in them."""
    return abuse.found_kinds(_content(spark, d))


@registry.add("p7_scores")
def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every post."""
    return _content(spark, d)


@registry.add("p7_rates")
def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of each subreddit."""
    sources = table(spark, d, "submissions").select("id", community_key(F.col("subreddit")).alias("source"))
    return abuse.source_rates(cut(_content(spark, d), "scores"), sources)
