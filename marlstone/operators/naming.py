"""Topic names and quizzes through a text model behind an interface, with offline stand-ins."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marlstone.config import DEFAULT
from marlstone.functions.sampling import order_key
from marlstone.functions.text import lettered


class TextModel(Protocol):
    """Anything that answers a prompt."""

    def complete(self, prompt: str) -> str: ...


class TopWordNamer:
    """Names a topic by its first two words."""

    def complete(self, prompt: str) -> str:
        words = prompt.rpartition("Words: ")[2].split(", ")
        return json.dumps({"topic": " ".join(words[:2]).strip()})


class OverlapSolver:
    """Answers a quiz by the option that shares most words with the post; ties go to the first."""

    def complete(self, prompt: str) -> str:
        post, _, options = prompt.partition("\nOptions:\n")
        own = set(post.lower().split())
        scored = [(-len(own & set(x[3:].lower().split())), x[0]) for x in options.split("\n") if x[1:3] == ": "]
        return json.dumps({"answer": min(scored)[1] if scored else ""})


def naming_prompt(words: Column) -> Column:
    return F.concat(F.lit('Name the common topic of these words. Answer as JSON {"topic": ...}. Words: '), F.array_join(words, ", "))


def parsed_topic(answer: Column) -> Column:
    """The topic of an answer, or ``Error`` where it is no JSON or lacks one."""
    return F.coalesce(F.get_json_object(answer, "$.topic"), F.lit("Error"))


def ask(df: DataFrame, prompt: str, model: TextModel, out: str = "answer") -> DataFrame:
    """``df`` with the model's answer to each prompt, in batches on the tasks."""
    schema = StructType([*df.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [model.complete(p) for p in pdf[prompt]]})

    return df.mapInPandas(run, schema)


def name_topics(words: DataFrame, model: TextModel, key: str = "cluster") -> DataFrame:
    """``key, words, topic`` of ranked words; noise is not named."""
    lists = words.filter(F.col(key) != -1).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("words"))
    asked = ask(lists.withColumn("prompt", naming_prompt(F.col("words"))), "prompt", model)
    return asked.select(key, "words", parsed_topic(F.col("answer")).alias("topic"))


def name_subtopics(words: DataFrame, model: TextModel, key: str = "cluster", sub: str = "subcluster") -> DataFrame:
    """``key, sub, words, topic`` of ranked words of sub-clusters; noise on either level is not named."""
    lists = words.filter((F.col(key) != -1) & (F.col(sub) != -1)).groupBy(key, sub).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("words"))
    asked = ask(lists.withColumn("prompt", naming_prompt(F.col("words"))), "prompt", model)
    return asked.select(key, sub, "words", parsed_topic(F.col("answer")).alias("topic"))


def quiz_questions(labelled: DataFrame, titles: DataFrame, size: int, runs: int, seed: str = DEFAULT.seed, strict: bool = True) -> DataFrame:
    """``run, id, cluster``: ``size`` posts with a non-empty title for each run, the first by that run's hash.

    Each task keeps its first ``size`` posts of every run, so no run is sorted whole. Fewer usable posts
    than ``size`` are an error; where not ``strict``, all of them are asked then.
    """
    usable = labelled.filter(F.col("cluster") != -1).select("id", "cluster").distinct().join(titles.filter(F.length("title") > 0).select("id").distinct(), "id", "left_semi")
    order = [order_key(seed, F.col("run").cast("string"), F.col("id")), F.col("id"), F.col("cluster")]
    numbered = usable.select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "id", "cluster")
    picked = numbered.withColumn("_r", F.row_number().over(Window.partitionBy("run").orderBy(*order))).filter(F.col("_r") <= size).drop("_r")
    if not strict:
        return picked
    few = picked.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < size)
    if picked.isEmpty() or not few.isEmpty():
        raise ValueError(f"fewer than {size} labelled posts with a title")
    return picked


def nearest_topics(centers: DataFrame, n: int) -> DataFrame:
    """``cluster, rank, other``: the n nearest other centroids of each; one row per pair of topics, both few."""
    cells = centers.select("cluster", "pos", "value")
    other = cells.select(F.col("cluster").alias("other"), "pos", F.col("value").alias("w"))
    pairs = cells.join(other, "pos").filter("cluster <> other").groupBy("cluster", "other").agg(F.sqrt(F.sum(F.pow(F.col("value") - F.col("w"), F.lit(2)))).alias("distance"))
    w = Window.partitionBy("cluster").orderBy(F.round("distance", 9), "other")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("cluster", "rank", "other", F.round("distance", 6).alias("distance"))


def quiz_options(questions: DataFrame, near: DataFrame, names: DataFrame, seed: str = DEFAULT.seed) -> DataFrame:
    """``id, cluster, options, answer``: the true topic and its nearest others in hashed order, and the right letter."""
    true = questions.select("id", "cluster", F.col("cluster").alias("choice"))
    others = questions.select("id", "cluster").join(near.select("cluster", F.col("other").alias("choice")), "cluster")
    all_ = true.unionByName(others.select("id", "cluster", "choice")).join(names.select(F.col("cluster").alias("choice"), "topic"), "choice")
    order = order_key(seed, F.col("id"), F.col("choice").cast("string"))
    rows = all_.groupBy("id", "cluster").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "choice", "topic"))).alias("c"))
    place = F.array_position(F.transform("c", lambda x: x["choice"]), F.col("cluster"))
    options = F.transform("c", lambda x: x["topic"])
    return rows.select("id", "cluster", options.alias("options"), F.chr(F.lit(64) + place).alias("answer"))


def solve_quiz(quiz: DataFrame, texts: DataFrame, model: TextModel) -> DataFrame:
    """``id, answer, given``: unreadable answers are null."""
    asked = quiz.join(texts.select("id", "text"), "id").withColumn("prompt", F.concat("text", F.lit("\nOptions:\n"), lettered(F.col("options"))))
    return ask(asked, "prompt", model, "reply").select("id", "answer", F.get_json_object("reply", "$.answer").alias("given"))


def accuracy(solved: DataFrame) -> DataFrame:
    """``n, accuracy``: unreadable answers are wrong; an empty quiz gives null."""
    right = F.coalesce(F.col("given") == F.col("answer"), F.lit(False)).cast("int")
    return solved.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


def confidence(runs: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, population deviation and 95 % half width of repeated runs."""
    half = F.lit(1.96) * F.stddev_pop(value) / F.sqrt(F.count(value))
    return runs.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"), F.round(half, 6).alias("ci"))
