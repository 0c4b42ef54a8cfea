import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone import runner
from marlstone.functions import sampling
from marlstone.functions.text import decoded, subset_size
from marlstone.operators import agreement, density, naming, reduce, skew, tfidf
from marlstone.sources import archive, sinks, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_word_lists_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"1": ["bread", "oven"], "2": [], "3": None}))
    (tmp_path / "b.json").write_text(json.dumps({"1": {"0": ["bread"], "1": ["oven", "yeast"]}}))
    (tmp_path / "c.json").write_text("no json")
    assert rows(tables.read_word_lists(spark, str(tmp_path / "a.json"))) == [("1", 1, "bread"), ("1", 2, "oven")]
    assert rows(tables.read_word_lists(spark, str(tmp_path / "b.json"), nested=True)) == [("1", "0", 1, "bread"), ("1", "1", 1, "oven"), ("1", "1", 2, "yeast")]
    assert tables.read_word_lists(spark, str(tmp_path / "c.json")).count() == 0


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,title,n\na,"one\ntwo, ""three""",5\nb,,\n')
    got = tables.read_csv(spark, str(tmp_path / "x.csv"))
    assert rows(got) == [("a", 'one\ntwo, "three"', 5), ("b", None, None)] and dict(got.dtypes)["n"] == "int"
    assert dict(tables.read_csv(spark, str(tmp_path / "x.csv"), "id string, title string, n double").dtypes)["n"] == "double"


def test_archives_are_listed_in_name_order(spark, tmp_path):
    for name in ("RS_2012-02.zst", "RS_2011-12.zst", "RC_2011-12.zst", "notes.txt"):
        (tmp_path / name).write_bytes(b"abc")
    assert [(r["name"], r["bytes"]) for r in tables.archive_files(spark, str(tmp_path)).collect()] == [("RS_2011-12", 3), ("RS_2012-02", 3)]
    assert [r["name"] for r in tables.archive_files(spark, str(tmp_path), limit=1).collect()] == ["RS_2011-12"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, True), ("b", 2, False), ("c", 3, None)], "id string, n int, ok boolean")
    assert sinks.write_posts(df, str(tmp_path / "p"), valid="ok") == {"rows": 1, "bad": 2, "bad_share": pytest.approx(2 / 3)}
    assert sinks.write_posts(df.limit(0), str(tmp_path / "e"), valid="ok")["bad_share"] == 0.0
    sinks.append_rows(df, str(tmp_path / "q"))
    sinks.append_rows(df, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 6
    sinks.write_projection(df, str(tmp_path / "r"), ["n", "id"])
    assert spark.read.parquet(str(tmp_path / "r")).columns == ["n", "id"]
    with pytest.raises(ValueError, match="none"):
        sinks.write_projection(df, str(tmp_path / "s"), ["id", "none"])
    sinks.write_chunks(df, str(tmp_path / "t"), "id", 2)
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["chunk=0", "chunk=1"]


def test_tables_are_replaced_with_types(spark, tmp_path):
    df = spark.createDataFrame([("7", "x")], "n string, s string")
    spark.sql(f"create database if not exists w location '{tmp_path}/w'")
    try:
        for _ in range(2):
            sinks.replace_table(df, "w.posts", {"n": "int", "s": "string"})
        assert rows(spark.table("w.posts")) == [(7, "x")]
        with pytest.raises(Exception, match="CAST"):
            sinks.replace_table(df, "w.posts2", {"s": "int"})
    finally:
        spark.sql("drop database w cascade")


def test_chunks_hold_whole_keys(spark):
    df = spark.createDataFrame([(f"i{k % 25}",) for k in range(60)] + [(None,)], "id string")
    got = sampling.chunk_numbers(df, "id", 10).collect()
    assert len(got) == 61 and {r["chunk"] for r in got if r["id"] is None} == {None}
    of = {}
    for r in got:
        if r["id"]:
            of.setdefault(r["chunk"], set()).add(r["id"])
    assert [len(of[k]) for k in sorted(of)] == [10, 10, 5] and sum(len(x) for x in of.values()) == 25
    assert sampling.chunk_numbers(df.limit(0), "id", 10).count() == 0


def test_text_helpers(spark):
    df = spark.createDataFrame([("k_0.5.json", bytearray("é🙂".encode())), ("k.json", None)], "name string, raw binary")
    assert rows(df.select(subset_size(F.col("name")), decoded(F.col("raw")))) == [(0.5, "é🙂"), (None, None)]


def test_labels_of_two_runs(spark):
    left = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", None)], "id string, label int")
    right = spark.createDataFrame([("a", 7), ("b", 7), ("c", 7)], "id string, label int")
    got = agreement.relabelled(left, agreement.best_overlap(agreement.contingency(left, right)))
    assert rows(got) == [("a", 1, 7), ("b", 1, 7), ("c", 2, 7), ("d", None, None)]
    cells = spark.createDataFrame([("x", 1, 1, 4), ("x", 2, 2, 4), ("y", 1, 1, 1), ("z", 1, 1, 2), ("z", 1, 2, 2)], "f string, l1 int, l2 int, n long")
    assert rows(agreement.rand_index_by(cells, "f")) == [("x", 1.0), ("y", 1.0), ("z", 0.0)]


def test_subtopics_and_questions(spark):
    words = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, -1, 1, "c"), (-1, 0, 1, "d")], "cluster int, subcluster int, rank int, term string")
    assert rows(naming.name_subtopics(words, naming.TopWordNamer())) == [(1, 0, ["a", "b"], "a b")]
    labelled = spark.createDataFrame([(f"i{k}", k % 3 - 1) for k in range(30)], "id string, cluster int")
    titles = spark.createDataFrame([(f"i{k}", "" if k < 9 else "t") for k in range(30)], "id string, title string")
    got = naming.quiz_questions(labelled, titles, 5, 3).collect()
    assert len(got) == 15 and len({(r["run"], r["id"]) for r in got}) == 15 and all(int(r["id"][1:]) >= 9 and r["cluster"] >= 0 for r in got)
    assert len({frozenset(r["id"] for r in got if r["run"] == k) for k in range(3)}) > 1
    with pytest.raises(ValueError, match="fewer than 20"):
        naming.quiz_questions(labelled, titles, 20, 2)


def test_models_are_kept(spark, tmp_path):
    calls = []

    def fit():
        calls.append(1)
        return {"axes": np.arange(6.0).reshape(2, 3), "mean": np.zeros(0)}

    for _ in range(2):
        got = reduce.fit_or_load(spark, str(tmp_path / "m"), fit)
        assert got["axes"].tolist() == [[0, 1, 2], [3, 4, 5]] and got["mean"].shape == (0,)
    assert len(calls) == 1
    reduce.fit_or_load(spark, None, fit)
    assert len(calls) == 2


def test_grid_equals_single_fits(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.2, (40, 5)) for c in (0, 3)] + [rng.uniform(-2, 5, (30, 5))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, vec array<double>")
    got = {(r["least"], r["samples"]): r["score"] for r in density.grid_scores(df, "id", "vec", [5, 10, 1000], [3, 5]).collect()}
    assert set(got) == {(5, 3), (5, 5), (10, 3), (10, 5)}
    least, samples, score = density.best_parameters(x, [5, 10, 1000], [3, 5])
    assert got[least, samples] == pytest.approx(score) == max(got.values())


def test_cv_coherence_equals_brute_force(spark):
    texts = ["aa bb cc dd aa ee bb", "cc aa bb", "dd dd ee aa bb cc aa dd", "", "ee"]
    words, window = {1: ["aa", "bb", "cc"], 2: ["dd", "ee", "zz"]}, 3
    spans = [set(t.split()[i : i + window]) for t in texts if t for i in range(max(1, len(t.split()) - window + 1))]
    n = len(spans)
    p = lambda *w: sum(all(x in s for x in w) for s in spans) / n

    def npmi(x, y):
        if x == y:
            return 1.0
        if not p(x) or not p(y):
            return 0.0
        both = p(x, y) + 1e-12
        return math.log(both / (p(x) * p(y))) / -math.log(both)

    want = {}
    for g, ws in words.items():
        v = np.array([[npmi(x, y) for y in ws] for x in ws])
        s = v.sum(0)
        want[g] = float(np.mean([a @ s / (np.linalg.norm(a) * np.linalg.norm(s)) for a in v]))
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    ranked = spark.createDataFrame([(g, w) for g, ws in words.items() for w in ws], "cluster int, term string")
    got = {r["cluster"]: r["coherence"] for r in tfidf.cv_coherence(ranked, df, "cluster", window).collect()}
    assert got == {g: pytest.approx(x, abs=1e-9) for g, x in want.items()}


def test_sampled_statistics(spark):
    lines = spark.createDataFrame([(f"RS_2012-0{1 + i % 3}.zst", json.dumps({"title": f"t{i}"})) for i in range(3000)], "file_name string, line string")
    got = archive.sampled_statistics(lines, "line", "file_name", 0.2, files=2)
    assert {r["month"] for r in got.select("month").distinct().collect()} == {1, 2} and 320 < got.count() < 480
    assert archive.sampled_statistics(lines, "line", "file_name", 1.0).count() == 3000


def test_split_join_equals_plain_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "FREQUENT", 4)
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 7}", i) for i in range(200)] + [(None, -1)], "k string, i int")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.length("k"))
    assert rows(skew.split_join(left, right, "k", "n", 200)) == rows(left.join(right, "k"))


def test_settings_and_overrides(tmp_path):
    c = runner.configured({"min_score": 3}, ["seed=7", "min_score=5", "link_base=x"])
    assert (c.seed, c.min_score, c.link_base) == ("7", 5, "x")
    for bad in (["none=1"], ["seed"]):
        with pytest.raises(ValueError):
            runner.configured(None, bad)
    out, took = runner.call_with(lambda min_score, other, quiz_size=1: (min_score, other, quiz_size), c, other="o")
    assert out == (5, "o", 100) and took >= 0
    for _ in range(2):
        runner.configure_logging("debug", str(tmp_path / "log"))
    assert len(runner.log.handlers) == 2
    runner.log.info("hello")
    assert "hello" in (tmp_path / "log").read_text()
    runner.configure_logging()


def test_assignments_use_given_costs():
    from marlstone.operators.drift import assign

    rng = np.random.default_rng(2)
    for _ in range(20):
        n, m = rng.integers(1, 4, 2)
        cost, drop, add = rng.random((n, m)) * 3, (rng.random(n) * 2).tolist(), (rng.random(m) * 2).tolist()
        to = assign(cost.tolist(), drop, add)
        value = sum(cost[i, j] if j >= 0 else drop[i] for i, j in enumerate(to)) + sum(add[j] for j in range(m) if j not in to)
        best = min(
            sum(cost[i, j] for i, j in zip(a, b)) + sum(drop[i] for i in range(n) if i not in a) + sum(add[j] for j in range(m) if j not in b)
            for k in range(min(n, m) + 1)
            for a in itertools.combinations(range(n), k)
            for b in itertools.permutations(range(m), k)
        )
        assert value == pytest.approx(best)
