import random

import numpy as np
import pytest

from marlstone.llm import language, similar

ROWS = "row_no long, ids string, embeddings array<float>, clusters int, grp long, vec string"


def vectors(seed=1, groups=6, size=40, noise=80, spread=0.55):
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    means = unit(rng.normal(size=(groups, 64)))
    x = [unit(means[k] + unit(rng.normal(size=64)) * spread) * rng.uniform(0.2, 5) for k in range(groups) for _ in range(size)]
    labels = [k for k in range(groups) for _ in range(size)]
    return np.array(x + list(rng.normal(size=(noise, 64)))), labels + [-1] * noise


def frame(spark, x, labels):
    rng = random.Random(2)
    rows = [(i, f"p{i}", [float(v) for v in e], None if rng.random() < 0.5 else (k + 10 if k >= 0 else -1), 7, "x") for i, (e, k) in enumerate(zip(x, labels))]
    bad = [(9001, "null", None, 1, 7, "x"), (9002, "zero", [0.0] * 64, 1, 7, "x"), (9003, "short", [1.0] * 5, 1, 7, "x"), (9004, "nan", [float("nan")] * 64, 1, 7, "x"), (9005, "p0", [1.0] * 64, None, 7, "x"), (9006, None, [1.0] * 64, 1, 7, "x"), (9007, "hole", [None] + [1.0] * 63, 1, 7, "x")]
    return spark.createDataFrame(rows + bad, ROWS)


def test_groups_are_found(spark):
    x, truth = vectors()
    members = similar.similarity_groups(frame(spark, x, truth)).cache()
    named = {r["grp"]: (r["cluster"], r["size"]) for r in similar.named_groups(members).collect()}
    assert sorted(named.values()) == [(k + 10, 40) for k in range(6)]
    got = {r["id"]: named[r["grp"]][0] for r in members.collect()}
    assert got == {f"p{i}": k + 10 for i, k in enumerate(truth) if k >= 0}
    typical = similar.typical_members(members, 3).collect()
    assert len(typical) == 6 and all(len(r["typical"]) == 3 for r in typical)


def test_least_groups_among_many_unstructured_vectors(spark):
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    truth = [k for k, s in enumerate(s for s in (8, 12, 18, 36, 90) for _ in range(5)) for _ in range(s)]
    means = unit(rng.normal(size=(25, 64)))
    x = np.array([unit(means[k] + unit(rng.normal(size=64)) * 0.55) for k in truth] + list(rng.normal(size=(18_000, 64))))
    members = similar.similarity_groups(frame(spark, x, truth + [-1] * 18_000)).toPandas()
    sizes = members.groupby("grp")["id"].nunique()
    assert len(sizes) == 25 and (sizes < 10).sum() == 5


def test_unusable_and_empty(spark):
    x, truth = vectors(noise=0)
    assert similar.similarity_groups(frame(spark, x[:0], [])).count() == 0
    usable = similar.usable_vectors(frame(spark, x, truth), "ids", "embeddings", "row_no", "clusters")
    assert usable.count() == len(x)


def test_adjacent_dense_cells_of_like_direction_are_joined(spark):
    from marlstone.operators.components import components

    one, two = [1.0] + [0.0] * 63, [0.0] * 63 + [1.0]
    held = [(0, 9, one), (1, 5, one), (3, 4, one), (2, 6, two), (12, 6, two), (8, 4, two), (15, 1, one)]
    rows = [(f"{c}-{i}", 0, c, v) for c, n, v in held for i in range(n)]
    codes = spark.createDataFrame([r[:3] for r in rows], "id string, grid int, cell long")
    unit = spark.createDataFrame([(r[0], r[3]) for r in rows], "id string, vec array<float>")
    dense = similar.dense_cells(codes, unit, 4)
    of = {r["grp"]: r["cell"] for r in dense.collect()}
    assert set(of.values()) == {0, 1, 2, 12, 8, 3} - {c for c, n, _ in held if n < 5}
    links = {tuple(sorted((of[r["a"]], of[r["b"]]))) for r in similar.cell_links(dense, codes, 4).collect()}
    assert links == {(0, 1)}  # 0 and 2 are adjacent, but point apart
    assert components(similar.cell_links(dense, codes, 4)).count() == 2


def test_cells_without_common_direction_are_not_dense(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    unit = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<float>")
    for bits, finer in ((10, 0), (13, 3)):
        assert similar.dense_cells(similar.cell_codes(unit, bits), unit, bits).count() <= 4
    assert len(similar.candidate_directions(unit, 4000)) <= 4


POSTS = "id string, title string, selftext string, label string, lang string"
TEXTS = {
    "en": ["the old lamp is still in the garage and nobody wants it", "we should fix the garden before the rain comes back again"],
    "de": ["die alte lampe steht noch im keller und keiner will sie haben", "wir sollten den garten vor dem regen wieder in ordnung bringen"],
    "fr": ["la vieille lampe est encore dans la cave et personne ne la veut", "nous devrions réparer le jardin avant que la pluie ne revienne"],
}


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        lang = list(TEXTS)[i % 3]
        ws = " ".join(TEXTS[lang]).split()
        rows.append((f"p{i}", None, ". ".join(" ".join(rnd.choice(ws) for _ in range(9)) for _ in range(4)) + ".", "x", "y"))
        wrong = rnd.random() < 0.12
        labels.append((f"p{i}", rnd.choice(["en", "de", "fr"]) if wrong else {"en": "English", "de": "ger", "fr": "fr-CA"}[lang], None))
    posts = spark.createDataFrame(rows, POSTS)
    return language.fit_languages(posts, language.latest_labels(spark.createDataFrame(labels, "id string, lang string, labelled_at timestamp")))


def test_mixed_texts_get_segments(model):
    text = "The old lamp is still in the garage! Die alte Lampe steht noch im Keller.\nKeiner will sie haben, oder? Hasta luego.\n"
    got = model.segments(text)
    assert [(text[a:b], lang) for a, b, lang, _, _ in got] == [("The old lamp is still in the garage!", "en"), ("Die alte Lampe steht noch im Keller.\nKeiner will sie haben, oder? Hasta luego.", "de")]
    assert all(0.85 <= sure <= 1 for *_, sure, _ in got)


def test_unseen_words_back_off(model):
    assert model.segments("wieder gartenlampen kellergarten regenlampe ordnungen")[0][2] == "de"
    assert model.segments(None) == [] and model.segments("  \n 12 !!") == []
    assert model.segments("keller")[0][4] == 0
    long = model.segments("the old lamp is still in the garage. " * 5000)
    assert len(long) == 1 and long[0][2] == "en"


def test_found_languages(spark, model):
    en, de = "The old lamp is still in the garage.", "Die alte Lampe steht noch im Keller."
    posts = spark.createDataFrame([("a", en, de, "", ""), ("b", en, None, "", ""), ("c", "", "", "", ""), ("d", en, "Guten Tag, Keller!", "", ""), ("e", de, en, "", "")], POSTS)
    labels = spark.createDataFrame([("a", "EN"), ("d", "en_US"), ("e", "??")], "id string, lang string").selectExpr("id", "lang", "timestamp'2020-01-01' labelled_at")
    got = language.unlabelled_languages(language.language_segments(posts, model), language.latest_labels(labels))
    assert {tuple(r) for r in got.collect()} == {("a", "de"), ("b", "en"), ("e", "de"), ("e", "en")}
    assert language.post_languages(language.language_segments(posts, model)).count() == 4
    assert language.language_segments(posts.limit(0), model).count() == 0


def test_latest_label_holds(spark):
    rows = spark.sql("select * from values ('a','German',timestamp'2020-01-01'),('a','und',timestamp'2021-01-01'),('b','pt-BR',null),('b',' ENG ',timestamp'2020-01-01'),('c','xx',null),(null,'en',null),('d',null,null) t(id, lang, labelled_at)")
    assert {r["id"]: r["label"] for r in language.latest_labels(rows).collect()} == {"a": None, "b": "en", "c": "xx", "d": None}


def test_nothing_to_fit_on(spark):
    empty = spark.createDataFrame([], POSTS)
    m = language.fit_languages(empty, spark.createDataFrame([], "id string, label string"))
    assert all(sure <= 0.2 for *_, sure, _ in m.segments("some words here that mean nothing"))
