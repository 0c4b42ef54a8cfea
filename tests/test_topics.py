import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import agreement, density, hierarchy, naming, neighbours, reduce, reports, tfidf


def test_tfidf_formula(spark):
    texts = spark.createDataFrame([(1, "zebra zebra lamp"), (2, "lamp chair"), (-1, "lamp the and")], "cluster int, text string")
    got = {(r["cluster"], r["term"]): r["score"] for r in tfidf.tfidf(tfidf.group_terms(texts, ["cluster"]), ["cluster"]).collect()}
    idf = lambda df: math.log(4 / (1 + df)) + 1
    v = np.array([2 * idf(1), idf(3)])
    assert got[1, "zebra"] == pytest.approx(v[0] / np.linalg.norm(v)) and got[-1, "lamp"] == pytest.approx(1)
    assert ("the" not in {t for _, t in got})


def test_adjacency_and_ties(spark):
    scores = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (2, "a", 1.0), (3, "z", 1.0)], "cluster int, term string, score double")
    assert [tuple(r) for r in tfidf.adjacency(scores, "cluster").collect()] == [(1, 2, 0.5)]
    assert [r["term"] for r in tfidf.top_terms(scores, ["cluster"], 1).orderBy("cluster").collect()] == ["a", "a", "z"]


def labels(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, label int")


@pytest.mark.parametrize("a, b, want", [([0, 0, 1, 1], [5, 5, 3, 3], 1.0), ([0, 0, 0, 0], [1, 1, 1, 1], 1.0)])
def test_rand_index(spark, a, b, want):
    assert agreement.rand_index(agreement.contingency(labels(spark, a), labels(spark, b))).first()["ari"] == pytest.approx(want)


def test_rand_index_against_pairs(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, 60), rng.integers(0, 3, 60)
    same = [(a[i] == a[j], b[i] == b[j]) for i in range(60) for j in range(i)]
    n, s = len(same), sum(x and y for x, y in same)
    ea, eb = sum(x for x, _ in same), sum(y for _, y in same)
    want = (s - ea * eb / n) / ((ea + eb) / 2 - ea * eb / n)
    got = agreement.rand_index(agreement.contingency(labels(spark, a.tolist()), labels(spark, b.tolist()))).first()["ari"]
    assert got == pytest.approx(want)


def test_relabelling_is_unique(spark):
    raw = spark.createDataFrame([(0, 0), (0, 1), (0, -1), (2, -1), (5, 0), (5, 2)], "cluster int, sub int")
    got = {(r["cluster"], r["sub"]): r["label"] for r in agreement.relabel_subclusters(raw).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (0, -1): -1, (2, -1): -1, (5, 0): 2, (5, 2): 4}


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 5)) * 12
    x = np.concatenate([rng.normal(size=(60, 5)) * 0.4 + c for c in centres] + [rng.uniform(-30, 30, (25, 5))])
    return x, np.repeat([0, 1, 2, 3, -1], [60, 60, 60, 60, 25])


def test_density_clustering_finds_blobs(spark, blobs):
    x, truth = blobs
    f = density.fit(x, 10, 5)
    assert len(set(f.labels[f.labels >= 0])) == 4
    assert all(len(set(f.labels[truth == k])) <= 2 for k in range(4)) and (f.labels[truth == -1] == -1).mean() >= 0.7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    got = density.cluster(df, "id", "v", 10, 5, fraction=0.6).toPandas().set_index("id")["label"]
    assert len(got) == len(x) and got[got >= 0].nunique() == 4
    assert density.cluster(df.limit(0), "id", "v").count() == 0


def test_dbcv_forms_agree(spark, blobs):
    x, _ = blobs
    f = density.fit(x, 10, 5)
    edges = spark.createDataFrame([(int(a), int(b), float(d)) for a, b, d in f.edges], "a long, b long, distance double")
    got = agreement.dbcv(edges, labels(spark, f.labels.tolist())).first()["score"]
    assert got == pytest.approx(density.dbcv_score(f.edges, f.labels)) and got > 0.3
    assert density.best_parameters(x[:120], [1, 10, 500], [5])[0] == 10


def test_subclusters(spark, blobs):
    x, truth = blobs
    df = spark.createDataFrame([(i, int(t > 1) if t >= 0 else -1, v.tolist()) for i, (v, t) in enumerate(zip(x, truth))], "id long, cluster int, v array<double>")
    got = density.subclusters(df, "id", "cluster", "v", 10, 5).toPandas()
    assert set(got["cluster"]) == {0, 1} and got[got["sub"] >= 0].groupby("cluster")["sub"].nunique().tolist() == [2, 2]


def test_tree_of_boxes_is_minimal(blobs):
    x = np.concatenate([blobs[0], blobs[0][:90], np.round(blobs[0])])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    core = np.sort(d, axis=1)[:, 5]
    assert np.allclose(density.fit(x, 10, 5).core, core)
    d = np.maximum(np.maximum(d, core[:, None]), core)
    best, inside, want = d[0].copy(), {0}, []
    while len(inside) < len(x):
        at = min(set(range(len(x))) - inside, key=lambda i: best[i])
        want.append(best[at])
        inside.add(at)
        best = np.minimum(best, d[at])
    edges = density.spanning_tree(x, core)
    assert len(edges) == len(x) - 1 and np.allclose(sorted(edges[:, 2]), sorted(want))


def test_fits_leave_no_row_out(spark):
    rng = np.random.default_rng(3)
    spots = [np.array([20.0 * i, 20.0 * (k // 20), 0, 0, 0]) for k in range(500) for i in [k % 20]]
    x = np.concatenate([rng.normal(size=(12, 5)) * 0.3 + s for s in spots])
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, cluster int, v array<double>")
    got = density.cluster(df, "id", "v", 10, 5).toPandas()
    assert len(got) == len(x) and got["label"].nunique() == 500 and (got["label"] >= 0).all()
    assert density.subclusters(df, "id", "cluster", "v", 10, 5).toPandas()["sub"].nunique() == 500


def test_neighbours_are_exact(spark, blobs):
    x = blobs[0][:50]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {(r["id"], r["rank"]): r["other"] for r in neighbours.nearest(df, df, 3, block=20).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert all(got[i, k + 1] == np.argsort(d[i])[k] for i in range(50) for k in range(3))


def test_trustworthiness_against_brute_force(spark, blobs):
    x = blobs[0][:80]
    y, n, k = x[:, :2], 80, 6
    full, flat = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, vec array<double>") for z in (x, y))
    got = neighbours.trustworthiness(neighbours.ranks_of(full, neighbours.nearest(flat, flat, k), block=30), n, k).first()["trust"]
    dx, dy = (np.linalg.norm(z[:, None] - z[None], axis=2) + np.diag(np.full(n, np.inf)) for z in (x, y))
    rank = dx.argsort(1).argsort(1) + 1
    excess = sum(max(0, rank[i, j] - k) for i in range(n) for j in dy[i].argsort()[:k])
    assert got == pytest.approx(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * excess)


def test_reductions(spark, blobs):
    x, truth = blobs
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    p = np.array([r["reduced"] for r in reduce.principal_components(df, "id", "v", 2).orderBy("id").collect()])
    want = (x - x.mean(0)) @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(p), np.abs(want), atol=1e-6)
    y = np.array([r["reduced"] for r in reduce.reduce_by_layout(df, "id", "v", 2, fraction=1.0).orderBy("id").collect()])
    own = [np.linalg.norm(y[truth == k] - y[truth == k].mean(0), axis=1).mean() for k in range(4)]
    apart = min(np.linalg.norm(y[truth == a].mean(0) - y[truth == b].mean(0)) for a in range(4) for b in range(a))
    assert max(own) < apart
    assert reduce.principal_components(df.limit(0), "id", "v").count() == 0


def test_linkage_and_cuts():
    x = np.array([0.0, 0.1, 5.0, 5.2, 20.0])
    d = np.abs(x[:, None] - x[None])
    z = hierarchy.linkage(d)
    assert z[:, 3].tolist() == [2, 2, 4, 5] and (np.diff(z[:, 2]) >= 0).all()
    assert hierarchy.flat_cut(z, 5, 3).tolist() == [1, 1, 2, 2, 3]
    assert hierarchy.linkage(d, "single")[-1, 2] == pytest.approx(14.8) and hierarchy.linkage(d, "complete")[-1, 2] == pytest.approx(20)


def test_quiz_and_names(spark):
    words = spark.createDataFrame([(1, 1, "bread"), (1, 2, "oven"), (-1, 1, "x")], "cluster int, rank int, term string")
    named = naming.name_topics(words, naming.TopWordNamer()).collect()
    assert [(r["cluster"], r["topic"]) for r in named] == [(1, "bread oven")]
    q = spark.createDataFrame([("p", 1)], "id string, cluster int")
    near = spark.createDataFrame([(1, 2), (1, 3)], "cluster int, other int")
    names = spark.createDataFrame([(1, "bread oven"), (2, "bike lane"), (3, "moon lens")], "cluster int, topic string")
    quiz = naming.quiz_options(q, near, names)
    texts = spark.createDataFrame([("p", "my bread burnt in the oven")], "id string, text string")
    assert naming.accuracy(naming.solve_quiz(quiz, texts, naming.OverlapSolver())).first()["accuracy"] == 1.0
    assert naming.accuracy(naming.solve_quiz(quiz.limit(0), texts, naming.OverlapSolver())).first()["accuracy"] is None
    bad = spark.createDataFrame([("a", "A", None), ("b", "B", "B")], "id string, answer string, given string")
    assert naming.accuracy(bad).first()["accuracy"] == 0.5


def test_npmi_and_diversity(spark):
    words = spark.createDataFrame([(1, "aa"), (1, "bb"), (2, "aa"), (2, "cc")], "cluster int, term string")
    texts = spark.createDataFrame([("1", "aa bb"), ("2", "cc"), ("3", "aa bb x"), ("4", None)], "id string, text string")
    got = {r["cluster"]: r["coherence"] for r in tfidf.npmi(words, texts, "cluster").collect()}
    assert got[2] == -1 and got[1] == pytest.approx(1.0)
    assert tfidf.word_diversity(words).first()["diversity"] == pytest.approx(3 / 25) and tfidf.distinct_ratio(words).first()["diversity"] == 0.75
    assert words.filter(F.lit(False)).transform(tfidf.distinct_ratio).first()["diversity"] is None


def test_months_without_rows_are_there(spark):
    rows = spark.sql("select * from values (timestamp'2020-11-05', 4.0D), (timestamp'2020-11-30', 8.0D), (timestamp'2021-02-01', 3.0D), (null, 9.0D) t(at, v)")
    got = reports.monthly_mean(rows, F.col("at"), "v").collect()
    assert {r["month"]: r["mean"] for r in got} == {"2020-11": 6.0, "2020-12": None, "2021-01": None, "2021-02": 3.0}


def test_fit_measures_few_distances(monkeypatch):
    x = np.random.default_rng(6).uniform(size=(20_000, 5))
    seen = []
    for name in ("_distances", "_lengths"):
        if f := getattr(density, name, None):
            monkeypatch.setattr(density, name, lambda a, b, f=f: seen.append((d := f(a, b)).size) or d)
    density.fit(x, 10, 5)
    assert sum(seen) < 1_500 * len(x)


def test_ties_leave_labels_and_score_alone():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(-3, 4, (150, 2)) + 30 * k for k in range(3)] + [rng.integers(-40, 100, (60, 2))]).astype(float)
    want = density.fit(x, 10, 5)
    assert len(set(want.labels)) >= 4
    for seed in range(5):
        order = np.random.default_rng(seed).permutation(len(x))
        got = density.fit(x[order], 10, 5)
        assert set(zip(got.labels, want.labels[order])) == {(a, b) for a, b in zip(got.labels, want.labels[order])} and len(set(zip(got.labels, want.labels[order]))) == len(set(want.labels))


def test_copies_and_strays_are_searched_in_full():
    rng = np.random.default_rng(9)
    x = np.concatenate([np.repeat(rng.normal(size=(40, 5)), 50, axis=0), rng.normal(size=(300, 5)) * 1e-4 + 1e4, [[1e8] * 5, [-1e8, 0, 0, 0, 0]]])
    d = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), axis=1)
    boxes = density.Boxes(x)
    far, near = density._lists(boxes, 60)
    assert np.allclose(far, d[boxes.order, :60], rtol=1e-12, atol=0)
    assert np.allclose(far, np.linalg.norm(boxes.points[:, None] - boxes.points[near], axis=2), rtol=1e-12, atol=0)


def test_each_setting_gets_all_exact_neighbours(spark, blobs):
    x = np.concatenate([blobs[0], np.round(blobs[0])])
    boxes = density.Boxes(x)
    got = density._fitted(spark.sparkContext.broadcast(boxes), 16, 3, spark.range(1)).toPandas()
    d = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), axis=1)[boxes.order, :16]
    for task in range(3):
        own = got[got["task"] == task].sort_values("at")
        assert own["at"].tolist() == list(range(len(x))) and np.allclose([np.frombuffer(v) for v in own["far"]], d)


def test_clusters_of_all_rows_are_not_fitted_on_the_driver(spark, blobs, monkeypatch):
    x, _ = blobs
    want = density.fit(x, 10, 5).labels
    monkeypatch.setattr(density, "fit", lambda *_: pytest.fail("fitted on the driver"))
    for name, kind in ((int, "long"), ("{:04}".format, "string")):
        df = spark.createDataFrame([(name(i), v.tolist()) for i, v in enumerate(x)][::-1] + [(name(999), None)], f"id {kind}, v array<float>" if kind == "string" else "id long, v array<double>")
        got = density.cluster(df, "id", "v", 10, 5).orderBy("id").toPandas()
        assert got["id"].tolist() == [name(i) for i in range(len(x))] and got["label"].tolist() == want.tolist()
    assert density.cluster(df.limit(1), "id", "v").count() <= 1


def test_trees_of_copies_are_exact_and_search_many_boxes_at_once(monkeypatch):
    rng = np.random.default_rng(10)
    for spots, shift in ((40, 1e-3), (40, 0.0), (300, 1e-3)):
        x = np.concatenate([np.repeat(rng.normal(size=(spots, 5)), 67, axis=0), rng.normal(size=(300, 5)) * 3])
        x += rng.normal(size=x.shape) * shift
        boxes = density.Boxes(x)
        far, near = density._lists(boxes, 16)
        core, seen, gaps = far[:, 5], [], density._gaps
        with monkeypatch.context() as m:
            m.setattr(density, "_gaps", lambda *a, gaps=gaps, seen=seen: seen.append(1) or gaps(*a))
            edges = density._tree(boxes, core, far, near)
        assert len(seen) < 1_000
        if spots == 40:
            p, best, here, want = boxes.points, np.full(len(x), np.inf), 0, []
            out = np.ones(len(x), bool)
            for _ in range(len(x) - 1):
                out[here] = False
                best = np.minimum(best, np.maximum(np.maximum(np.linalg.norm(p - p[here], axis=1), core), core[here]))
                here = int(np.where(out, best, np.inf).argmin())
                want.append(best[here])
            assert np.allclose(edges[:, 2], np.sort(want), rtol=1e-12)
