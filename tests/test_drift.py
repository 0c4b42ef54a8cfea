import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import drift
from marlstone.session import cut

LINES = "mirror string, file_name string, line_no long, line string, a string, profile string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], LINES)


def posts(n, make):
    return [json.dumps(make(i)) for i in range(n)]


def report(spark, files):
    rows = [("m", name, i, line) for name, lines in files.items() for i, line in enumerate(lines)]
    changes = cut(drift.schema_changes(drift.file_profiles(frame(spark, rows))))
    return {tuple(r)[2:] for r in drift.change_report(changes).collect()}, changes


def base(i):
    return {"id": f"r{i}", "title": f"How do I fix the {'red old big'.split()[i % 3]} lamp number {i}?", "score": i * 7 % 90, "author": f"{'odd shy'.split()[i % 2]}_heron", "created_utc": 1448085247 + i * 977}


def test_rename_add_remove_and_type(spark):
    second = posts(30, lambda i: {**{k: v for k, v in base(i + 50).items() if k not in ("title", "score")}, "headline": base(i + 31)["title"], "score": str(base(i)["score"]), "awards": [i % 3]})
    third = posts(30, lambda i: {k: v for k, v in {**base(i + 9), "headline": base(i)["title"]}.items() if k not in ("title", "author")})
    got, _ = report(spark, {"RS_1": posts(30, base), "RS_2": second, "RS_3": third})
    assert got == {("renamed", "title", "headline"), ("type", "score", "score"), ("added", "", "awards"), ("removed", "awards", ""), ("removed", "author", "")}


def test_wrapped_number_is_a_rename_with_type(spark):
    one = posts(40, lambda i: {"id": f"r{i}", "num_comments": i * 13 % 250})
    two = posts(40, lambda i: {"id": f"r{i + 40}", "n_comments": {"count": i * 11 % 250, "hidden": i % 2 == 0}})
    got, _ = report(spark, {"RS_1": one, "RS_2": two})
    assert got == {("renamed", "num_comments", "n_comments"), ("type", "num_comments", "n_comments")}


def test_bad_lines_do_not_count(spark):
    good = posts(6, base)
    dirty = good + [None, "", "{", "[1, 2]", "no json", '{"id": NaN}', "7"]
    rows = [("m", "RS_1", i, x) for i, x in enumerate(dirty)] + [("m", "RS_2", i, x) for i, x in enumerate(good)] + [(None, "RS_2", 1, good[0]), ("m", None, 1, good[0])]
    changes = drift.schema_changes(drift.file_profiles(frame(spark, rows)))
    assert changes.count() == 0
    table = drift.unified_table(frame(spark, rows), changes, {"id": "string", "score": "bigint"})
    assert table.filter("mirror = 'm' and file_name = 'RS_1'").count() == 6


def test_half_of_the_lines_make_a_field(spark):
    half = [json.dumps({"id": str(i), **({"x": 1} if i < 5 else {})}) for i in range(10)]
    less = [json.dumps({"id": str(i), **({"x": 1} if i < 4 else {})}) for i in range(10)]
    got, _ = report(spark, {"RS_1": half, "RS_2": less})
    assert got == {("removed", "x", "")}


def test_fields_side_by_side_are_no_renames(spark):
    one = posts(30, lambda i: {"id": f"r{i}", "over_18": i % 5 == 0})
    two = posts(30, lambda i: {"id": f"r{i}", "spoiler": i % 5 == 1})
    both = posts(30, lambda i: {"id": f"r{i}", "spoiler": i % 5 == 1, "over_18": i % 4 == 0})
    got, _ = report(spark, {"RS_1": one, "RS_2": two, "RS_3": both})
    assert ("renamed", "over_18", "spoiler") not in got and ("removed", "over_18", "") in got


def test_empty_input(spark):
    empty = frame(spark, [])
    changes = drift.schema_changes(drift.file_profiles(empty))
    assert drift.change_report(changes).count() == 0
    assert drift.unified_table(empty, changes, {"id": "string"}).count() == 0


def test_unified_table_follows_renames(spark):
    files = {"RS_1": posts(20, base), "RS_2": posts(20, lambda i: {("user" if k == "author" else k): v for k, v in base(i + 3).items()})}
    got, changes = report(spark, files)
    assert ("renamed", "author", "user") in got
    rows = [("m", n, i, x) for n, ls in files.items() for i, x in enumerate(ls)]
    table = drift.unified_table(frame(spark, rows), changes, {"author": "string", "score": "bigint"})
    assert table.filter(F.col("author").isNull()).count() == 0 and table.count() == 40


def test_stray_keys_hide_no_field(spark):
    second = [{("user" if k == "author" else k): v for k, v in base(i + 3).items()} | ({"author": [None, "x", 1, True][i // 5]} if i % 5 == 0 else {}) for i in range(20)]
    files = {"RS_1": posts(20, base), "RS_2": [json.dumps(x) for x in second]}
    got, changes = report(spark, files)
    assert ("renamed", "author", "user") in got
    rows = [("m", n, i, x) for n, ls in files.items() for i, x in enumerate(ls)]
    table = drift.unified_table(frame(spark, rows), changes, {"author": "string"}).filter("file_name = 'RS_2'")
    assert {r["line_no"]: r["author"] for r in table.collect()} == {i: x["user"] for i, x in enumerate(second)}


def unified(spark, files, fields):
    rows = [(m, n, i, json.dumps(x)) for (m, n), lines in files.items() for i, x in enumerate(lines)]
    lines = frame(spark, rows)
    profiles = cut(drift.file_profiles(lines))
    changes = cut(drift.schema_changes(profiles))
    got = drift.unified_table(lines, changes, fields, profiles)
    return {(r["mirror"], r["file_name"], r["line_no"]): r.asDict() for r in got.collect()}


def test_a_name_with_two_meanings_is_two_columns(spark):
    renamed = lambda i: {("karma" if k == "score" else k): v for k, v in base(i).items()}
    files = {("a", "RS_1"): [base(i) for i in range(30)], ("a", "RS_2"): [renamed(i) for i in range(30)], ("b", "RS_1"): [{"id": f"b{i}", "karma": {"given": f"text {i} of many words"}} for i in range(30)]}
    got = unified(spark, files, {"score": "bigint"})
    assert got["a", "RS_2", 5]["score"] == base(5)["score"]
    other = json.loads(got["b", "RS_1", 5]["more"])
    assert got["b", "RS_1", 5]["score"] is None and [v for k, v in other.items() if k.startswith("karma")] == [{"given": "text 5 of many words"}]


def test_stray_key_of_another_mirror_is_not_read(spark):
    renamed = lambda i: {("karma" if k == "score" else k): v for k, v in base(i).items()}
    plain = [{"id": f"b{i}", "title": base(i)["title"]} | ({"karma": 99999} if i == 3 else {}) for i in range(20)]
    got = unified(spark, {("a", "RS_1"): [base(i) for i in range(20)], ("a", "RS_2"): [renamed(i) for i in range(20)], ("b", "RS_1"): plain}, {"score": "bigint", "title": "string"})
    assert got["b", "RS_1", 3]["score"] is None and got["b", "RS_1", 3]["more"] == '{"id": "b3"}'
    assert got["a", "RS_2", 7]["score"] == base(7)["score"]


def test_added_and_moved_fields_stay_in_the_table(spark):
    first = [base(i) | {"stats": {"n_views": i}} for i in range(30)]
    second = [{k: v for k, v in base(i).items() if k != "score"} | {"stats": {"n_views": i, "score": base(i)["score"]}, "flair": f"f{i % 3}"} for i in range(30)]
    got = unified(spark, {("a", "RS_1"): first, ("a", "RS_2"): second}, {"score": "bigint", "id": "string"})
    assert got["a", "RS_2", 4]["score"] == base(4)["score"]
    assert json.loads(got["a", "RS_2", 4]["more"])["flair"] == "f1"
    rows = [("a", n, i, json.dumps(x)) for n, ls in (("RS_1", first), ("RS_2", second)) for i, x in enumerate(ls)]
    changes = drift.schema_changes(drift.file_profiles(frame(spark, rows)))
    assert {r["kind"] for r in changes.collect()} == {"moved_in", "added"}
    assert {tuple(r)[2:] for r in drift.change_report(changes).collect()} == {("removed", "score", ""), ("added", "", "flair")}


def test_lines_without_a_file_keep_their_fields(spark):
    lines = frame(spark, [(None, "RS_1", 1, '{"id": "x", "n": 3}'), ("m", None, 2, '{"id": "y"}')])
    got = drift.unified_table(lines, drift.schema_changes(drift.file_profiles(lines)), {"id": "string"})
    assert {(r["id"], r["more"]) for r in got.collect()} == {("x", '{"n": 3}'), ("y", None)}


def test_moves_cost_less_than_rebuilding():
    old = {"a": tree("a", {"x": {"p": 1, "q": "some words in here"}, "y": {"k": True}}), "b": tree("b", 5)}
    new = {"a": tree("a", {"x": {"p": 1}, "y": {"k": True, "q": "some words in here"}}), "b": tree("b", 5)}
    assert [s[:3] for s in drift.edit_script(old, new, set())] == [("nested_moved", "/a/x/q", "/a/y/q")]


def test_profiles_count_every_element_and_keys_with_separators():
    from collections import Counter

    c = Counter()
    drift._visit({"a/b~": [1] * 100 + ["x" * 10_000 + " a b c"]}, c)
    assert c["/a~1b~0/~a", "t:integer"] == 100 and c["/a~1b~0/~a", "t:string"] == 1
    assert drift._key(drift._step("a/b~1")[1:]) == "a/b~1"
    deep: list = []
    for _ in range(5000):
        deep = [deep]
    drift._visit(deep, c)


def test_components_of_chains(spark):
    from marlstone.operators.components import components

    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", None)], "a string, b string")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert {got[f"n{i:03}"] for i in range(41)} == {"n000"} and got["y"] == "x" and "z" not in got


@pytest.mark.parametrize("value, kind", [(True, "boolean"), (3, "integer"), (3.0, "decimal"), ("3", "string"), ([], "array"), ({}, "object")])
def test_json_types(value, kind):
    assert drift.json_type(value) == kind


def test_exponents_are_decimals_and_long_numbers_parse():
    assert drift.json_type(drift.parse_object('{"a": 1e3}')["a"]) == "decimal"
    assert drift.parse_object('{"a": ' + "9" * 5000 + "}") is not None
    assert drift.parse_object('{"a": ' + "[" * 100_000) is None


def tree(name, value, n=10):
    from collections import Counter

    c = Counter()
    for _ in range(n):
        drift._visit(value, c)
    return drift.build_tree(name, [{"path": p, "feature": f, "n": k} for (p, f), k in c.items()])


def test_tree_distance_counts_edits():
    a, b = tree("a", {"x": 1, "y": {"z": "abc"}}), tree("b", {"x": 1, "y": {"z": "abc"}})
    assert drift.tree_distance(a, b) == 0
    assert drift.tree_distance(tree("a", {"x": 1}), tree("b", {"x": 1, "w": True})) == pytest.approx(1)


def test_assignment_is_minimal():
    import itertools
    import random

    rnd = random.Random(3)
    for _ in range(30):
        n, m = rnd.randint(1, 4), rnd.randint(1, 4)
        cost = [[round(rnd.random() * 1.6, 3) for _ in range(m)] for _ in range(n)]
        got = drift.assign(cost)
        value = sum(cost[i][j] if j >= 0 else 0.5 for i, j in enumerate(got)) + 0.5 * (m - sum(j >= 0 for j in got))
        best = min(
            sum(cost[i][j] for i, j in zip(rows, cols)) + 0.5 * (n - k) + 0.5 * (m - k)
            for k in range(min(n, m) + 1)
            for rows in itertools.combinations(range(n), k)
            for cols in itertools.permutations(range(m), k)
        )
        assert value == pytest.approx(best)
