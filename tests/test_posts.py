import json

from pyspark.sql import functions as F

from marlstone.config import DEFAULT as C
from marlstone.functions import sampling
from marlstone.operators import posts, reports
from marlstone.sources import archive, sinks, tables

POST = "author string, id string, title string, selftext string, score int, num_comments int, subreddit string, created_utc long, media boolean"


def post(i, **kw):
    row = {"author": "a", "id": i, "title": "t" * 41, "selftext": "x", "score": 11, "num_comments": 1, "subreddit": "s", "created_utc": C.start + 1, "media": False} | kw
    return tuple(row.values())


def test_bounds_are_open_and_nulls_drop(spark):
    rows = [post("ok"), post("len", title="t" * 40), post("score", score=10), post("start", created_utc=C.start), post("end", created_utc=C.end), post("null", selftext=None), post("media", media=None), post("pic", media=True), post("del", selftext="a [deleted] b"), post("rem", selftext="[removed]"), post("case", selftext="[Removed]")]
    got = {r["id"] for r in posts.filter_posts(spark.createDataFrame(rows, POST)).collect()}
    assert got == {"ok", "case"}


def test_exports_keep_or_drop_noise(spark):
    p = spark.createDataFrame([post("a"), post("b"), post("a")], POST)
    labels = spark.createDataFrame([("a", -1, -1), ("b", 2, 0)], "id string, cluster int, subcluster int")
    out = posts.exports(p, labels)
    assert [r["id"] for r in out["main"].collect()] == ["b"]
    assert {r["id"] for r in out["url"].collect()} == {"a", "b"} and out["text"].count() == 2


def test_exact_sample_is_exact_and_stable(spark):
    df = spark.range(1000).repartition(7)
    a = {r["id"] for r in sampling.exact_sample(df, "id", 0.1, "s").collect()}
    b = {r["id"] for r in sampling.exact_sample(df.coalesce(1), "id", 0.1, "s").collect()}
    assert len(a) == 100 and a == b
    assert sampling.exact_sample(df, "id", 1.0, "s").count() == 1000 and sampling.exact_sample(df.limit(0), "id", 0.5, "s").count() == 0


LINES = [
    ('{"author":"a","subreddit":"s","score":7,"created_utc":1,"title":"t","id":"1","num_comments":1,"selftext":"","media":null}', True),
    ('{"author":null,"subreddit":"s","score":"7.0","created_utc":" 7 ","title":"t","id":"1","num_comments":null,"selftext":null,"media":{"a":1},"extra":1}', True),
    ('{"author":"a","subreddit":"s","score":true,"created_utc":1e3,"title":"t","id":"1","num_comments":1,"selftext":"","media":0}', True),
    ('{"author":"a","subreddit":"s","score":5.5,"created_utc":1,"title":"t","id":"1","num_comments":1,"selftext":"","media":null}', False),
    ('{"author":"a","subreddit":"s","score":"x","created_utc":1,"title":"t","id":"1","num_comments":1,"selftext":"","media":null}', False),
    ('{"author":"a","subreddit":"s","score":7,"created_utc":1,"title":3,"id":"1","num_comments":1,"selftext":"","media":null}', False),
    ('{"author":"a","subreddit":null,"score":7,"created_utc":1,"title":"t","id":"1","num_comments":1,"selftext":"","media":null}', False),
    ('{"subreddit":"s","score":7,"created_utc":1,"title":"t","id":"1","num_comments":1,"selftext":"","media":null}', False),
    ('{"author":"a","subreddit":"s","score":7,"created_utc":1,"title":"t","id":"1","num_comments":1,"selftext":""}', False),
    ("[1]", False),
    ("", False),
    ("{", False),
    (None, False),
]


def test_validation_rules(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LINES)], "n int, value string")
    got = {r["n"]: r["valid"] for r in archive.validated(df).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(LINES)}
    first = archive.ingest(df).orderBy("score").collect()
    assert [r["score"] for r in first] == [1, 7, 7] and sorted(r["media"] for r in first) == [False, True, True]
    assert archive.bad_share(df).first()["bad"] == 10


def test_zst_lines_are_read_whole(spark, tmp_path):
    import zstandard

    text = "\n".join(x for x, _ in LINES if x) + '\n{"last": 1}'
    (tmp_path / "RS_2012-03.zst").write_bytes(zstandard.ZstdCompressor().compress(text.encode()))
    lines = archive.read_lines(spark, str(tmp_path / "RS_*.zst"))
    assert lines.count() == len([x for x, _ in LINES if x]) + 1
    stats = archive.statistics(lines, "value", "file_name")
    assert {(r["year"], r["month"]) for r in stats.collect()} == {(2012, 3)}


def test_stats_tell_missing_from_null(spark):
    df = spark.createDataFrame([('{"title":"ab","selftext":"cde","score":null}', "RS_2010-01.zst"), ('{"title":"ab","selftext":"cde","media":{}}', "x")], "value string, file_name string")
    rows = sorted(archive.statistics(df, "value", "file_name").collect(), key=lambda r: r["length"])
    assert [(r["length"], r["score"], r["num_comments"], r["has_media"], r["year"]) for r in rows] == [(2, -1, -1, True, None), (5, None, -1, False, 2010)]


def test_job_logs(spark, tmp_path):
    (tmp_path / "a.out").write_text("one\na b c d e f g h /x/y/RS_1.zst\n")
    (tmp_path / "b.out").write_text("one\na b c d e f g h /x/y/RS_2.zst\nFinished converting")
    assert [r["file"] for r in archive.unfinished_jobs(spark, str(tmp_path / "*.out")).collect()] == ["RS_1.zst"]


def test_only_files_of_the_right_type_are_read(spark, tmp_path):
    spark.createDataFrame([(True,)], "media boolean").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("x",)], "media string").write.parquet(str(tmp_path / "b"))
    files = [str(p) for p in tmp_path.rglob("*.parquet")] + [str(tmp_path / "none.parquet")]
    assert tables.read_consistent(spark, files).count() == 1
    assert len(tables.sample_paths(files, 2)) == 2


def test_writers(spark, tmp_path):
    assert sinks.write_posts(spark.range(10).coalesce(1), str(tmp_path / "p"), 4) == {"rows": 10}
    assert len(list((tmp_path / "p").glob("*.parquet"))) == 3
    words = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "cluster int, rank int, term string")
    assert json.loads(sinks.words_json(words).first()["value"]) == {"1": ["a", "b"]}
    for _ in range(2):
        sinks.append_log(spark.range(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_bins_runs_and_gaps(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (25.0,), (None,)], "x double")
    bins = {r["bin"]: r["n"] for r in reports.equal_width_bins(df, "x").collect()}
    assert len(bins) == 25 and bins[1] == 2 and bins[25] == 1
    assert reports.equal_width_bins(df.limit(0), "x").count() == 0
    flat = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert sum(r["n"] for r in reports.equal_width_bins(flat, "x").collect()) == 4
    v = spark.createDataFrame([(i,) for i in [*range(-5, 40), 50, *range(60, 97), None]], "v long")
    assert sorted(tuple(r) for r in reports.runs(v, "v", block=16).collect()) == [(-5, 39, 45), (50, 50, 1), (60, 96, 37)]
    t = spark.sql("select timestamp'2020-01-03' t, 2.0 v union all select timestamp'2020-03-09', 4.0")
    got = {r["month"]: r["mean"] for r in reports.monthly_mean(t, F.col("t"), "v").collect()}
    assert got == {"2020-01": 2.0, "2020-02": None, "2020-03": 4.0}
