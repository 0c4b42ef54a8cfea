import json

from marlstone.streaming.incremental import daily_counts, ingest_stream


def test_ingest_once(spark, tmp_path):
    def line(i, t):
        return json.dumps({"author": "a", "subreddit": "s", "score": 1, "created_utc": t, "title": "t", "id": i, "num_comments": 0, "selftext": "", "media": None})

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join([line("1", 10), line("1", 10), "bad"]))
    args = (spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    ingest_stream(*args).awaitTermination()
    (source / "b.json").write_text(line("2", 20))
    ingest_stream(*args).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]


def test_daily_counts(spark):
    df = spark.sql("select timestamp'2024-01-01 10:00:00' t, 'a' k union all select timestamp'2024-01-01 23:59:59', 'a' union all select timestamp'2024-01-02', 'a'")
    assert sorted(r["n"] for r in daily_counts(df, "t", "k").collect()) == [1, 2]
