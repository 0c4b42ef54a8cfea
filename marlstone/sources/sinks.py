"""Writers: rolled Parquet, the three post exports, JSON dictionaries and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marlstone.config import DEFAULT
from marlstone.functions.sampling import chunk_numbers


def write_posts(df: DataFrame, path: str, rows_per_file: int = DEFAULT.rows_per_file, valid: str | None = None) -> dict:
    """Write snappy Parquet with at most so many rows per file; returns ``rows`` and, where ``valid`` names a column, ``bad`` and ``bad_share``.

    Rows that are not valid are counted on the way and not written; both counts come from the one pass that writes.
    """
    seen = Observation("written")
    counts = [F.count(F.lit(1)).alias("rows")]
    if valid:
        counts.append(F.count_if(~F.coalesce(F.col(valid), F.lit(False))).alias("bad"))
    counted = df.observe(seen, *counts)
    if valid:
        counted = counted.filter(F.col(valid)).drop(valid)
    counted.write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", rows_per_file).parquet(path)
    rows, lost = seen.get["rows"], seen.get.get("bad", 0)
    return {"rows": rows - lost, "bad": lost, "bad_share": lost / rows if rows else 0.0} if valid else {"rows": rows}


def replace_table(df: DataFrame, name: str, columns: dict[str, str]) -> None:
    """Create or replace a catalogue table with typed columns; a value that doesn't fit its type is an error, as in SQL."""
    df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()]).write.mode("overwrite").option("overwriteSchema", True).saveAsTable(name)


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a Parquet data set; it is created if absent."""
    df.write.mode("append").parquet(path)


def write_projection(df: DataFrame, path: str, columns: list[str]) -> None:
    """Write some columns of a data set to a new one; a missing column is an error that names it."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    df.select(*columns).write.mode("overwrite").parquet(path)


def write_chunks(df: DataFrame, path: str, key: str, size: int) -> None:
    """CSV parts of at most ``size`` keys each, one folder per chunk number."""
    chunk_numbers(df, key, size).write.mode("overwrite").partitionBy("chunk").option("header", True).csv(path)


def write_exports(tables: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per export, with header."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def words_json(words: DataFrame, key: str = "cluster") -> DataFrame:
    """``value``: one line per key, a JSON object from key to its words in rank order."""
    lists = words.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("w"))
    return lists.select(F.to_json(F.create_map(F.col(key).cast("string"), F.col("w"))).alias("value"))


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSON lines log; it is created if absent."""
    df.write.mode("append").json(path)
