"""Tables of many files: schema checks before the read, union by name, key-preserving samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.sampling import order_key


def file_schemas(spark: SparkSession, paths: list[str], column: str) -> DataFrame:
    """``path, kind``: the type of a column in each file's footer; null where it lacks or can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for pdf in batches:
            kinds = []
            for p in pdf["path"]:
                try:
                    schema = pq.read_schema(p)
                    kinds.append(str(schema.field(column).type) if column in schema.names else None)
                except Exception:  # noqa: BLE001 - an unreadable file is reported, not fatal
                    kinds.append(None)
            yield pd.DataFrame({"path": pdf["path"], "kind": kinds})

    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.repartition(max(1, min(200, len(paths)))).mapInPandas(run, "path string, kind string")


def read_consistent(spark: SparkSession, paths: list[str], column: str = "media", kind: str = "bool") -> DataFrame:
    """Union by name of the files whose column has the wanted type; the others are left out."""
    good = [r["path"] for r in file_schemas(spark, paths, column).filter(F.col("kind") == kind).orderBy("path").collect()]
    if not good:
        raise ValueError(f"no file has {column} as {kind}")
    return spark.read.option("mergeSchema", True).parquet(*good)


def sample_paths(paths: list[str], n: int, seed: str = "42") -> list[str]:
    """n paths by hash; asking for more than there are is an error."""
    if n > len(paths):
        raise ValueError(f"{n} files asked for, {len(paths)} there")
    import hashlib

    return sorted(sorted(paths, key=lambda p: hashlib.md5(f"{seed}|{p}".encode()).hexdigest())[:n])


def sample_table(df: DataFrame, key: str, fraction: float, seed: str = "42") -> DataFrame:
    """About a fraction of the keys, with all their rows: the same keys in every table that has them."""
    bucket = F.conv(F.substring(order_key(seed, F.col(key).cast("string")), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    return df.filter(bucket < fraction)


def archive_files(spark: SparkSession, folder: str, prefix: str = "RS", limit: int | None = None) -> DataFrame:
    """``path, name, bytes`` of the archive files of a folder in name order, names without extension; the first ``limit`` if one is given.

    Only the listing is read, never a file. An empty folder gives no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*").load(folder).select("path", F.col("length").alias("bytes"))
    base = F.element_at(F.split("path", "/"), -1)
    named = files.select("path", F.regexp_replace(base, r"\.[^.]*$", "").alias("name"), "bytes").orderBy("name", "path")
    return named if limit is None else named.limit(limit)


def read_word_lists(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """``key, rank, term`` of a JSON dictionary from keys to word lists; ``nested`` ones (key to key to list) have ``subkey`` too.

    Text that is no such dictionary, and null lists, give no row.
    """
    kind = "map<string,map<string,array<string>>>" if nested else "map<string,array<string>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("d")).filter("d is not null")
    rows = whole.select(F.explode("d").alias("key", "v"))
    if nested:
        rows = rows.select("key", F.explode("v").alias("subkey", "v"))
    ranked = rows.select(*[c for c in rows.columns if c != "v"], F.posexplode("v").alias("rank", "term"))
    return ranked.withColumn("rank", F.col("rank") + 1)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV export with header; quoted line breaks are part of their field. Types come from ``schema``, else from the data."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
