"""Reading raw archives: compressed JSON lines to validated posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a post, whether null is allowed, and their kind.
FIELDS = {
    "author": (True, "string"),
    "subreddit": (False, "string"),
    "score": (False, "integer"),
    "created_utc": (False, "integer"),
    "title": (False, "string"),
    "id": (False, "string"),
    "num_comments": (True, "integer"),
    "selftext": (True, "string"),
    "media": (True, "any"),
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file_name`` of every line of text files, zstd-compressed ones included; one task per compressed file."""
    lines = spark.read.text(path)
    return lines.select("value", F.col("_metadata.file_name").alias("file_name"))


def _field(record: Column, name: str) -> Column:
    return F.variant_get(record, f"$.{name}", "variant")


def _integer(v: Column) -> Column:
    """Whole numbers, texts of whole numbers and booleans as a long; anything else is null."""
    text = F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("string")).otherwise(F.try_variant_get(v, "$", "string"))
    number = F.trim(text).try_cast("decimal(38,6)")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def validated(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` with the typed fields and ``valid``.

    A line is valid if it is a JSON object with every key, of the right kind; null only where
    allowed. ``media`` becomes whether it is there. Nothing is valid in null or empty lines.
    """
    # The generator parses each line once; as a plain column it would be parsed for every field.
    parsed = lines.select("*", F.explode(F.array(F.try_parse_json(F.col(line)))).alias("_r"))
    is_object = F.coalesce(F.schema_of_variant("_r").startswith("OBJECT"), F.lit(False))
    ok, columns = is_object, []
    for name, (nullable, kind) in FIELDS.items():
        v = F.when(is_object, _field(F.col("_r"), name))
        there, null = v.isNotNull(), F.coalesce(F.is_variant_null(v), F.lit(False))
        if kind == "string":
            value, right = F.try_variant_get(v, "$", "string"), F.schema_of_variant(v) == "STRING"
        elif kind == "integer":
            value = _integer(v)
            right = value.isNotNull()
        else:
            value, right = there & ~null, there
        columns.append(F.when(there & ~null, value).alias(name) if kind != "any" else value.alias(name))
        ok = ok & there & (F.lit(nullable) & null | ~null & F.coalesce(right, F.lit(False)))
    rest = [c for c in lines.columns if c not in FIELDS]
    return parsed.select(*rest, *columns, F.coalesce(ok, F.lit(False)).alias("valid"))


def ingest(lines: DataFrame, line: str = "value") -> DataFrame:
    """Valid posts only."""
    return validated(lines, line).filter("valid").select(*FIELDS)


def bad_share(lines: DataFrame, line: str = "value") -> DataFrame:
    """``n, bad, share`` of invalid lines."""
    v = validated(lines, line)
    return v.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("bad"), F.round(F.avg((~F.col("valid")).cast("int")), 6).alias("share"))


def statistics(lines: DataFrame, line: str, file_name: str) -> DataFrame:
    """Text length, counts with defaults for missing keys, year and month of each object.

    A missing key gives -1 (numbers) or the empty text; an explicit null stays null. A post with
    media counts its title only.
    """
    parsed = lines.select("*", F.explode(F.array(F.try_parse_json(F.col(line)))).alias("_r"))
    rows = parsed.filter(F.coalesce(F.schema_of_variant("_r").startswith("OBJECT"), F.lit(False)))

    def number(name: str) -> Column:
        v = _field(F.col("_r"), name)
        return F.when(v.isNull(), F.lit(-1)).otherwise(_integer(v))

    def string(name: str) -> Column:
        return F.coalesce(F.try_variant_get("_r", f"$.{name}", "string"), F.lit(""))

    media = _field(F.col("_r"), "media")
    has_media = media.isNotNull() & ~F.coalesce(F.is_variant_null(media), F.lit(False))
    body = F.when(has_media, "").otherwise(string("selftext"))
    when = F.regexp_extract(F.col(file_name), r"RS_(\d{4})-(\d{2})", 1), F.regexp_extract(F.col(file_name), r"RS_(\d{4})-(\d{2})", 2)
    return rows.select(F.length(F.concat(string("title"), body)).alias("length"), number("score").alias("score"), number("num_comments").alias("num_comments"), has_media.alias("has_media"), when[0].try_cast("int").alias("year"), when[1].try_cast("int").alias("month"))


def sampled_statistics(lines: DataFrame, line: str, file_name: str, share: float, files: int | None = None, seed: str = "42") -> DataFrame:
    """``statistics`` of a Bernoulli sample of the lines, of the first ``files`` files by name if a number is given.

    Sampling is the operator's purpose; a line is in or out by a hash of its file, its text and the seed, so that a run can be repeated.
    """
    if files is not None:
        lines = lines.join(F.broadcast(lines.select(file_name).distinct().orderBy(file_name).limit(files)), file_name, "left_semi")
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(file_name), F.col(line)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return statistics(lines.filter(place < share), line, file_name)


def unfinished_jobs(spark: SparkSession, path: str, done: str = "Finished converting") -> DataFrame:
    """``file`` of job logs without the closing message: the base name in the ninth word of the second line."""
    logs = spark.read.text(path, wholetext=True).filter(~F.col("value").contains(done))
    second = F.get(F.split("value", "\n"), F.lit(1))
    return logs.select(F.element_at(F.split(F.get(F.split(second, " "), F.lit(8)), "/"), -1).alias("file"))
