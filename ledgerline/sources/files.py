"""Sources of recorded files and sinks, all bounded and declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def json_documents(spark: SparkSession, path: str, max_bytes: int = 8 << 20) -> DataFrame:
    """One row per file: path, body, and the reason why it can't be used (`too_large`, `not_json`), else null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))
    body = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", body.alias("body"), F.when(F.col("length") > max_bytes, "too_large").when(body.isNull() | F.try_parse_json(body).isNull(), "not_json").alias("reason"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str, max_line: int = 256 << 10) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines source with exactly the schema, and the lines that are not: (rows, rejected lines)."""
    parsed = spark.read.text(path).select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("v"))
    names = spark.createDataFrame([], schema).columns
    exact = F.array_sort(F.json_object_keys("value")) == F.array(*map(F.lit, sorted(names)))
    good = F.coalesce((F.octet_length("value") <= max_line) & F.col("v").isNotNull() & exact, F.lit(False))
    return parsed.where(good).select("r.*"), parsed.where(~good).select("value")


def labelled_lines(lines: DataFrame) -> DataFrame:
    """`address<TAB>label` lines of a `value` column; blank lines and comments left out, further fields ignored."""
    text = F.trim("value")
    parts = F.split("value", "\t")
    return lines.where((text != "") & ~text.startswith("#")).select(F.trim(parts[0]).alias("address"), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("label"))


def file_manifest(spark: SparkSession, path: str, exclude: str = "/__pycache__/") -> DataFrame:
    """path, bytes and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(~F.contains("path", F.lit(exclude))).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_new(df: DataFrame, path: str) -> None:
    """Write a table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def append_events(batch: DataFrame, target: str, key: str = "event_id", digest: str = "payload_hash") -> None:
    """Append rows whose key is new; a known key with another digest is an error, a repeated row is nothing."""
    spark = batch.sparkSession
    rows = batch.dropDuplicates([key, digest])
    if not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("event id collision within the batch")
    try:
        known = spark.read.parquet(target).select(F.col(key).alias("_k"), F.col(digest).alias("_d"))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    if known is not None:
        both = rows.join(known, rows[key] == known["_k"], "left")
        if not both.where(F.col("_d").isNotNull() & (F.col("_d") != F.col(digest))).isEmpty():
            raise ValueError("event id collision with the table")
        rows = both.where("_k is null").drop("_k", "_d")
    rows.write.mode("append").parquet(target)


def markdown_table(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A table as ordered markdown lines: position, line."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns]), F.lit(" |"))
    return df.orderBy(*order).select(cells.alias("line"))
