"""Readers, writers and import decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line; the schema is given, never inferred. Blank lines are none, broken ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Complete or absent: the committer moves finished files alone. Nulls are kept as such."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(column).write.mode("overwrite").text(path)


def discover(spark: SparkSession, path: str, recursive: bool = True, pattern: str = "*") -> DataFrame:
    """Files below the path, once for each name regardless of case, with hash and size. Files of no bytes are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(path)
    once = files.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("path")).orderBy("path"))).where("_n = 1")
    return once.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def source_id(sha256: Column) -> Column:
    return F.concat(F.lit("source_"), F.substring(sha256, 1, 24))


def import_codes(files: DataFrame, project: str, order: str, text: str) -> DataFrame:
    """Adds sha256, source_id and code, in order: accepted for new content, duplicate_in_project for content that the
    project has, reused_immutable_source for content of other projects; blank text is unreadable."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    rows = files.withColumn("sha256", digest).withColumn("source_id", source_id(F.col("sha256")))
    blank = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) == 0
    nth = F.row_number().over(Window.partitionBy("sha256").orderBy(order))
    nth_here = F.row_number().over(Window.partitionBy("sha256", project).orderBy(order))
    rows = rows.withColumn("_a", nth).withColumn("_b", nth_here)
    code = F.when(blank, "unreadable").when(F.col("_a") == 1, "accepted").when(F.col("_b") > 1, "duplicate_in_project").otherwise("reused_immutable_source")
    return rows.withColumn("code", code).drop("_a", "_b")


def inspect_pages(pages: DataFrame, by: str) -> DataFrame:
    """Text lengths of each book's pages, and whether it has a text layer."""
    n = F.length("text")
    return pages.groupBy(by).agg(F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.bround(F.avg(n), 2).alias("mean_chars"), F.sum(n).alias("chars"), F.bool_or(n > 0).alias("has_text_layer"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


#: Suffixes that a review may bring, and its largest file.
REVIEW_SUFFIXES, REVIEW_BYTES = ("json", "jsonl", "csv", "xlsx"), 100 * 1024 * 1024


def review_surface(files: DataFrame) -> DataFrame:
    """Adds decision to files of (path, bytes): accepted, or what speaks against an import."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("decision", F.when(~suffix.isin(*REVIEW_SUFFIXES), "suffix_not_allowed").when(F.col("bytes") > REVIEW_BYTES, "too_large").otherwise("accepted"))


def artifact_manifest(files: DataFrame, build: str) -> DataFrame:
    """Files of (path, bytes, sha256) with role, by suffix, and an id from build, role, path and hash."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    role = F.when(suffix.isin("md", "docx", "pdf"), "edition").when(suffix.isin("json", "jsonl"), "data").when(suffix.isin("png", "jpg"), "image").otherwise("other")
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("role", role)
    return rows.withColumn("artifact_id", F.concat(F.lit("artifact_"), F.substring(F.sha2(F.concat_ws("|", F.lit(build), "role", name, "sha256").cast("binary"), 256), 1, 24)))
