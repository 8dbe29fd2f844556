"""Content keys, reuse and incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def unit_id(*parts: Column) -> Column:
    """A unit's id: tu_ and 24 hex digits of its key."""
    return F.concat(F.lit("tu_"), F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 24))


def text_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted names that keeps nulls: what a stable hash is taken of. Strings are escaped by to_json."""
    quoted = {k: F.when(v.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)) for k, v in sorted(fields.items())}
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in quoted.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def pending(units: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Units without a cached row."""
    return units.join(cache.select(key).distinct(), key, "left_anti")


def reusable(units: DataFrame, done: DataFrame) -> DataFrame:
    """Units whose trimmed text already stands in ``done``."""
    keys = done.select(T.strip(F.col("text")).alias("bare")).distinct()
    return units.withColumn("bare", T.strip(F.col("text"))).join(keys, "bare", "left_semi").drop("bare")


def first_match(units: DataFrame, done: DataFrame, order: str) -> DataFrame:
    """Units with the first of ``done`` (in ``order``) that has the same text hash: reused, or pending without one."""
    ranked = done.withColumn("text_sha256", text_hash(F.col("text"))).groupBy("text_sha256").agg(F.min(order).alias("reuse_of"))
    joined = units.withColumn("text_sha256", text_hash(F.col("text"))).join(ranked, "text_sha256", "left")
    return joined.withColumn("state", F.when(F.col("reuse_of").isNull(), "pending").otherwise("reused"))


def conflicting(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """Keys with more than one value: an immutable store must have none."""
    return rows.groupBy(key.alias("key")).agg(F.count_distinct(value).alias("values"), F.count("*").alias("rows")).where("values > 1")


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def append_unseen(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The held rows and those new ones whose key is not among them."""
    return held.unionByName(new.join(held.select(key).distinct(), key, "left_anti").select(held.columns))
