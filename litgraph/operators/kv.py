"""Key-value tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_kv(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """key as text, value as JSON."""
    return rows.select(key.cast("string").alias("key"), F.to_json(value).alias("value"))


def get(kv: DataFrame, key) -> DataFrame:
    return kv.filter(F.col("key") == key)


def get_many(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the keys that exist."""
    return kv.join(keys.select("key").distinct(), "key")


def contains(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("key").distinct().join(kv.select("key").distinct().withColumn("found", F.lit(True)), "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


def where(kv: DataFrame, condition: str | Column) -> DataFrame:
    return kv.where(condition)


def keys(kv: DataFrame) -> DataFrame:
    return kv.select("key").distinct()


def size(kv: DataFrame) -> DataFrame:
    return kv.agg(F.count(F.lit(1)).alias("n"))
