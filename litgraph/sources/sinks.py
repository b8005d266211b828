"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_kv_lines(rows: DataFrame, key: Column, value: Column, path: str) -> None:
    rows.select(F.to_json(F.struct(key.cast("string").alias("key"), value.alias("value"))).alias("value")).write.mode("overwrite").text(path)


def write_kv_table(rows: DataFrame, name: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by key, for look-ups and joins without a shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").saveAsTable(name)


def write_edge_list(edges: DataFrame, path: str) -> None:
    """Lines `src dst 1`."""
    edges.select(F.concat_ws(" ", F.col("src_id"), F.col("dst_id"), F.lit(1)).alias("value")).write.mode("overwrite").text(path)


def write_edge_buckets(buckets: DataFrame, path: str) -> None:
    buckets.repartition("lhs_part", "rhs_part").write.mode("overwrite").partitionBy("lhs_part", "rhs_part").parquet(path)


def write_edge_lines(edges: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    edges.select(F.to_json(F.struct(F.col("src").alias("key"), F.col("dst").alias("value"))).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).text(path)


def write_predications(rows: DataFrame, path: str) -> None:
    from ..functions.dates import clean_date

    rows.withColumn("date", clean_date(F.col("date"))).write.mode("overwrite").option("header", True).csv(path)


def write_result(result: DataFrame, path: str, overwrite: bool = False) -> None:
    """A nested result as one table; refuses to replace one unless told to."""
    result.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_corpus(lines: DataFrame, path: str, files: int = 20) -> None:
    lines.repartition(files).write.mode("overwrite").text(path)


def build_kv(rows: DataFrame, key: Column, value: Column, name: str, path: str, merge: bool = False, buckets: int = 64) -> DataFrame:
    """The key-value table `name`, built unless it is there: JSON lines at path, then the table, bucketed and sorted by key. With `merge`,
    the values of a key become a JSON array of its distinct ones."""
    spark = rows.sparkSession
    if not spark.catalog.tableExists(name):
        write_kv_lines(rows, key, value, path)
        lines = spark.read.schema("key STRING, value STRING").json(path)
        if merge:
            from ..operators.edges import gathered

            lines = gathered(lines, "key", "value").select("key", F.to_json("values").alias("value"))
        write_kv_table(lines, name, buckets)
    return spark.table(name)


def write_shards(rows: DataFrame, order: list[Column], path: str, per_shard: int = 100_000) -> None:
    """Training rows by position: each has its index along the order, and index // per_shard names its folder."""
    from .datasets import numbered

    one = numbered(rows, order).withColumn("shard", F.floor(F.col("index") / per_shard))
    one.repartition("shard").sortWithinPartitions("index").write.mode("overwrite").partitionBy("shard").parquet(path)


def write_names(ids: DataFrame, path: str) -> None:
    """The name list of an edge list: a name a line, in the order of ids."""
    ids.orderBy("id").select(F.col("name").alias("value")).write.mode("overwrite").text(path)


def write_locations(locations: DataFrame, name: str, buckets: int = 64) -> None:
    """Where each entity's vector lies: name -> JSON of type, part and row, as a key-value table."""
    write_kv_table(locations.select(F.col("name").alias("key"), F.to_json(F.struct("type", "part", "row")).alias("value")), name, buckets)
