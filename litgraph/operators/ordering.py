"""Numbers along a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import scratch


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Adds 1, 2, ... along `order`, which must be total. Rows are dealt by range and numbered in each range; what joins them is one count
    for each range. The ranges are written down first, so that counts and numbers come from the same deal."""
    dealt = scratch(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_range").withColumn(name, F.col("_own").cast("long") + F.col("_before")).drop("_range", "_own", "_before")


def dense_ids(names: DataFrame, column: str, name: str = "id", base: int = 0) -> DataFrame:
    """Distinct values of a column with consecutive ids in their order."""
    return global_row_number(names.select(column).distinct(), [F.col(column)], name).withColumn(name, F.col(name) - 1 + base)


def first_appearance_ids(rows: DataFrame, column: str, order: list[str], base: int = 0, name: str = "id") -> DataFrame:
    """Distinct values of a column with consecutive ids in the order in which they first occur along `order`. Nulls have none."""
    first = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("_first"))
    return global_row_number(first, [F.col("_first"), F.col(column)], name).select(column, (F.col(name) - 1 + base).alias(name))


def batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Adds the batch number of consecutive rows; rows whose ordering column is null are left out."""
    kept = df
    for c in order:
        kept = kept.filter(c.isNotNull())
    return global_row_number(kept, order, "_k").withColumn("batch", F.floor((F.col("_k") - 1) / size).cast("long")).drop("_k")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Spark limits each task's rows of a group to k before it exchanges them."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)
