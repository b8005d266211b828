"""Views for training: samples, numbered rows, vectors by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sample_by_hash
from ..operators.ordering import global_row_number


def two_level_sample(rows: DataFrame, part: Column, key: Column, part_rate: float, rate: float, seed: str = "") -> DataFrame:
    """A share of the parts, then a share of their rows, both by hash."""
    for r in (part_rate, rate):
        if not 0 < r <= 1:
            raise ValueError("rates are above 0 and at most 1")
    return rows.filter(sample_by_hash(part, part_rate, f"part{seed}") & sample_by_hash(key, rate, f"row{seed}"))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with an index from 0, for access by position."""
    return global_row_number(rows, order, "index").withColumn("index", F.col("index") - 1)


def filtered_keys(kv: DataFrame, keep: Column) -> DataFrame:
    return kv.filter(keep)


def key_view(kv: DataFrame) -> DataFrame:
    return kv.select("key")


def value_view(kv: DataFrame) -> DataFrame:
    return kv.select("value")


def loaded(df: DataFrame) -> DataFrame:
    """df, computed now and kept by the executors, on their disks where memory doesn't do."""
    df = df.persist()
    df.count()
    return df


def with_zero_vectors(names: DataFrame, vectors: DataFrame, dimensions: int, column: str = "name") -> DataFrame:
    """Each name with its vector, or zeros where it has none, as predicates have."""
    joined = names.join(vectors.withColumnRenamed("name", column), column, "left")
    return joined.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), dimensions)))


def with_vectors(names: DataFrame, vectors: DataFrame, column: str = "name") -> DataFrame:
    """Each name with its vector; a name without one is an error when its row is read."""
    joined = names.join(vectors.withColumnRenamed("name", column), column, "left")
    return joined.withColumn("embedding", F.when(F.col("embedding").isNull(), F.raise_error(F.concat(F.lit("no vector: "), column))).otherwise(F.col("embedding")))


def title_sentences(abstracts: DataFrame, sentences: str) -> DataFrame:
    """Titles among sentence structs (type, text), or the first sentence where there is none."""
    titles = F.filter(sentences, lambda s: s["type"] == "title")
    return abstracts.withColumn(sentences, F.when(F.size(titles) > 0, titles).otherwise(F.slice(sentences, 1, 1)))


def overlapping_label(start: Column, end: Column, spans: Column) -> Column:
    """Label of the first span (start, end, label) that shares a character."""
    return F.get(F.filter(spans, lambda s: (s["start"] < end) & (start < s["end"])), F.lit(0))["label"]
