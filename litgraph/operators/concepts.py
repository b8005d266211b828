"""Concepts and their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import gathered


def filter_atoms(atoms: DataFrame, language: str | None = "ENG", codes: DataFrame | None = None, suppressed: bool = False) -> DataFrame:
    out = atoms if suppressed else atoms.filter(F.col("suppress") == "N")
    if language is not None:
        out = out.filter(F.upper("lat") == language.upper())
    return out if codes is None else out.join(codes.select("cui"), "cui", "left_semi")


def preferred_texts(atoms: DataFrame, order: str) -> DataFrame:
    """Of each code the preferred text that comes last."""
    own = atoms.filter((F.col("ispref") == "Y") & (F.col("ts") == "P") & (F.col("stt") == "PF"))
    return own.groupBy(F.upper("cui").alias("cui")).agg(F.max_by("str", order).alias("text"))


def code_texts(atoms: DataFrame) -> DataFrame:
    """cui and its texts; see `gathered` for chunk."""
    return gathered(atoms.select(F.upper("cui").alias("cui"), F.lower("str").alias("text")), "cui", "text").withColumnRenamed("values", "texts")


def text_codes(atoms: DataFrame) -> DataFrame:
    return gathered(atoms.select(F.lower("str").alias("text"), F.upper("cui").alias("cui")), "text", "cui").withColumnRenamed("values", "codes")


def codes_by_pattern(atoms: DataFrame, pattern: str) -> DataFrame:
    """Codes with a text that the pattern matches from its start."""
    return atoms.filter(F.lower("str").rlike(f"^(?:{pattern})")).select(F.upper("cui").alias("cui")).distinct()


def closest_texts(atoms: DataFrame, queries: list[str]) -> DataFrame:
    """query, text, distance: all texts at the least edit distance. The stated queries go through every row with it, and the least
    distance of each is a partial aggregate."""
    texts = atoms.select(F.lower("str").alias("text")).distinct()
    pairs = texts.select("text", F.explode(F.array(*(F.lit(q.lower()) for q in queries))).alias("query")).withColumn("distance", F.levenshtein("query", "text").cast("long"))
    least = pairs.groupBy("query").agg(F.min("distance").alias("distance"))
    return pairs.join(F.broadcast(least), ["query", "distance"])
