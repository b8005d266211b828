"""For each query of a table all texts at the least edit distance, without comparing every query with every text.

A text is cut into r + 1 segments. Whoever turns it into a query by r edits leaves one segment whole, moved by at most r places, so the two
meet in a key of the text's length, the segment's number and its characters. Queries ask for all keys that a text within the radius can
have. The radius grows; a query is settled by the first radius within which it has a text, and only the others go on. What is farther than
the last radius from all texts is compared with all of them in blocks, keeping the least distance of each block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import drop, scratch

RADII = (0, 1, 2, 4)
#: Queries of a block that meets all texts.
BLOCK = 256


def _range(low: Column, high: Column) -> Column:
    """low, ..., high; empty where high is less."""
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _bound(i, length: Column, r: int) -> Column:
    return F.floor(i * length / (r + 1)).cast("int")


def text_keys(texts: DataFrame, r: int) -> DataFrame:
    """text with size, segment and part: its r + 1 segments."""
    rows = texts.select("text", F.length("text").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(r))).alias("segment"))
    begin, end = _bound(F.col("segment"), F.col("size"), r), _bound(F.col("segment") + 1, F.col("size"), r)
    return rows.select("text", "size", "segment", F.substring("text", begin + 1, end - begin).alias("part"))


def query_keys(queries: DataFrame, r: int) -> DataFrame:
    """query with all keys (size, segment, part) that a text within r edits can have."""
    n = F.length("query")
    rows = queries.select("query", n.alias("n"), F.explode(_range(F.greatest(n - r, F.lit(0)), n + r)).alias("size"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(r))).alias("segment"))
    begin, end = _bound(F.col("segment"), F.col("size"), r), _bound(F.col("segment") + 1, F.col("size"), r)
    rows = rows.select("query", "n", "size", "segment", begin.alias("begin"), (end - begin).alias("width"))
    rows = rows.select("*", F.explode(_range(F.greatest(F.col("begin") - r, F.lit(0)), F.least(F.col("begin") + r, F.col("n") - F.col("width")))).alias("at"))
    return rows.select("query", "size", "segment", F.substring("query", F.col("at") + 1, F.col("width")).alias("part")).distinct()


def within(queries: DataFrame, texts: DataFrame, r: int) -> DataFrame:
    """query, text and distance of all pairs within r edits."""
    if r == 0:
        return queries.join(texts.select("text", F.col("text").alias("query")), "query").select("query", "text", F.lit(0).cast("long").alias("distance"))
    pairs = query_keys(queries, r).join(text_keys(texts, r), ["size", "segment", "part"]).select("query", "text").distinct()
    return pairs.withColumn("distance", F.levenshtein("query", "text", r).cast("long")).filter("distance >= 0")


def _in_blocks(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """All texts at the least distance of queries that no radius settled. Each block of queries is one row that meets the texts."""
    n = queries.count()
    if not n:
        return queries.select("query", F.col("query").alias("text"), F.lit(0).cast("long").alias("distance")).limit(0)
    blocks = -(-n // BLOCK)
    own = queries.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).agg(F.collect_list("query").alias("queries"))
    rows = texts.select("text", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")).join(own, "block")
    pairs = rows.select("text", F.explode("queries").alias("query")).withColumn("distance", F.levenshtein("query", "text").cast("long"))
    least = scratch(pairs.groupBy("query").agg(F.min("distance").alias("distance")))  # two passes, so that no query's texts are held
    return pairs.join(least, ["query", "distance"]).select("query", "text", "distance")


def closest_pairs(queries: DataFrame, texts: DataFrame, radii: tuple[int, ...] = RADII) -> DataFrame:
    """query, text and distance: of each query (query) all texts (text) at the least edit distance, equal ones once. Nulls take no part; without
    texts there are no rows."""
    texts = scratch(texts.select("text").filter("text IS NOT NULL").distinct())
    left = scratch(queries.select("query").filter("query IS NOT NULL").distinct())
    found = []
    if not texts.isEmpty():
        for r in radii:
            near = scratch(within(left, texts, r))
            best = near.withColumn("_least", F.min("distance").over(Window.partitionBy("query"))).filter("distance = _least").drop("_least")
            found.append(best)
            left, before = scratch(left.join(near.select("query"), "query", "left_anti")), left
            drop(before)
            if left.isEmpty():
                break
    found.append(_in_blocks(left, texts))
    return reduce(DataFrame.unionByName, found)
