"""Documents to sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import sentence_key
from ..functions.text import split_sentences

MIN_CHARS, MAX_CHARS = 10, 1000


def language_filter(docs: DataFrame, language: str = "eng", column: str = "language") -> DataFrame:
    return docs.filter(F.col(column) == language)


def cut_date_filter(docs: DataFrame, date: str, column: str = "date") -> DataFrame:
    """Strictly earlier, as text: months and days may be zero."""
    from ..functions.dates import valid_cut_date

    return docs.filter(F.col(column) < valid_cut_date(date))


def explode_sentences(docs: DataFrame, text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Columns of docs, sent_idx and sent_total over the sentences kept, and sent_text. The order within a document is settled in its
    array, so no shuffle is needed."""
    kept = F.filter(split_sentences(text), lambda s: F.length(s).between(min_chars, max_chars))
    rows = docs.withColumn("_kept", kept)
    return rows.select("*", F.size("_kept").cast("long").alias("sent_total"), F.posexplode("_kept").alias("_i", "sent_text")).withColumn("sent_idx", F.col("_i").cast("long")).drop("_kept", "_i")


def parts_to_sentences(docs: DataFrame, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """For document records (text_data: array of text and type): one index over all parts, sent_type, and the sentence key as id."""
    each = F.flatten(F.transform("text_data", lambda p: F.transform(F.filter(split_sentences(p["text"]), lambda s: F.length(s).between(min_chars, max_chars)), lambda s: F.struct(s.alias("text"), p["type"].alias("type")))))
    rows = docs.withColumn("_kept", each).drop("text_data")
    rows = rows.select("*", F.size("_kept").alias("sent_total"), F.posexplode("_kept").alias("sent_idx", "_s")).drop("_kept")
    return rows.select("*", F.col("_s.text").alias("sent_text"), F.col("_s.type").alias("sent_type"), sentence_key(F.lower("pmid"), F.col("version"), F.col("sent_idx")).alias("id")).drop("_s")


def adjacent_keys(rows: DataFrame, group: str, idx: str, key: str) -> DataFrame:
    """key and its neighbours before and after, as rows (src, dst)."""
    w = Window.partitionBy(group).orderBy(idx)
    both = rows.select(F.col(key).alias("src"), F.array(F.lag(key).over(w), F.lead(key).over(w)).alias("near"))
    return both.select("src", F.explode(F.filter("near", lambda x: x.isNotNull())).alias("dst"))
