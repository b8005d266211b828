"""Training data for text generators, and the n-gram recall metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from ..functions.text import plain_tokens
from ..plans.stage import scratch


def regroup_abstracts(sentences: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """One row for each document of at least `least` sentences: its sentences in order."""
    rows = sentences.filter(F.col("sent_total") >= least)
    ordered = F.sort_array(F.collect_list(F.struct("sent_idx", "sent_text")))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda s: s["sent_text"]).alias("sentences"))


def valid_years(rows: DataFrame, year: Column) -> DataFrame:
    return rows.filter(year > 1000)


def training_pairs(abstracts: DataFrame, sentences: str, key: str) -> DataFrame:
    """title, and input and target words shifted by one from a start sentence that a hash picks."""
    start = (hash32(F.col(key).cast("string")) % F.size(sentences) + 1).cast("int")
    words = plain_tokens(F.array_join(F.slice(F.col(sentences), start, F.size(sentences)), " "))
    n = F.greatest(F.size("_w") - 1, F.lit(0))
    return abstracts.withColumn("_w", words).select(key, F.coalesce(F.get(sentences, F.lit(0)), F.lit("")).alias("title"), F.slice("_w", 1, n).alias("input"), F.slice("_w", 2, n).alias("target"))


def encode_words(words: Column, vocabulary: dict[str, int], offset: int = 3, unknown: int = 1) -> Column:
    """Vocabulary ids moved by offset; a bounded vocabulary travels as a literal map. Text ids take an offset of TEXT_OFFSET."""
    pairs = [F.lit(x) for kv in vocabulary.items() for x in kv]
    ids = F.create_map(*pairs)
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(ids, w) + offset, F.lit(unknown)))


#: Fixed value: ids below it are those of the special markers of a text.
TEXT_OFFSET = 5


def encode_by_join(rows: DataFrame, key: str, words: str, vocabulary: DataFrame, offset: int = 3, unknown: int = 1) -> DataFrame:
    """(key, pos, code) for a vocabulary (word, id) of any size."""
    one = rows.select(key, F.posexplode(words).alias("pos", "word"))
    return one.join(vocabulary.select("word", F.col("id").alias("_id")), "word", "left").select(key, "pos", F.coalesce(F.col("_id") + offset, F.lit(unknown)).alias("code"))


def decode_words(ids: Column, words: list[str], offset: int = 3, markers: dict[int, str] | None = None) -> Column:
    """Words of ids; ids of `markers` (padding, unknown, beginning, end, ...) are written as these."""
    table = F.array(*map(F.lit, words))
    special = F.create_map(*(F.lit(x) for kv in (markers or {1: "[unk]"}).items() for x in kv))
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.try_element_at(special, i), F.get(table, i - offset), F.lit("[unk]"))), " ")


def tokenizer_corpus(sentences: DataFrame, document: Column, key: Column, document_rate: float = 0.3, rate: float = 0.1) -> DataFrame:
    """Lower-case sentences: a share of the documents, then a share of their sentences, both picked by hash."""
    from ..functions.hashing import sample_by_hash

    own = sentences.filter(sample_by_hash(document, document_rate, "documents"))
    return own.filter(sample_by_hash(key, rate, "tokenizer")).select(F.lower("sent_text").alias("value"))


def recall_minus_title(rows: DataFrame, key: str, generated: Column, target: Column, title: Column, frequency: DataFrame) -> DataFrame:
    """Of the target's n-grams that the title lacks, the weight of those generated. A weight is 1 / log2(n + 1), or 1 for an n-gram that
    `frequency` (ngram, n) lacks. A target without such n-grams scores 1."""
    frequency = scratch(frequency)  # a table, so that the join can split an n-gram of every row
    wanted = rows.select(key, F.array_except(target, title).alias("_t"), F.array_except(F.array_intersect(generated, target), title).alias("_g"))
    marked = lambda items, found: F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.struct(x.alias("ngram"), F.lit(found).alias("found")))
    hit = F.coalesce("_g", F.array().cast("array<string>"))  # each n-gram travels with a mark, not with the row's list
    grams = wanted.select(key, F.explode_outer(F.concat(marked(F.col("_g"), True), marked(F.array_except("_t", hit), False))).alias("_x")).select(key, "_x.ngram", "_x.found")
    weight = F.when(F.col("ngram").isNull(), 0.0).otherwise(F.coalesce(1.0 / F.log2(F.col("n") + 1.0), F.lit(1.0)))
    sums = grams.join(frequency, "ngram", "left").groupBy(key).agg(F.sum(weight).alias("all"), F.sum(F.when(F.col("found"), weight).otherwise(0.0)).alias("found"))
    return sums.select(key, F.when(F.col("all") > 0, F.col("found") / F.col("all")).otherwise(1.0).alias("recall"))
