"""Frequent phrases, bags of words and their pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_text, interesting, is_interesting, mask_phrases, ngrams, without_stop_entities
from ..plans.stage import scratch


def candidate_ngrams(tokens: Column, longest: int) -> Column:
    """Phrases of 2 to `longest` lemmas that begin and end with an interesting token. The token array is zipped with itself, shifted, so
    the work is linear in its length."""

    def of(n: int) -> Column:
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        runs = F.arrays_zip(*(F.slice(tokens, j + 1, count).alias(f"t{j}") for j in range(n)))
        joined = F.transform(runs, lambda z: F.when(interesting(z["t0"]) & interesting(z[f"t{n - 1}"]), F.concat_ws("_", *(z[f"t{j}"]["lemma"] for j in range(n)))))
        return F.filter(joined, lambda x: x.isNotNull())

    return F.concat(*(of(n) for n in range(2, longest + 1)))


_MARK = "\u0001"


def ngram_rows(rows: DataFrame, words: Column, longest: int, *kept: str) -> DataFrame:
    """The columns kept and ngram, a row for each phrase of `candidate_ngrams` of a column of words. Each word is classified once and marked if it
    can't begin or end a phrase; all else is done on rows of neighbouring words, in generated code."""
    marked = F.transform(words, lambda w: F.when(is_interesting(w), w).otherwise(F.concat(F.lit(_MARK), w)))
    one = rows.select(*kept, marked.alias("_m"))
    near = F.arrays_zip(*(F.slice("_m", j + 1, F.greatest(F.size("_m"), F.lit(1))).alias(f"t{j}") for j in range(longest)))
    flat = one.select(*kept, F.explode(near).alias("_z")).select(*kept, *(F.col(f"_z.t{j}").alias(f"_t{j}") for j in range(longest)))
    good = lambda j: F.col(f"_t{j}").isNotNull() & ~F.col(f"_t{j}").startswith(_MARK)
    plain = lambda j: F.translate(f"_t{j}", _MARK, "")
    grams = [F.when(good(0) & good(n - 1), F.concat_ws("_", *(plain(j) for j in range(n)))) for n in range(2, longest + 1)]
    return flat.filter(good(0)).select(*kept, F.explode(F.array(*grams)).alias("ngram")).filter("ngram IS NOT NULL")


def mine_ngrams(one: DataFrame, support: int, part: str | None = None, part_support: int = 1) -> DataFrame:
    """Of rows with ngram: ngram and n, its occurrences; with `part`, only counts of parts in which it reaches part_support add up."""
    if part:
        one = one.groupBy(part, "ngram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= part_support).groupBy("ngram").agg(F.sum("n").alias("n"))
    else:
        one = one.groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))
    return one.filter(F.col("n") >= support)


def annotate(rows: DataFrame, key: str, lemmas: str, model: DataFrame, longest: int) -> DataFrame:
    """key and ngrams: the model's phrases (ngram) in each row's words, longest first, without overlap. A row's own n-grams are joined with the
    model, so no task holds it all."""
    candidates = ngram_rows(rows, F.col(lemmas), longest, key).distinct()
    own = candidates.join(model.select("ngram"), "ngram").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("ngram", F.lit(True)))).alias("_phrases")).withColumnRenamed(key, "_of")
    matched = rows.join(own, F.col(key).eqNullSafe(F.col("_of")), "left").withColumn("_phrases", F.coalesce("_phrases", F.create_map().cast("map<string,boolean>")))
    return matched.select(key, mask_phrases(F.col(lemmas), F.col("_phrases"), longest).alias("ngrams"))


def plain_ngrams(words: Column, low: int, high: int) -> Column:
    return F.concat(*(ngrams(words, n) for n in range(low, high + 1)))


def bag_of_words(tokens: Column, *more: Column) -> Column:
    """Lemmas of interesting tokens, then other terms; order and repeats stay."""
    return F.concat(F.transform(F.filter(tokens, interesting), lambda t: t["lemma"]), *more)


def full_bag(tokens: Column, entities: Column, ngrams: Column, codes: Column) -> Column:
    """Lemmas, texts of entities that aren't all stop words, n-grams, and coded terms, in this order."""
    return bag_of_words(tokens, F.transform(without_stop_entities(entities, tokens), lambda e: entity_text(e, tokens)), ngrams, codes)


def document_frequency(rows: DataFrame, bow: str) -> DataFrame:
    return rows.select(F.explode(F.array_distinct(bow)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def prune_low_support(rows: DataFrame, key: str, bow: str, least: int) -> DataFrame:
    """Rows (key, pos, word) without words of fewer than `least` documents; documents left empty are gone with them."""
    words = rows.select(key, F.posexplode(bow).alias("pos", "word"))
    frequent = scratch(document_frequency(rows, bow).filter(F.col("df") >= least).select("word"))  # a table, so that the join can split a word of every row
    return words.join(frequent, "word", "left_semi")


def frequent_items(rows: DataFrame, item: Column, support: int) -> DataFrame:
    return rows.select(item.alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
