"""Predications: subject, verb, object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import coded_key, entity_key, lemma_key, ngram_key, predicate_key, sentence_key


def split_terms(rows: DataFrame) -> DataFrame:
    """Rows with `|`-joined ids and names become one row for each pair of a subject and an object; the shorter list sets the length."""

    def side(name: str):
        ids, names = F.split(F.col(f"{name}_ids"), r"\|"), F.split(F.col(f"{name}_names"), r"\|")
        return F.filter(F.arrays_zip(ids.alias("id"), names.alias("name")), lambda x: x["id"].isNotNull() & x["name"].isNotNull())

    one = rows.withColumn("_s", F.explode(side("subj"))).withColumn("_o", F.explode(side("obj")))
    return one.withColumns({"subj_ids": F.col("_s.id"), "subj_names": F.col("_s.name"), "obj_ids": F.col("_o.id"), "obj_names": F.col("_o.name")}).drop("_s", "_o")


def with_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", predicate_key(F.col("subj_ids"), F.col("pred_type"), F.col("obj_ids")))


def before(rows: DataFrame, date: str) -> DataFrame:
    from ..functions.dates import valid_cut_date

    return rows.filter(F.col("date") < valid_cut_date(date))


def earliest(rows: DataFrame, key: str = "key", date: str = "date") -> DataFrame:
    """First date of each key; 9999-99-99 where none is known."""
    return rows.groupBy(key).agg(F.coalesce(F.min(date), F.lit("9999-99-99")).alias("first_date"))


def predicate_edges(rows: DataFrame) -> DataFrame:
    """Each predicate with its sentence (version 1), both coded terms and both texts, in both directions."""

    def text_keys(name: str):
        words = F.split(F.lower(F.col(name)), " ")
        joined = F.array_join(words, "_")
        return entity_key(words), F.when(joined.contains("_"), ngram_key(joined)).otherwise(lemma_key(F.lit("noun"), joined))

    others = F.array(sentence_key(F.col("pmid"), F.lit(1), F.col("sent_idx")), coded_key(F.col("subj_ids")), coded_key(F.col("obj_ids")), *text_keys("subj_text"), *text_keys("obj_text"))
    pairs = with_keys(rows).select(F.col("key"), F.explode(others).alias("other"))
    return pairs.select(F.explode(F.array(F.struct(F.col("key").alias("src"), F.col("other").alias("dst")), F.struct(F.col("other").alias("src"), F.col("key").alias("dst")))).alias("e")).select("e.*").distinct()


def four_way(predication: DataFrame, sentence: DataFrame, citation: DataFrame, aux: DataFrame) -> DataFrame:
    """The extract's inner joins, by sentence, citation and predication id."""
    return predication.join(sentence, "sentence_id").join(citation, "pmid").join(aux, "predication_id")
