"""Graph keys: a type character, a colon and a lower-case name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The key grammar's type characters.
TYPES = {"data_bank": "d", "entity": "e", "gene": "a", "lemma": "l", "mesh": "m", "umls": "m", "ngram": "n", "predicate": "p", "sentence": "s"}


def sentence_key(pmid: Column, version: Column, idx: Column) -> Column:
    """The ids keep their case; a missing version is 1."""
    return F.concat_ws(":", F.lit("s"), pmid.cast("string"), F.coalesce(version.cast("string"), F.lit("1")), idx.cast("string"))


def lemma_key(pos: Column, lemma: Column) -> Column:
    return F.lower(F.concat_ws(":", F.lit("l"), pos, lemma))


def entity_key(lemmas: Column) -> Column:
    return F.lower(F.concat(F.lit("e:"), F.array_join(lemmas, "_")))


def coded_key(code: Column) -> Column:
    return F.lower(F.concat(F.lit("m:"), code))


def ngram_key(ngram: Column) -> Column:
    return F.lower(F.concat(F.lit("n:"), ngram))


def predicate_key(subject: Column, verb: Column | None, obj: Column) -> Column:
    """A missing verb is `unknown`; a verb with a colon is an error."""
    verb = F.lit("unknown") if verb is None else F.coalesce(verb, F.lit("unknown"))
    checked = F.when(verb.contains(":"), F.raise_error(F.lit("a predicate's verb holds a colon"))).otherwise(verb)
    return F.lower(F.concat_ws(":", F.lit("p"), subject, checked, obj))


def is_type(key: Column, kind: str) -> Column:
    return (F.length(key) > 2) & (F.substring(key, 1, 2) == f"{TYPES[kind]}:")


def is_graph_key(key: Column) -> Column:
    return key.rlike("^[adelmnps]:.") & (key == F.lower(key))


def to_graph_key(key: Column, kind: str) -> Column:
    """A key of that type as it is, another type's key an error, any other text prefixed and in lower case."""
    return F.when(is_type(key, kind) & is_graph_key(key), key).when(is_graph_key(key), F.raise_error(F.concat(F.lit(f"no {kind} key: "), key))).otherwise(F.lower(F.concat(F.lit(f"{TYPES[kind]}:"), key)))


def clean_coded_term(term: Column) -> Column:
    return F.lower(F.when(is_type(term, "umls"), term).otherwise(F.concat(F.lit("m:"), term)))


def is_predicate(key: Column) -> Column:
    """Four fields, with a subject and an object; the verb may be empty."""
    parts = F.split(key, ":")
    return (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "p") & (F.get(parts, F.lit(1)) != "") & (F.get(parts, F.lit(3)) != "")


def predicate_subject(key: Column) -> Column:
    return F.concat(F.lit("m:"), F.get(F.split(key, ":"), F.lit(1)))


def predicate_object(key: Column) -> Column:
    return F.concat(F.lit("m:"), F.get(F.split(key, ":"), F.lit(3)))


def adjacent_sentence_keys(pmid: Column, version: Column, idx: Column, total: Column) -> Column:
    """Keys of the sentences before and after, where there are any."""
    before = F.when(idx > 0, sentence_key(pmid, version, idx - 1))
    after = F.when(idx < total - 1, sentence_key(pmid, version, idx + 1))
    return F.filter(F.array(before, after), lambda k: k.isNotNull())


def lemma_keys(tokens: Column) -> Column:
    """Of the interesting tokens. The rules' parts of speech are too coarse to tell nodes apart, so all are nouns."""
    from .text import interesting

    return F.transform(F.filter(tokens, interesting), lambda t: lemma_key(F.lit("noun"), t["lemma"]))


def entity_keys(entities: Column, tokens: Column) -> Column:
    from .text import entity_text

    return F.transform(entities, lambda e: F.lower(F.concat(F.lit("e:"), entity_text(e, tokens))))


def coded_keys(codes: Column) -> Column:
    return F.transform(codes, coded_key)


def ngram_keys(ngrams: Column) -> Column:
    return F.transform(ngrams, ngram_key)
