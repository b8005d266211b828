"""The graph's construction from documents, end to end: named stages that are computed once, driven by the settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.hashing import hash64, hash_bucket, sample_by_hash
from ..operators import edges as E
from ..operators import hooks, knn, ngrams, predicates, sentences
from ..operators.kv import to_kv
from ..operators.vector_index import VectorIndex
from .config import BuildConfig
from .stage import StageStore

#: Parts among which an n-gram's local support is asked for.
PARTS = 16


def build(spark: SparkSession, config: BuildConfig, documents: DataFrame, predications: DataFrame | None = None) -> StageStore:
    """Document records (see sources.schemas.DOCUMENT) and, if given, predications become the stages of a store under config.root:
    sentences, tokens and entities, edges of all families, phrases, bags of words, vectors, their index and neighbours, and the graph. A
    stage that is done isn't computed again, so a build that stopped goes on where it was."""
    store = StageStore(spark, config.root, halt_after=config.halt_after or None)
    stage = store.stage

    def select_documents() -> DataFrame:
        kept = documents.filter(F.col("language").isNull() | (F.col("language") == config.language))
        return sentences.cut_date_filter(kept.withColumn("date", F.coalesce("date", F.lit("0000-00-00"))), config.cut_date) if config.cut_date != BuildConfig.cut_date else kept

    docs = stage("documents", select_documents)
    parsed = stage("parsed_sentences", lambda: hooks.with_entities(sentences.parts_to_sentences(docs, config.sentences.min_chars, config.sentences.max_chars), "sent_text"))
    tokens, entities, key = F.col("tokens"), F.col("entities"), F.col("id")
    families = {
        "coded": K.coded_keys(F.col("mesh_headings")),
        "adjacent": K.adjacent_sentence_keys(F.lower("pmid"), F.col("version"), F.col("sent_idx"), F.col("sent_total")),
        "lemma": K.lemma_keys(tokens),
        "entity": K.entity_keys(entities, tokens),
    }
    for name, near in families.items():
        stage(f"{name}_edges", lambda near=near, name=name: E.bipartite_edges(parsed, key, near, both_ways=name != "adjacent", disjoint=True))
    lemmas = parsed.select("id", F.transform("tokens", lambda t: t["lemma"]).alias("lemmas"))
    sampled = lemmas.filter(sample_by_hash(key, config.phrases.sample_rate, "phrases")) if config.phrases.sample_rate < 1 else lemmas
    rows = ngrams.ngram_rows(sampled.withColumn("part", hash_bucket(key, PARTS)), F.col("lemmas"), config.phrases.longest, "part")
    model = stage("ngrams", lambda: ngrams.mine_ngrams(rows, config.phrases.support, "part" if config.phrases.part_support > 1 else None, config.phrases.part_support))
    phrases = stage("phrases", lambda: ngrams.annotate(lemmas, "id", "lemmas", model, config.phrases.longest))
    stage("ngram_edges", lambda: E.bipartite_edges(phrases, key, K.ngram_keys(F.col("ngrams")), disjoint=True))
    bags = stage("bow", lambda: parsed.join(phrases, "id").select("id", "sent_text", ngrams.full_bag(tokens, entities, F.col("ngrams"), F.col("mesh_headings")).alias("bow")))
    vectors = stage("embeddings", lambda: hooks.embed(bags, "id", "bow", config.vectors.dimensions).withColumn("hash", hash64(key)))
    names = stage("names", lambda: E.gathered(vectors.select("hash", F.col("id").alias("name")), "hash", "name"))

    def neighbours() -> DataFrame:
        v, own = config.vectors, vectors.dropDuplicates(["hash"])
        index = VectorIndex.train(own, "hash", "embedding", v.cells, v.parts, v.bits, rate=v.train_rate)
        coded = stage("codes", lambda: index.encode(own, "hash", "embedding").repartitionByRange("cell"))
        return index.search(coded, own, "hash", "embedding", v.neighbours, v.probes)

    near = stage("neighbours", neighbours)
    stage("knn_edges", lambda: E.both_directions(knn.named(near, names.select("hash", F.explode("values").alias("name")))).distinct())
    if predications is not None:
        stage("predicate_edges", lambda: predicates.predicate_edges(predicates.split_terms(predications)))
    stage("graph", lambda: store.union("_edges").select("src", "dst").distinct())
    stage("sentence_store", lambda: to_kv(bags, F.col("id"), F.struct("bow", F.col("sent_text").alias("text"))))
    return store
