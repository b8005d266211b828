"""A training-data pipeline: toxic documents go, one document of each near-duplicate group stays, benchmark passages are cut, personal
data is masked, and what is left is packed into sequences. Stages take (spark, docs, sf_dir); all but the last return the columns of
documents. Between stages `run` writes Parquet to the shared folder."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgraph.llm.common import drop, small_batches, table, written
from litgraph.llm.decontaminate import cut_spans, match_benchmark
from litgraph.llm.jaccard_join import link_documents
from litgraph.llm.packing import default_tokenizer, pack
from litgraph.llm.pii import find_spans, redact, train_detector
from litgraph.llm.toxicity import THRESHOLD, learn, score_toxicity

#: Near duplicates: five words a shingle, a similarity of at least four fifths.
NEAR = {"words": 5, "num": 4, "den": 5}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose score reaches the threshold. Null and empty texts have the lowest score and stay; equal texts go or stay
    together; without labels of both classes nothing is learnt: all stay, or all go where every label is toxic."""
    field = learn(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select(COLUMNS), field, offsets=False).filter(F.col("toxic_score") < THRESHOLD).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest id. Where an id has several texts, told apart by 128 bits, each text is a
    document of its own, so rows that share an id go only if their texts link or are equal. Null and empty texts link with nothing, so of
    them only repeated rows go. Rows with a null id are no one's duplicate and stay. Ids and hashes settle what stays; a text moves once,
    and once more where ids have several texts."""
    docs = docs.select(COLUMNS)
    rows = docs.filter("doc_id is not null").withColumns({f"h{k}": F.xxhash64(F.lit(k), "text") for k in (1, 2)})
    seen = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *(f(h).alias(f"{f.__name__}_{h}") for f in (F.min, F.max) for h in ("h1", "h2")))
    repeated = written(seen.filter("n > 1").select((F.expr("min_h1 <> max_h1 OR min_h2 <> max_h2")).alias("several")), "pipeline-repeated")
    if repeated.filter("several").isEmpty():
        groups = link_documents(rows, **NEAR)
        kept = rows.join(groups.filter("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti")
        kept = kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id"])
    else:
        told = ["doc_id", "h1", "h2"]
        nodes = written(rows.select(told).distinct().withColumn("node", F.monotonically_increasing_id()), "pipeline-nodes")
        rows = written(rows.join(nodes, told).dropDuplicates(["node"]), "pipeline-rows")
        groups = link_documents(rows, "node", **NEAR).select(F.col("doc_id").alias("node"), "component_id")
        ids = nodes.select("node", "doc_id").join(groups, "node")
        first = written(ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("one")).select("one.node"), "pipeline-first")
        kept = rows.join(first, "node", "left_semi")
    drop(repeated)
    return kept.select(COLUMNS).unionByName(docs.filter("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in benchmark windows are cut; documents of which they are more than half go. Null and empty texts have no words and stay;
    each row is judged alone, whatever its id; an empty benchmark cuts nothing."""
    return _documents(cut_spans(match_benchmark(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")), max_coverage=0.5))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span becomes the name of its kind in brackets. Null and empty texts have no spans; each row is judged alone; the detector
    learns from these documents, and without any that has personal data only the base rules hold."""
    docs = docs.select(COLUMNS)
    return _documents(redact(find_spans(docs, train_detector(docs, "doc_id"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences. A null or empty text is one piece, its end id; repeated rows are packed each; a null id stays null; without
    documents there are no sequences."""
    return pack(docs.select("doc_id", "text"), default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: The first stage's scores come from a trained model, which SQL can't express.
ORACLE_SQL = None


def _small(stage):
    """Any stage's texts go to Python workers in small batches."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _small(stage)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(before, "path_"):
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
