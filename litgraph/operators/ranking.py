"""Term pairs: neighbourhoods, a default scorer, negatives, and ranking metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot
from ..functions.hashing import hash64, sample_by_hash
from ..functions.keys import is_type
from ..plans.stage import scratch
from .ordering import dense_ids, global_row_number, top_per_group


def neighbour_rows(pairs: DataFrame, edges: DataFrame, kind: str | None = "predicate") -> DataFrame:
    """subj, obj, neighbour, and whether it is the subject's (s) and the object's (o): 0 or 1. Only neighbours of type `kind`, if it is
    given. Set work is done on edges, so no node's neighbours are gathered in a row."""
    if kind is not None:
        edges = edges.filter(is_type(F.col("dst"), kind))
    pairs = pairs.select("subj", "obj").distinct()
    side = lambda end, s, o: pairs.join(edges.select(F.col("src").alias(end), F.col("dst").alias("neighbour")), end).select("subj", "obj", "neighbour", F.lit(s).alias("s"), F.lit(o).alias("o"))
    return side("subj", 1, 0).unionByName(side("obj", 0, 1)).groupBy("subj", "obj", "neighbour").agg(F.max("s").alias("s"), F.max("o").alias("o"))


def disjoint_neighbourhoods(pairs: DataFrame, edges: DataFrame, kind: str | None = "predicate") -> DataFrame:
    """subj, obj, and how many neighbours only the subject has, only the object has, both have, and either has; for pairs whose terms both
    are in the graph. `missing_pairs` reports the others."""
    ends = pairs.select(F.explode(F.array("subj", "obj")).alias("src")).distinct()
    edges = scratch(edges.select("src", "dst").join(ends, "src", "left_semi"))  # read once for the vocabulary and once for each side
    own = in_vocabulary(pairs.select("subj", "obj").distinct(), edges.select(F.col("src").alias("node")).distinct())
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    s, o = F.col("s") == 1, F.col("o") == 1
    counts = neighbour_rows(pairs, edges, kind).groupBy("subj", "obj").agg(n(s & ~o)("n_subj"), n(o & ~s)("n_obj"), n(s & o)("n_both"), F.count(F.lit(1)).alias("n_any"))
    return own.join(counts, ["subj", "obj"], "left").fillna(0, ["n_subj", "n_obj", "n_both", "n_any"])


def missing_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs of which a term isn't among the nodes."""
    known = in_vocabulary(pairs.select("subj", "obj").distinct(), nodes)
    return pairs.join(known, ["subj", "obj"], "left_anti")


def sampled_neighbourhoods(pairs: DataFrame, edges: DataFrame, n: int, seed: str = "", kind: str | None = "predicate") -> DataFrame:
    """subj, obj, side (subj or obj), and at most n of the neighbours that only this side has, picked and ordered by hash."""
    rows = neighbour_rows(pairs, edges, kind).filter("s <> o").withColumn("side", F.when(F.col("s") == 1, "subj").otherwise("obj"))
    top = top_per_group(rows, ["subj", "obj", "side"], [hash64(F.concat("neighbour", F.lit(seed))), F.col("neighbour")], n)
    return top.groupBy("subj", "obj", "side").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"]).alias("neighbours"))


def sample_neighbours(items: Column, n: int, seed: str) -> Column:
    """All items, or n of them picked by hash."""
    keyed = F.sort_array(F.transform(items, lambda x: F.struct(hash64(F.concat(x, F.lit(seed))).alias("h"), x.alias("x"))))
    return F.transform(F.slice(keyed, 1, n), lambda s: s["x"])


def overlap_score(neighbourhoods: DataFrame) -> DataFrame:
    """The default scorer: shared over all neighbours."""
    return neighbourhoods.withColumn("score", F.coalesce(F.try_divide(F.col("n_both"), F.col("n_any")), F.lit(0.0)))


def predict_pairs(pairs: DataFrame, edges: DataFrame, kind: str | None = None) -> DataFrame:
    """Scores of (ord, subj, obj), 0 for terms the graph lacks, in the order asked."""
    scored = overlap_score(disjoint_neighbourhoods(pairs, edges, kind)).select("subj", "obj", "score")
    return pairs.join(scored, ["subj", "obj"], "left").select("ord", "subj", "obj", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy("ord")


FEATURES = ["overlap", "log_both", "log_subj", "log_obj", "cosine"]


def pair_features(pairs: DataFrame, edges: DataFrame, vectors: DataFrame, kind: str | None = "predicate") -> DataFrame:
    """The pairs with what a scorer looks at: shared over all neighbours, logarithms of one plus the shared and the disjoint ones, and the
    cosine of the terms' vectors (name, embedding; 0 where one is missing)."""
    counts = overlap_score(disjoint_neighbourhoods(pairs, edges, kind))
    end = lambda e: vectors.select(F.col("name").alias(e), F.col("embedding").alias(f"_{e}"))
    both = pairs.join(counts, ["subj", "obj"]).join(end("subj"), "subj", "left").join(end("obj"), "obj", "left")
    length = F.sqrt(dot(F.col("_subj"), F.col("_subj")) * dot(F.col("_obj"), F.col("_obj")))
    more = {f"log_{c}": F.log1p(F.col(f"n_{c}").cast("double")) for c in ("both", "subj", "obj")}
    cosine = F.coalesce(F.try_divide(dot(F.col("_subj"), F.col("_obj")), length), F.lit(0.0))
    return both.withColumns({"overlap": F.col("score"), "cosine": cosine, **more}).select(*pairs.columns, *FEATURES)


def fit_scorer(features: DataFrame, label: str = "label"):
    """A logistic regression over the features, as a pipeline model; `score_with` applies it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label, regParam=1e-3)]).fit(features)


def score_with(model, features: DataFrame) -> DataFrame:
    """The features' rows with score, the probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(features).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("_x", "rawPrediction", "probability", "prediction")


def dropped_by_label(pairs: DataFrame, nodes: DataFrame, label: str = "label") -> DataFrame:
    """How many pairs of each label the vocabulary filter drops."""
    return missing_pairs(pairs, nodes).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def in_vocabulary(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pairs.join(nodes.select(F.col("node").alias("subj")), "subj", "left_semi").join(nodes.select(F.col("node").alias("obj")), "obj", "left_semi")


def split_rows(rows: DataFrame, key: Column, rate: float, seed: str = "validation") -> DataFrame:
    return rows.withColumn("is_validation", sample_by_hash(key, rate, seed))


def negative_pairs(positives: DataFrame, terms: DataFrame, rate: int, seed: str = "swap", objects: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """For each (subj, obj), `rate` pairs of terms picked by hash; those that are positives (or among `known`, if given) go. With `objects`,
    only subjects are picked from `terms`."""
    subj_ids = dense_ids(terms, "term")
    obj_ids = subj_ids if objects is None else dense_ids(objects, "term")
    sizes = {"s": subj_ids.count(), "o": obj_ids.count()}
    draws = positives.select("subj", "obj", F.explode(F.sequence(F.lit(1), F.lit(rate))).alias("draw"))
    pick = lambda end: hash64(F.concat_ws("|", "subj", "obj", F.col("draw").cast("string"), F.lit(seed + end))) % max(sizes[end], 1)
    drawn = draws.select("subj", "obj", "draw", pick("s").alias("i"), pick("o").alias("j"))
    a, b = subj_ids.select(F.col("id").alias("i"), F.col("term").alias("neg_subj")), obj_ids.select(F.col("id").alias("j"), F.col("term").alias("neg_obj"))
    out = drawn.join(a, "i").join(b, "j").select("subj", "obj", "draw", "neg_subj", "neg_obj")
    known = positives if known is None else known
    return out.join(known.select(F.col("subj").alias("neg_subj"), F.col("obj").alias("neg_obj")).distinct(), ["neg_subj", "neg_obj"], "left_anti")


def negative_numbers(pairs: DataFrame, subj: Callable[[str], Column], obj: Callable[[str], Column], rate: int, seed: str = "swap", parts: int = 0) -> DataFrame:
    """`negative_pairs` of distinct pairs of numbers s and o, a table whose names are subj(s) and obj(o), among the terms of both ends; no
    subject may have an object's name. Numbers are exchanged, names are made where they are hashed or returned. Only a subject drawn with
    an object can be a known pair, so no other draw meets the pairs again; both kinds read the same exchange. As in SQL, a pair with a null
    has no draws, and null is the last term and equals itself among the known. `parts`: of each exchange of draws, if given."""
    side = lambda c, name, kind: pairs.filter(F.col(c).isNotNull()).select(F.col(c).alias("number")).distinct().select("number", F.lit(kind).alias("ks"), F.lit(kind).alias("ko"), name("number").alias("term"))
    null = pairs.filter("s IS NULL OR o IS NULL").select(F.lit(None).cast("long").alias("number"), F.lit(0).alias("ks"), F.lit(1).alias("ko"), F.lit(None).cast("string").alias("term")).distinct()
    terms = side("s", subj, 0).unionByName(side("o", obj, 1)).unionByName(null)
    ids = scratch(global_row_number(terms, [F.col("term").asc_nulls_last()], "id").select((F.col("id") - 1).alias("id"), "number", "ks", "ko"))
    n = max(ids.count(), 1)
    dealt = lambda rows, key: rows.repartition(parts, key) if parts else rows
    draws = pairs.dropna().select("s", "o", F.explode(F.sequence(F.lit(1), F.lit(rate))).alias("draw"))
    # never null: a filter on that would make each hash twice
    pick = lambda end: F.coalesce(hash64(F.concat_ws("|", subj("s"), obj("o"), F.col("draw").cast("string"), F.lit(seed + end))) % n, F.lit(-1))
    drawn = draws.select("s", "o", pick("s").alias("i"), (pick("o") * rate + F.col("draw") - 1).alias("jd"))
    term = lambda key, number, kind: ids.select(F.col("id").alias(key), F.col("number").alias(number), kind)
    half = dealt(drawn, F.col("i")).join(dealt(term("i", "ns", "ks"), F.col("i")), "i").select("s", "o", "ns", (F.col("jd") * 2 + F.col("ks")).alias("jd"))
    j = F.expr(f"jd div {2 * rate}")
    whole = dealt(half, j).join(dealt(term("j", "no", "ko"), F.col("j")), j == F.col("j"))
    both, ks = F.col("ko") > F.col("jd") % 2, F.col("jd") % 2
    known = pairs.select(F.col("s").alias("known_s"), F.col("o").alias("known_o"))
    out = whole.filter(~both).select("s", "o", "ns", "no", "jd", "ko").unionByName(whole.filter(both).select("s", "o", "ns", "no", "jd", "ko").join(known, F.col("ns").eqNullSafe(F.col("known_s")) & F.col("no").eqNullSafe(F.col("known_o")), "left_anti"))
    name = lambda kind, c: F.when(kind == 0, subj(c)).otherwise(obj(c))
    draw = (F.expr("jd div 2") % rate + 1).cast("int")
    return out.select(name(ks, "ns").alias("neg_subj"), name(F.col("ko"), "no").alias("neg_obj"), subj("s").alias("subj"), obj("o").alias("obj"), draw.alias("draw"))


def scrambled_neighbourhoods(positives: DataFrame, predicates: DataFrame, rate: int, n: int, seed: str = "scramble") -> DataFrame:
    """For each (subj, obj), `rate` draws of n predicates for either side, picked by hash among all: subj, obj, draw, k (from 1; the subject's
    are the first n) and predicate. What a scorer must not take for the pair's own neighbourhood."""
    numbered = dense_ids(predicates, "predicate")
    total = numbered.count()
    draws = positives.select("subj", "obj", F.explode(F.sequence(F.lit(1), F.lit(rate))).alias("draw")).select("*", F.explode(F.sequence(F.lit(1), F.lit(2 * n))).alias("k"))
    at = hash64(F.concat_ws("|", "subj", "obj", F.col("draw").cast("string"), F.col("k").cast("string"), F.lit(seed))) % max(total, 1)
    return draws.withColumn("id", at).join(numbered, "id").select("subj", "obj", "draw", "k", "predicate")


def batch_means(rows: DataFrame, batch: str, *metrics: str) -> DataFrame:
    """The mean over batches of each metric's mean in a batch."""
    return rows.groupBy(batch).agg(*(F.avg(m).alias(m) for m in metrics)).agg(*(F.avg(m).alias(m) for m in metrics))


def ranked(rows: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """rank by falling score; positives come first among equals."""
    return global_row_number(rows, [F.desc(score), F.desc(label), F.col(tie)], "rank")


def roc_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Rank-sum area: for each score, negatives below it and half of those equal to it, over all pairs."""
    by_score = rows.groupBy(score).agg(F.sum(label).cast("long").alias("p"), F.count(F.lit(1)).alias("n")).withColumn("neg", F.col("n") - F.col("p"))
    running = running_sums(by_score, [F.col(score)], {"neg": "below"})
    total = running.agg(F.sum(F.col("p") * (F.col("below") - F.col("neg") + F.col("neg") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("neg").alias("q"))
    return total.select((F.col("u") / (F.col("p") * F.col("q"))).alias("auc"))


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running sums along a global order, by ranges: each range's own sums, plus what all ranges before it hold."""
    dealt = scratch(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for c, n in sums.items()))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_range", *(F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)).alias(f"_{n}") for n in sums.values()))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(before), "_range")
    return out.withColumns({n: F.sum(c).over(own) + F.col(f"_{n}") for c, n in sums.items()}).drop("_range", *(f"_{n}" for n in sums.values()))


def average_precision(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the precision-recall steps, one step for each score."""
    by_score = rows.groupBy(score).agg(F.sum(label).cast("long").alias("p"), F.count(F.lit(1)).alias("n"))
    running = running_sums(by_score, [F.desc(score)], {"p": "hits", "n": "seen"})
    return running.agg((F.sum(F.col("p") * F.col("hits") / F.col("seen")) / F.sum("p")).alias("ap"))


def at_k(rows: DataFrame, label: str, k: int) -> DataFrame:
    """Precision and average precision of the first k ranks, the latter over the hits found there; and the first hit's reciprocal rank."""
    top = rows.filter(F.col("rank") <= k)
    hits = top.withColumn("hits", F.sum(label).over(Window.orderBy("rank")))  # k rows
    found = hits.agg((F.sum(label) / F.count(F.lit(1))).alias("precision"), F.coalesce(F.try_divide(F.sum(F.col(label) * F.col("hits") / F.col("rank")), F.sum(label).cast("double")), F.lit(0.0)).alias("average_precision"))
    return found


def reciprocal_rank(rows: DataFrame, label: str) -> DataFrame:
    return rows.filter(F.col(label) == 1).agg((1.0 / F.min("rank")).alias("rr"))


def balanced(rows: DataFrame, label: str, order: list[Column]) -> DataFrame:
    """As many rows of each label as the rarest one has, first ones first. Rows are numbered along one order by ranges, so a label of most rows
    is many tasks."""
    numbered = global_row_number(rows, [F.col(label), *order], "_k")
    first = numbered.groupBy(label).agg(F.min("_k").alias("_first"), F.count(F.lit(1)).alias("_n")).collect()  # one row for each label
    if not first:
        return rows
    least, own = min(r["_n"] for r in first), rows.sparkSession.createDataFrame([(r[label], r["_first"]) for r in first], rows.select(label).schema.add("_first", "long"))
    own = own.withColumnRenamed(label, "_label")
    return numbered.join(F.broadcast(own), F.col(label).eqNullSafe(F.col("_label"))).filter(F.col("_k") < F.col("_first") + least).drop("_k", "_first", "_label")


def percent_positive(rows: DataFrame, group: str, label: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("share"))


def masked_accuracy(rows: DataFrame, heads: dict[str, tuple[str, str]], padding: int = 0) -> DataFrame:
    """For each head, given by the columns of what it predicts and of what is right, the share of right ones where that isn't padding."""
    return rows.agg(*(F.avg(F.when(F.col(right) != padding, (F.col(guess) == F.col(right)).cast("int"))).alias(head) for head, (guess, right) in heads.items()))
