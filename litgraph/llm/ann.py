"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes with error bounds, then exact reranking.

Vectors are dealt to cells by k-means (fitted on a bounded sample; every vector is indexed). In its cell a vector keeps its residual's
length, the signs of the randomly rotated residual as packed bits, and the inner product of residual and code. From the bits and a query
rotated and quantised to four bits, an inner product is estimated by popcounts, with a bound on its error. In each block of a cell, a
query reranks by exact double-precision products all vectors whose upper bound reaches the k-th best lower bound.

A query probes the cells of the largest products with its centroid until they hold the share `probe` of all vectors. Unless it is given,
that share is learnt: the true neighbours of PILOT queries are found by going through all vectors, and the share is the one that reaches
RECALL of them, so vectors that cluster cost few cells, and others are not lost. Equal vectors are
indexed once with their k + 1 smallest ids (ties go to smaller ids, so no other id of the group can be among the nearest k), equal
queries search once, and cells and query lists are cut into blocks of BLOCK rows; so neither a vector that a third of the rows share
nor a large cell comes to one task.

Edge cases: vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do those whose dimension is not
the most frequent one (the smaller one, if equally frequent); rows that repeat id and vector count once; a query with fewer than k
candidates gets all that its cells hold (tables of up to BLOCK rows have one cell, hence all of them); null ids take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, drop, table, written

BLOCK = 8192
SAMPLE = 20_000
MAX_CELLS = 4096
PILOT = 64
RECALL = 0.98
EPSILON = 2.4
QUERY_BITS = 4


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest_center(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def nearest_center(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centers.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def rotation(d: int, seed: int = 2) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """(n, d) booleans as (n, words) 64-bit words."""
    n, d = bits.shape
    b = np.packbits(np.pad(bits, ((0, 0), (0, -d % 64))), axis=1, bitorder="little")
    return b.view("<u8").reshape(n, -1)


def encode(x: np.ndarray, centers: np.ndarray, cells: np.ndarray, p: np.ndarray):
    """Packed signs, residual lengths and <residual direction, code direction>."""
    r = x.astype(np.float64) - centers[cells]
    length = np.linalg.norm(r, axis=1)
    turned = (r / np.maximum(length, 1e-30)[:, None]) @ p
    return packed(turned > 0), length, np.abs(turned).sum(1) / np.sqrt(x.shape[1])


def estimate(codes: np.ndarray, length: np.ndarray, agree: np.ndarray, q: np.ndarray, p: np.ndarray, center: np.ndarray, epsilon: float = EPSILON):
    """(queries, vectors) estimates of inner products, and the bound of their error.

    The turned query is quantised to QUERY_BITS bits between its extremes; its product with a code needs the bits set in both, plane by
    plane. The quantisation adds at most half a step for each dimension to the bound.
    """
    d = q.shape[1]
    turned = q @ p
    low, high = turned.min(1, keepdims=True), turned.max(1, keepdims=True)
    step = np.maximum((high - low) / (2**QUERY_BITS - 1), 1e-30)
    levels = np.rint((turned - low) / step).astype(np.int64)
    inside = np.zeros((len(q), len(codes)))
    for j in range(QUERY_BITS):
        plane = packed((levels >> j & 1).astype(bool))
        for w in range(codes.shape[1]):
            inside += np.bitwise_count(plane[:, w, None] & codes[None, :, w]) * float(1 << j)
    ones = np.bitwise_count(codes).sum(1).astype(np.float64)
    # A code is (2 bit - 1) / sqrt(d) in each dimension.
    product = (2 * (step * inside + low * ones) - (step[:, 0] * levels.sum(1) + low[:, 0] * d)[:, None]) / np.sqrt(d)
    safe = np.maximum(agree, 1e-9)
    guess = q @ center
    guess = guess[:, None] + length * product / safe
    spread = np.sqrt(np.maximum(1 - agree**2, 0)) / safe
    error = np.linalg.norm(q, axis=1)[:, None] * (length * spread * epsilon / np.sqrt(max(d - 1, 1))) + step * (length / safe / 2)
    return guess, error


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products in double precision, summed dimension by dimension, so that the order of rows or blocks changes no bit."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[j]
    return out


def valid(rows: DataFrame) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & fine)
    sizes = sorted((-r[1], r[0]) for r in rows.groupBy(F.size("embedding")).count().collect())
    return rows.filter(F.size("embedding") == (sizes[0][1] if sizes else 0))


def learnt_probe(coded: DataFrame, queries: DataFrame, centers: np.ndarray, sizes: np.ndarray, k: int) -> float:
    """The share of all vectors that a query's cells must hold, best cells first, for RECALL of the pilot queries' true neighbours."""
    pilot = np.array([r[0] for r in queries.orderBy(F.xxhash64("embedding"), "qid").limit(PILOT).select("embedding").collect()], np.float64)
    shared = coded.sparkSession.sparkContext.broadcast(pilot)

    def run(batches):
        q = shared.value
        for b in batches:
            if len(b):
                score = q @ np.stack(b["embedding"].to_numpy()).astype(np.float64).T
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"q": np.repeat(np.arange(len(q)), best.shape[1]), "score": np.take_along_axis(score, best, 1).ravel(), "cell": b["cell"].to_numpy()[best.ravel()]})

    near = coded.select("cell", "embedding").mapInPandas(run, "q long, score double, cell long")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("n") <= k).select("q", "cell").collect()
    order = np.argsort(-(pilot @ centers.T), axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1) / sizes.sum()
    place = np.argsort(order, axis=1)
    return float(np.quantile([held[q, place[q, c]] for q, c in near], RECALL, method="higher"))


def search(rows: DataFrame, queries: DataFrame, k: int = 20, probe: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for rows and queries of (vec_id, embedding). Vectors keep their type, floats or doubles."""
    spark = rows.sparkSession
    single = all(d.schema["embedding"].dataType.simpleString() == "array<float>" for d in (rows, queries))
    vector = "array<float>" if single else "array<double>"
    rows, queries = (d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(vector).alias("embedding")) for d in (rows, queries))
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    own = valid(rows).dropDuplicates(["vec_id", "embedding"]).withColumn("n", first).filter(F.col("n") <= k + 1)
    index = written(own.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-vectors")
    total = index.count()
    sample = np.array([r[0] for r in bounded_sample(index, "embedding", SAMPLE, total).select("embedding").collect()], np.float64)
    asked = valid(queries).dropDuplicates(["vec_id", "embedding"])
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_cells = 1 if total <= BLOCK else min(MAX_CELLS, len(sample), max(1, round(np.sqrt(total) / 2)))
    centers = kmeans(sample, n_cells)
    p = rotation(sample.shape[1])
    shared = spark.sparkContext.broadcast((centers, p))

    def build(batches):
        c, turn = shared.value
        for b in batches:
            if len(b):
                x = np.stack(b["embedding"].to_numpy()).astype(np.float64)
                cells = nearest_center(x, c)
                codes, length, agree = encode(x, c, cells, turn)
                yield pd.DataFrame({"cell": cells, "ids": b["ids"], "embedding": b["embedding"], "code": [r.tobytes() for r in codes], "length": length, "agree": agree})

    coded = written(index.mapInPandas(build, f"cell long, ids array<long>, embedding {vector}, code binary, length double, agree double"), "ann-codes")
    drop(index)
    sizes = np.zeros(n_cells, np.int64)
    for r in coded.groupBy("cell").count().collect():
        sizes[r[0]] = r[1]
    v_blocks = np.maximum(1, -(-sizes // BLOCK))

    def probes(batches):
        c, _ = shared.value
        for b in batches:
            if len(b):
                q = np.stack(b["embedding"].to_numpy()).astype(np.float64)
                order = np.argsort(-(q @ c.T), axis=1, kind="stable")
                enough = np.cumsum(sizes[order], axis=1) >= probe * total - 0.5
                n = np.minimum(enough.argmax(1) + 1, n_cells)
                who = np.repeat(np.arange(len(b)), n)
                cell = np.concatenate([o[:m] for o, m in zip(order, n, strict=True)])
                yield pd.DataFrame({"cell": cell, "qid": b["qid"].to_numpy()[who], "embedding": b["embedding"].to_numpy()[who]}).loc[sizes[cell] > 0]

    distinct = written(asked.groupBy("embedding").agg(F.min("vec_id").alias("qid")), "ann-queries")
    if probe is None and n_cells > 1 and not distinct.isEmpty():
        probe = learnt_probe(coded, distinct, centers, sizes, k)
    probe = 1.0 if probe is None else probe
    routed = written(distinct.repartition(2 * spark.sparkContext.defaultParallelism).mapInPandas(probes, f"cell long, qid long, embedding {vector}"), "ann-routed")
    asked_of = {r[0]: r[1] for r in routed.groupBy("cell").count().collect()}
    q_blocks = np.array([max(1, -(-asked_of.get(c, 0) // BLOCK)) for c in range(n_cells)])
    blocks = spark.createDataFrame(pd.DataFrame({"cell": np.arange(n_cells), "vb": v_blocks, "qb": q_blocks}), "cell long, vb long, qb long")
    left = coded.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("embedding"), "vb").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)).alias("q"), "ids", "embedding", "code", "length", "agree")
    right = routed.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vb") - 1)).alias("v"), F.pmod(F.xxhash64("qid"), "qb").alias("q"), "qid", "embedding")

    def scan(vectors: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(wanted):
            c, turn = shared.value
            vectors = vectors.sort_values("ids", key=lambda s: s.str[0])
            x = np.stack(vectors["embedding"].to_numpy()).astype(np.float64)
            codes = np.frombuffer(b"".join(vectors["code"]), "<u8").reshape(len(x), -1)
            length, agree, ids = vectors["length"].to_numpy(), vectors["agree"].to_numpy(), vectors["ids"].tolist()
            center = c[int(vectors["cell"].iloc[0])]
            all_q = np.stack(wanted["embedding"].to_numpy()).astype(np.float64)
            for at in range(0, len(all_q), 64):
                q = all_q[at : at + 64]
                guess, error = estimate(codes, length, agree, q, turn, center)
                for i, qid in enumerate(wanted["qid"].iloc[at : at + 64].tolist()):
                    near = np.arange(len(x))
                    if len(x) > k + 1:
                        least = np.partition(guess[i] - error[i], -k - 1)[-k - 1]
                        near = np.flatnonzero(guess[i] + error[i] >= least)
                    score = exact(x[near], q[i])
                    best = np.argsort(-score, kind="stable")[: k + 1]
                    pairs = sorted((-s, v) for s, j in zip(score[best].tolist(), near[best].tolist(), strict=True) for v in ids[j])[: k + 1]
                    out += [(qid, v, -s) for s, v in pairs]
        return pd.DataFrame(out, columns=["qid", "vec_id", "score"])

    keys = ["cell", "v", "q"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(scan, "qid long, vec_id long, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    named = asked.join(distinct, "embedding").select(F.col("vec_id").alias("query_id"), "qid")
    without_own = F.filter("near", lambda r: r["vec_id"] != F.col("query_id"))
    result = named.join(top, "qid").select("query_id", F.posexplode(F.slice(without_own, 1, k)).alias("i", "r"))
    return result.select("query_id", (F.col("i") + 1).alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))


def op6_ann(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0))
