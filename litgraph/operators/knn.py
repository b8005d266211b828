"""Nearest neighbours: exact in blocks, and cells and codes by given centres as column expressions. `vector_index` has the index that
scales."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import squared_distance
from .ordering import top_per_group

#: Rows and queries of a task of the exact search.
ROWS, QUERIES = 16_384, 2048


def exact_knn(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, most_rows: int = ROWS, most_queries: int = QUERIES) -> DataFrame:
    """src, dst, dist (squared) and rank of the k nearest other rows of each query, for vectors that aren't null. Rows and queries are dealt to
    blocks whose number follows theirs; a pair of blocks is a task's piece of work, which multiplies matrices to find what may be among the
    k nearest, measures that exactly and passes on k rows for each query."""
    kind = rows.schema[key].dataType.simpleString()
    asked, held = (df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x")) for df in (queries, rows))
    vb, qb = max(1, -(-held.count() // most_rows)), max(1, -(-asked.count() // most_queries))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.withColumn("v", deal(vb)).withColumn("q", spread(qb))
    right = asked.withColumn("q", deal(qb)).withColumn("v", spread(vb))

    def scan(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        src, dst, dist = [], [], []
        if len(block) and len(wanted):
            block = block.sort_values("id", kind="stable")
            ids, x = block["id"].to_numpy(dtype=object), np.stack(block["x"].to_numpy())
            own = (x**2).sum(axis=1)
            for at in range(0, len(wanted), 64):
                names, q = wanted["id"].to_numpy(dtype=object)[at : at + 64], np.stack(wanted["x"].to_numpy()[at : at + 64])
                rough = own + (q**2).sum(axis=1)[:, None] - 2 * q @ x.T
                for name, v, r in zip(names, q, rough):
                    bound = np.partition(r, k)[k] if len(r) > k + 1 else np.inf
                    near = np.flatnonzero(r <= bound + 1e-6 * (1 + abs(bound)))
                    near = near[ids[near] != name]
                    d = ((x[near] - v) ** 2).sum(axis=1).round(9)
                    best = np.argsort(d, kind="stable")[:k]
                    src += [name] * len(best)
                    dst += ids[near[best]].tolist()
                    dist += d[best].tolist()
        return pd.DataFrame({"src": pd.Series(src, dtype=object), "dst": pd.Series(dst, dtype=object), "dist": pd.Series(dist, dtype=float)})

    found = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInPandas(scan, f"src {kind}, dst {kind}, dist double")
    return top_per_group(found, ["src"], [F.col("dist"), F.col("dst")], k)


def nearest(vector: Column, centers: np.ndarray) -> Column:
    """Index of the nearest centre, as a column expression; ties go to the smaller index."""
    options = F.array(*(F.struct(F.round(squared_distance(vector, F.array(*map(F.lit, c))), 9).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers.tolist())))
    return F.array_min(options)["i"]


def lloyd(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    centers = sample[np.sort(rng.choice(len(sample), min(k, len(sample)), replace=False))].astype(np.float64)
    for _ in range(rounds):
        near = np.concatenate([((centers**2).sum(1) - 2 * sample[at : at + 4096] @ centers.T).argmin(1) for at in range(0, len(sample), 4096)])
        count, total = np.bincount(near, minlength=len(centers)), np.zeros_like(centers)
        np.add.at(total, near, sample)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return centers


class IvfPq:
    """Coarse cells and per-subspace codebooks; rows become (key, cell, codes)."""

    def __init__(self, coarse: np.ndarray, books: list[np.ndarray]) -> None:
        self.coarse, self.books = coarse, books
        self.width = books[0].shape[1]

    @staticmethod
    def train(sample: np.ndarray, cells: int, parts: int, codes: int) -> IvfPq:
        if sample.shape[1] % parts:
            raise ValueError("the dimension must be a multiple of the number of parts")
        width = sample.shape[1] // parts
        return IvfPq(lloyd(sample, cells), [lloyd(sample[:, i * width : (i + 1) * width], codes, seed=i + 1) for i in range(parts)])

    def encode(self, rows: DataFrame, key: str, vector: str) -> DataFrame:
        codes = F.array(*(nearest(F.slice(F.col(vector), i * self.width + 1, self.width), b).cast("short") for i, b in enumerate(self.books)))
        return rows.select(key, nearest(F.col(vector), self.coarse).alias("cell"), codes.alias("codes"))

    @staticmethod
    def merge(*indexes: DataFrame) -> DataFrame:
        """Parts of one index, encoded apart, as one."""
        return reduce(DataFrame.unionByName, indexes)


def named(neighbours: DataFrame, names: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """src and dst as names, from neighbours by hash and names (hash, name); a hash may have several names. Hashes without a name go, and so
    do rows of a name and itself."""
    root = names.select(F.col("hash").alias(src), F.col("name").alias("_root"))
    near = names.select(F.col("hash").alias(dst), F.col("name").alias("_near"))
    return neighbours.join(root, src).join(near, dst).filter("_root <> _near").select(F.col("_root").alias("src"), F.col("_near").alias("dst")).distinct()


def to_matrix(rows: DataFrame, key: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded table as arrays, by Arrow."""
    table = rows.select(key, vector).toArrow()
    flat = table.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table.column(0).to_numpy().astype(np.int64), flat.reshape(table.num_rows, -1).astype(np.float32)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The share of the exact pairs (src, dst) that were found."""
    hit = found.select("src", "dst", F.lit(1).alias("hit")).distinct()
    return exact.join(hit, ["src", "dst"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def knn_edges(neighbours: DataFrame, prefix: str = "s:") -> DataFrame:
    """Both directions of each found pair, as keys."""
    a, b = F.concat(F.lit(prefix), F.col("src").cast("string")), F.concat(F.lit(prefix), F.col("dst").cast("string"))
    return neighbours.select(F.explode(F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst")))).alias("e")).select("e.*").distinct()
