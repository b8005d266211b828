"""A vector index whose size follows the data: coarse cells, product codes of the residuals, exact distances for the best candidates.

Cells are found by k-means over a sample that grows with their number, codes by k-means over the parts of the sample's residuals, one task
for each part. Vectors are sums of whole numbers on the way (2**30 steps over the largest component), so an index doesn't depend on how rows
were split. Centres come to the driver: cells x dimensions numbers, where cells grow as the root of the rows.

A search sends each query once to every group of neighbouring cells that it probes, not to every cell. A group's rows are dealt to blocks of
about BLOCK, and so are its queries, so a crowded cell is many tasks. In a task, a query's look-up table of squared distances
(parts x codes) is added up over the codes of the rows in its cells; the `candidates` best of the block are measured exactly and the k best
of these leave the task. How many cells to probe for a recall can be learnt from the true neighbours of a few queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash64
from ..plans.stage import drop, scratch
from .knn import exact_knn, lloyd
from .ordering import top_per_group

#: Rows and queries of a task; least and most training vectors for each cell or code; rows from whose neighbours probes are learnt.
BLOCK, QUERIES, LEAST, PER_CENTER, LEARN_FROM = 16_384, 2048, 8, 64, 64
STEPS = 2.0**30


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows of numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances but for each row's own length, which doesn't change which centre is nearest."""
    return (centers**2).sum(axis=1) - 2 * x @ centers.T


def pieces(batches, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def k_means(sample: DataFrame, k: int, rounds: int, largest: float) -> np.ndarray:
    """k centres of the `vector`s of a table, which must hold k different ones at least. The first are those first by hash; a centre
    that no vector is nearest to starts again beside that with the most."""
    first = sample.groupBy("vector").agg(F.min("h").alias("h")).orderBy("h", "vector").limit(k).collect()  # k vectors
    if len(first) < k:
        raise ValueError(f"{k} cells need as many different training vectors; there are {len(first)}")
    centers = np.array([r.vector for r in first], np.float64)
    scale = STEPS / max(largest, 1e-300)

    def sums(batches, centers):
        total, count = np.zeros(centers.shape, np.int64), np.zeros(len(centers), np.int64)
        for b in pieces(batches):
            x = matrix(b.column("vector"))
            near = distances(x, centers).argmin(axis=1)
            np.add.at(total, near, np.rint(x * scale).astype(np.int64))
            count += np.bincount(near, minlength=len(centers))
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count[own]), pa.array(list(total[own]), pa.list_(pa.int64()))], ["cell", "n", "total"])

    def merged(batches):
        held = {}
        for b in batches:
            for cell, n, t in zip(b.column("cell").to_pylist(), b.column("n").to_pylist(), matrix_of_ints(b.column("total"))):
                m, s = held.get(cell, (0, 0))
                held[cell] = m + n, s + t
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([(s / scale / n) for n, s in held.values()], pa.list_(pa.float64()))], ["cell", "n", "mean"])

    for _ in range(rounds):
        partial = sample.select("vector").mapInArrow(lambda b, c=centers: sums(b, c), "cell long, n long, total array<long>")
        means = partial.repartition(1 + k // 256, "cell").mapInArrow(merged, "cell long, n long, mean array<double>").collect()  # k rows
        count, centers = np.zeros(k, np.int64), centers.copy()
        for r in means:
            count[r.cell], centers[r.cell] = r.n, r.mean
        for cell in np.flatnonzero(count == 0):
            most = int(count.argmax())
            shift = 1e-3 * np.where(np.arange(centers.shape[1]) % 2 == 0, 1, -1)
            centers[cell], centers[most] = centers[most] * (1 + shift), centers[most] * (1 - shift)
            count[cell] = count[most] = count[most] // 2
    return centers


def matrix_of_ints(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class VectorIndex:
    """centers: one row for each cell. books[p]: the codes' vectors of part p. groups[c]: the group of cell c."""

    centers: np.ndarray
    books: list[np.ndarray]
    groups: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = max(1, round(len(self.centers) ** 0.5))
        middle = lloyd(self.centers, n)
        self.groups = distances(self.centers, middle).argmin(axis=1)

    @property
    def wide(self) -> bool:
        """Codes take two bytes."""
        return max(map(len, self.books)) > 256

    @staticmethod
    def train(rows: DataFrame, key: str, vector: str, cells: int = 0, parts: int = 8, bits: int = 8, rounds: int = 8, rate: float = 1.0) -> VectorIndex:
        """From a sample by hash of the key: `rate` of the rows, but at least LEAST and at most PER_CENTER for each cell or code. cells = 0 takes the root
        of the number of rows. Settings are kept to or refused: parts must divide the dimension, bits be 1 to 16, and the sample hold as
        many different vectors as cells; a part has fewer codes only where the sample has fewer vectors."""
        kept = rows.filter(F.col(vector).isNotNull())
        facts = kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("most"), F.min(F.size(vector)).alias("least"), F.max(F.array_max(F.transform(vector, F.abs))).alias("largest")).first()
        if not facts.n or facts.most != facts.least or facts.most % parts or not 1 <= bits <= 16:
            raise ValueError(f"an index needs vectors of one length that {parts} parts divide, and 1 to 16 bits; lengths here are {facts.least} to {facts.most}")
        cells = cells or max(1, round(facts.n**0.5))
        wanted = min(max(rate * facts.n, LEAST * max(cells, 1 << bits)), PER_CENTER * max(cells, 1 << bits), facts.n)
        h = hash64(F.col(key).cast("string"))
        sample = kept.select(F.col(vector).cast("array<double>").alias("vector"), h.alias("h"))
        if wanted < facts.n:
            sample = sample.filter(F.pmod("h", F.lit(1 << 31)) < int((1 << 31) * wanted / facts.n))
        sample = scratch(sample.repartition(max(1, int(wanted) // 4096), "h"))
        centers = k_means(sample, cells, rounds, float(facts.largest))
        width = facts.most // parts

        def residuals(batches):
            for b in pieces(batches):
                x = matrix(b.column("vector"))
                left = x - centers[distances(x, centers).argmin(axis=1)]
                for p in range(parts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p)), b.column("h"), pa.array(list(left[:, p * width : (p + 1) * width]), pa.list_(pa.float64()))], ["part", "h", "x"])

        def book(part: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(part.sort_values("h", kind="stable")["x"].to_numpy())
            return pd.DataFrame({"part": part["part"].iloc[:1], "book": [lloyd(x, 1 << bits, seed=int(part["part"].iloc[0])).ravel()]})

        few = PER_CENTER << bits
        some = sample if wanted <= few else sample.filter(F.pmod(F.shiftright("h", 20), F.lit(1 << 31)) < int((1 << 31) * few / wanted))
        books = some.mapInArrow(residuals, "part long, h long, x array<double>").groupBy("part").applyInPandas(book, "part long, book array<double>").collect()  # one row for each part
        drop(sample)
        return VectorIndex(centers, [np.array(r.book).reshape(-1, width) for r in sorted(books)])

    def save(self, spark, path: str) -> None:
        """As a table: part (-1 for the centres), place, vector."""
        rows = [(p, i, v) for p, m in enumerate([self.centers, *self.books], -1) for i, v in enumerate(m.tolist())]
        spark.createDataFrame(rows, "part int, place int, vector array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> VectorIndex:
        held: dict[int, list] = {}
        for r in spark.read.parquet(path).orderBy("part", "place").collect():
            held.setdefault(r.part, []).append(r.vector)
        return VectorIndex(np.array(held[-1]), [np.array(held[p]) for p in sorted(held) if p >= 0])

    def encode(self, rows: DataFrame, key: str, vector: str) -> DataFrame:
        """key, cell, code (bytes, one or two for each part) and vector of each row that has one. Tables encoded apart are one by a union."""
        kind = np.uint16 if self.wide else np.uint8

        def coded(batches):
            for b in pieces(batches):
                x = matrix(b.column(1))
                cell = distances(x, self.centers).argmin(axis=1)
                left, code, at = x - self.centers[cell], np.zeros((len(x), len(self.books)), kind), 0
                for p, book in enumerate(self.books):
                    code[:, p] = distances(left[:, at : at + book.shape[1]], book).argmin(axis=1)
                    at += book.shape[1]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), b.column(1).cast(pa.list_(pa.float32()))], [key, "cell", "code", "vector"])

        kept = rows.filter(F.col(vector).isNotNull()).select(key, F.col(vector).alias("vector"))
        return kept.mapInArrow(coded, f"`{key}` {rows.schema[key].dataType.simpleString()}, cell int, code binary, vector array<float>")

    def write(self, index: DataFrame, path: str) -> None:
        """By ranges of cells and sorted by them, so that readers of some cells skip other files and row groups."""
        index.repartitionByRange("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(path)

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells of each row, nearest first."""
        return np.argsort(distances(x, self.centers), axis=1, kind="stable")[:, :probes]

    def learn_probes(self, index: DataFrame, key: str, k: int, share: float = 0.97) -> int:
        """How many cells must be probed so that `share` of true neighbours are among their rows, by the k nearest of LEARN_FROM rows."""
        some = index.select(key, "cell", "vector").orderBy(hash64(F.col(key).cast("string")), key).limit(LEARN_FROM)
        some = scratch(some)
        true = exact_knn(some, index, key, "vector", k)
        cells = index.select(F.col(key).alias("dst"), "cell")
        found = true.join(F.broadcast(some.select(F.col(key).alias("src"), F.col("vector").alias("q"))), "src").join(cells, "dst").select("q", "cell").toPandas()  # LEARN_FROM x k rows
        drop(some)
        if found.empty:
            return 1
        order = self.probed(np.stack(found["q"].to_numpy()).astype(np.float64), len(self.centers))
        rank = (order == found["cell"].to_numpy()[:, None]).argmax(axis=1)
        return int(np.quantile(rank, share, method="higher")) + 1

    def search(self, index: DataFrame, queries: DataFrame, key: str, vector: str, k: int, probes: int, candidates: int | None = None) -> DataFrame:
        """src, dst, dist (squared, exact) and rank: the k nearest other rows that the probed cells and the codes bring up. `candidates`
        rows of each block are measured for each query, 8 k if not said."""
        candidates = candidates or 8 * k
        kind = index.schema[key].dataType.simpleString()
        centers, groups, books = self.centers, self.groups, self.books
        dtype, n_groups = (np.uint16 if self.wide else np.uint8), int(groups.max()) + 1
        probes = min(probes, len(centers))

        def route(batches):
            for b in pieces(batches, 1024):
                x = matrix(b.column(1))
                cells = self.probed(x, probes)
                which = groups[cells]
                where, who, own = [], [], []
                for i, g in enumerate(which):
                    for group in np.unique(g):
                        where.append(int(group))
                        who.append(i)
                        own.append(cells[i][g == group])
                who = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), b.column(0).take(who), pa.array(own, pa.list_(pa.int32())), b.column(1).cast(pa.list_(pa.float32())).take(who)], ["grp", "src", "cells", "vector"])

        asked = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("src"), F.col(vector).alias("vector"))
        routed = scratch(asked.mapInArrow(route, f"grp int, src {kind}, cells array<int>, vector array<float>"))
        held, came = np.zeros(n_groups, np.int64), np.zeros(n_groups, np.int64)
        for r in index.groupBy("cell").count().collect():  # one row for each cell
            held[groups[r["cell"]]] += r["count"]
        for r in routed.groupBy("grp").count().collect():  # one row for each group of cells
            came[r["grp"]] = r["count"]
        of_cell = F.array(*map(F.lit, groups.tolist())) if len(groups) <= 256 else None
        spark = index.sparkSession
        plan = spark.createDataFrame([(g, int(-(-held[g] // BLOCK)), int(-(-came[g] // QUERIES))) for g in range(n_groups) if held[g] and came[g]], "grp int, vb int, qb int")
        if of_cell is not None:
            rows = index.withColumn("grp", F.get(of_cell, F.col("cell")))
        else:
            rows = index.join(F.broadcast(spark.createDataFrame(list(enumerate(groups.tolist())), "cell int, grp int")), "cell")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.join(F.broadcast(plan), "grp").select("grp", F.pmod(F.xxhash64(key), "vb").cast("int").alias("v"), spread("qb").alias("q"), F.col(key).alias("dst"), "cell", "code", "vector")
        right = routed.join(F.broadcast(plan), "grp").select("grp", spread("vb").alias("v"), F.pmod(F.xxhash64("src"), "qb").cast("int").alias("q"), "src", "cells", "vector")

        def frame(src: list, dst: list, dist: list) -> pd.DataFrame:
            return pd.DataFrame({"src": pd.Series(src, dtype=object), "dst": pd.Series(dst, dtype=object), "dist": pd.Series(dist, dtype=float)})

        def scan(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            src, dst, dist = [], [], []
            if block.empty or wanted.empty:
                return frame(src, dst, dist)
            block = block.sort_values("dst", kind="stable")
            x, ids, cell = np.stack(block["vector"].to_numpy()).astype(np.float64), block["dst"].to_numpy(dtype=object), block["cell"].to_numpy()
            codes = np.frombuffer(b"".join(block["code"]), dtype).reshape(len(block), -1)
            q, names = np.stack(wanted["vector"].to_numpy()).astype(np.float64), wanted["src"].to_numpy(dtype=object)
            guess = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
            asks: dict[int, list[int]] = {}
            for i, own in enumerate(wanted["cells"]):
                for c in own:
                    asks.setdefault(int(c), []).append(i)
            for c in np.unique(cell):
                rows_of = np.flatnonzero(cell == c)
                for at in range(0, len(asks.get(int(c), ())), 64):
                    who = np.array(asks[int(c)][at : at + 64])
                    left, total, begin = q[who] - centers[c], np.zeros((len(who), len(rows_of))), 0
                    for p, book in enumerate(books):
                        width = book.shape[1]
                        table = ((left[:, None, begin : begin + width] - book[None]) ** 2).sum(axis=2)
                        total += table[:, codes[rows_of, p]]
                        begin += width
                    for i, t in zip(who, total):
                        old, d = guess[i]
                        both, d = np.concatenate([old, rows_of]), np.concatenate([d, t])
                        if len(both) > candidates + 1:  # the heap's bound; one more, as the query itself may be there
                            best = np.argpartition(d, candidates)[: candidates + 1]
                            both, d = both[best], d[best]
                        guess[i] = both, d
            for i, (near, _) in enumerate(guess):
                near = np.sort(near)
                near = near[ids[near] != names[i]]
                d = ((x[near] - q[i]) ** 2).sum(axis=1).round(9)
                best = np.argsort(d, kind="stable")[:k]
                src += [names[i]] * len(best)
                dst += ids[near[best]].tolist()
                dist += d[best].tolist()
            return frame(src, dst, dist)

        keys = ["grp", "v", "q"]
        found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(scan, f"src {kind}, dst {kind}, dist double")
        return top_per_group(found, ["src"], [F.col("dist"), F.col("dst")], k)
