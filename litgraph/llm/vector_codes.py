"""Compression of vectors to one code for each part, with partial-distance search for the nearest codebook entry.

Components become integers, so every distance and mean is exact and no result depends on how rows are partitioned. A round is one map over
all vectors, which sends the sums and counts of each codebook entry and place from each task (entries x dimensions rows, whatever the
task's rows), and one sum over these; codebooks (parts x entries x components integers) come to the driver and go back with the next round.

Nearest entries are found dimension by dimension, those first in which the codebook varies most. A vector starts with the complete distance
to the entry nearest in that first dimension. For every other entry its distance grows by a dimension at a time, and a mask drops the
vectors for which it strictly exceeds their best complete distance so far; an equal one stays, since a lower index wins ties. What
is left at the last dimension is complete.

Edge cases: a vector that is null, empty, or holds null, non-finite or very large components (32,768 or more: squares would leave 64 bits)
takes no part; nor does one of another length than the vector with the smallest id. Repeated ids are rows of their own, in order of
their vectors; a null id comes last. Fewer vectors than entries make shorter codebooks; no vectors make no rows. A length that the parts
don't divide is cut as evenly as possible. Equal labels share label_error, null labels too. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import table, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
MOST = 32768
#: Vectors worked on at once; labels whose sums are broadcast; rows of a label are dealt to so many keys beyond that.
BLOCK, SMALL, SALTS = 8192, 65536, 64


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each column of x (components x vectors) the index of the nearest row of `entries`, ties to the lower index, its squared
    distance, and how many single differences were squared for all of them."""
    width, n = x.shape
    if not width or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    order = np.argsort(-entries.astype(np.float64).var(axis=0), kind="stable")
    lead = order[0]
    index = np.abs(x[lead][:, None] - entries[:, lead]).argmin(axis=1)
    best = ((x - entries[index].T) ** 2).sum(axis=0)
    work = n * (len(entries) + width)
    for e, entry in enumerate(entries):
        rows = np.flatnonzero(index != e)
        total = np.zeros(len(rows), np.int64)
        for j in order:
            total += (x[j, rows] - entry[j]) ** 2
            work += len(rows)
            alive = total <= best[rows]
            rows, total = rows[alive], total[alive]
            if not len(rows):
                break
        wins = (total < best[rows]) | (e < index[rows])
        rows = rows[wins]
        index[rows], best[rows] = e, total[wins]
    return index, best, work


@dataclass
class Codebooks:
    """entries[p]: the codebook of part p, one row for each entry; edges[p]: where part p begins."""

    dimensions: int
    parts: int = PARTS
    scale: int = SCALE
    entries: list[np.ndarray] = field(default_factory=list)

    @property
    def edges(self) -> list[int]:
        return [p * self.dimensions // self.parts for p in range(self.parts + 1)]

    def integers(self, vectors: pa.Array) -> np.ndarray:
        """Usable vectors as whole numbers, components x vectors."""
        flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, self.dimensions)
        return np.ascontiguousarray(np.floor(flat * self.scale).astype(np.int64).T)

    def assign(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indexes and squared distances of each part."""
        for begin, end, entries in zip(self.edges, self.edges[1:], self.entries):
            yield nearest(x[begin:end], entries)[:2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(c) for part in self.entries for entry in part.tolist() for c in entry).encode()).hexdigest()


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    return rows.filter(F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda c: c.isNotNull() & (F.abs(c) < MOST)))


def blocks(batches, column: str):
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            piece = b.slice(at, BLOCK)
            yield piece, piece.column(piece.schema.get_field_index(column))


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of usable `embedding`s of one length, from those with the smallest vec_id on; None where there are no vectors."""
    first = vectors.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    if not first:
        return None
    books = Codebooks(len(first[0].embedding), parts, scale)
    seeds = np.floor(np.array([r.embedding for r in first], np.float64) * scale).astype(np.int64)
    books.entries = [seeds[:, b:e] for b, e in zip(books.edges, books.edges[1:])]

    def sums(batches):
        total, count = [np.zeros_like(e) for e in books.entries], [np.zeros(len(e), np.int64) for e in books.entries]
        for _, column in blocks(batches, "embedding"):
            x = books.integers(column)
            for p, (index, _) in enumerate(books.assign(x)):
                begin = books.edges[p]
                for e in np.unique(index):
                    own = index == e
                    count[p][e] += own.sum()
                    total[p][e] += x[begin : books.edges[p + 1], own].sum(axis=1)
        for p, (t, c) in enumerate(zip(total, count)):
            e, i = np.nonzero(np.broadcast_to((c > 0)[:, None], t.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), p)), pa.array(e), pa.array(i), pa.array(t[e, i]), pa.array(c[e])], ["part", "entry", "place", "total", "n"])

    for _ in range(rounds):
        # at most entries x dimensions rows
        found = vectors.select("embedding").mapInArrow(sums, "part long, entry long, place long, total long, n long")
        means = found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        books.entries = [e.copy() for e in books.entries]
        for r in means:
            books.entries[r.part][r.entry, r.place] = r.total // r.n
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part, squared distances summed over the parts."""

    def coded(batches):
        for piece, column in blocks(batches, "embedding"):
            codes, error = np.zeros((piece.num_rows, books.parts), np.uint8), np.zeros(piece.num_rows, np.int64)
            for p, (index, distance) in enumerate(books.assign(books.integers(column))):
                codes[:, p] = index
                error += distance
            text = codes.tobytes().hex()
            width = 2 * books.parts
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([text[i : i + width] for i in range(0, len(text), width)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    fields = [StructField(c, vectors.schema[c].dataType) for c in ("vec_id", "label")] + [StructField("code", StringType()), StructField("error", LongType())]
    return vectors.select("vec_id", "label", "embedding").mapInArrow(coded, StructType(fields))


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the errors' sum over equal labels. Few labels are broadcast after they are counted; of many, each is joined under SALTS keys,
    so one label's rows are many tasks' work."""
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "codes-labels")
    if sums.count() <= SMALL:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("_own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_own") == F.col("_salt")), "left").drop("_label", "_salt", "_own")


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each usable vector. At most 256 entries, so that two digits hold an index."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    rows = usable(embeddings.select("vec_id", "embedding", "label"))
    smallest = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding")).first()
    rows = rows.filter(F.size("embedding") == (smallest[0] if smallest else 0))
    books = train_codebooks(rows, parts, entries, rounds, scale) or Codebooks(0, parts, scale)
    coded = written(encode(rows, books), "codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT p.rn, p.part, min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {ENTRIES} + b.e) AS best
  FROM parts p JOIN b{k} b ON b.part = p.part GROUP BY p.rn, p.part
)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (
  SELECT part, e, list(mean ORDER BY place) AS x FROM (
    SELECT p.part, a.best % {ENTRIES} AS e, s.place, floor(sum(p.x[s.place]) / count(*))::BIGINT AS mean
    FROM parts p JOIN a{k} a ON a.rn = p.rn AND a.part = p.part JOIN places s ON s.place <= len(p.x) GROUP BY ALL
  ) GROUP BY part, e
), b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.e = b.e)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rn, vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS MATERIALIZED (
  SELECT rn, p.part, v[p.part * (len(v) // {PARTS}) + 1 : (p.part + 1) * (len(v) // {PARTS})] AS x FROM kept CROSS JOIN (SELECT unnest(range({PARTS})) AS part) p
), places AS (
  SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS place
), b0 AS (
  SELECT part, rn - 1 AS e, x FROM parts WHERE rn <= {ENTRIES}
), {", ".join(steps)}, coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', (a.best % {ENTRIES})::INT), '' ORDER BY a.part) AS code, sum(a.best // {ENTRIES})::BIGINT AS error
  FROM kept k JOIN a{ROUNDS} a ON a.rn = k.rn GROUP BY k.rn, k.vec_id, k.label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded
"""


OP11_SQL = _sql()
