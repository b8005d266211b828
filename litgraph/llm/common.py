"""Shared helpers: table access, written checkpoints in the cluster's shared folder, byte-level tokenisation."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import pickle
import re
import tempfile
import traceback
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps upper-case ASCII letters to lower case and every other ASCII character that is no letter or digit to a space.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


#: Rows that go to a Python worker at once, unless the session says otherwise. Whole texts are long: the default of 10,000 takes tens of
#: megabytes for each task, twice in the JVM and again in the worker.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="litgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, cut from its lineage by a Parquet table in the shared folder. `.path_` of the result names it for `drop`."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path_ = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that `written` made and that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.path_)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(col, mod: int):
    """crc32 of the id's decimal text, modulo `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def crc_mod_py(value, mod: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % mod


def bounded_sample(df: DataFrame, key, target: int, total: int | None = None) -> DataFrame:
    """About `target` rows (all, if there are fewer), picked by a hash of `key`: the same rows whatever the partitioning."""
    total = df.count() if total is None else total
    if total <= target:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < int((1 << 31) * target / total))


def byte_list(batch: pa.RecordBatch, column: str) -> list:
    """A string column as UTF-8 bytes; null stays None."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def words_of(data: bytes | None) -> list[bytes]:
    """Words of ASCII letters and digits and all other characters beyond ASCII, A-Z lower-cased."""
    return data.translate(WORD_TABLE).split() if data else []


def tokens_of(data: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return data.lower().split() if data else []


def release() -> None:
    """Gives memory that a task no longer uses back to the system; Python workers live on, and idle ones share their executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def in_child(work, *args):
    """work(*args), done by a forked process, so that the memory it takes goes with it. The result must pickle."""
    out, into = os.pipe()
    pid = os.fork()
    if not pid:
        try:
            os.close(out)
            with os.fdopen(into, "wb") as f:
                pickle.dump(work(*args), f)
            os._exit(0)
        except BaseException:  # the parent reports it
            traceback.print_exc()
        os._exit(1)
    os.close(into)
    with os.fdopen(out, "rb") as f:
        data = f.read()
    if os.waitpid(pid, 0)[1]:
        raise RuntimeError(f"{work.__name__} failed in a child process")
    return pickle.loads(data)


_SPACE = re.compile(rb"\s")


def text_parts(data: bytes | None, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about `most` bytes, cut at white space, so that a very long text is never whole in Python objects. One at least."""
    data, at = data or b"", 0
    while len(data) - at > most and (m := _SPACE.search(data, at + most)):
        yield data[at : m.start()]
        at = m.start()
    yield data[at:] if at else data


def token_lists(data: bytes | None) -> Iterator[list[bytes]]:
    """`tokens_of` the parts."""
    return map(tokens_of, text_parts(data))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 2 << 20, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and about `most` bytes of a string column; a row is never cut."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        begin = held = 0
        for i, n in enumerate(sizes):
            if i > begin and (held + n > most or i - begin == rows):
                yield b.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < b.num_rows:
            yield b.slice(begin)


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Bits:
    """A Bloom filter of one hash for 64-bit numbers, which says whether one may be in a table. It has about eight bits for each row of
    the table, up to `most` (128 MB). Beyond that there is none and every number passes: what follows the filter is an exact join, so
    only the rows that it saves are lost."""

    def __init__(self, held: np.ndarray) -> None:
        self.held, self.shift = held, U(64 - (len(held) * 8).bit_length() + 1)

    @staticmethod
    def places(x: np.ndarray, shift) -> np.ndarray:
        return (mix(x.view(U) + U(0x2545F4914F6CDD1D)) >> shift).astype(np.int64)

    @staticmethod
    def of(rows: DataFrame, column: str, most: int = 1 << 30) -> Bits | None:
        size = 1 << 16
        while size < 8 * (n := rows.count()):
            size *= 2
            if size > most:
                return None
        shift, piece = U(64 - size.bit_length() + 1), 16

        def place(batches):
            for b in batches:
                at = np.unique(Bits.places(b.column(0).to_numpy(zero_copy_only=False), shift))
                yield pa.RecordBatch.from_arrays([pa.array(at >> piece), pa.array(at & (1 << piece) - 1)], ["piece", "bit"])

        def pack(part: pd.DataFrame) -> pd.DataFrame:
            own = np.zeros(1 << piece, bool)
            own[part["bit"].to_numpy()] = True
            return pd.DataFrame({"piece": part["piece"].iloc[:1], "bits": [np.packbits(own, bitorder="little").tobytes()]})

        held = np.zeros((size >> piece, 1 << piece - 3), np.uint8)
        found = rows.select(F.col(column).cast("long")).mapInArrow(place, "piece long, bit long").distinct()
        for r in found.groupBy("piece").applyInPandas(pack, "piece long, bits binary").collect() if n else ():
            held[r[0]] = np.frombuffer(bytes(r[1]), np.uint8)
        return Bits(held.ravel())

    def holds(self, x: np.ndarray) -> np.ndarray:
        bit = self.places(x, self.shift)
        return self.held[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
