"""Key-value stores in SQLite files as a data source: spark.read.format("sqlite_kv").load(path).

Every file is read by several tasks, each with a range of its row numbers; filters on the key (=, in, prefix) go down to the store's own index
where Spark hands filters to Python sources (spark.sql.python.filterPushdown.enabled, option pushdown). Files must lie where all executors see them.
"""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

#: The names that a store has unless it says otherwise.
TABLE, KEY, VALUE = "lookup_table", "key", "value"


@dataclass
class Range(InputPartition):
    path: str
    table: str
    key: str
    value: str
    first: int
    last: int


def connect(path: str) -> sqlite3.Connection:
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no file {path}")
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def checked(db: sqlite3.Connection, path: str, table: str, key: str, value: str) -> tuple[str, str, str]:
    """The names, or the usual ones where these don't fit the store. An error says what is missing or of a wrong type."""
    if key == value:
        raise ValueError("key and value can't be one column")
    problem = ""
    for names in ((table, key, value), (TABLE, KEY, VALUE)):
        kinds = {r[1]: r[2].upper() for r in db.execute(f"PRAGMA table_info({quoted(names[0])})")}
        if not kinds:
            problem = problem or f"{path} has no table {names[0]}"
            continue
        wrong = [f"{c} is {kinds.get(c) or 'missing'}" for c in names[1:] if kinds.get(c) != "TEXT"]
        if not wrong:
            return names
        problem = problem or f"{path}, table {names[0]}: {' and '.join(wrong)}; both must be TEXT"
    raise ValueError(problem)


class KvReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.where = options, []

    def paths(self) -> list[str]:
        path = self.options.get("path", "").removeprefix("file://").removeprefix("file:")
        found = sorted(glob.glob(os.path.join(path, "*.db")) + glob.glob(os.path.join(path, "*.sqlite*"))) if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(f"no store at {path}")
        return found

    def partitions(self) -> list[Range]:
        """Ranges of `rows` row numbers (100,000 unless said)."""
        names = (self.options.get("table", TABLE), self.options.get("key", KEY), self.options.get("value", VALUE))
        rows, out = int(self.options.get("rows", 100_000)), []
        for path in self.paths():
            with connect(path) as db:
                table, key, value = checked(db, path, *names)
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(table)}").fetchone()
                if low is not None:
                    out += [Range(path, table, key, value, at, min(at + rows - 1, high)) for at in range(low, high + 1, rows)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part is None:  # no partitions: an empty store
            return
        key, value = quoted(part.key), quoted(part.value)
        where = "".join(f" AND {w.format(key)}" for w, _ in self.where)
        args = [part.first, part.last, *(a for _, values in self.where for a in values)]
        with connect(part.path) as db:
            cursor = db.execute(f"SELECT {key}, {value} FROM {quoted(part.table)} WHERE rowid BETWEEN ? AND ?{where}", args)
            while rows := cursor.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["key", "value"])


class FilteringKvReader(KvReader):
    """Spark refuses a reader that takes filters where the session doesn't hand them on, so this is a class of its own."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",) and f.value is not None:
                self.where.append(("{} = ?", [f.value]))
            elif isinstance(f, In) and f.attribute == ("key",) and len(f.value) <= 500:
                self.where.append((f"{{}} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute == ("key",):
                self.where.append(("substr({0}, 1, ?) = ?", [len(f.value), f.value]))
            elif isinstance(f, IsNotNull) and f.attribute == ("key",):
                self.where.append(("{} IS NOT NULL", []))
            else:
                yield f


class KvDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_kv"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> KvReader:
        options = dict(self.options)
        return (FilteringKvReader if options.get("pushdown", "").lower() == "true" else KvReader)(options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KvDataSource)


def read_kv_stores(spark: SparkSession, path: str, **options: str):
    """key and value of a store, of all stores of a folder, or of a pattern's. Options: table, key, value, rows; pushdown follows the session."""
    register(spark)
    options = {"pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")} | options
    return spark.read.format("sqlite_kv").options(**options).load(path)
