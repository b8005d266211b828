"""Readers with fixed schemas."""

from __future__ import annotations

import os
import sqlite3
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_space
from ..plans.stage import scratch
from .schemas import ATOM_COLUMNS, FULL_TEXT, PREDICATION_COLUMNS


def read_full_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document record for each JSON file: abstract, body and captions as text parts; the title stands apart."""
    raw = spark.read.schema(FULL_TEXT).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    part = lambda column, kind: F.transform(F.coalesce(column, F.array().cast("array<struct<text:string>>")), lambda p: F.struct(p["text"].alias("text"), F.lit(kind).alias("type")))
    empty = F.array().cast("array<struct<text:string,type:string>>")
    captions = F.transform(F.coalesce(F.map_values("ref_entries"), empty), lambda r: F.struct(r["text"].alias("text"), F.lower(r["type"]).alias("type")))
    authors = F.transform(F.coalesce(F.col("metadata.authors"), F.array().cast("array<struct<first:string,last:string>>")), lambda a: F.concat(F.substring(a["first"], 1, 1), F.lit(". "), a["last"]))
    return raw.select(
        F.lower("paper_id").alias("pmid"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("medline_status"),
        F.filter(F.concat(part(F.col("abstract"), "abstract"), part(F.col("body_text"), "body"), captions), lambda p: p["text"] != "").alias("text_data"),
        F.array().cast("array<string>").alias("publication_types"), F.array().cast("array<string>").alias("mesh_headings"), F.array().cast("array<struct<name:string,id:string>>").alias("data_banks"), F.filter(authors, lambda a: a.isNotNull()).alias("authors"), F.col("metadata.title").alias("title"),
    )


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """The concept table: 18 columns between pipes, and an empty one at the end."""
    schema = ", ".join(f"`{c}` STRING" for c in [*ATOM_COLUMNS, "_end"])
    return spark.read.schema(schema).option("sep", "|").csv(path).drop("_end")


def read_predications(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} STRING" for c in PREDICATION_COLUMNS)).option("header", True).csv(path)


def read_predications_jdbc(spark: SparkSession, url: str, tables: dict[str, str], limit: int | None = None, **options: str) -> DataFrame:
    """The four tables over JDBC and their joins; column pruning and the limit reach the source where it can take them."""
    from ..operators.predicates import four_way

    t = {k: spark.read.format("jdbc").options(url=url, dbtable=v, **options).load() for k, v in tables.items()}
    out = four_way(t["predication"], t["sentence"], t["citation"], t["aux"])
    return out if limit is None else out.limit(limit)


def read_kv_lines(spark: SparkSession, path: str) -> DataFrame:
    """key and value as text; a value that is an object or an array stays JSON."""
    return spark.read.schema("key STRING, value STRING").json(path)


def read_kv_sqlite(spark: SparkSession, path: str, table: str | None = None, rows: int = 100_000) -> DataFrame:
    """A local SQLite table of keys and JSON values, under any of the usual names of table and columns. It is read on the driver, as its file
    lies there, and goes to the shared folder in parts of `rows` rows."""
    parts = []
    with sqlite3.connect(f"file:{os.fspath(path)}?mode=ro", uri=True) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        name = table or next(n for n in ("lookup_table", "graph", "sentences", *names) if n in names)
        columns = [r[1] for r in db.execute(f'PRAGMA table_info("{name}")')]
        key = next(c for c in ("key", "node", "id", columns[0]) if c in columns)
        value = next(c for c in ("value", "neighbors", "bow", columns[-1]) if c in columns)
        cursor = db.execute(f'SELECT "{key}", "{value}" FROM "{name}"')
        while part := cursor.fetchmany(rows):
            parts.append(scratch(spark.createDataFrame(part, "key STRING, value STRING")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "key STRING, value STRING")


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def read_entity_names(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """name, type, part and row (the place in its file) from JSON arrays in files like entity_names_<type>_<part>.json."""
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select("value", file.alias("file"))
    pattern = r"_([a-z])_([0-9]+)\."
    rows = raw.select(F.regexp_extract("file", pattern, 1).alias("type"), F.regexp_extract("file", pattern, 2).cast("long").alias("part"), F.posexplode(F.from_json("value", "array<string>")).alias("row", "name"))
    return rows if kinds is None else rows.filter(F.col("type").isin(*kinds))


def read_vector_text(spark: SparkSession, path: str) -> DataFrame:
    """idx and vector from lines of an index and numbers; the header line has two fields only."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(parts) > 2).select(F.get(parts, F.lit(0)).cast("long").alias("idx"), F.slice(parts, 2, F.size(parts) - 1).cast("array<float>").alias("vector"))


def read_pairs(spark: SparkSession, path: str, label: int) -> DataFrame:
    from ..functions.keys import clean_coded_term

    raw = spark.read.schema("subj STRING, obj STRING, year INT").option("sep", "|").csv(path)
    return raw.select(clean_coded_term(F.col("subj")).alias("subj"), clean_coded_term(F.col("obj")).alias("obj"), "year", F.lit(label).alias("label"))


def read_typed_pairs(spark: SparkSession, path: str) -> DataFrame:
    """kind, source, target, label from an object of arrays."""
    raw = spark.read.option("wholetext", True).text(path)
    kinds = raw.select(F.explode(F.from_json("value", "map<string,array<struct<source:string,target:string,label:int>>>")).alias("kind", "rows"))
    return kinds.select("kind", F.inline("rows"))


def extractor_lines(rows: DataFrame, key: Column, text: Column) -> DataFrame:
    """`id|text` lines for the predication extractor: one line each, ASCII, no apostrophes, empty ones out."""
    from ..functions.text import ascii_fold

    clean = F.trim(F.regexp_replace(ascii_fold(normal_space(text)), "['\"]", ""))
    checked = F.when(key.contains("|"), F.raise_error(F.lit("an id holds a pipe"))).otherwise(key)
    return rows.select(F.concat_ws("|", checked, clean).alias("value"), clean.alias("_c")).filter("_c <> ''").select("value")


def last_files(spark: SparkSession, path: str, n: int) -> list[str]:
    """The last n files of a folder by name, as paths to read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    names = sorted(s.getPath().toString() for s in found if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
    return names[-n:] if n > 0 else []
