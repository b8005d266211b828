"""Queries that write a given table in a format of the sources and read it back, each with SQL for what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import datasets, readers, sinks, xml_documents
from ..sources.schemas import ATOM_COLUMNS, PREDICATION_COLUMNS
from .stage import shared_dir
from .text_queries import table

#: Documents of an XML file; rows of a shard.
PER_FILE, PER_SHARD = 1000, 500


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"


def citations_read(spark, d):
    """Orders as citations in XML files of about PER_FILE each."""
    at, orders = _folder(spark), table(spark, d, "orders")
    files = max(1, orders.count() // PER_FILE)
    day = lambda f: f(F.col("o_orderdate").cast("date")).cast("string")
    text = lambda tag, value: F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))
    author = F.concat(F.lit("<AuthorList><Author>"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("<Initials>AB</Initials>")).otherwise(""), text("LastName", F.regexp_replace("o_orderpriority", "[^A-Z]", "")), F.lit("</Author></AuthorList>"))
    article = F.concat(
        F.lit('<PubmedArticle><MedlineCitation Status="'), "o_orderstatus", F.lit('"><PMID Version="1">'), F.col("o_orderkey").cast("string"), F.lit("</PMID><Article><Language>eng</Language>"),
        text("ArticleTitle", F.col("o_orderpriority")), F.lit("<Abstract><AbstractText>Cost &lt;"), F.col("o_custkey").cast("string"), F.lit("&gt;</AbstractText></Abstract>"), author,
        F.lit("</Article></MedlineCitation><PubmedData><History><PubMedPubDate>"), text("Year", day(F.year)), text("Month", day(F.month)), text("Day", day(F.day)), F.lit("</PubMedPubDate></History></PubmedData></PubmedArticle>"),
    )
    one = orders.select(F.pmod(F.xxhash64("o_orderkey"), F.lit(files)).alias("file"), article.alias("x")).groupBy("file").agg(F.concat(F.lit("<PubmedArticleSet>"), F.concat_ws("", F.collect_list("x")), F.lit("</PubmedArticleSet>")).alias("value"))
    one.repartition("file").write.partitionBy("file").text(at)
    read = xml_documents.read_citations(spark, at)
    return read.select("pmid", "version", "date", "language", "medline_status", F.array_join(F.transform("text_data", lambda t: F.concat(t["type"], F.lit("="), t["text"])), "|").alias("texts"), F.array_join("authors", "|").alias("authors"))


def atoms_read(spark, d):
    at, given = _folder(spark), {"CUI": F.concat(F.lit("C"), "p_partkey"), "LAT": F.lit("ENG"), "STR": F.col("p_name"), "SUPPRESS": F.lit("N")}
    part = table(spark, d, "part").select(*(given.get(c.upper(), F.lit("")).alias(c) for c in ATOM_COLUMNS), F.lit("").alias("_end"))
    part.select(F.concat_ws("|", *part.columns).alias("value")).write.text(at)
    return readers.read_atoms(spark, at).select(*(F.col(c).alias(c.lower()) for c in ATOM_COLUMNS if c.upper() in given))


def predications_read(spark, d):
    at, rows = _folder(spark), table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    given = {"pmid": F.col("s_suppkey").cast("string"), "date": F.lit("2001-2-3"), "pred": F.lit("SUPPLIES"), "subj_text": F.col("s_name"), "obj_text": F.col("n_name")}
    sinks.write_predications(rows.select(*(given.get(c.lower(), F.lit("x")).alias(c) for c in PREDICATION_COLUMNS)), at)
    return readers.read_predications(spark, at).select(*(F.col(c).alias(c.lower()) for c in PREDICATION_COLUMNS if c.lower() in ("pmid", "subj_text", "obj_text")))


def kv_lines_read(spark, d):
    at = _folder(spark)
    sinks.write_kv_lines(table(spark, d, "orders"), F.col("o_orderkey"), F.array("o_custkey", F.year(F.col("o_orderdate").cast("date"))), at)
    return readers.read_kv_lines(spark, at)


def vector_text_read(spark, d):
    at, rows = _folder(spark), table(spark, d, "embeddings")
    rows.select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value")).write.text(at)
    read = readers.read_vector_text(spark, at)
    return read.select("idx", F.size("vector").cast("long").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def pairs_read(spark, d):
    at = _folder(spark)
    table(spark, d, "customer").select(F.concat_ws("|", F.concat(F.lit("C"), "c_custkey"), F.concat(F.lit("m:n"), "c_nationkey"), F.lit("1999")).alias("value")).write.text(at)
    return readers.read_pairs(spark, at, 1).select("subj", "obj", F.col("year").cast("long").alias("year"), F.col("label").cast("long").alias("label"))


def typed_pairs_read(spark, d):
    """Nations as objects of arrays, one object for each region."""
    at = _folder(spark)
    pair = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.lower("n_name").alias("target"), (F.col("n_nationkey") % 2).cast("int").alias("label"))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.create_map(F.concat(F.lit("r"), "n_regionkey"), F.collect_list(pair))).alias("value"))  # a region's nations
    rows.select("value", F.col("n_regionkey").alias("file")).repartition("file").write.partitionBy("file").text(at)
    return readers.read_typed_pairs(spark, at).select("kind", "source", "target", F.col("label").cast("long").alias("label"))


def zero_vectors(spark, d):
    vectors = table(spark, d, "embeddings").select(F.concat(F.lit("e:c"), "vec_id").alias("name"), "embedding")
    found = datasets.with_zero_vectors(table(spark, d, "customer").select(F.concat(F.lit("e:c"), "c_custkey").alias("name")), vectors, 64)
    return found.select("name", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def shards_read(spark, d):
    """Orders by key, in shards, and where each lies."""
    at = _folder(spark)
    sinks.write_shards(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [F.col("o_orderkey")], at, PER_SHARD)
    return spark.read.parquet(at).select("o_orderkey", "o_custkey", F.col("index").cast("long").alias("index"), F.col("shard").cast("long").alias("shard"))


def extractor_lines(spark, d):
    return readers.extractor_lines(table(spark, d, "part"), F.col("p_partkey").cast("string"), F.concat(F.col("p_name"), F.lit(" d'été")))


QUERIES = {f.__name__: f for f in (citations_read, atoms_read, predications_read, kv_lines_read, vector_text_read, pairs_read, typed_pairs_read, zero_vectors, shards_read, extractor_lines)}

_TOTAL = "round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5)"
ORACLES = {
    "citations_read": """SELECT o_orderkey::VARCHAR AS pmid, '1' AS version, strftime(o_orderdate, '%Y-%m-%d') AS date, 'eng' AS language, o_orderstatus AS medline_status,
'title=' || o_orderpriority || '|abstract:raw=Cost <' || o_custkey || '>' AS texts, CASE WHEN o_orderkey % 2 = 0 THEN 'AB. ' ELSE '' END || regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') AS authors FROM orders""",
    "atoms_read": "SELECT 'C' || p_partkey AS cui, 'ENG' AS lat, p_name AS str, 'N' AS suppress FROM part",
    "predications_read": "SELECT s_suppkey::VARCHAR AS pmid, s_name AS subj_text, n_name AS obj_text FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "kv_lines_read": "SELECT o_orderkey::VARCHAR AS key, '[' || o_custkey || ',' || year(o_orderdate) || ']' AS value FROM orders",
    "vector_text_read": f"SELECT vec_id AS idx, len(embedding)::BIGINT AS n, {_TOTAL} AS total FROM embeddings",
    "pairs_read": "SELECT 'm:c' || c_custkey AS subj, 'm:n' || c_nationkey AS obj, 1999::BIGINT AS year, 1::BIGINT AS label FROM customer",
    "typed_pairs_read": "SELECT 'r' || n_regionkey AS kind, 'n' || n_nationkey AS source, lower(n_name) AS target, (n_nationkey % 2)::BIGINT AS label FROM nation",
    "zero_vectors": f"SELECT 'e:c' || c_custkey AS name, 64::BIGINT AS n, coalesce({_TOTAL}, 0) AS total FROM customer LEFT JOIN embeddings ON vec_id = c_custkey",
    "shards_read": f"SELECT o_orderkey, o_custkey, i AS index, i // {PER_SHARD} AS shard FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)",
    "extractor_lines": "SELECT p_partkey || '|' || p_name || ' dete' AS value FROM part",
}
