"""XML sources. Mixed content needs a real parser, so files are streamed through one in Arrow batches; each record is dropped once read."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .schemas import DOCUMENT, SEMREP


def _text(node, path: str) -> str | None:
    found = node.find(path) if node is not None else None
    return None if found is None else "".join(found.itertext())


def _date(node) -> str:
    part = lambda name: int(re.sub(r"\D", "", _text(node, name) or "") or 0)
    return f"{part('Year'):04d}-{part('Month'):02d}-{part('Day'):02d}"


def citation(article) -> dict:
    """The document record of one article element."""
    medline = article.find("MedlineCitation")
    pmid = medline.find("PMID")
    body = medline.find("Article")
    parts = [{"text": re.sub(r"\s", " ", t), "type": "title"} for t in [_text(body, "ArticleTitle")] if t]
    for a in body.iterfind("Abstract/AbstractText"):
        text = re.sub(r"\s", " ", "".join(a.itertext()))
        if text:
            parts.append({"text": text, "type": f"abstract:{(a.get('NlmCategory') or 'raw').lower()}"})
    names = [((_text(a, "Initials") or "").strip(), _text(a, "LastName")) for a in body.iterfind("AuthorList/Author")]
    authors = [f"{initials}. {last.strip()}" if initials else last.strip() for initials, last in names if last is not None]
    banks = [{"name": _text(b, "DataBankName"), "id": "".join(x.itertext())} for b in body.iterfind("DataBankList/DataBank") for x in b.iterfind("AccessionNumberList/AccessionNumber")]
    codes = [x.get("UI") for x in [*medline.iterfind("ChemicalList/Chemical/NameOfSubstance"), *medline.iterfind("MeshHeadingList/MeshHeading/DescriptorName")]]
    dates = [d for d in (_date(x) for x in article.iterfind("PubmedData/History/PubMedPubDate")) if d != "0000-00-00"]
    return {
        "pmid": pmid.text, "version": pmid.get("Version") or "1", "date": min(dates, default=None), "language": _text(body, "Language"), "medline_status": medline.get("Status"), "text_data": parts,
        "publication_types": ["".join(x.itertext()) for x in body.iterfind("PublicationTypeList/PublicationType")], "mesh_headings": [c for c in codes if c], "data_banks": banks, "authors": authors,
    }


def _flag(value: str | None) -> bool | None:
    if value is None:
        return None
    if value.lower() not in ("true", "false"):
        raise ValueError(f"neither true nor false: {value}")
    return value.lower() == "true"


def _int(value: str | None) -> int | None:
    return None if value is None else int(value)


# Fixed value: the extractor's document ids begin with a D and the sentence's key.
_SENTENCE_ID = re.compile(r"D(s:[a-zA-Z0-9]+:[0-9]+:[0-9]+)")


def clean_sentence_id(value: str) -> str:
    m = _SENTENCE_ID.match(value)
    if not m:
        raise ValueError(f"no sentence id: {value}")
    return m[1]


def extraction(document) -> dict:
    """Entity ids and dereferenced predications of one extractor document."""
    entities = {e.get("id"): e for e in document.iter("Entity")}

    def argument(node) -> dict:
        e = entities[node.get("entityID")]
        return {"id": e.get("id"), "cui": e.get("cui"), "name": e.get("name"), "score": _int(e.get("score")), "negated": _flag(e.get("negated")), "begin": _int(e.get("begin")), "end": _int(e.get("end")), "maxDist": _int(node.get("maxDist")), "dist": _int(node.get("dist")), "relSemType": node.get("relSemType")}

    predicates = []
    for p in document.iter("Predication"):
        verb = p.find("Predicate")
        predicates.append({
            "negated": _flag(p.get("negated")), "inferred": _flag(p.get("inferred")), "subject": argument(p.find("Subject")), "object": argument(p.find("Object")),
            "predicate": {"type": verb.get("type"), "indicatorType": verb.get("indicatorType"), "begin": _int(verb.get("begin")), "end": _int(verb.get("end"))},
        })
    return {"id": clean_sentence_id(document.get("id")), "entities": [e.get("cui") for e in entities.values() if e.get("cui")], "predicates": predicates}


def _read(spark: SparkSession, path: str, tag: str, convert, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = io.BytesIO(content)
                rows = []
                for _, node in ElementTree.iterparse(gzip.open(raw) if name.endswith(".gz") else raw):
                    if node.tag == tag:
                        rows.append(convert(node))
                        node.clear()
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, schema)


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "PubmedArticle", citation, DOCUMENT)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "Document", extraction, SEMREP)
