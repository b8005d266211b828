import gzip
import json
import sqlite3

from litgraph.sources import readers, sinks
from litgraph.sources.xml_documents import read_citations, read_extractions
from litgraph.streaming.arrivals import ingest_new

CITATION = """<?xml version="1.0"?><PubmedArticleSet><PubmedArticle><MedlineCitation Status="MEDLINE"><PMID Version="2">77</PMID><Article><Language>eng</Language><ArticleTitle>On <i>lung</i> cells</ArticleTitle>
<Abstract><AbstractText NlmCategory="METHODS">We\tlooked.</AbstractText><AbstractText>Found.</AbstractText></Abstract><AuthorList><Author><Initials>AB</Initials><LastName>Doe</LastName></Author><Author><LastName>Alone</LastName></Author><Author><Initials> </Initials><LastName>Blank</LastName></Author><Author><Initials>X</Initials></Author></AuthorList>
<PublicationTypeList><PublicationType>Journal Article</PublicationType></PublicationTypeList><DataBankList><DataBank><DataBankName>GENBANK</DataBankName><AccessionNumberList><AccessionNumber>X1</AccessionNumber></AccessionNumberList></DataBank></DataBankList></Article>
<ChemicalList><Chemical><NameOfSubstance UI="D01">c</NameOfSubstance></Chemical></ChemicalList><MeshHeadingList><MeshHeading><DescriptorName UI="D02">m</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><History><PubMedPubDate><Year>2015</Year><Month>3</Month><Day>0</Day></PubMedPubDate><PubMedPubDate><Year>0</Year></PubMedPubDate></History></PubmedData></PubmedArticle></PubmedArticleSet>"""
EXTRACTION = """<SemRepAnnotation><Document id="Ds:77:1:0.tx.1"><Utterance><Entity id="E1" cui="C1" name="a" score="10" negated="false" begin="0" end="3"/><Entity id="E2" cui="C2" name="b" negated="true"/>
<Predication id="P1" negated="false" inferred="true"><Subject entityID="E1" dist="1" maxDist="2" relSemType="x"/><Predicate type="TREATS" indicatorType="VERB" begin="4" end="6"/><Object entityID="E2"/></Predication></Utterance></Document></SemRepAnnotation>"""


def test_citations(spark, tmp_path):
    with gzip.open(tmp_path / "one.xml.gz", "wt") as f:
        f.write(CITATION)
    r = read_citations(spark, str(tmp_path)).first()
    assert (r.pmid, r.version, r.date, r.language) == ("77", "2", "2015-03-00", "eng")
    assert [(t.text, t.type) for t in r.text_data] == [("On lung cells", "title"), ("We looked.", "abstract:methods"), ("Found.", "abstract:raw")]
    assert (r.mesh_headings, r.authors, [tuple(b) for b in r.data_banks]) == (["D01", "D02"], ["AB. Doe", "Alone", "Blank"], [("GENBANK", "X1")])


def test_extractions(spark, tmp_path):
    (tmp_path / "one.xml").write_text(EXTRACTION)
    r = read_extractions(spark, str(tmp_path)).first()
    p = r.predicates[0]
    assert (r.id, r.entities, p.subject.cui, p.object.negated, p.predicate.type, p.inferred) == ("s:77:1:0", ["C1", "C2"], "C1", True, "TREATS", True)


def test_full_texts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    one = {"paper_id": "AbC", "metadata": {"title": "T", "authors": [{"first": "Ann", "last": "Doe"}]}, "body_text": [{"text": "Body."}], "ref_entries": {"FIGREF0": {"text": "Cap.", "type": "FIGURE"}}}
    (tmp_path / "sub" / "a.json").write_text(json.dumps(one))
    r = readers.read_full_texts(spark, str(tmp_path)).first()
    assert (r.pmid, r.version, r.title, r.authors) == ("abc", "1", "T", ["A. Doe"])
    assert [tuple(t) for t in r.text_data] == [("Body.", "body"), ("Cap.", "figure")]


def test_tables(spark, tmp_path):
    (tmp_path / "atoms.rrf").write_text("|".join(map(str, range(18))) + "|\n")
    assert list(readers.read_atoms(spark, str(tmp_path / "atoms.rrf")).first()) == list(map(str, range(18)))
    (tmp_path / "kv.json").write_text('{"key": "a", "value": "x"}\n{"key": "b", "value": [1, 2]}\n')
    assert sorted(map(tuple, readers.read_kv_lines(spark, str(tmp_path / "kv.json")).collect())) == [("a", "x"), ("b", "[1, 2]")]  # as it is in the file
    with sqlite3.connect(tmp_path / "g.db") as db:
        db.execute("CREATE TABLE graph (node TEXT PRIMARY KEY, neighbors TEXT)")
        db.execute("INSERT INTO graph VALUES ('a', '[1]')")
    assert list(readers.read_kv_sqlite(spark, tmp_path / "g.db").first()) == ["a", "[1]"]
    (tmp_path / "entity_names_m_3.json").write_text('["m:a", "m:b"]')
    assert sorted(map(tuple, readers.read_entity_names(spark, str(tmp_path / "entity_names_m_3.json")).select("name", "type", "part", "row").collect())) == [("m:a", "m", 3, 0), ("m:b", "m", 3, 1)]
    (tmp_path / "pairs").write_text("C1|m:C2|2015\n")
    assert list(readers.read_pairs(spark, str(tmp_path / "pairs"), 1).first()) == ["m:c1", "m:c2", 2015, 1]
    (tmp_path / "typed.json").write_text('{"a:b": [{"source": "x", "target": "y", "label": 1}]}')
    assert list(readers.read_typed_pairs(spark, str(tmp_path / "typed.json")).first()) == ["a:b", "x", "y", 1]
    (tmp_path / "vectors").write_text("2 2\n0 1.5 2\n1 0 0\n")
    assert sorted(map(tuple, readers.read_vector_text(spark, str(tmp_path / "vectors")).collect())) == [(0, [1.5, 2.0]), (1, [0.0, 0.0])]


def test_edge_lines_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    sinks.write_edge_lines(edges, str(tmp_path / "e"))
    assert sorted(map(tuple, readers.read_kv_lines(spark, str(tmp_path / "e")).collect())) == [("a", "b"), ("b", "a")]


def test_ingest_is_incremental(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    for batch in range(2):
        spark.range(batch * 3, batch * 3 + 3).write.mode("append").parquet(at("in"))
        ingest_new(spark, at("in"), "id long", at("out"), at("state"))
        assert spark.read.parquet(at("out")).count() == 3 * (batch + 1)
