import hashlib

import pytest
from pyspark.sql import functions as F

from litgraph.functions import keys as K
from litgraph.functions.arrays import padded, set_jaccard, shifted, weighted_jaccard
from litgraph.functions.dates import clean_date, earliest_date, valid_cut_date
from litgraph.functions.hashing import hash32, hash64
from litgraph.functions.text import mask_phrases, ngrams, split_sentences


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_keys(spark):
    lit = F.lit
    assert one(spark, K.sentence_key(lit("12"), lit(None), lit(3)), K.lemma_key(lit("NOUN"), lit("Cell")), K.entity_key(F.array(lit("Lung"), lit("Cancer"))), K.coded_key(lit("C01"))) == ["s:12:1:3", "l:noun:cell", "e:lung_cancer", "m:c01"]
    assert one(spark, K.predicate_key(lit("C1"), None, lit("C2"))) == ["p:c1:unknown:c2"]
    assert one(spark, *(K.is_predicate(lit(k)) for k in ("p:a:b:c", "p:a::c", "p::b:c", "p:a:b", "m:a:b:c", "p:a:b:c:d"))) == [True, True, False, False, False, False]
    assert one(spark, *(K.is_graph_key(lit(k)) for k in ("m:c1", "M:c1", "m:", "x:c1", "m:C1"))) == [True, False, False, False, False]
    assert one(spark, K.clean_coded_term(lit("C01")), K.clean_coded_term(lit("m:C01"))) == ["m:c01", "m:c01"]
    assert one(spark, K.to_graph_key(lit("Lung"), "lemma"), K.to_graph_key(lit("l:noun:a"), "lemma")) == ["l:lung", "l:noun:a"]
    with pytest.raises(Exception, match="no lemma key"):
        one(spark, K.to_graph_key(lit("m:c1"), "lemma"))
    with pytest.raises(Exception, match="colon"):
        one(spark, K.predicate_key(lit("a"), lit("b:c"), lit("d")))


@pytest.mark.parametrize("text", ["", "a", "lung cancer", "éß漢"])
def test_hashes(spark, text):
    n = int.from_bytes(hashlib.md5(text.encode()).digest(), "big")
    assert one(spark, hash64(F.lit(text)), hash32(F.lit(text))) == [n % (2**63 - 1), n % (2**31 - 1)]


def test_text(spark):
    assert one(spark, split_sentences(F.lit("One. Two!  Three? Four")))[0] == ["One.", "Two!", "Three?", "Four"]
    words = F.array(*map(F.lit, "a b c d".split()))
    assert one(spark, ngrams(words, 3), ngrams(words, 5)) == [["a_b_c", "b_c_d"], []]
    phrases = F.create_map(F.lit("a_b"), F.lit(1), F.lit("b_c_d"), F.lit(1), F.lit("a_b_c"), F.lit(1))
    assert one(spark, mask_phrases(words, phrases, 3))[0] == ["a_b_c"]


def test_arrays(spark):
    a, b = F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(2.0), F.lit(1.0))
    assert one(spark, weighted_jaccard(a, b), set_jaccard(a, b), padded(a, 3, 0.0), *shifted(a)) == [2 / 5, 1 / 3, [1.0, 3.0, 0.0], [1.0], [3.0]]


def test_dates(spark):
    given = ["2015 Mar 7", "2015 Mar", "2015", "Spring 2015", "2015 Mar 77", ""]
    assert one(spark, *(clean_date(F.lit(t)) for t in given)) == ["2015-03-07", "2015-03-01", "2015-01-01", "9999-01-01", "9999-01-01", "9999-01-01"]
    assert one(spark, earliest_date(F.array(F.lit("2015-00-00"), F.lit("0000-00-00"), F.lit("2016-01-01")))) == ["2015-00-00"]
    with pytest.raises(ValueError):
        valid_cut_date("2015-13-01")
