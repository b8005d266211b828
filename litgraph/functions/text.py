"""Text as column expressions: sentences, words, n-grams, phrases."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that carry no topic (English, German, French, Spanish).
STOPWORDS = (
    "the of and in to a is that it was for on are as with at by be this have from or an not but which "
    "der die das und in zu den ist mit von auf ein eine nicht als des dem im "
    "le la les de et des en un une que est dans au pour pas sur par "
    "el los las y del se con una su lo por para como"
).split()
#: Parts of speech that mark a word as a topic's.
TOPIC_POS = ("NOUN", "ADJ", "VERB", "PROPN", "NUM", "SYM", "X")


def split_sentences(text: Column) -> Column:
    """At white space after a full stop, question or exclamation mark."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def is_stop(word: Column) -> Column:
    return word.isin(*STOPWORDS)


def part_of_speech(word: Column) -> Column:
    """By rule: digits, then endings; any other word is a noun."""
    return F.when(word.rlike(r"^[0-9]+$"), "NUM").when(word.rlike("(ly|ment)$"), "ADV").when(word.rlike("(ing|ed)$"), "VERB").otherwise("NOUN")


def tokens(text: Column) -> Column:
    """Structs lemma, pos, stop."""
    return F.transform(words(text), lambda w: F.struct(w.alias("lemma"), part_of_speech(w).alias("pos"), is_stop(w).alias("stop")))


def is_interesting(word: Column) -> Column:
    """What `interesting` says of a word by rule, as plain column expressions: the only part of speech that marks no topic is the adverb."""
    return ~is_stop(word) & ~(word.endswith("ly") | word.endswith("ment"))


def cased_tokens(text: Column) -> Column:
    """Structs lemma, pos, stop, and upper: whether the word begins with a capital."""
    cased = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def one(w: Column) -> Column:
        low = F.lower(w)
        return F.struct(low.alias("lemma"), part_of_speech(low).alias("pos"), is_stop(low).alias("stop"), w.rlike(r"^\p{Lu}").alias("upper"))

    return F.transform(cased, one)


def entity_spans(tokens: Column) -> Column:
    """Entities by rule: runs of two or more words with capitals, as structs tok_start, tok_end (exclusive) and label."""
    empty = F.array().cast("array<struct<tok_start:int,tok_end:int>>")
    state = lambda i, begin, spans: F.struct(i.alias("i"), begin.alias("begin"), spans.alias("spans"))
    ended = lambda acc: F.concat(acc["spans"], F.array(F.struct(acc["begin"].alias("tok_start"), acc["i"].alias("tok_end"))))

    def step(acc: Column, t: Column) -> Column:
        after, upper, inside = acc["i"] + 1, t["upper"], acc["begin"] >= 0
        return F.when(upper & ~inside, state(after, acc["i"], acc["spans"])).when(~upper & inside, state(after, F.lit(-1), ended(acc))).otherwise(state(after, acc["begin"], acc["spans"]))

    finish = lambda acc: F.when(acc["begin"] >= 0, ended(acc)).otherwise(acc["spans"])
    spans = F.coalesce(F.aggregate(tokens, state(F.lit(0), F.lit(-1), empty), step, finish), empty)
    return multi_token(F.transform(spans, lambda e: F.struct(e["tok_start"].alias("tok_start"), e["tok_end"].alias("tok_end"), F.lit("ENT").alias("label"))))


def multi_token(entities: Column) -> Column:
    return F.filter(entities, lambda e: e["tok_end"] - e["tok_start"] > 1)


def span_tokens(entity: Column, tokens: Column) -> Column:
    return F.slice(tokens, entity["tok_start"] + 1, entity["tok_end"] - entity["tok_start"])


def without_stop_entities(entities: Column, tokens: Column) -> Column:
    """Without entities of which every word is a stop word."""
    return F.filter(entities, lambda e: F.exists(span_tokens(e, tokens), lambda t: ~t["stop"]))


def entity_text(entity: Column, tokens: Column) -> Column:
    """Lemmas of its span, joined by an underscore."""
    return F.array_join(F.transform(span_tokens(entity, tokens), lambda t: t["lemma"]), "_")


def all_text(parts: Column) -> Column:
    """The texts of a document's parts, joined by a space."""
    return F.array_join(F.transform(parts, lambda p: p["text"]), " ")


def interesting(token: Column) -> Column:
    return ~token["stop"] & token["pos"].isin(*TOPIC_POS)


def ngrams(items: Column, n: int) -> Column:
    """All runs of n items, joined by an underscore."""
    last = F.size(items) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(items, i, n), "_")))


def mask_phrases(items: Column, phrases: Column, longest: int) -> Column:
    """Phrases found from left to right, the longest one at each place, without overlap. `phrases` is a map phrase -> anything."""

    def step(acc: Column, i: Column) -> Column:
        here = F.lit(None).cast("string")
        width = F.lit(1)
        for n in range(2, longest + 1):
            p = F.array_join(F.slice(items, i, n), "_")
            fits = (i + n - 1 <= F.size(items)) & F.map_contains_key(phrases, p)
            here, width = F.when(fits, p).otherwise(here), F.when(fits, F.lit(n)).otherwise(width)
        taken = F.struct((i + width).alias("next"), F.when(here.isNotNull(), F.concat(acc["found"], F.array(here))).otherwise(acc["found"]).alias("found"))
        return F.when(i < acc["next"], acc).otherwise(taken)

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("found"))
    places = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda acc: acc["found"])


# Names of the Greek letters.
GREEK = dict(zip("αβγδεζηθικλμνξοπρστυφχψω", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split(), strict=True))


def greek_names(text: Column) -> Column:
    """Greek letters become their names; a capital's name begins with a capital."""
    for letter, name in GREEK.items():
        text = F.replace(F.replace(text, F.lit(letter), F.lit(name)), F.lit(letter.upper()), F.lit(name.capitalize()))
    return F.replace(text, F.lit("ς"), F.lit("sigma"))


def _base_letters() -> tuple[str, str]:
    """All letters beyond ASCII that Unicode decomposes to an ASCII letter with marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0x80, 0x2200)]
    pairs = [(c, d[0]) for c, d in pairs if d[0].isascii() and d[0].isalpha() and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, BASE = _base_letters()


def ascii_fold(text: Column) -> Column:
    """Greek letters become names, letters with marks lose them, then everything beyond ASCII goes."""
    text = F.when(text.rlike(r"\p{InGreek}"), greek_names(text)).otherwise(text)
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, ACCENTED, BASE)).otherwise(text)
    return F.regexp_replace(folded, r"[^\x00-\x7F]", "")


def normal_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", " ")


def plain_tokens(text: Column) -> Column:
    """Lower-case words between white space, without empty ones."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
