"""Sentence boundaries by a model that is learnt from unlabelled text (Kiss and Strunk, 2006): abbreviations, words that often begin
sentences, and pairs that a full stop doesn't part, all found by log-likelihood ratios over counts of word types.

One pass over the texts counts pairs of neighbouring tokens; what precedes a token is kept by name only where it ends with a full stop, so
the table is about as long as the vocabulary. Types, abbreviations, contexts, starters and collocations are aggregates and joins of it. Where
only types are asked for, tokens alone are counted. The model that goes to the tasks is sets of types; the two that grow with the vocabulary are
packed. Of a set with more than `most` types only the files' names go to the tasks: tasks write it sorted, Spark brings the files to the
executors, and workers look types up in them without holding them.
"""

from __future__ import annotations

import mmap
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import drop, kept_lines, scratch
from ..session import small_batches

#: Fixed values of the published method: the least scores of an abbreviation, a collocation and a sentence starter.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
NUMBER = "##number##"
#: What is no part of a token's type before and after it.
OPENERS, CLOSERS = "\"'“”‘’«»([{", "\"'“”‘’«»)]},;:!?"
_DIGITS = r"^-?[.,]?[0-9][0-9.,-]*$"
_FIRST = "0123456789-.,"
#: A mark that may end a sentence, what may close after it, and the space before the next one.
_CANDIDATE = re.compile(r"[.!?][\"'“”‘’«»)\]}]*\s+(?=\S)")


def token_type(core: Column) -> Column:
    """The type of a token without its final full stop: in lower case, all numbers as one."""
    bare = F.lower(F.when(core.endswith("."), F.substring(core, F.lit(1), F.length(core) - 1)).otherwise(core))
    return F.when(F.substring(bare, 1, 1).isin(*_FIRST) & bare.rlike(_DIGITS), NUMBER).otherwise(bare)


def _core(token: Column) -> Column:
    return F.rtrim(F.ltrim(token, F.lit(OPENERS)), F.lit(CLOSERS))


def _split(text: str) -> Column:
    return F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " ")


def token_counts(texts: DataFrame, text: str) -> DataFrame:
    """type, stop and n of `neighbour_counts`, without what stands before: equal tokens are counted before their types are made."""
    rows = texts.select(F.explode(_split(text)).alias("b")).filter("b <> ''").groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("cb", _core(F.col("b")))
    return rows.select(token_type(F.col("cb")).alias("type"), F.col("cb").endswith(".").alias("stop"), "n")


def neighbour_counts(texts: DataFrame, text: str) -> DataFrame:
    """before, before_type, type, stop, letter and n. before: how the token before ends ('.', '!' for exclamation and question marks, '-' for
    anything else, '^' at a text's beginning); before_type: its type where that is a full stop; stop: whether the token ends with one; letter:
    the case of its first letter, 'u', 'l' or '-'."""
    rows = texts.select(_split(text).alias("t"))
    rows = rows.select(F.explode(F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.col("t")).alias("a"), F.col("t").alias("b"))).alias("p")).select(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    rows = rows.filter("b IS NOT NULL AND b <> ''").select("a", _core(F.col("a")).alias("ca"), _core(F.col("b")).alias("cb"))
    asked = F.rtrim("a", F.lit("\"'“”‘’«»)]}"))
    before = F.when(F.col("a").isNull(), "^").when(F.col("ca").endswith("."), ".").when(asked.endswith("!") | asked.endswith("?"), "!").otherwise("-")
    rows = rows.withColumn("before", before).withColumn("before_type", F.when(F.col("before") == ".", token_type(F.col("ca"))))
    first = F.substring("cb", 1, 1)
    letter = F.when(F.lower(first) != first, "u").when(F.upper(first) != first, "l").otherwise("-")
    return rows.select("before", "before_type", token_type(F.col("cb")).alias("type"), F.col("cb").endswith(".").alias("stop"), letter.alias("letter")).groupBy("before", "before_type", "type", "stop", "letter").agg(F.count(F.lit(1)).alias("n"))


def type_counts(pairs: DataFrame) -> DataFrame:
    """type, with_stop and without: how often a type ends with a full stop, and how often not."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return pairs.groupBy("type").agg(n(F.col("stop")).alias("with_stop"), n(~F.col("stop")).alias("without"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """type and score of all types that are abbreviations: those that go with a full stop more than chance says, the more so the shorter
    they are and the more full stops are inside, the less so the more often they occur without one."""
    total = counts.agg(F.sum(F.col("with_stop") + F.col("without")), F.sum("with_stop")).first()
    if not total[1] or total[0] == total[1]:
        return counts.select("type", F.lit(0.0).alias("score")).limit(0)
    share = total[1] / total[0]
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    size = F.greatest(F.length("type") - inner, F.lit(1)).cast("double")
    log = lambda p: F.col("with_stop") * F.log(F.lit(p)) + F.col("without") * F.log(F.lit(1 - p))
    score = -2 * (log(share) - log(0.99)) * F.exp(-size) * (inner + 1) * F.pow(size, -F.col("without").cast("double"))
    some = counts.filter((F.col("with_stop") > 0) & (F.col("type") != NUMBER) & F.col("type").rlike(r"\p{L}"))
    return some.withColumn("score", score).filter(F.col("score") >= ABBREVIATION).select("type", "score")


def log_ratio(a: Column, b: Column, both: Column, n: Column) -> Column:
    """How much likelier it is that a and b are tied than that they aren't, from their counts, their count together and that of all."""
    part = lambda k, m, p: F.when((p > 0) & (p < 1), k * F.log(p) + (m - k) * F.log(1 - p)).otherwise(0.0)
    p, p1, p2 = b / n, both / a, F.try_divide(b - both, n - a)
    return -2 * (part(both, a, p) + part(b - both, n - a, p) - part(both, a, p1) - part(b - both, n - a, F.coalesce(p2, F.lit(0.0))))


def marked(pairs: DataFrame, short: DataFrame) -> DataFrame:
    """The pairs with `place`: 'b' after what ends a sentence at first sight, '?' after an abbreviation or dots, 'm' within a sentence. Only
    pairs with a full stop before have a type there; the others, most of them, would all meet in one task of the join."""
    known = short.select(F.col("type").alias("before_type"), F.lit(True).alias("short"))
    unsure = F.col("short").isNotNull() | (F.col("before_type").rlike(r"^\.*$"))
    place = F.when(F.col("before").isin("^", "!"), "b").when(F.col("before") == "-", "m").when(unsure, "?").otherwise("b")
    named, others = pairs.filter("before_type IS NOT NULL"), pairs.filter("before_type IS NULL").withColumn("short", F.lit(None).cast("boolean"))
    return named.join(known, "before_type", "left").unionByName(others).withColumn("place", place)


def contexts(places: DataFrame) -> DataFrame:
    """type and where it was seen: lower (in lower case), upper_inside (with a capital within a sentence), upper (with a capital at all),
    lower_first (in lower case at a sentence's beginning)."""
    seen = lambda c: F.coalesce(F.max(c), F.lit(False))
    low, up = F.col("letter") == "l", F.col("letter") == "u"
    return places.groupBy("type").agg(F.sum("n").alias("n"), seen(low).alias("lower"), seen(up & (F.col("place") == "m")).alias("upper_inside"), seen(up).alias("upper"), seen(low & (F.col("place") == "b")).alias("lower_first"))


_INITIAL = r"^\p{L}$"


def sentence_starters(places: DataFrame) -> DataFrame:
    """type and score of words that follow a sentence's end more often than chance says."""
    ends = (F.col("place") == "b") & (F.col("before") != "^")
    after = ends & ~F.coalesce((F.col("before_type") == NUMBER) | F.col("before_type").rlike(_INITIAL), F.lit(False))
    sums = {"all": F.lit(True), "here": after, "breaks": ends}
    types = scratch(places.groupBy("type").agg(*(F.sum(F.when(c, F.col("n"))).alias(k) for k, c in sums.items())))
    n, breaks = (int(x or 0) for x in types.agg(F.sum("all"), F.sum("breaks")).first())
    found = types.filter(F.col("type").rlike(r"^\p{L}+$") & (F.col("here") > 0))
    score = log_ratio(F.lit(float(breaks)), F.col("all").cast("double"), F.col("here").cast("double"), F.lit(float(n)))
    return found.withColumn("score", score).filter((F.col("score") >= STARTER) & (F.lit(n) / max(breaks, 1) > F.col("all") / F.col("here"))).select("type", "score")


def collocations(places: DataFrame, counts: DataFrame) -> DataFrame:
    """before_type, type and score: initials and numbers with a full stop and words that belong to them."""
    n = int(places.agg(F.sum("n")).first()[0] or 0)
    both = places.filter((F.col("before") == ".") & ((F.col("before_type") == NUMBER) | F.col("before_type").rlike(_INITIAL)) & F.col("type").rlike(r"[\p{L}\p{N}]"))
    both = both.groupBy("before_type", "type").agg(F.sum("n").alias("both")).filter("both > 1")
    whole = counts.select("type", (F.col("with_stop") + F.col("without")).alias("all"))
    rows = both.join(whole.select(F.col("type").alias("before_type"), F.col("all").alias("a")), "before_type").join(whole.select("type", F.col("all").alias("b")), "type")
    score = log_ratio(F.col("a").cast("double"), F.col("b").cast("double"), F.col("both").cast("double"), F.lit(float(n)))
    keep = (F.col("a") > 1) & (F.col("b") > 1) & (F.col("score") >= COLLOCATION) & (F.lit(n) / F.col("a") > F.col("b") / F.col("both"))
    return rows.withColumn("score", score).filter(keep).select("before_type", "type", "score")


_WORD, _NUMBER = re.compile(r"\S+"), re.compile(_DIGITS)


def _word_start(text: str, begin: int, at: int) -> int:
    """Where the word that ends at `at` begins, looked for in growing stretches before it."""
    width = 64
    while True:
        low = max(begin, at - width)
        found = max(text.rfind(c, low, at) for c in " \t\n\r\f\v\xa0")
        if found >= 0 or low == begin:
            return max(found + 1, begin)
        width *= 8


class Types:
    """A set of types as one sorted string of bytes, some tenth of a set's memory; every worker process holds it."""

    def __init__(self, types=()) -> None:
        held = sorted({t.encode() for t in types})
        self.text, self.ends = b"".join(held), np.cumsum([0, *map(len, held)])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def _at(self, i: int) -> bytes:
        return self.text[self.ends[i] : self.ends[i + 1]]

    def __contains__(self, one: str) -> bool:
        key, low, high = one.encode(), 0, len(self)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self._at(mid) < key else (low, mid)
        return low < len(self) and self._at(low) == key

    def __iter__(self):
        return (self._at(i).decode() for i in range(len(self)))

    def __eq__(self, other) -> bool:
        return set(self) == set(other)


class StoredTypes(Types):
    """A set of types of any size, as sorted lines of files that every executor has: each worker maps them and looks types up by halves."""

    def __init__(self, files: list[str]) -> None:
        self.files = files

    def __getstate__(self) -> dict:
        return {"files": self.files}

    @cached_property
    def _parts(self) -> tuple[list[bytes], list[mmap.mmap]]:
        """The files' first lines and their text, in order."""
        out = []
        for name in self.files:
            with open(SparkFiles.get(name), "rb") as f:
                out.append(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        out.sort(key=lambda m: m[: m.find(b"\n")])
        return [m[: m.find(b"\n")] for m in out], out

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def __contains__(self, one: str) -> bool:
        firsts, texts = self._parts
        key = one.encode()
        at = bisect_right(firsts, key) - 1
        if at < 0:
            return False
        text, low, high = texts[at], 0, len(texts[at])
        while low < high:
            mid = (low + high) // 2
            begin, end = text.rfind(b"\n", low, mid) + 1 or low, text.find(b"\n", mid)
            line = text[begin:end]
            if line == key:
                return True
            low, high = (end + 1, high) if line < key else (low, begin)
        return False

    def __iter__(self):
        for text in self._parts[1]:
            begin = 0
            while (end := text.find(b"\n", begin)) >= 0:
                yield text[begin:end].decode()
                begin = end + 1


class StoredPairs(StoredTypes):
    """A set of pairs of types, with a space between them, which no type has."""

    def __contains__(self, pair: tuple[str, str]) -> bool:
        return super().__contains__(" ".join(pair))

    def __iter__(self):
        return (tuple(line.split(" ")) for line in super().__iter__())


@dataclass
class SentenceModel:
    abbreviations: set[str] | StoredTypes = field(default_factory=set)
    starters: set[str] | StoredTypes = field(default_factory=set)
    collocations: set[tuple[str, str]] | StoredPairs = field(default_factory=set)
    #: Of types seen with a capital where a full stop leaves doubt: those that begin sentences then, as they are seen in lower case and never
    #: with a capital inside; and all that are seen in lower case.
    capital_starts: Types = field(default_factory=Types)
    lower: Types = field(default_factory=Types)

    @staticmethod
    def type_of(token: str) -> tuple[str, str]:
        """A token without quotes and brackets, and its type."""
        core = token.lstrip(OPENERS).rstrip(CLOSERS)
        bare = core.removesuffix(".").lower()
        return core, NUMBER if bare[:1] in _FIRST and _NUMBER.match(bare) else bare

    def ends(self, token: str, following: str) -> bool:
        """Whether a sentence ends between two tokens, of which the first ends with a mark."""
        core, kind = self.type_of(token)
        if not core.endswith("."):
            return True
        after, next_kind = self.type_of(following)
        capital, small = after[:1].isupper(), after[:1].islower()
        initial, dots = len(kind) == 1 and kind.isalpha(), not kind.strip(".")
        if (kind, next_kind) in self.collocations:
            return False
        short = (kind in self.abbreviations or dots) and not initial
        if short or initial or kind == NUMBER:
            begins = True if capital and next_kind in self.capital_starts else False if small else None
            if short:
                return bool(begins or (capital and next_kind in self.starters))
            if begins is False or (begins is None and initial and capital and next_kind not in self.lower):
                return False
        return not small or kind not in self.abbreviations

    def split(self, text: str | None) -> list[str]:
        out, begin = [], 0
        for m in _CANDIDATE.finditer(text or ""):
            at, end = m.start() + 1, m.end()
            if self.ends(text[_word_start(text, begin, at) : end].rstrip(), _WORD.match(text, end)[0]):
                out.append(text[begin:end].rstrip())
                begin = end
        if text and text[begin:].strip():
            out.append(text[begin:])
        return out


def _held(rows: DataFrame, most: int, make, *columns: str):
    """The set of the rows' types, or of their pairs: made in memory of at most `most`, stored if there are more."""
    few = rows.select(*columns).limit(most + 1).toArrow()  # one more tells whether there are more
    if len(few) <= most:
        values = few.to_pydict()
        return make(values[columns[0]] if len(columns) == 1 else zip(*(values[c] for c in columns)))
    files = kept_lines(rows.select(F.concat_ws(" ", *columns).alias("line")).orderBy("line"))
    return (StoredTypes if len(columns) == 1 else StoredPairs)(files)


def train_sentence_model(texts: DataFrame, text: str = "text", most: int = 1 << 20) -> SentenceModel:
    """The model with all types that were learnt. Sets of more than `most` types are stored (`StoredTypes`) as long as the session lasts."""
    pairs = scratch(neighbour_counts(texts, text))
    counts = scratch(type_counts(pairs))
    short = scratch(abbreviations(counts))
    places = scratch(marked(pairs, short))
    unsure = (F.col("place") == "?") | (F.col("before_type") == NUMBER) | F.col("before_type").rlike(_INITIAL)
    asked = places.filter((F.col("before") == ".") & (F.col("letter") == "u") & unsure).select("type").distinct()  # other contexts are never asked for
    follows = scratch(contexts(places).join(asked, "type", "left_semi").filter("lower"))
    model = SentenceModel(
        _held(short, most, set, "type"),
        _held(sentence_starters(places), most, set, "type"),
        _held(collocations(places, counts), most, set, "before_type", "type"),
        _held(follows.filter("NOT upper_inside"), most, Types, "type"),
        _held(follows, most, Types, "type"),
    )
    drop(follows)
    drop(pairs, counts, short, places)
    return model


def explode_trained(docs: DataFrame, text: str, model: SentenceModel, min_chars: int = 10, max_chars: int = 1000) -> DataFrame:
    """As `explode_sentences`: columns of docs, sent_idx, sent_total and sent_text, with the model's boundaries."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def sentences(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s for s in model.split(t) if min_chars <= len(s) <= max_chars])

    rows = docs.withColumn("_kept", sentences(text))
    return rows.select("*", F.size("_kept").cast("long").alias("sent_total"), F.posexplode("_kept").alias("_i", "sent_text")).withColumn("sent_idx", F.col("_i").cast("long")).drop("_kept", "_i")
