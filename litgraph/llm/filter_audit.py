"""Audit of how filters interact: what each removes in every order, what it removes alone, and its share over all orders.

Every document has one failure flag for each filter. Documents are counted by flags and part before anything else happens, so at most 32
rows for each part go into CUBE over the flags and the part. In a row of CUBE a flag is either grouped away or given; the rows whose given
flags are all false count the survivors of that subset of filters, whatever their order. A step of an order goes from one subset to
the next, so its figures are differences between two of these rows, found by joins on part and subset.

The fifth flag asks for the smallest id that has the text. Only ids and 256-bit digests of texts move: the least id for each digest is an
aggregate with partial sums, and a row is the first of its copies if (digest, id) is in that table. This key spreads a group of copies over
all tasks, however large it is.

Edge cases: null and empty texts are one text, without words (A fails, B to D don't). A null language is the part "". Repeated ids with equal
texts aren't each other's copies, since neither id is smaller; rows with a null id are nobody's copy and make none. Of repeated labels
any 1 counts; a null label is none. Without documents there are no parts and no rows. Only the columns named here are read.
"""

from __future__ import annotations

import string
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: White space as Java's and RE2's expressions write it, and the least number of words.
SPACE, LEAST_WORDS = r"[ \t-\r]+", 200


def failures(text: Column) -> dict[str, Column]:
    """Flags of the four filters that see one text: too short, repetitive, upper-case, symbols."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < LEAST_WORDS, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def flag_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, good, toxic) for each document."""
    text = F.coalesce("text", F.lit(""))
    flags = [c.alias(k) for k, c in failures(text).items()]
    rows = written(documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *flags), "audit-flags")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("is_first", F.lit(True))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    met = rows.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    return met.select("part", "A", "B", "C", "D", copy.alias("E"), (F.coalesce("quality", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))


def survivors(flags: DataFrame, filters: str) -> DataFrame:
    """(part, subset, n, good, toxic): documents that fail no filter of the subset, a bit mask by place in `filters`. Subsets that nothing
    survives have no row."""
    names = list(filters)
    counted = flags.groupBy("part", *names).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    cube = counted.cube(*names, "part").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")), F.grouping("part").alias("all_parts"), *(F.grouping(k).alias(f"any_{k}") for k in names))
    mine = F.col("all_parts") == 0
    for k in names:
        mine &= (F.col(f"any_{k}") == 1) | ~F.col(k)
    subset = sum(((1 - F.col(f"any_{k}").cast("int")) * (1 << i) for i, k in enumerate(names)), F.lit(0))
    return cube.filter(mine).select("part", subset.alias("subset"), "n", "good", "toxic")


def audit(flags: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of all filters and step. `flags` has a column for each filter, named by one letter, and part, good and
    toxic."""
    if not filters or len(set(filters)) != len(filters) or not set(filters) <= set(string.ascii_letters):
        raise ValueError("filters are different letters")
    kept = written(survivors(flags, filters), "audit-survivors")
    whole = (1 << len(filters)) - 1
    bits = lambda letters: sum((F.when(F.instr(letters, k) > 0, 1 << i).otherwise(0) for i, k in enumerate(filters)), F.lit(0))

    def of(rows: DataFrame, subset: str, *names: str) -> DataFrame:
        """Adds the counts of a subset as subset_n, ...; a subset without a row has none left."""
        found = kept.select(F.col("part").alias("_part"), F.col("subset").alias("_subset"), *(F.col(c).alias(f"{subset}_{c}") for c in names))
        joined = rows.join(found, (F.col("part") == F.col("_part")) & (F.col(subset) == F.col("_subset")), "left").drop("_part", "_subset")
        return joined.fillna(0, [f"{subset}_{c}" for c in names])

    parts = kept.filter("subset = 0").select("part", F.col("n").alias("documents"))
    letters = parts.select("*", F.explode(F.split(F.lit(filters), "")).alias("letter"))
    letters = letters.select("*", bits(F.col("letter")).alias("alone"), F.lit(whole).alias("every")).withColumn("others", F.col("every") - F.col("alone"))
    letters = of(of(of(letters, "alone", "n"), "others", "n"), "every", "n")
    letters = letters.select("part", "letter", (F.col("documents") - F.col("alone_n")).alias("fails"), (F.col("others_n") - F.col("every_n")).alias("unique_fails"))

    orders = F.explode(F.lit(["".join(p) for p in permutations(filters)]))
    steps = parts.select("part", orders.alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    steps = steps.withColumn("before", bits(F.substring("filter_order", F.lit(1), F.col("at")))).withColumn("after", F.col("before") + bits(F.col("letter")))
    steps = of(of(steps, "before", "n", "good", "toxic"), "after", "n", "good", "toxic").join(letters, ["part", "letter"])
    removed = F.col("before_n") - F.col("after_n")
    return steps.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), F.col("after_n").alias("kept"), removed.alias("removed"), (F.col("fails") - removed).alias("redundant"), "unique_fails",
        (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"), F.sum(removed).over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(flag_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 3 * length(body) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN d.doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM docs d LEFT JOIN marks m ON m.doc_id = d.doc_id
), counted AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letter a JOIN letter b ON b.x <> a.x JOIN letter c ON c.x NOT IN (a.x, b.x) JOIN letter d ON d.x NOT IN (a.x, b.x, c.x) JOIN letter e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), met AS (
  SELECT part, filter_order, fails, n, good, toxic,
    coalesce(list_min(list_transform(list_filter(string_split(fails, ''), lambda f: f <> ''), lambda f: instr(filter_order, f))), 6) AS out_at
  FROM counted CROSS JOIN orders
), steps AS (
  SELECT part, filter_order, s.step, substr(filter_order, s.step, 1) AS x,
    sum(CASE WHEN out_at > s.step THEN n ELSE 0 END) AS kept, sum(CASE WHEN out_at = s.step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN out_at < s.step AND instr(fails, substr(filter_order, s.step, 1)) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = substr(filter_order, s.step, 1) THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN out_at = s.step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN out_at = s.step THEN toxic ELSE 0 END) AS toxic_lost
  FROM met CROSS JOIN (SELECT unnest(range(1, 6)) AS step) s GROUP BY part, filter_order, s.step
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM steps
"""
