"""How filters of documents interact: what each removes in every order of applying them, by recursive enumeration.

Each document gets a mask with one bit for every filter that it fails. Documents are counted by part and mask (cells), so
that what follows depends on parts only. A recursive query then extends prefixes of filter orders by each letter that they
lack, joins the part's cells, and carries the bits applied so far; the rows of a level are the metrics of that step. An
order's step is the row of its prefix, so 325 rows a part stand for the 600 of all 120 orders. A filter's shapley is the
sum of what it removes at a prefix, times the orders that begin with it.

Filters (words are maximal runs of other characters than blanks and \\t \\n \\v \\f \\r): A under 200 words; B less than half of
the words distinct; C more than 2 % of the code points in A-Z; D a character of #$%&*|; E the text of a smaller doc_id
anywhere in the table, whether that is removed or not.

Defined cases: null texts are empty, a null source is the part ''; a row without id is never later than another, nor
earlier, and has no labels; rows repeated with their id and text are counted each and are not copies of each other; rows
of one id with different texts are judged one by one; labels are met by id, and of several for one id the largest counts;
an empty table gives no rows. Only id, text, source and the labels' three columns are read, so others never clash. A text
is one row, whose words a task holds as an array. Texts are never shuffled: only their digests, counted by equal rows
before; copies are found by the least id of each digest (summed before the shuffle), which only one id of the group meets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import staged, table

WORD = "[^\\x20\\x09-\\x0D]+"
LETTERS = "ABCDE"
BITS = {letter: 1 << i for i, letter in enumerate(LETTERS)}
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column, words: Column) -> dict[str, Column]:
    """By letter, whether a text fails the filters that judge it alone; words is the array of its words."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def judged(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask, copies: how many rows of an id and a part fail the filters of mask; ids may take several rows."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    alone = sum((fails.cast("int") * BITS[letter] for letter, fails in failures(F.col("text"), F.col("words")).items()), F.lit(0))
    narrow = rows.select("doc_id", "part", alone.alias("mask"), F.unhex(F.sha2(F.col("text"), 256)).alias("digest"))
    counted = staged(narrow.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("copies")), "judged")
    first = counted.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("first").isNull().cast("int") * BITS["E"]
    known = counted.filter("doc_id is not null").join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + later)
    return known.select("doc_id", "part", "mask", "copies").unionByName(counted.filter("doc_id is null").select("doc_id", "part", "mask", "copies"))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part: arrays n, good, toxic with a count for each mask from 0."""
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.filter("doc_id is not null").join(marks, "doc_id", "left")
    both = known.unionByName(rows.filter("doc_id is null"), allowMissingColumns=True)
    counts = both.groupBy("part", "mask").agg(F.sum("copies").alias("n"), *(F.sum(F.when(F.col(c) == 1, F.col("copies")).otherwise(0)).alias(c) for c in ("good", "toxic")))
    by_mask = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("found"))
    each = lambda c: F.transform(F.sequence(F.lit(0), F.lit(2 ** len(LETTERS) - 1)), lambda m: F.coalesce(F.try_element_at("found", m)[c], F.lit(0).cast("long")))
    return by_mask.select("part", *(each(c).alias(c) for c in ("n", "good", "toxic")))


def _total(counts: str, condition: str) -> str:
    """SQL for the sum of an array's counts over masks m that meet a condition."""
    return f"aggregate(filter({counts}, (x, m) -> {condition}), 0L, (a, x) -> a + x)"


_FREE, _FAILS = "m & s.applied = 0", "m & l.bit <> 0"
LEVELS_SQL = f"""
WITH RECURSIVE letters(letter, bit) AS (VALUES {", ".join(f"('{letter}', {bit})" for letter, bit in BITS.items())}),
steps(part, prefix, applied, step, letter, {", ".join(METRICS)}) AS (
  SELECT part, '', 0, 0, '', aggregate(n, 0L, (a, x) -> a + x), 0L, 0L, 0L, 0L, 0L FROM {{cells}}
  UNION ALL
  SELECT s.part, s.prefix || l.letter, s.applied | l.bit, s.step + 1, l.letter,
    {_total("c.n", "m & (s.applied | l.bit) = 0")}, {_total("c.n", f"{_FREE} AND {_FAILS}")}, {_total("c.n", f"NOT {_FREE} AND {_FAILS}")},
    c.n[l.bit], {_total("c.good", f"{_FREE} AND {_FAILS}")}, {_total("c.toxic", f"{_FREE} AND {_FAILS}")}
  FROM steps s JOIN letters l ON s.applied & l.bit = 0 JOIN {{cells}} c ON c.part = s.part
)
SELECT part, prefix, step, letter, {", ".join(METRICS)} FROM steps WHERE step > 0
"""


def levels(counts: DataFrame) -> DataFrame:
    """part, prefix, step, letter and the metrics of every prefix of every order, by recursion over cells()."""
    spark = counts.sparkSession
    prefixes = sum(math.perm(len(LETTERS), k) for k in range(len(LETTERS) + 1))
    limit = "spark.sql.cteRecursionRowLimit"  # Spark stops a recursion at this many rows; ours is bounded by its letters
    spark.conf.set(limit, str(max(int(spark.conf.get(limit)), prefixes * counts.count() + 1)))
    return spark.sql(LEVELS_SQL, cells=counts)


def interactions(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, the metrics and shapley: one row a part, order of all filters and step."""
    found = staged(levels(staged(cells(judged(documents, id_col, text_col, part_col), labels), "cells")), "levels")
    orders = found.filter(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"))
    each = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS))))).withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    completions = F.factorial(F.lit(len(LETTERS)) - F.col("step"))
    shapley = found.groupBy("part", "letter").agg(F.sum(F.col("removed") * completions).alias("shapley"))
    return each.join(found.join(shapley, ["part", "letter"]).drop("step"), ["part", "prefix"]).select("part", "filter_order", "step", *METRICS, "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: By another way: no recursion and no cells, every document is walked through every order.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(first < doc_id, false)] AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
j AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || e.c || g.c || h.c AS filter_order FROM x a, x b, x e, x g, x h WHERE len(list_distinct([a.c, b.c, e.c, g.c, h.c])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, ascii(filter_order[step]) - 64 AS place, list_transform(range(1, step), lambda k: ascii(filter_order[k]) - 64) AS before FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, place, fails[place] AS here, list_contains(list_transform(before, lambda k: fails[k]), true) AS gone, len(list_filter(fails, lambda v: v)) = 1 AS single, good, toxic FROM j, s),
m AS (SELECT part, filter_order, step, place, count(*) FILTER (NOT here AND NOT gone) AS kept, count(*) FILTER (here AND NOT gone) AS removed, count(*) FILTER (here AND gone) AS redundant, count(*) FILTER (here AND single) AS unique_fails,
  count(*) FILTER (here AND NOT gone AND good = 1) AS good_lost, count(*) FILTER (here AND NOT gone AND toxic = 1) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, place) AS BIGINT) AS shapley FROM m
"""
