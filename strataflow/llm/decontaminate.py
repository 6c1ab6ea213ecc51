"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are cut into words (runs of letters and digits, lower case). A seed is a fixed mask over consecutive words; words at
its zeros are ignored. Both masks together hit every window of 13 words in which up to two words are substituted (each
mask alone misses some; the pair was found by trying all masks of six words, and a test goes through all 78 places of two
substitutions). Seed hashes of the benchmark are joined with those of all documents. A hit proposes how the item would lie in the text; the words around it
are aligned with the item's that way, and a window of `WINDOW` words with at most `SUBSTITUTIONS` differences must be
found. An item shorter than a window must occur whole and unchanged; one shorter than a mask has its whole word sequence
as its seed, and documents are hashed by as many words where items of that length exist.

Defined cases: null and empty texts hold nothing; null item texts, and items without a word, are ignored; a long text is
one row, whose words are held as arrays, and of which a hit copies no more words than its item has; rows that share an id
are one document, null ids are one too, though each different text is searched by itself, so many rows without an id are
not gathered; columns of documents may have any names;
null item ids are ignored, items that share an id are one, repeated texts are reported under each of their ids; an empty table gives an empty result. Only the id and text column of
either table are read. Text is not shuffled: the benchmark's seeds are broadcast after a count (SEED_ROWS), beyond it the
documents' seed hashes are shuffled; texts with hits are met by a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import BROADCAST_LISTS, lookup_join, staged, table, unused

#: 1 marks the words that count.
MASKS = ("11101011", "110100111")
WINDOW, SUBSTITUTIONS = 13, 2
SEED_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def seeds(words: DataFrame, short: list[int], whole: bool = False) -> DataFrame:
    """key, at (first word, from 0) and the other columns of rows with an array `words`, which is left behind.

    short: the lengths below a mask's at which word sequences are hashed too; of items (`whole`) only the entire sequence.
    Hashes are made inside the row's arrays, so that what is exploded is narrow however long a text is.
    """
    hashed = words.select(*(c for c in words.columns if c != "words"), F.transform("words", lambda w: F.xxhash64(w)).alias("_w"))
    keys = []
    for i, mask in enumerate([*MASKS, *("1" * n for n in short)]):
        ones = ", ".join(f"get(_w, p + {k})" for k, bit in enumerate(mask) if bit == "1")
        made = F.expr(f"transform(sequence(0, size(_w) - {len(mask)}), p -> xxhash64({i if i < len(MASKS) else 100 + len(mask)}, {ones}))")
        fits = F.size("_w") == len(mask) if whole and i >= len(MASKS) else F.size("_w") >= len(mask)
        keys.append(F.when(fits, made).otherwise(F.array().cast("array<bigint>")).alias(f"_k{i}"))
    kept = [c for c in hashed.columns if c != "_w"]
    both = hashed.select(*kept, *keys)
    ends, at = F.lit(0), F.col("_p")
    for i in range(len(keys) - 1):  # a key's place among those of its mask
        ends = ends + F.size(f"_k{i}")
        both = both.withColumn(f"_e{i}", ends)
    flat = both.select(*kept, *(f"_e{i}" for i in range(len(keys) - 1)), F.posexplode(F.concat(*(f"_k{i}" for i in range(len(keys))))).alias("_p", "key"))
    for i in range(len(keys) - 1):
        at = F.when(F.col("_p") >= F.col(f"_e{i}"), F.col("_p") - F.col(f"_e{i}")).otherwise(at)
    return flat.select(*kept, "key", at.alias("at"))


def overlaps(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """doc_id, item_id, first_word, end_word: the span of a document's words within verified windows of an item."""
    items = staged(benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), words_of(F.col(item_text_col)).alias("words")).withColumn("n_item", F.size("words")), "items")
    # at most as many rows as a mask has words
    short = sorted(r["n"] for r in items.select(F.size("words").alias("n")).filter(F.col("n").between(1, len(MASKS[0]) - 1)).distinct().collect())
    known = staged(seeds(items, short, whole=True).withColumnRenamed("at", "item_at"), "seeds")
    text = F.col(text_col)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    found = seeds(docs.select("doc_id", "mark", words_of(F.col("text")).alias("words")), short)
    small = known.limit(SEED_ROWS + 1).count() <= SEED_ROWS
    hits = found.join(F.broadcast(known) if small else known, "key")
    # a hit proposes a diagonal: where the item would start in the document; texts with one mark only share proposals
    places = hits.select("doc_id", "mark", "item_id", "n_item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    row = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "mark"]
    places = staged(places.groupBy(*row).agg(F.collect_list(F.struct("item_id", "n_item", "shift")).alias("places")), "places")
    again = lookup_join(docs.select("doc_id", "text", *row), places, ["id", "none", "mark"], "inner", ["id"], most=BROADCAST_LISTS)
    again = again.select("doc_id", words_of(F.col("text")).alias("words"), "places")
    first = lambda p: F.greatest(F.lit(0), p["shift"])
    length = lambda p: F.greatest(F.lit(1), F.least(F.size("words") - first(p), p["n_item"] - first(p) + p["shift"]))
    # words are got one by one: slice() inside transform() would copy all words for each place
    part = lambda p: F.transform(F.sequence(F.lit(0), length(p) - 1), lambda k: F.get("words", first(p) + k))
    met = F.transform("places", lambda p: F.struct(p["item_id"].alias("item_id"), p["shift"].alias("shift"), first(p).alias("base"), part(p).alias("x")))
    cut = again.select("doc_id", F.explode(met).alias("p")).select("doc_id", "p.*")
    # every item with a word has a seed, and at most seven words more than seeds: the count of seeds bounds these too
    item_words = items.select("item_id", F.col("words").alias("y")).filter("item_id is not null and size(words) > 0")
    size = F.size("y")
    both = cut.join(F.broadcast(item_words) if small else item_words, "item_id")
    skip = F.col("base") - F.col("shift")
    aligned = both.select("doc_id", "item_id", "base", F.least(F.lit(window), size).alias("window"), F.when(size < window, size).otherwise(window - substitutions).alias("need"), F.size("x").alias("length"), F.zip_with("x", F.slice("y", skip + 1, F.size("x")), lambda a, b: (a == b).cast("int")).alias("same"))
    good = F.expr("filter(sequence(0, size(same) - window), s -> aggregate(slice(same, s + 1, window), 0, (a, b) -> a + b) >= need)")
    passed = aligned.withColumn("good", F.when((F.col("length") >= F.col("window")) & (F.size("same") >= F.col("window")), good)).filter(F.size("good") > 0)
    spans = passed.select("doc_id", "item_id", (F.col("base") + F.array_min("good")).alias("first"), (F.col("base") + F.array_max("good") + F.col("window")).alias("end"))
    return spans.groupBy("doc_id", "item_id").agg(F.min("first").cast("long").alias("first_word"), F.max("end").cast("long").alias("end_word"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, whose id is not in overlaps()."""
    number, none = (unused(n, documents) for n in ("_id", "_none"))
    hit = overlaps(documents, benchmark, id_col, text_col).select(F.coalesce("doc_id", F.lit(0)).alias(number), F.col("doc_id").isNull().alias(none))
    hit, own = staged(hit.distinct(), "leaks"), F.col(id_col).cast("long")
    keyed = documents.withColumn(number, F.coalesce(own, F.lit(0))).withColumn(none, own.isNull())
    return lookup_join(keyed, hit, [number, none], "left_anti", [id_col]).drop(number, none)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: By another way: any window of 13 words with at most two substitutions holds four equal words in a row.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS y FROM benchmark),
dg AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS pos FROM d)),
bg AS (SELECT item_id, pos, array_to_string(y[pos:pos + 3], ' ') AS g FROM (SELECT item_id, y, unnest(range(1, len(y) - 2)) AS pos FROM b)),
short AS (SELECT doc_id, item_id, pos - 1 AS shift FROM (SELECT doc_id, w, item_id, y, unnest(range(1, len(w) - len(y) + 2)) AS pos FROM d, b WHERE len(y) BETWEEN 1 AND 3) WHERE w[pos:pos + len(y) - 1] = y),
hits AS (SELECT DISTINCT doc_id, item_id, dg.pos - bg.pos AS shift FROM dg JOIN bg USING (g) UNION SELECT * FROM short),
laid AS (SELECT doc_id, item_id, shift, len(w) AS n, least(13, len(y)) AS size, CASE WHEN len(y) < 13 THEN len(y) ELSE 11 END AS need, len(y) AS m, list_transform(range(1, len(y) + 1), lambda p: CASE WHEN p + shift >= 1 AND w[p + shift] = y[p] THEN 1 ELSE 0 END) AS same FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
found AS (SELECT doc_id, item_id, shift, size, list_filter(range(1, m - size + 2), lambda s: s + shift >= 1 AND s + size - 1 + shift <= n AND list_sum(same[s:s + size - 1]) >= need) AS good FROM laid)
SELECT doc_id, item_id, CAST(min(list_min(good) + shift - 1) AS BIGINT) AS first_word, CAST(max(list_max(good) + size - 1 + shift) AS BIGINT) AS end_word FROM found WHERE len(good) > 0 GROUP BY doc_id, item_id
"""
