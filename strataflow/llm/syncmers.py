"""Document fingerprints by closed syncmers, in DataFrame functions only.

A k-mer (K code points) has K - S + 1 inner substrings of S code points, ordered by their hashes. It is an anchor where the
least, the leftmost of equal ones, stands at its first or last place. That depends on the k-mer alone, so an edit only
touches anchors that overlap it, and no K - S + 1 places in a row are without one. Text of a short period has one a period.
The fingerprint of a text is its anchors in order, each with its distance from the one before; a text too short to have any
has one for the whole. Two fingerprints are compared by place, in two ways: by anchors at
the same place of both texts, which counts every repetition of a passage, and by links, which are distinct anchors at the
same distance from the same anchor before, wherever that stands. The likeness is the greater of the two shares, twice what
is common over all of both.

Since anchors are free of context, a text is cut into overlapping blocks of BLOCK code points, so that the arrays in a task
stay small however long it is, and an edited text needs only the anchors after the last place that it shares with the old.

Neighbours in the order of doc_id: rows are dealt to buckets by quantiles of doc_id, about `bucket_bytes` of text each; the
first row of each is repeated in the one before, so that one window, within buckets, brings every row its next. Rows of one
id so frequent that quantiles repeat are dealt further, by the hash of their text, which is also the order among them.

Defined cases: a null text is empty; rows without an id come first, as one id; rows repeated with id and text follow one
another; the only row is its own next; an empty text is like an empty text (1.0) and like no other (0.0); an empty table
gives no rows. Only the id and text column are read, so others never clash. A text is one row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataflow.llm.common import staged, table

#: Code points of a k-mer and of its inner substrings; K is a multiple of S. An anchor stands about every 8 code points of prose.
K, S = 20, 5
BLOCK = 2048
LOW = 0xFFFFFFFF
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 1 << 15


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _all(conditions: list[Column]) -> Column:
    """Conjunction that stops at the first that fails."""
    return reduce(lambda rest, c: c & rest, reversed(conditions))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW))


def _packed(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(_low(low))


def _in_block(block: Column, start: Column) -> Column:
    """anchors() of one block, which begins at a place of the text."""
    width = K - S

    def closed(h: Column, x: Column, i: Column) -> Column:
        """Whether the k-mer that begins at place i has its least inner substring at an edge; null or false where the block ends before."""
        last, inside = F.get(h, i + width), [F.get(h, i + j) for j in range(1, width)]
        return F.when(x <= last, _all([x <= y for y in inside])).otherwise(_all([last < y for y in inside]))

    def chosen(h: Column) -> Column:
        at = F.filter(F.transform(h, lambda x, i: F.when(closed(h, x, i), i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: _packed(start + i, F.xxhash64(*(F.get(h, i + j) for j in range(0, K, S)))))

    inner = F.regexp_extract_all(block, F.lit(f"(?s)(?=(.{{{S}}}))."), F.lit(1))
    return _let(F.transform(inner, lambda x: F.xxhash64(x)), chosen)


def anchors(text: Column) -> Column:
    """A text's closed syncmers in order: array of long, the place in the upper half and 32 bits of the k-mer's hash below."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{BLOCK + K - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    return F.flatten(F.transform(blocks, lambda b, i: _in_block(b, i * BLOCK)))


def or_whole(found: Column, text: Column) -> Column:
    """anchors() of a text, or for a text without any, one at the place -1 with the hash of it all."""
    return F.when(F.size(found) > 0, found).otherwise(F.array(_packed(F.lit(-1), F.xxhash64(text))))


def fingerprint(spots: Column) -> Column:
    """or_whole() with the distance from the anchor before for the place."""
    return F.transform(spots, lambda a, i: F.when(i == 0, a).otherwise(a - F.shiftleft(F.shiftright(F.get(spots, i - 1), 32), 32)))


def written(prints: Column) -> Column:
    """A fingerprint as a string: distance:hash of each anchor in hexadecimal, or =hash for a text without anchors."""
    digits = lambda x: F.lower(F.hex(x))
    return F.array_join(F.transform(prints, lambda a: F.concat(F.when(a < 0, F.lit("=")).otherwise(F.concat(digits(F.shiftright(a, 32)), F.lit(":"))), digits(_low(a)))), ",")


def links(prints: Column) -> Column:
    """What a fingerprint has at its places: distinct hashes of an anchor, its distance from the one before, and that one."""
    return F.array_distinct(F.transform(prints, lambda a, i: F.when(i == 0, F.xxhash64(a < 0, _low(a))).otherwise(F.xxhash64(_low(F.get(prints, i - 1)), a))))


def likeness(spots: Column, joined: Column, other_spots: Column, other_joined: Column) -> Column:
    """Of two texts by their or_whole() and links(), from 0 to 1."""
    dice = lambda a, b: 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))
    return F.greatest(dice(spots, other_spots), dice(joined, other_joined))


def in_order(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, WindowSpec]:
    """(rows, window): doc_id, text and columns that the window needs; its lead is the next row, the first after the last.

    Rows with `again` repeat the first row of the next bucket and are to be dropped when the window has been used.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.shiftrightunsigned(F.xxhash64("text"), 1).alias("tie"))
    volume = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, min(MOST_BUCKETS, -(-volume // bucket_bytes)))
    shares = F.split(F.lit(",".join(str(i / n) for i in range(1, n))), ",").cast("array<double>") if n > 1 else F.array(F.lit(0.5))
    cuts = staged(keyed.agg(F.percentile_approx("key", shares, max(10_000, 10 * n)).alias("cuts")).filter("cuts is not null"), "cuts")  # one row
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(MOST_BUCKETS.bit_length()))))

    def below(fits: Callable[[Column, Column], Column]) -> Column:
        """How many cuts, from the first, fit a row's key: by halving."""
        return F.aggregate(steps, F.lit(0), lambda k, s: F.when((k + s <= F.size("cuts")) & fits(F.get("cuts", k + s - 1), F.col("key")), k + s).otherwise(k))

    placed = keyed.crossJoin(F.broadcast(cuts)).select("doc_id", "text", "key", "tie", below(lambda cut, key: cut < key).alias("lo"), below(lambda cut, key: cut <= key).alias("hi"))
    share = F.floor(F.col("tie") / F.lit(2.0**63) * (F.col("hi") - F.col("lo")))
    dealt = F.when(F.col("hi") - F.col("lo") < 2, F.col("hi")).otherwise(F.least(F.col("hi"), F.col("lo") + 1 + share)).cast("int")
    placed = placed.select("doc_id", "text", "key", "tie", dealt.alias("bucket"))
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("first"))
    row = Window.orderBy("bucket")  # one row a bucket, MOST_BUCKETS at most
    firsts = firsts.select("first.*", F.coalesce(F.lag("bucket").over(row), F.max("bucket").over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("bucket"))
    repeated = keyed.join(F.broadcast(staged(firsts, "firsts")), ["key", "tie"]).dropDuplicates(["bucket"])
    both = placed.withColumn("again", F.lit(False)).unionByName(repeated.withColumn("again", F.lit(True)))
    return both, Window.partitionBy("bucket").orderBy("again", "key", "tie")


def neighbour_prints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, prints, edited_prints (fingerprint()), near_edited, near_next of each document.

    The edited text has its last quarter of code points (rounded down) replaced by the first as many of the next document.
    """
    documents.sparkSession.conf.set("spark.sql.windowExec.buffer.in.memory.threshold", "64")  # more rows of a bucket are held where Spark can spill them
    rows, order = in_order(documents, id_col, text_col, bucket_bytes)
    held = ["doc_id", "bucket", "again", "key", "tie", "n_chars"]
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("n_chars", F.length("text"))
    rows = rows.select(*held, "text", (F.col("n_chars") - cut).alias("shared"), F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut)).alias("edited"))
    rows = rows.withColumn("found", anchors(F.col("text"))).withColumn("seam", F.greatest(F.lit(0), F.col("shared") - K + 1))
    later = F.transform(anchors(F.substring("edited", F.col("seam") + 1, F.length("edited"))), lambda a: a + F.shiftleft(F.col("seam").cast("long"), 32))
    rows = rows.withColumn("edited_found", F.concat(F.filter("found", lambda a: F.shiftright(a, 32) < F.col("seam")), later))
    rows = rows.select(*held, F.sha2(F.col("edited"), 256).alias("edited_sha256"), or_whole(F.col("found"), F.col("text")).alias("spots"), or_whole(F.col("edited_found"), F.col("edited")).alias("edited_spots"))
    rows = rows.withColumns({"prints": fingerprint(F.col("spots")), "edited_prints": fingerprint(F.col("edited_spots"))})
    rows = rows.withColumns({"links": links(F.col("prints")), "edited_links": links(F.col("edited_prints"))})
    like = lambda other: likeness(F.col("spots"), F.col("links"), F.col(f"{other}_spots"), F.col(f"{other}_links"))
    rows = rows.select(*held, "edited_sha256", "prints", "edited_prints", "spots", "links", like("edited").alias("near_edited"))
    rows = rows.withColumns({"next_spots": F.lead("spots").over(order), "next_links": F.lead("links").over(order)}).filter("not again")
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "prints", "edited_prints", "near_edited", like("next").alias("near_next"))


def op11_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbour_prints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", written(F.col("prints")).alias("fingerprint"), written(F.col("edited_prints")).alias("edited_fingerprint"), "near_edited", "near_next")
