"""A trie of conversations' prefixes, and its subtree totals by centroid decomposition.

A prefix is known by its depth and a sum of hashes of (place, turn) over its turns: places tell the terms apart, so sums
of two 64-bit hashes, kept in four parts of 32 bits, stand for the sequence, and running sums give every prefix of a
conversation. Grouping by them yields the nodes. A node's address is its smallest member and its depth: that member's
path leads through it, so an ancestor is met by one join with the table of paths, whatever the distance.

Subtree totals are added up by centroids. A node's mass is what all its members have left from it on, in turns; every
node has some, and what its subtree holds is known from its members alone. In a component (a connected part of the forest
of parent edges, with one top) the nodes with half the component's mass or more are just the path from the centroid to
the top. Each round finds every component's centroid, sums the component below it, adds this to all nodes of the path,
and cuts: the centroid leaves with its total, its children's subtrees and what is left above are the next components, none
with more than half the mass. So rounds grow with the logarithm of all turns, for chains and for stars alike.

Defined cases: rows without conv_id are left out; null role and text are empty; null turns come first, and turns that tie
are ordered by a hash of role and text, so repeated rows count each; conversations that end up without turns are members
of the root only; an empty table gives no nodes (no root either). Only conv_id, turn, role, text are read, so other columns
never clash. Texts are hashed where they are read and never shuffled. A conversation of any number of turns is numbered
and summed in blocks of BLOCK turns by their number, with one row a block; a node's members are summed before the shuffle.
Only a node's digest of its ends goes through one task, as SHA-256 is a sequence: in pieces, a batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataflow.llm.common import BROADCAST_ROWS, lookup_join, staged, table

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK = 4096
#: Conversations of one family of FAMILY ids begin with up to HEAD - 1 turns of its first.
FAMILY, HEAD = 20, 4
LOW = 0xFFFFFFFF


def met(rows: DataFrame, small: DataFrame, on: list[str], salt_by: list[str], n: int) -> DataFrame:
    """rows joined with small, of n rows and one for each key: broadcast within the bound, else by key and salt."""
    return rows.join(F.broadcast(small), on) if n <= BROADCAST_ROWS else lookup_join(rows, small, on, "inner", salt_by)


def running(blocks: DataFrame, keys: list[str], by: str, sums: dict[str, Column]) -> DataFrame:
    """blocks with the sums of all earlier blocks of the same keys."""
    before = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*keys, by, *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(name) for name, x in sums.items()))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, depth from 1, h1, h2, words; conversations: conv_id, length) of the rebuilt conversations.

    A conversation's first crc32(conv_id) % HEAD turns are replaced by as many of its family's first, where that has them.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.floor(F.col("turn").cast("long") / BLOCK).cast("long"), F.lit(-(1 << 62))).alias("block"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), text, role).alias("h2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    own = staged(own, "turns")
    blocks = own.groupBy("conv_id", "block").agg(F.count("*").alias("k"))
    lengths = blocks.groupBy("conv_id").agg(F.sum("k").alias("n"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEAD)).cast("long")
    family = lengths.select("conv_id", "n", taken.alias("taken"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    firsts = lengths.select(F.col("conv_id").alias("first"), F.col("n").alias("first_n"))
    family = family.join(firsts, "first", "left").withColumn("given", F.least("taken", F.coalesce("first_n", F.lit(0).cast("long"))))
    family = staged(family.withColumn("length", F.col("given") + F.greatest(F.lit(0), F.col("n") - F.col("taken"))), "families")
    offsets = running(blocks, ["conv_id"], "block", {"before": F.col("k")}).join(family.select("conv_id", "taken", "given"), "conv_id")
    within = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "h1", "h2"))
    placed = own.withColumn("within", within).join(offsets, ["conv_id", "block"])
    placed = staged(placed.select("conv_id", (F.col("before") + F.col("within")).alias("place"), "h1", "h2", "words", "taken", "given"), "placed")
    rest = placed.filter("place > taken").select("conv_id", (F.col("given") + F.col("place") - F.col("taken")).alias("depth"), "h1", "h2", "words")
    heads = placed.filter((F.col("place") < HEAD) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("first"), "place", "h1", "h2", "words")
    begun = family.select("conv_id", "first", "given").join(heads, "first").filter("place <= given")
    return begun.select("conv_id", F.col("place").alias("depth"), "h1", "h2", "words").unionByName(rest), family.select("conv_id", "length")


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2, words, length: each turn with the key of the prefix that ends with it."""
    g1, g2 = F.xxhash64("depth", "h1", "h2"), F.xxhash64("h2", "depth", "h1")
    low, high = (lambda g: g.bitwiseAND(F.lit(LOW))), (lambda g: F.shiftrightunsigned(g, 32))
    parts = staged(turns.select("conv_id", "depth", "words", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), low(g1).alias("a"), high(g1).alias("b"), low(g2).alias("c"), high(g2).alias("d")), "parts")
    names = ["a", "b", "c", "d"]
    blocks = parts.groupBy("conv_id", "block").agg(*(F.sum(x).alias(x) for x in names))
    before = running(blocks, ["conv_id"], "block", {f"{x}0": F.col(x) for x in names}).join(lengths, "conv_id")
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = parts.select("conv_id", "depth", "block", "words", *(F.sum(x).over(so_far).alias(x) for x in names)).join(before, ["conv_id", "block"])
    whole = lambda x: (F.col(x) + F.col(f"{x}0")).bitwiseAND(F.lit(LOW))
    return summed.select("conv_id", "depth", whole("a").bitwiseOR(F.shiftleft(whole("b"), 32)).alias("k1"), whole("c").bitwiseOR(F.shiftleft(whole("d"), 32)).alias("k2"), "words", "length")


def trie(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths) of conversations given by turns(conv_id, depth, h1, h2, words) and lengths(conv_id, length).

    paths: conv_id, depth, rep, parent: the node at each depth of each conversation, and the node before, by their smallest
    members. nodes: rep, depth, parent, n_convs, words of the last turn, mass; the root, at depth 0, has no parent.
    """
    keyed = staged(prefixes(turns, lengths), "prefixes")
    key = ["depth", "k1", "k2"]
    found = keyed.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.sum(F.col("length") - F.col("depth") + 1).alias("mass"))
    members = staged(lookup_join(keyed.select("conv_id", *key), staged(found, "nodes"), key, "inner", ["conv_id"]).drop("k1", "k2"), "members")
    root = staged(lengths.agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.sum(F.col("length") + 1).alias("mass")).filter("n_convs > 0"), "root")
    above = members.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent")).unionByName(lengths.crossJoin(F.broadcast(root)).select("conv_id", F.lit(1).cast("long").alias("depth"), F.col("rep").alias("parent")))  # the root is one row
    paths = staged(members.join(above, ["conv_id", "depth"]), "paths")
    nodes = paths.filter("conv_id = rep").select("rep", "depth", "parent", "n_convs", "words", "mass")
    top = root.select("rep", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words"), "mass")
    return nodes.unionByName(top), paths.select("conv_id", "depth", "rep", "parent")


def rollup(nodes: DataFrame, paths: DataFrame, weights: list[str]) -> DataFrame:
    """rep, depth and each weight summed over the node's subtree, by centroid decomposition; nodes also have mass."""
    comp = ["comp_rep", "comp_depth"]
    here = (F.col("rep") == F.col("comp_rep")) & (F.col("depth") == F.col("comp_depth"))
    sums = {w: f"acc_{w}" for w in weights}
    top = nodes.filter("depth = 0").select(F.col("rep").alias("comp_rep"), F.col("depth").alias("comp_depth"))
    state = staged(nodes.select("rep", "depth", "mass", *weights, *(F.lit(0).cast("long").alias(acc) for acc in sums.values())).crossJoin(F.broadcast(top)), "component")  # one top at first
    done: list[DataFrame] = []
    columns = state.columns
    while n := (tops := state.filter(here)).count():
        whole = met(state, tops.select(*comp, F.col("mass").alias("whole")), comp, ["rep", "depth"], n)
        path = whole.filter("2 * mass >= whole").groupBy(*comp).agg(F.min_by(F.struct("rep", "depth", "mass"), F.col("mass")).alias("c"), F.max("whole").alias("whole"))
        placed = met(state, staged(path, "centroids"), comp, ["rep", "depth"], n)
        lower = placed.filter("depth > c.depth").withColumn("below", F.col("c.depth") + 1)
        child = paths.select(F.col("conv_id").alias("rep"), F.col("depth").alias("below"), F.col("rep").alias("child"), F.col("parent").alias("child_parent"))
        lower = lower.join(child, ["rep", "below"]).withColumn("child", F.when(F.col("child_parent") == F.col("c.rep"), F.col("child")))
        upper = placed.filter("depth <= c.depth").withColumn("child", F.lit(None).cast("long"))
        keep = [*columns, "c", "whole", "child"]
        cut = lower.select(*keep).unionByName(upper.select(*keep)).withColumn("is_c", (F.col("rep") == F.col("c.rep")) & (F.col("depth") == F.col("c.depth")))
        cut = staged(cut, "cut")
        totals = staged(cut.filter("is_c or child is not null").groupBy(*comp).agg(*(F.sum(w).alias(f"sum_{w}") for w in weights)), "totals")
        on_path = F.expr("2 * mass >= whole and child is null")
        moved = met(cut, totals, comp, ["rep", "depth"], n)
        moved = moved.select(
            "rep", "depth", "is_c", *weights,
            F.when(on_path & ~F.col("is_c"), F.col("mass") - F.col("c.mass")).otherwise(F.col("mass")).alias("mass"),
            *(F.when(on_path, F.col(acc) + F.col(f"sum_{w}")).otherwise(F.col(acc)).alias(acc) for w, acc in sums.items()),
            F.coalesce("child", "comp_rep").alias("comp_rep"),
            F.when(F.col("child").isNotNull(), F.col("c.depth") + 1).otherwise(F.col("comp_depth")).alias("comp_depth"),
        )
        moved = staged(moved, "component")
        done.append(moved.filter("is_c").select("rep", "depth", *(F.col(acc).alias(w) for w, acc in sums.items())))
        state = moved.filter("not is_c").select(*columns)
    out = done[0] if done else nodes.select("rep", "depth", *weights).limit(0)
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, depth, ids), a node's rows together and in order: one row (rep, depth, ends_sha256) a node."""
    node, digest = None, None
    flush = lambda: pa.RecordBatch.from_pydict({"rep": [node[0]], "depth": [node[1]], "ends_sha256": [digest.hexdigest()]}, _DIGEST)
    for batch in batches:
        for rep, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "ids")), strict=True):
            if node != (rep, depth):
                if node is not None:
                    yield flush()
                node, digest = (rep, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if node is not None:
        yield flush()


_DIGEST = pa.schema([("rep", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def end_digests(lengths: DataFrame, paths: DataFrame, root: DataFrame) -> DataFrame:
    """rep, depth, ends_sha256 of nodes at which conversations end; root(rep) is one row."""
    at_root = lengths.filter("length = 0").select("conv_id").crossJoin(F.broadcast(root)).select("conv_id", "rep", F.lit(0).cast("long").alias("depth"))
    ends = lengths.filter("length > 0").withColumnRenamed("length", "depth").join(paths, ["conv_id", "depth"]).select("conv_id", "rep", "depth").unionByName(at_root)
    pieces = ends.groupBy("rep", "depth", F.floor(F.col("conv_id") / BLOCK).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = staged(pieces, "ends").repartition("rep", "depth").sortWithinPartitions("rep", "depth", "piece")
    return ordered.select("rep", "depth", "ids").mapInArrow(_digests, "rep long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node."""
    turns, lengths = rebuilt(conversations)
    nodes, paths = trie(turns, lengths)
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["rep", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = staged(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")), "weighed")
    totals = rollup(nodes.select("rep", "depth", "mass", "n_leaves", "saved_tokens"), paths, ["n_leaves", "saved_tokens"])
    ends = end_digests(lengths, paths, nodes.filter("depth = 0").select("rep"))
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, ["rep", "depth"]).join(ends, ["rep", "depth"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: By another way: prefixes as strings, subtrees by the paths that begin with them; CRC-32 bit by bit.
OP12_SQL = r"""
WITH crc_table AS (SELECT list(v ORDER BY i) AS crcs FROM (SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(i AS BIGINT)) AS v FROM range(256) t(i))),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS first, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: xor(a >> 8, crcs[1 + (xor(a, b) & 255)]), 4294967295), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM own), crc_table),
turned AS (SELECT c.conv_id, 0 AS part, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.first AND o.place <= c.h
  UNION ALL SELECT c.conv_id, 1, o.place, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, role, text, string_agg(sha256(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY part, place) AS path FROM turned),
members AS (SELECT conv_id, depth, path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
last AS (SELECT conv_id, max(depth) AS length FROM members GROUP BY conv_id),
n AS (SELECT path, depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved, sha256(coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (l.length = m.depth), '')) AS ends_sha256 FROM members m JOIN last l USING (conv_id) GROUP BY path, depth),
p AS (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND n.path[:(n.depth - 1) * 64] = u.path),
k AS (SELECT n.path, n.depth, count(c.path) AS n_children FROM n LEFT JOIN p c ON c.depth = n.depth + 1 AND c.path[:n.depth * 64] = n.path GROUP BY n.path, n.depth),
below AS (SELECT n.path, n.depth, s.n_convs, s.saved, k.n_children FROM n JOIN members m ON m.path = n.path JOIN n s ON s.conv_id = m.conv_id AND s.depth >= n.depth JOIN k ON k.path = s.path),
r AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM below GROUP BY path)
SELECT p.conv_id, CAST(p.depth AS BIGINT) AS depth, p.parent_conv_id, p.n_convs, k.n_children, r.n_leaves, CAST(r.saved_tokens AS BIGINT) AS saved_tokens, p.ends_sha256 FROM p JOIN k ON k.path = p.path JOIN r ON r.path = p.path
"""
