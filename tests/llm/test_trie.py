"""The prefix trie against its SQL and against a dictionary of prefixes."""

import collections
import hashlib
import re
import zlib

from pyspark.sql import functions as F

from helpers import DATA, rows_of
from strataflow.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def nodes_of(rows: list[tuple]) -> set[tuple]:
    """By brute force; turns must not tie within a conversation unless they are equal."""
    own = collections.defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    leaves, saved = collections.Counter(), collections.Counter()
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(ms) - 1) * words(p)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(built[c]) == len(p)).encode()).hexdigest()
    return {(ms[0], len(p), members[p[:-1]][0] if p else None, len(ms), children[p], leaves[p], saved[p], ends(p)) for p, ms in members.items()}


def built(spark, rows, schema=SCHEMA):
    out = trie.prefix_trie(spark.createDataFrame(rows, schema))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return [tuple(r) for r in out.collect()]


def test_query_equals_sql(spark, duck):
    assert rows_of(trie.op12_prefix_trie(spark, DATA).toPandas()) == rows_of(duck.execute(trie.OP12_SQL).df())


def test_awkward_conversations_equal_brute_force(spark, monkeypatch):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"hello  there {t}") for c in range(100, 140) for t in range(4)]  # a large group
    rows += [(200, t, "user", f"turn {t} of many") for t in range(150)] + [(203, t, "user", f"turn {t} of many") for t in range(140)]  # long chains
    rows += [(7, None, None, None), (7, 0, "user", None), (7, 1, "", ""), (8, 3, "user", "\t\n"), (8, -5, "user", "first"), (9, 2, "user", "same"), (9, 2, "user", "same"), (9, 2, "user", "same"), (9, 2, "user", "same")]
    rows += [(None, 0, "user", "nobody"), (5, 0, "a", "bc"), (6, 0, "ab", "c"), (41, 0, "user", "alone"), (1 << 40, 0, "user", "far")]
    monkeypatch.setattr(trie, "BLOCK", 7)  # conversations, sums and pieces of ends in many blocks
    extra = [(*r, 1.0, "x", None, 3) for r in rows]
    found = built(spark, extra, SCHEMA + ", rep double, depth string, mass int, block int")
    assert len(found) == len(set(found)) and set(found) == nodes_of(rows)


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds = []
    kept = trie.staged
    monkeypatch.setattr(trie, "staged", lambda df, name: (rounds.append(name), kept(df, name))[1])
    rows = [(200, t, "user", str(t)) for t in range(256)]
    assert set(built(spark, rows)) == nodes_of(rows)
    assert rounds.count("totals") <= 17  # half the mass a round; 257 nodes with a mass of 33,153


def test_turnless_and_empty(spark):
    rows = [(c, 0, "user", "gone") for c in range(1, 12)]  # no family head; those of h > 0 lose their only turn
    assert set(built(spark, rows)) == nodes_of(rows)
    assert built(spark, []) == [] and built(spark, [(None, 1, "user", "x")]) == []


def test_members_of_a_node_may_fill_many_pieces(spark):
    rows = [(c * 1000, 0, "user", "one") for c in range(30)]
    assert set(built(spark, rows)) == nodes_of(rows)
    assert trie.rollup(*(f(spark) for f in (no_nodes, no_paths)), ["w"]).count() == 0


def no_nodes(spark):
    return spark.range(0).select(*(F.lit(0).cast("long").alias(c) for c in ("rep", "depth", "mass", "w")))


def no_paths(spark):
    return spark.range(0).select(*(F.lit(0).cast("long").alias(c) for c in ("conv_id", "depth", "rep", "parent")))
