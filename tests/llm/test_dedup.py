"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from helpers import DATA, rows_of
from llm_helpers import WORDS, prose
from strataflow.llm import components, exact_dedup, order_minhash, substring_dedup
from strataflow.llm.common import lookup_join, table


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = (max(ids) if ids else None) if len(groups[t or ""]) > 1 else i
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("huge", [exact_dedup.HUGE_BYTES, 1000])
def test_exact_groups(awkward, nothing, huge):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(awkward, huge_bytes=huge).collect()), key=repr)
    assert got == brute_exact(rows)
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_exact_query_equals_sql(spark, duck):
    assert rows_of(exact_dedup.op6_exact_dedup(spark, DATA).toPandas()) == rows_of(duck.execute(exact_dedup.OP6_SQL).df())


def test_fingerprints_compose():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 30_000).astype(np.uint8)
    whole = exact_dedup.fingerprints(data, np.array([0, 30_000]))
    parts = exact_dedup.fingerprints(data, np.array([0, 12_345, 30_000]))
    for k, (b, p) in enumerate(zip(exact_dedup.BASES, exact_dedup.PRIMES, strict=True)):
        plain = 0
        for x in data.tolist():
            plain = (plain * b + x) % p
        assert int(whole[k][0]) == plain == (int(parts[k][0]) * pow(b, 30_000 - 12_345, p) + int(parts[k][1])) % p


def test_collisions_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "bb", "aa"])], "doc_id long, text string")
    plain = exact_dedup.fingerprinted

    def blind(*a, **k):
        from pyspark.sql import functions as F

        return plain(*a, **k).withColumn("h1", F.lit(1).cast("long")).withColumn("h2", F.lit(1).cast("long"))

    monkeypatch.setattr(exact_dedup, "fingerprinted", blind)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {0: (5, 3), 2: (5, 3), 5: (5, 3), 1: (4, 2), 4: (4, 2), 3: (3, 1)}


def test_huge_texts_of_equal_fingerprints_are_compared(spark, monkeypatch):
    """Texts beyond huge_bytes that differ in one byte of the last chunk, or not at all, with fingerprints made equal."""
    a = prose(9, 40_000)
    texts = [a, a[:-1] + "#", a, a[:-1] + "#", "#" + a[1:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    combined = exact_dedup.huge_fingerprints
    monkeypatch.setattr(exact_dedup, "huge_fingerprints", lambda *x: combined(*x).selectExpr("doc_id", "n_bytes", "sha", "1L as h1", "1L as h2"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, huge_bytes=100_000).collect()}
    assert got == {0: (2, 2), 2: (2, 2), 1: (3, 2), 3: (3, 2), 4: (4, 1)}
    monkeypatch.undo()
    prints = exact_dedup.fingerprinted(docs.selectExpr("doc_id", "cast(text as binary) as body"), 100_000).selectExpr("doc_id", "n_bytes", "sha", "1L as h1", "1L as h2")
    found = exact_dedup.confirmed(docs.selectExpr("doc_id", "cast(text as binary) as body"), prints, prints.select(*exact_dedup.KEY).distinct())
    assert found.count() == 1


def brute_near(rows, threshold=0.8):
    """Classes by comparing all pairs."""
    def kmers(text):
        values = np.frombuffer(text.lower().encode(), np.uint8)
        words, owner = order_minhash.word_hashes(values, np.array([0, len(values)]))
        return order_minhash.labelled_kmers(words, owner, 1)[0]

    def chain(a, b, band):
        at = {x: j for j, x in enumerate(b.tolist())}
        tails = []
        for i, x in enumerate(a.tolist()):
            j = at.get(x)
            if j is not None and abs(i - j) <= band:
                k = bisect_left(tails, j)
                tails[k : k + 1] = [j]
        return len(tails)

    rows = [(i, kmers(t or "")) for i, t in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (i, a) in enumerate(rows):
        for j, b in rows[:p]:
            n = max(len(a), len(b))
            if n and chain(a, b, int(np.ceil((1 - threshold) * n)) + 1) >= threshold * n:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def test_near_classes_on_awkward_rows(awkward, nothing):
    got = {(r.doc_id, r.class_id, r.kept) for r in order_minhash.near_classes(awkward).collect()}
    want = brute_near([(r.doc_id, r.text) for r in awkward.collect()])
    assert {(i, c) for i, c, _ in got if i is not None} == set(want.items())
    assert {c for i, c, _ in got if i is None} == {None} and all(k == (i == c) for i, c, k in got)
    assert order_minhash.near_classes(awkward).count() == awkward.count()
    assert order_minhash.near_classes(nothing).count() == 0


def test_near_classes_of_edited_copies(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for g in range(12):
        base = prose(g, rng.choice([6, 12, 20, 26, 60, 200, 400])).split()
        for _ in range(6):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(base) // 60)])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                words = words[: int(len(words) * 0.9)]
            rows.append((n, " ".join(words).title() if rng.random() < 0.3 else ", ".join(words)))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(docs).collect()}
    assert got == brute_near(rows)


def test_near_classes_on_the_table(spark):
    docs = table(spark, DATA, "documents")
    got = {r.doc_id: r.class_id for r in order_minhash.op1_order_minhash(spark, DATA).collect()}
    assert got == brute_near([(r.doc_id, r.text) for r in docs.collect()])


def test_large_groups_of_near_copies(spark):
    rng = random.Random(8)
    base = prose(50, 120).split()

    def edited(n):
        words = list(base)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"w{rng.randrange(10**6)}"
        return " ".join(words)

    # most are linked with some other, hardly any with all: links must be found between components of one bucket
    mixed = [(i, edited(rng.choice([1, 2, 3, 3, 4, 5, 8]))) for i in range(300)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(spark.createDataFrame(mixed, "doc_id long, text string")).collect()}
    want = brute_near(mixed)
    assert len(set(want.values())) > 20 and got == want
    many = spark.createDataFrame([(i, edited(1)) for i in range(3000)], "doc_id long, text string")
    assert {r.class_id for r in order_minhash.near_classes(many).collect()} == {0}


def test_pairs_across_components_grow_with_the_group(spark, monkeypatch):
    """Copies edited so much that many lie apart from their leaders: most of them by a hair, so that pairs of them pass loose bounds."""
    rng = random.Random(21)
    base = prose(51, 150).split()

    def edited(n):
        words = list(base)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"w{rng.randrange(300)}"
        return " ".join(words)

    rows = [(i, edited(rng.choice([1, 2, 3, 4, 5, 5, 6, 6, 7]))) for i in range(800)]
    compared, sizes = order_minhash.compared, []

    def counted(docs, pairs, *more, **options):
        pairs = pairs.persist()
        sizes.append(pairs.count())
        return compared(docs, pairs, *more, **options)

    monkeypatch.setattr(order_minhash, "compared", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(docs).collect()}
    assert got == brute_near(rows)
    assert sizes[-1] < 4 * len(rows), sizes  # 25,848 pairs where members met by the bounds of their leader alone


def test_bounds_of_shared_kmers():
    rng = np.random.default_rng(4)
    for n in (30, 256, 700):
        leader = np.arange(n, dtype=np.uint64)
        a, b = (np.sort(rng.choice(leader, int(n * f), replace=False)) for f in (0.9, 0.85))
        la, lb = (order_minhash.lost_bins(n, order_minhash.aligned(leader, x, 0.8)[1]) for x in (a, b))
        lost = sum(int(x).bit_count() for x in (la | lb).view(np.uint64))
        assert len(np.intersect1d(a, b)) <= n - lost and (n > 256 or len(np.intersect1d(a, b)) == n - lost)


def test_order_matters():
    a = np.arange(1, 200, dtype=np.uint64)
    assert order_minhash.similarity(a, a, 0.8) == 1.0
    assert order_minhash.similarity(a, a[::-1].copy(), 0.8) < 0.2
    assert order_minhash.similarity(a, a[:100], 0.8) == 0.0
    mixed = order_minhash.mixed(a)
    assert (order_minhash.sketches(mixed) == order_minhash.sketches(mixed[::-1].copy())).mean() < 0.1


def test_components_of_random_links(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.id: r.class_id for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert all(got[i] == find(i) for i in got) and {i for e in links for i in e if e[0] != e[1]} == set(got)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_substrings(rows):
    """n_bytes, n_removed, n_spans, kept digest by id: every 50-byte string against all smaller ids."""
    seen, out = {}, {}
    for i, t in sorted((i, t or "") for i, t in rows):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def op5(spark, docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "table", lambda *a: docs)
    return substring_dedup.op5_substring_dedup(spark, "")


def test_substrings_on_awkward_rows(spark, awkward, nothing, monkeypatch):
    rows = op5(spark, awkward, monkeypatch).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows if r.doc_id is not None}
    assert got == brute_substrings([(r.doc_id, r.text) for r in awkward.collect() if r.doc_id is not None])
    assert len(rows) == awkward.count() and all(r.n_removed == 0 for r in rows if r.doc_id is None)
    assert op5(spark, nothing, monkeypatch).count() == 0


def test_substrings_of_cut_and_pasted_texts(spark, monkeypatch):
    rng = random.Random(9)
    pool = [prose(100 + k, 12) for k in range(6)] + ["a" * 120, "ab" * 60, "é" * 40, "x" * 49, "y" * 50]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(pool)
            a = rng.randrange(0, 20)
            parts += [p[a : rng.randrange(30, 130)], rng.choice(["", " ", "zz", prose(rng.randrange(10**6), 3)])]
        rows.append((i, "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in op5(spark, docs, monkeypatch).collect()}
    assert got == brute_substrings(rows)


def test_substrings_of_ids_with_two_texts(spark, monkeypatch):
    a, b = prose(1, 40), prose(2, 40)
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + b)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in op5(spark, docs, monkeypatch).collect()}
    least = min((a, b), key=lambda t: hashlib.sha256(t.encode()).digest())
    assert got[2, len(a + b)] == len(least) and got[1, len(a)] == got[1, len(b)] == 0


def test_substrings_of_equal_short_hashes(spark, monkeypatch):
    """Runs with one q-gram whose content hashes agree in their low 40 bits, but not their bytes; each in a task of its own."""
    pair = [(1, "chleaalmbcngbeffkfgcjlakihnjjpolkjoineaiamglpkifnj"), (2, "chleaalmbcngbeffbabcgcdomppdefcfhohbpjfnmcmnepccjp")]
    runs = [substring_dedup.runs_of(np.frombuffer(t.encode(), np.uint8), np.array([0, 50])) for _, t in pair]
    low = np.uint64((1 << 40) - 1)
    assert runs[0][1] == runs[1][1] and runs[0][2] & low == runs[1][2] & low
    docs = spark.createDataFrame(pair[:1], "doc_id long, text string").union(spark.createDataFrame(pair[1:], "doc_id long, text string"))
    assert [r.n_removed for r in op5(spark, docs, monkeypatch).collect()] == [0, 0]


def test_substrings_split_hot_keys(spark, monkeypatch):
    """The q-grams at the edges of a passage with as many surroundings as texts: no task holds all runs or contexts of one."""
    passage, most = prose(50, 12), 15
    rows = [(i, prose(1000 + i, 6) + passage + prose(2000 + i, 1 + i % 5)) for i in range(60)] + [(100 + i, "=" * 60 + str(i) + passage[:70]) for i in range(20)]
    settle, refine = substring_dedup._settle_batches, substring_dedup._refine_batches
    unpack = substring_dedup.unpack40

    def few(met, key, what):
        met.setdefault(key, set()).add(what)
        if len(met[key]) > most:
            raise ValueError("a task holds a hot key")

    def guarded_settle(batches):
        counts = {}

        def watched():
            for batch in batches:
                for bucket, keys, contents in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "contents")), strict=True):
                    for k, key in enumerate([] if bucket < 0 else unpack(keys).tolist()):
                        if key:  # strings have none
                            few(counts, (bucket, key), contents[len(contents) * 5 * k // len(keys) :][:5])
                yield batch

        yield from settle(watched())

    def guarded_refine(batches):
        counts = {}

        def watched():
            for batch in batches:
                for key, data in zip(batch.column("key").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                    few(counts, key, data)
                yield batch

        yield from refine(watched())

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(substring_dedup, "_refine_batches", guarded_refine)
    monkeypatch.setattr(substring_dedup, "HOT_CONTEXTS", most, raising=False)
    got = {r.doc_id: tuple(r)[1:] for r in op5(spark, docs, monkeypatch).collect()}
    assert got == brute_substrings(rows)
    monkeypatch.setattr(substring_dedup, "_settle_batches", guarded_settle)
    monkeypatch.setattr(substring_dedup, "SAMPLE", 1, raising=False)
    monkeypatch.setattr(substring_dedup, "HOT_RUNS", most, raising=False)
    got = {r.doc_id: tuple(r)[1:] for r in op5(spark, docs, monkeypatch).collect()}
    assert got == brute_substrings(rows)


def test_bucket_pointers_sort_strings():
    rng = np.random.default_rng(2)
    for letters, waves in ((b"ab", 8), (b"a", 3), (b"abcdefgh", 1), (b"ab", 50)):
        text = rng.choice(np.frombuffer(letters, np.uint8), 3000)
        text[1000:1200] = text[200:400]
        text[2900:] = text[:100]
        order, _ = substring_dedup.refined_order(text, waves)
        suffixes = [text[i : i + 50].tobytes().ljust(50, b"\0") for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(3000)) and suffixes == sorted(suffixes)
        starts = np.arange(len(text) - 49)
        group = substring_dedup.equal_strings(text, starts)
        strings = [text[s : s + 50].tobytes() for s in starts]
        first = {}
        assert all(first.setdefault(s, p) == p for s, p in zip(strings, group.tolist(), strict=True)) and len(set(group.tolist())) == len(set(strings))


def test_substring_query_equals_sql(spark, duck):
    assert rows_of(substring_dedup.op5_substring_dedup(spark, DATA).toPandas()) == rows_of(duck.execute(substring_dedup.OP5_SQL).df())


def test_substrings_of_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 500)
    base, other = prose(70, 400), prose(71, 60)
    rows = [(1, base), (2, other + base[450:560] + other[:30]), (3, base[:1040] + "!" + base[1041:]), (4, "#" * 500 + base[960:1030] + "#" * 430), (5, base[:499]), (6, base[:500]), (7, base[1:551])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "body": [base.encode()]})
    assert {len(x[3]) for x in substring_dedup.pieces(batch, 500)} >= {549} and max(len(x[3]) for x in substring_dedup.pieces(batch, 500)) == 549
    assert {r.doc_id: tuple(r)[1:] for r in op5(spark, docs, monkeypatch).collect()} == brute_substrings(rows)


def test_lookup_join_beyond_the_broadcast(spark):
    rows = spark.range(100).selectExpr("id % 3 as k", "id")
    small = spark.createDataFrame([(0, "x"), (2, "y")], "k long, v string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a, b = (lookup_join(rows, small, ["k"], how, ["id"], most=m) for m in (10, 1))
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(a.columns).collect()), key=repr)
