"""Near-duplicate classes by Order MinHash with banded alignment.

Words are runs of ASCII letters, digits and non-ASCII characters of the lower-cased text. A k-mer is five consecutive
words (all words of a shorter text), labelled with its occurrence number, so that the labelled k-mers of a text differ.
A sketch is the `SAMPLE` k-mers that come first under one hash order, kept in text order: it is equal for two texts only
if these k-mers are the same and stand in the same order, which follows edit similarity. Texts that share one of the
sketches are candidates. Candidates are aligned: the longest chain of shared labelled k-mers that rises in both texts and
stays within a band of (1 - threshold) * longer length around the diagonal. Their similarity is chain / longer length;
they are linked at `threshold` (0.8) or more. Short texts have smaller samples, so that few k-mers suffice.

Equal word sequences are one node. In a bucket of equal sketches each node is compared with the bucket's leader, so a
bucket of any size gives as many comparisons as members. Members that then lie in another component than their leader may
still be linked with other members of it. The members of such a leader are compared once more, with a centre: the one
among them whose k-mers are the most frequent in all these texts, which is nearest to what they were copied from. Leaders
with one centre become one group. For members that are still in another component than their centre
  - a node of which more than the allowed part of the labelled k-mers stand in no other text in question can't be linked;
  - of any two nodes under one centre, what both share is bounded by the centre's k-mers that neither lost (bit maps of
    `BINS` and up to `PARTS` parts of the centre) and by the k-mers outside of the centre that others have too, or that meet
    in a signature of `EXTRA` bits.
All bounds are exact, so pairs that pass them are aligned, all others can't be linked, and no link within a bucket is lost
because a leader lay between. Pairs are formed in cells of `CELL` by `CELL` nodes, only between components, and never
within one. At the least k-mer overlap that the threshold allows (a Jaccard similarity of 2/3) 0.3 % of pairs share none of
the sketches.

Defined cases: null and empty texts, and texts without words, are in a class of their own; null ids have class null; rows
that share an id count as one document; an empty table gives an empty result. Ties in hash order fall to the smaller hash
value of the k-mer. A task holds about 40 times the longest text. Only the id and text column are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import BROADCAST_ROWS, lean, lookup_join, staged, table
from strataflow.llm.components import components

K = 5
THRESHOLD = 0.8
SKETCHES, SAMPLE = 64, 6
SHORT, SHORT_SKETCHES, SHORT_SAMPLE = 24, 16, 2  # texts of up to SHORT k-mers
LEAST_LONG = 16  # texts from here on have the long sketches too: 0.8 * (SHORT + 1) is above it
LEADER_ROWS = 256
CELL = 512
BINS = 256
PARTS, EXTRA = 4096, 2048  # bits of a centre's lost k-mers, and of a member's k-mers outside of the centre
PART_BYTES = 1 << 19  # of text at a time: a task holds about 40 times that
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)

_letters = np.zeros(256, bool)
_letters[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = mixed(np.arange(1, SKETCHES + SHORT_SKETCHES + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2**64; those for parts of usual size are kept."""
    if base in _kept and len(_kept[base]) >= n:
        return _kept[base][:n]
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    if n <= 2 * PART_BYTES:
        _kept[base] = out
    return out[:n]


def word_hashes(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and the text that it belongs to."""
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    on = _letters[values]
    first = np.zeros(len(values) + 1, bool)  # a text's first byte starts a word
    first[offsets[:-1]] = True
    starts = np.flatnonzero(on & (first[:-1] | ~np.concatenate([[False], on[:-1]])))
    ends = np.flatnonzero(on & (first[1:] | ~np.concatenate([on[1:], [False]]))) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(values)), dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(values))[starts]
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return mixed(h ^ ((ends - starts).astype(np.uint64) * _STEP)), owner


def labelled_kmers(words: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers of all texts in text order, and the offsets of each text."""
    counts = np.bincount(owner, minlength=n_texts)
    first = np.cumsum(counts) - counts
    kmers = np.where(counts >= K, counts - K + 1, np.minimum(counts, 1))
    out_first = np.cumsum(kmers) - kmers
    text = np.repeat(np.arange(n_texts), kmers)
    at = np.repeat(first, kmers) + np.arange(kmers.sum()) - np.repeat(out_first, kmers)
    left = np.minimum(np.repeat(counts, kmers), K)
    padded = np.concatenate([words, np.zeros(K, np.uint64)])
    h = np.zeros(len(at), np.uint64)
    for j in range(K):
        h = h * _STEP + np.where(j < left, padded[at + j], np.uint64(j + 1))
    h = mixed(h)
    # occurrence numbers: equal k-mers of one text, in text order
    own = h ^ mixed(text.astype(np.uint64) + np.uint64(77))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    nth = np.empty(len(h), np.int64)
    nth[order] = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return np.where(nth == 0, h, mixed(h + nth.astype(np.uint64) * _STEP)), np.append(out_first, len(h))


def sketches(kmers: np.ndarray) -> np.ndarray:
    """The text's sketch keys: SAMPLE smallest under each order, in text order, hashed with the order's number."""
    out = []
    n = len(kmers)
    for lo, hi, size in ((0, SKETCHES, SAMPLE), (SKETCHES, SKETCHES + SHORT_SKETCHES, SHORT_SAMPLE)):
        if n == 0 or (n < LEAST_LONG if lo == 0 else n > SHORT):
            continue
        factors = _FACTORS[lo:hi]
        size = min(size, n)
        h = factors[:, None] * kmers
        if n > 64:  # only the low tail is partitioned; its width leaves far more than size values in nearly all rows
            cut = np.uint64(min((1 << 64) - 1, int((1 << 64) * 5 * size / n)))
            low = h < cut
            enough = low.sum(1)
            if enough.min() >= size:
                rows, cols = np.nonzero(low)
                order = np.lexsort((h[rows, cols], rows))
                begin = np.cumsum(enough) - enough
                pick = cols[order][begin[:, None] + np.arange(size)]
            else:
                pick = np.argpartition(h, size - 1, axis=1)[:, :size]
        else:
            pick = np.argpartition(h, size - 1, axis=1)[:, :size] if size < n else np.tile(np.arange(n), (hi - lo, 1))
        chosen = kmers[np.sort(pick, axis=1)]
        key = np.arange(lo, hi, dtype=np.uint64)
        for j in range(size):
            key = mixed(key * _STEP + chosen[:, j])
        out.append(key)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def binary_parts(batch: pa.RecordBatch, column: str, budget: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of parts of a binary column, of about `budget` bytes or one row."""
    body = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    data = body.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(body):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, side="right")) - 1)
        hi = min(hi, len(body))
        yield lo, hi - lo, values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, n, values, offsets in binary_parts(batch, "body"):
            words, owner = word_hashes(values, offsets)
            kmers, at = labelled_kmers(words, owner, n)
            keys, sizes, prints = [], np.diff(at), np.zeros((n, 2), np.uint64)
            place = np.arange(len(words), dtype=np.uint64) - np.repeat(np.cumsum(np.bincount(owner, minlength=n)) - np.bincount(owner, minlength=n), np.bincount(owner, minlength=n)).astype(np.uint64)
            for k in range(2):  # of the word sequence: hashes that depend on word and place, summed
                np.add.at(prints[:, k], owner, mixed(words * np.uint64(2 * k + 1) + mixed(place + np.uint64(1000 + k))))
            for i in range(n):
                keys.append(sketches(kmers[at[i] : at[i + 1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, n), pa.array(sizes, pa.int32()), pa.array(prints[:, 0].view(np.int64)), pa.array(np.ascontiguousarray(prints[:, 1]).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "kmers", "fp1", "fp2", "keys"],
            )


def chain_length(i: np.ndarray, j: np.ndarray, band: int) -> int:
    """Longest chain of shared k-mers, at places i and j, that rises in both, each at most band places off the diagonal."""
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        at = bisect_left(tails, x)
        if at == len(tails):
            tails.append(x)
        else:
            tails[at] = x
    return len(tails)


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[float, np.ndarray, np.ndarray]:
    """chain / longer length, or 0 if the lengths or the shared k-mers alone keep it below the threshold; and the places in a and b of what is shared."""
    longer = max(len(a), len(b))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not longer or min(len(a), len(b), len(i)) < threshold * longer:
        return 0.0, i, j
    return chain_length(i, j, int(np.ceil((1 - threshold) * longer)) + 1) / longer, i, j


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    return aligned(a, b, threshold)[0]


def lost_bins(n: int, shared: np.ndarray, parts: int = BINS) -> np.ndarray:
    """Which of `parts` parts of n places hold one that is not shared, in integers of 64 bits."""
    lost = np.ones(n, bool)
    lost[shared] = False
    at = np.flatnonzero(lost)
    bins = np.zeros(parts, np.uint8)
    bins[at if n <= parts else at * parts // n] = 1
    return np.packbits(bins).view("<i8")


def extra_bits(kmers: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """A signature of EXTRA bits, in integers of 64, of the k-mers that do not stand at the shared places.

    Each of its bits that another's lacks stands for a k-mer at least that the other has not.
    """
    extra = np.ones(len(kmers), bool)
    extra[shared] = False
    bits = np.zeros(EXTRA, np.uint8)
    bits[(kmers[extra] % np.uint64(EXTRA)).astype(np.int64)] = 1
    return np.packbits(bits).view("<i8")


COMPARED = "leader long, member long, linked boolean, n_leader int, n_member int, shared int"
BOUNDED = f"{COMPARED}, l0 long, l1 long, l2 long, l3 long, lost array<long>, extra array<long>"


def _compare(threshold: float, bounded: bool):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by leader: the leader's own first, then its members; only the leader is held."""
        leader, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            for lo, n, values, offsets in binary_parts(batch, "body"):
                words, owner = word_hashes(values, offsets)
                kmers, at = labelled_kmers(words, owner, n)
                out = []
                rows = zip(batch.column("leader").slice(lo, n).to_pylist(), batch.column("member").slice(lo, n).to_pylist(), strict=True)
                for k, (x, y) in enumerate(rows):
                    own = kmers[at[k] : at[k + 1]]
                    if y is None:
                        leader, held = x, own.copy()
                    elif x == leader:
                        score, shared, there = aligned(held, own, threshold)
                        row = (x, y, score >= threshold, len(held), len(own), len(shared))
                        if bounded:
                            parts = min(PARTS, -(-len(held) // 64) * 64)
                            row += (*lost_bins(len(held), shared).tolist(), lost_bins(len(held), shared, parts), extra_bits(own, there))
                        out.append(row)
                columns = list(zip(*out, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = [c.split(" ")[0] for c in (BOUNDED if bounded else COMPARED).split(", ")]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()] + ([pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 if bounded else [])
    return compare


def compared(docs: DataFrame, pairs: DataFrame, threshold: float, bounded: bool = False) -> DataFrame:
    """COMPARED (BOUNDED, if so) of pairs (leader, member) of distinct ids; docs(doc_id, body) has each id's text.

    A leader's text goes out once for every LEADER_ROWS members, each member's once a pair.
    """
    pairs = staged(pairs.distinct(), "omh-pairs")
    leaders = staged(pairs.groupBy("leader").agg(F.ceil(F.count("*") / LEADER_ROWS).cast("int").alias("blocks")), "omh-leaders")
    placed = staged(lookup_join(pairs, leaders, ["leader"], "inner", ["member"]).select(F.col("member").alias("doc_id"), "leader", F.expr("pmod(xxhash64(member), blocks)").cast("int").alias("block")), "omh-placed")

    def with_text(rows: DataFrame) -> DataFrame:
        if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            return docs.join(F.broadcast(rows), "doc_id")
        some = lookup_join(docs, rows.select("doc_id").distinct(), ["doc_id"], "left_semi", ["doc_id"])
        return some.join(rows, "doc_id")

    members = with_text(placed).select("leader", "block", F.col("doc_id").alias("member"), "body")
    heads = with_text(leaders.withColumnsRenamed({"leader": "doc_id"})).select(F.col("doc_id").alias("leader"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(None).cast("long").alias("member"), "body")
    dealt = heads.unionByName(members).repartition("leader", "block").sortWithinPartitions("leader", "block", F.col("member").asc_nulls_first())
    return staged(dealt.mapInArrow(lean(_compare(threshold, bounded)), BOUNDED if bounded else COMPARED), "omh-compared")


def _kmer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, n, values, offsets in binary_parts(batch, "body"):
            kmers, at = labelled_kmers(*word_hashes(values, offsets), n)
            ids = np.repeat(batch.column("doc_id").to_numpy()[lo : lo + n], np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kmers.view(np.int64))], ["doc_id", "kmer"])


def kmers_seen(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, kmer) of ids(doc_id), and of each k-mer the least and greatest id that has it, and how many."""
    kmers = staged(lookup_join(docs, ids, ["doc_id"], "left_semi", ["doc_id"]).mapInArrow(lean(_kmer_batches), "doc_id long, kmer long"), "omh-kmers")
    return kmers, staged(kmers.groupBy("kmer").agg(F.min("doc_id").alias("member"), F.max("doc_id").alias("last"), F.count("*").alias("n")), "omh-seen")


def own_kmers(seen: DataFrame) -> DataFrame:
    """member, own: how many labelled k-mers of a text stand in no other; rows with one at least."""
    return staged(seen.filter("member = last").groupBy("member").agg(F.count("*").cast("int").alias("own")), "omh-own")


def weights(kmers: DataFrame, seen: DataFrame) -> DataFrame:
    """member, weight: how often a text's k-mers stand in all texts; of the most frequent k-mers, as many as may be broadcast. It only chooses centres."""
    level = F.length(F.bin("n"))
    least, total = 64, 0
    for row in sorted(seen.filter("n > 1").groupBy(level.alias("level")).count().collect(), reverse=True):  # a row for each power of two
        total += row["count"]
        if total > BROADCAST_ROWS:
            break
        least = row["level"]
    common = seen.filter(level >= least).select("kmer", "n")
    return staged(kmers.join(F.broadcast(common), "kmer").groupBy(F.col("doc_id").alias("member")).agg(F.sum("n").alias("weight")), "omh-weights")


def centred(docs: DataFrame, met: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Pairs (leader, member) of a centre and each node of the leaders that have it, and own_kmers() of these nodes; None if in met(COMPARED) no member is apart from its leader."""
    classed = lookup_join(met, groups.withColumnsRenamed({"id": "member", "class_id": "x"}), ["member"], "left", ["leader"])
    classed = lookup_join(classed, groups.withColumnsRenamed({"id": "leader", "class_id": "y"}), ["leader"], "left", ["member"])
    active = staged(classed.filter("coalesce(x, member) != coalesce(y, leader)").select("leader").distinct(), "omh-active")
    if active.isEmpty():
        return None
    nodes = lookup_join(met.select("leader", "member"), active, ["leader"], "left_semi", ["member"]).unionByName(active.withColumn("member", F.col("leader")))
    nodes = staged(nodes, "omh-active-nodes")
    kmers, seen = kmers_seen(docs, staged(nodes.select(F.col("member").alias("doc_id")).distinct(), "omh-ids"))
    weighed = lookup_join(nodes, weights(kmers, seen), ["member"], "left", ["leader"])
    best = F.max_by("member", F.struct(F.coalesce("weight", F.lit(0)), F.expr("member = leader"), F.expr("-member")))
    centres = staged(weighed.groupBy("leader").agg(best.alias("centre")), "omh-centres")
    pairs = lookup_join(nodes, centres, ["leader"], "inner", ["member"]).filter("member != centre")
    return pairs.select(F.col("centre").alias("leader"), "member"), own_kmers(seen)


def _bits(of: str) -> str:
    """SQL for how many bits are set in `of`, an operation on words a and b of two lists: {0} and {1}."""
    return f"aggregate(zip_with({{0}}, {{1}}, (a, b) -> bit_count({of})), 0, (n, k) -> n + k)"


def crossing(met: DataFrame, groups: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """Pairs (leader, member) of nodes that met(BOUNDED) has under one centre, that lie in different components and pass the bounds."""
    of = groups.withColumnsRenamed({"id": "member", "class_id": "x"})
    classed = lookup_join(met, of, ["member"], "left", ["leader"]).withColumn("x", F.coalesce("x", "member"))
    classed = lookup_join(classed, groups.withColumnsRenamed({"id": "leader", "class_id": "y"}), ["leader"], "left", ["member"])
    classed = classed.withColumn("apart", F.col("x") != F.coalesce("y", "leader")).withColumnRenamed("x", "class_id").drop("y")
    pool = lookup_join(classed, own, ["member"], "left", ["leader"]).withColumn("open", F.expr("n_member - coalesce(own, 0)"))
    pool = staged(pool.filter(F.col("open") / F.col("n_member") >= threshold).withColumns({"outside": F.expr("open - shared"), "others": F.expr("n_member - shared")}), "omh-open")
    cells = staged(pool.groupBy("leader").agg(F.ceil(F.count("*") / CELL).cast("int").alias("ny"), F.ceil(F.count_if("apart") / CELL).cast("int").alias("nx")).filter("nx > 0"), "omh-cells")
    dealt = lookup_join(pool, cells, ["leader"], "inner", ["member"])
    y = dealt.withColumn("i", F.explode(F.expr("sequence(0, nx - 1)"))).withColumn("j", F.expr("cast(pmod(xxhash64(member), ny) as int)")).alias("y")
    x = dealt.filter("apart").withColumn("i", F.expr("cast(pmod(xxhash64(member), nx) as int)")).withColumn("j", F.explode(F.expr("sequence(0, ny - 1)"))).alias("x")
    between = F.expr("x.class_id != y.class_id and (not y.apart or x.member < y.member)")
    longer = F.greatest("x.n_member", "y.n_member")
    outside = F.least("x.outside", "y.outside")
    kept = F.expr("x.n_leader - " + " - ".join(f"bit_count(x.l{k} | y.l{k})" for k in range(4)))
    near = F.least(kept + outside, F.col("x.open"), F.col("y.open"), F.col("x.n_member"), F.col("y.n_member")) / longer >= threshold
    # the same with finer bit maps, for what passes
    kept = F.expr("x.n_leader - " + _bits("a | b").format("x.lost", "y.lost"))
    met_by = [F.expr(f"{p}.others - " + _bits("a & ~b").format(f"{p}.extra", f"{q}.extra")) for p, q in ("xy", "yx")]
    nearer = (kept + F.least(outside, *met_by)) / longer >= threshold
    pairs = x.join(y, F.expr("x.leader = y.leader and x.i = y.i and x.j = y.j") & between & near & nearer)
    return pairs.select(F.col("x.member").alias("leader"), F.col("y.member").alias("member"))


def near_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), kept (whether it is that one) for each row."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("body"))
    sig = staged(docs.mapInArrow(lean(_sketch_batches), "doc_id long, kmers int, fp1 long, fp2 long, keys array<long>"), "omh-sketches")
    same = sig.filter("kmers > 0 and doc_id is not null").groupBy("kmers", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    same = staged(same, "omh-same")
    nodes = lookup_join(sig, same, ["kmers", "fp1", "fp2"], "left", ["doc_id"]).withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    reps = nodes.filter("rep = doc_id").select("rep", F.explode("keys").alias("bucket"))
    # the leader is the member whose mixed id is least, in all buckets alike, so a class has few leaders
    first = reps.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("leader"))).alias("x"), F.max(F.struct(F.xxhash64("rep").alias("h"), F.col("rep"))).alias("y"))
    shared = staged(first.filter("x.leader != y.rep").select("bucket", "x.leader"), "omh-buckets")
    pairs = lookup_join(reps, shared, ["bucket"], "inner", ["rep"]).filter("rep != leader").select("leader", F.col("rep").alias("member"))
    met = compared(docs, pairs, threshold)
    links = met.filter("linked").select(F.col("leader").alias("a"), F.col("member").alias("b"))
    groups = components(links)
    if (again := centred(docs, met, groups)) is not None:
        met = compared(docs, again[0], threshold, bounded=True)
        links = links.unionByName(met.filter("linked").select(F.col("leader").alias("a"), F.col("member").alias("b")))
        groups = components(links)
        found = compared(docs, crossing(met, groups, again[1], threshold), threshold).filter("linked").select(F.col("leader").alias("a"), F.col("member").alias("b"))
        if not found.isEmpty():
            groups = components(links.unionByName(found))

    out = lookup_join(nodes.select("doc_id", "rep"), groups.withColumnsRenamed({"id": "rep"}), ["rep"], "left", ["doc_id"])
    found = staged(out.select("doc_id", F.coalesce("class_id", "rep").alias("class_id")), "omh-classes")
    return found.withColumn("kept", F.expr("doc_id <=> class_id"))


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
