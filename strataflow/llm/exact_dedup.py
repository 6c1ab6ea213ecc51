"""Exact deduplication by composable polynomial fingerprints.

A text is a number sequence of bytes b; its fingerprint is sum(b[i] * B**(n-1-i)) modulo two primes. Fingerprints
compose: fp(x + y) = fp(x) * B**len(y) + fp(y), so chunks are hashed apart and combined by shifts. Documents beyond
`huge_bytes` are cut into pieces that different tasks hash; smaller ones are combined inside their task. Texts with equal
fingerprints and lengths are then compared chunk by chunk: the least and the greatest chunk at each place must agree, an
aggregate that collapses copies before the shuffle, so that a group of any size streams through bounded memory.

Defined cases: a null text counts as empty; empty texts equal one another; a null id is smaller than any other id, and
if a whole group has null ids its keep_id is null and all its rows stay. Rows repeated with the same id are each
returned; those with the group's largest id all stay. An empty table gives an empty result. Only the id and the text
column are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import lean, lookup_join, staged, table

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK = 4096
HUGE_BYTES = 8 << 20
COMPARE_BYTES = 1 << 16
KEY = ["n_bytes", "h1", "h2"]


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i], x = x, x * base % prime
    return out


_LOW = [_powers(b, p, CHUNK + 1) for b, p in zip(BASES, PRIMES, strict=True)]
_HIGH = [_powers(int(low[CHUNK]), p, HUGE_BYTES // CHUNK + 2) for low, p in zip(_LOW, PRIMES, strict=True)]


def shift(lengths: np.ndarray, k: int) -> np.ndarray:
    """BASES[k] ** lengths modulo PRIMES[k], for lengths up to HUGE_BYTES."""
    return _LOW[k][lengths % CHUNK] * _HIGH[k][lengths // CHUNK] % np.uint64(PRIMES[k])


def fingerprints(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The two fingerprints of each text values[offsets[i]:offsets[i + 1]] (bytes), by chunks."""
    sizes = np.diff(offsets)
    chunks = -(-sizes // CHUNK)
    owner = np.repeat(np.arange(len(sizes)), chunks)
    nth = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    starts = offsets[:-1][owner] + nth * CHUNK
    ends = np.minimum(starts + CHUNK, offsets[1:][owner])
    out = [np.zeros(len(sizes), np.uint64) for _ in PRIMES]
    step = 256
    for lo in range(0, len(starts), step):
        s, e, who = starts[lo : lo + step], ends[lo : lo + step], owner[lo : lo + step]
        body = values[s[0] : e[-1]].astype(np.uint64)
        size = e - s
        exponent = np.repeat(size, size) - 1 - (np.arange(len(body)) - np.repeat(s - s[0], size))
        for k, p in enumerate(PRIMES):
            # a chunk's terms are below 2**39, so 4096 of them stay far below 2**64
            term = np.add.reduceat(body * _LOW[k][exponent], s - s[0]) % np.uint64(p)
            term = term * shift(offsets[1:][who] - e, k) % np.uint64(p)
            np.add.at(out[k], who, term)
            out[k] %= np.uint64(p)
    return out


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h1, h2 instead of the binary column body."""
    for batch in batches:
        body = batch.column("body").cast(pa.large_binary())
        offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
        data = body.buffers()[2]
        values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        h = fingerprints(values, offsets)
        kept = [n for n in batch.schema.names if n != "body"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(pa.array(x.astype(np.int64)) for x in h)], [*kept, "h1", "h2"])


def fingerprinted(docs: DataFrame, huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, sha (binary), h1, h2 of each row of docs(doc_id, body)."""
    rows = docs.withColumn("n_bytes", F.octet_length("body").cast("long"))
    sha = F.unhex(F.sha2("body", 256))
    small = rows.filter(F.col("n_bytes") <= huge_bytes).select("doc_id", "n_bytes", sha.alias("sha"), "body").mapInArrow(lean(_hash_batches), "doc_id long, n_bytes long, sha binary, h1 long, h2 long")
    return small.unionByName(huge_fingerprints(rows.filter(F.col("n_bytes") > huge_bytes), sha, huge_bytes))


def huge_fingerprints(rows: DataFrame, sha, huge_bytes: int) -> DataFrame:
    """Pieces of huge rows hashed in parallel, then combined: sum(piece * B**(bytes after it)).

    A row is known by its id, length and digest; rows repeated in full are counted at piece 0 and given back.
    """
    pieces = rows.select("doc_id", "n_bytes", sha.alias("sha"), "body", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / huge_bytes))).alias("piece"))
    pieces = pieces.select("doc_id", "n_bytes", "sha", "piece", F.expr(f"substring(body, cast(piece * {huge_bytes} + 1 as int), {huge_bytes})").alias("body"))
    hashed = pieces.repartition("sha", "piece").mapInArrow(_hash_batches, "doc_id long, n_bytes long, sha binary, piece long, h1 long, h2 long")
    tail = F.greatest(F.lit(0).cast("long"), F.col("n_bytes") - (F.col("piece") + 1) * huge_bytes)
    once = hashed.groupBy("doc_id", "n_bytes", "sha", "piece").agg(F.min("h1").alias("h1"), F.min("h2").alias("h2"), F.count("*").alias("rows"))
    shifted = once.withColumn("tail", tail).mapInArrow(_shift_batches, "doc_id long, n_bytes long, sha binary, h1 long, h2 long, rows long")
    combined = shifted.groupBy("doc_id", "n_bytes", "sha").agg(F.sum("h1").alias("h1"), F.sum("h2").alias("h2"), F.max("rows").alias("rows"))
    whole = combined.select("doc_id", "n_bytes", "sha", F.pmod("h1", F.lit(PRIMES[0])).alias("h1"), F.pmod("h2", F.lit(PRIMES[1])).alias("h2"), "rows")
    return whole.withColumn("_i", F.explode(F.expr("sequence(1L, rows)"))).drop("_i", "rows")


def _shift_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tails = batch.column("tail").to_pylist()
        moved = [pa.array([h * pow(b, t, p) % p for h, t in zip(batch.column(n).to_pylist(), tails, strict=True)], pa.int64()) for n, b, p in zip(("h1", "h2"), BASES, PRIMES, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), batch.column("sha"), *moved, batch.column("rows")], ["doc_id", "n_bytes", "sha", "h1", "h2", "rows"])


def confirmed(docs: DataFrame, prints: DataFrame, groups: DataFrame) -> DataFrame:
    """KEY of those groups in which any chunk differs between texts (a collision of fingerprints).

    Texts of groups, which are found again by length and digest, are cut into chunks; min and max of the chunks at one
    place agree only if all are equal. The partial aggregate sees copies first, so a group's bytes are shuffled once a map
    task at most.
    """
    members = staged(lookup_join(prints, groups.select(*KEY), KEY, "left_semi", ["doc_id"]).select(*KEY, "sha").distinct(), "exact-members")
    rows = docs.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), F.unhex(F.sha2("body", 256)).alias("sha"), "body")
    bodies = lookup_join(rows, members, ["n_bytes", "sha"], "inner", ["doc_id"])
    cut = F.expr(f"transform(sequence(0L, greatest(0L, (n_bytes - 1) div {COMPARE_BYTES})), i -> substring(body, cast(i * {COMPARE_BYTES} + 1 as int), {COMPARE_BYTES}))")
    chunks = bodies.select(*KEY, F.posexplode(cut).alias("nth", "chunk"))
    ends = chunks.groupBy(*KEY, "nth").agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
    return ends.filter(F.col("least") != F.col("greatest")).select(*KEY).distinct()


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256. See the module for the defined cases.

    Members of a group in which the chunkwise comparison found a difference are told apart by their SHA-256.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    prints = staged(fingerprinted(docs, huge_bytes), "exact-prints")
    groups = staged(prints.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "exact-groups")
    collided = staged(confirmed(docs, prints, groups), "exact-collided").withColumn("apart", F.lit(True))
    # groups of one need no lookup; of the others a collided one is keyed by its digest too
    marked = lookup_join(prints, collided, KEY, "left", ["doc_id"])
    marked = marked.withColumn("sub", F.when(F.col("apart"), F.col("sha"))).drop("apart")
    sub = F.coalesce("sub", F.lit(b""))
    sizes = staged(marked.groupBy(*KEY, sub.alias("sub")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"), "exact-sizes")
    out = lookup_join(marked.withColumn("sub", sub), sizes, [*KEY, "sub"], "left", ["doc_id"])
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.expr("doc_id <=> if(group_size is null, doc_id, keep_id)").alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
