"""A content-addressed store of token ids.

Layout of a store (a folder of Parquet tables):
  chunks/    address (BLAKE2b-128 of the bytes), ids (packed little-endian ids), uses: each different chunk once
  recipes/   one row a document in ascending doc_id order: doc_id, start, n_tokens, n_chunks, addresses, sizes, root; one folder a part
  manifest/  one row a part: part, first, n_documents, n_tokens, root (Merkle root of its rows)
  head/      one row: parts, n_documents, n_tokens, n_chunks (different ones stored), root (Merkle root of the parts' roots)

A document's ids are cut where a rolling hash of the last `WINDOW` ids has its low bits zero, so an edit moves only the
cuts near it and equal passages give equal chunks. A document's root is the Merkle root of its chunks' addresses; the leaf
of its row in the part's tree covers doc_id, start, n_tokens and root. Readers recompute every address from the stored
bytes, every root from what is below it and the running totals, and fail if anything differs or is absent. A recipe's
sizes must be the lengths of the chunks stored under its addresses and add up to its n_tokens; the chunk table must hold as
many rows as the head says, so that a chunk that is there twice fails the read too. `uses` is a figure that no read needs.

Each word of a group of batches is encoded once, by the tokenizers library's model; texts are normalised and cut as lexer says.

Defined cases: a null or empty text is the end id alone; null ids come first in the order, rows that share an id are
ordered by root; equal rows are each written; an empty table gives an empty store; a long text is encoded and cut whole,
in memory that grows with the text; only the id and text column are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataflow.llm.bpe_automaton import parts, tokenizer_spec, vocabulary
from strataflow.llm.common import lean, shared_dir, staged, table
from strataflow.llm.lexer import Lexer

WINDOW = 16
MEAN_CHUNK = 256
MAX_CHUNK = 4096
END_ID = 1
MET = 200_000  # chunks that a task remembers to have sent
ROW = "doc_id long, n_tokens long, addresses array<binary>, sizes array<int>, root binary"
RECIPE = "doc_id long, start long, n_tokens long, n_chunks int, addresses array<binary>, sizes array<int>, root binary, part int"
PART = "part int, first long, n_documents long, n_tokens long, root binary"
HEAD = "parts long, n_documents long, n_tokens long, n_chunks long, root binary"


def cuts(ids: np.ndarray, ends: np.ndarray | None = None, mean: int = MEAN_CHUNK, most: int = MAX_CHUNK) -> np.ndarray:
    """Ends of the chunks of documents that lie one after the other; ends: those of the documents (one, by default)."""
    ends = np.array([len(ids)]) if ends is None else ends
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    factor, width = np.uint64(0xD6E8FEB86659FD93), 1
    while width < WINDOW and len(h) > width:  # h[i] covers ids[i : i + width]; factors wrap modulo 2**64
        h = h[:-width] * factor + h[width:]
        factor, width = np.uint64(int(factor) ** 2 % 2**64), 2 * width
    if width < WINDOW:
        found = np.zeros(0, np.int64)
    else:
        h ^= h >> np.uint64(32)
        found = np.flatnonzero(h & np.uint64(mean - 1) == 0) + WINDOW
        document = np.searchsorted(ends, found)  # the window must lie within one
        found = found[found - np.concatenate([[0], ends])[document] >= WINDOW]
    found = np.union1d(found, ends[ends > 0])
    gaps = np.diff(found, prepend=0)
    if gaps.max(initial=0) > most:  # far cuts at fixed distances from the last one
        extra = [np.arange(e - g + most, e, most) for e, g in zip(found, gaps, strict=True) if g > most]
        found = np.union1d(found, np.concatenate(extra))
    return found


def address(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node goes up as it is. Leaves and nodes are hashed apart."""
    level = [address(b"\0" + x) for x in leaves] or [address(b"")]
    while len(level) > 1:
        level = [address(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def encoded_chunks(documents: DataFrame, path: str, id_col: str, text_col: str, end_id: int, kind: str) -> DataFrame:
    """doc_id, n_tokens, addresses, sizes, root, chunks; a chunk that the task has met before is null in chunks."""
    spec = documents.sparkSession.sparkContext.broadcast(tokenizer_spec(path))
    width = np.dtype(kind).itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer, met = Lexer(spec.value, kind), set()
        # ids of rows are copied, since a column keeps its whole batch in memory
        texts = ((pa.array(part.column("doc_id").to_pylist(), pa.int64()), part.column("text").to_pylist()) for batch in batches for part in parts(batch, "text"))
        for doc_id, offsets, values in lexer.grouped(texts):
            ids = np.insert(values, offsets[1:], end_id).astype(kind)
            ends = offsets[1:] + np.arange(1, len(offsets))
            stops = cuts(ids, ends)
            sizes = np.diff(stops, prepend=0)
            data = ids.tobytes()
            chunks = [data[(b - n) * width : b * width] for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)]
            keys = [address(x) for x in chunks]
            sent: list[bytes | None] = []
            for key, chunk in zip(keys, chunks, strict=True):
                sent.append(None if key in met else chunk)
                met.add(key)
            if len(met) > MET:  # chunks met again are then sent again, and dropped by their address
                met.clear()
            each = pa.array(np.concatenate([[0], np.searchsorted(stops, ends, side="right")]), pa.int32())
            lists = [pa.ListArray.from_arrays(each, pa.array(x, t)) for x, t in ((keys, pa.binary()), (sizes, pa.int32()), (sent, pa.binary()))]
            bounds = each.to_pylist()
            roots = [merkle_root(keys[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            names = ["doc_id", "n_tokens", "addresses", "sizes", "root", "chunks"]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(ends, prepend=0), pa.int64()), lists[0], lists[1], pa.array(roots, pa.binary()), lists[2]], names)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(encode), f"{ROW}, chunks array<binary>")


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds local: the ids before a row in its partition, whose rows come in order."""
    at = 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n, pa.int64())], [*batch.schema.names, "local"])
        at = int(ends[-1]) if len(ends) else at


def write_store(documents: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, kind: str = "<u2") -> None:
    """Encodes and writes a store. kind: '<u2' for vocabularies up to 65,536 ids, '<u4' beyond."""
    spark = documents.sparkSession
    raw = staged(encoded_chunks(documents, path, id_col, text_col, end_id, kind), "store-encoded")
    flat = raw.select(F.explode(F.arrays_zip("addresses", "chunks")).alias("x")).select("x.addresses", "x.chunks")
    # a hot chunk gives one row a task: the others of a task are counted before the shuffle
    unique = flat.groupBy(F.col("addresses").alias("address")).agg(F.first("chunks", ignorenulls=True).alias("ids"), F.count("*").alias("uses"))
    unique.write.option("compression", "zstd").parquet(f"{folder}/chunks")

    rows = raw.select("doc_id", "n_tokens", "addresses", "sizes", "root")
    n_parts = max(1, min(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranged = rows.repartitionByRange(n_parts, F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    placed = staged(ranged.mapInArrow(_positions, f"{ROW}, local long").withColumn("part", F.spark_partition_id()), "store-placed")
    # one row a part, and their number is that of the partitions, whatever the number of documents
    totals = placed.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_documents"))
    in_order = Window.orderBy("part")
    before = F.coalesce(F.sum("n_tokens").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    base = staged(totals.select((F.row_number().over(in_order) - 1).alias("part"), F.col("part").alias("partition"), before.alias("first"), "n_documents", "n_tokens"), "store-parts")
    numbered = placed.withColumnRenamed("part", "partition").join(F.broadcast(base.select("part", "partition", "first")), "partition")
    recipes = numbered.select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", F.size("addresses").alias("n_chunks"), "addresses", "sizes", "root", "part")
    recipes.write.option("compression", "zstd").partitionBy("part").parquet(f"{folder}/recipes")
    manifest = base.select("part", "first", "n_documents", "n_tokens").join(_part_roots(recipes.select("part", "doc_id", "start", "n_tokens", "root")).select("part", "root"), "part")
    manifest.select("part", "first", "n_documents", "n_tokens", "root").write.parquet(f"{folder}/manifest")
    _head(spark.read.schema(PART).parquet(f"{folder}/manifest"), _stored(spark, folder)).write.parquet(f"{folder}/head")


def _rows_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, first, n_documents, n_tokens, root of each part, whose rows come in order: 16 bytes a document are held, for one part at a time."""
    part, first, tokens, leaves = None, 0, 0, []

    def out() -> pa.RecordBatch:
        names = ["part", "first", "n_documents", "n_tokens", "root"]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([len(leaves)]), pa.array([tokens]), pa.array([merkle_root(leaves)], pa.binary())], names)

    for batch in batches:
        for p, doc, start, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "start", "n_tokens", "root")), strict=True):
            if p != part and leaves:
                yield out()
                leaves = []
            if not leaves:
                part, first, tokens = p, start, 0
            if start != first + tokens:
                raise ValueError(f"part {p}: the document at {start} does not follow the one before it")
            tokens += n
            leaves.append(struct.pack("<?qqq", doc is None, doc or 0, start, n) + root)
    if leaves:
        yield out()


def _part_roots(rows: DataFrame) -> DataFrame:
    """One row for each part of rows (part, doc_id, start, n_tokens, root), recomputed from them."""
    return rows.repartition("part").sortWithinPartitions("part", "start").mapInArrow(_rows_root, PART)


def _stored(spark: SparkSession, folder: str) -> int:
    """Rows of the chunk table, which their files' footers tell."""
    return spark.read.schema("address binary").parquet(f"{folder}/chunks").count()


def _head(manifest: DataFrame, n_chunks: int) -> DataFrame:
    """The store's one row, of a manifest with one row a part; these are few, so the driver reads them."""
    rows = sorted(manifest.collect(), key=lambda r: r["part"])
    leaves = [struct.pack("<qqqq", r["part"], r["first"], r["n_documents"], r["n_tokens"]) + bytes(r["root"]) for r in rows]
    total = [(len(rows), sum(r["n_documents"] for r in rows), sum(r["n_tokens"] for r in rows), n_chunks, merkle_root(leaves))]
    return manifest.sparkSession.createDataFrame(total, HEAD)


# ---- reading


def _operators() -> np.ndarray:
    """ops[k] maps a CRC-32 to that of the same bytes followed by 2**k zero bytes, as 4 tables of 256 (GF(2) matrices)."""
    def times(matrix: np.ndarray, vector: int) -> int:
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= int(matrix[i])
            vector >>= 1
            i += 1
        return out

    one_bit = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint64)
    square = lambda m: np.array([times(m, int(x)) for x in m], np.uint64)
    matrix = square(square(square(one_bit)))  # one byte
    ops = []
    for _ in range(40):
        ops.append([[times(matrix, v << (8 * b)) for v in range(256)] for b in range(4)])
        matrix = square(matrix)
    return np.array(ops, np.uint64)


@cache
def _shift_tables() -> np.ndarray:
    return _operators()


def shifted_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC-32 of bytes with crc, moved before `zeros` more bytes: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    ops = _shift_tables()
    out = crc.astype(np.uint64)
    k = 0
    while len(zeros) and zeros.max() >> k:
        on = (zeros >> k & 1).astype(bool)
        v = out[on]
        t = ops[k]
        out[on] = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
        k += 1
    return out


def _checked_chunks(kind: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(kind).itemsize
        for batch in batches:
            crcs = []
            for key, data in zip(batch.column("address").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if data is None or address(data) != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(data, kind).astype("<u4").tobytes()))
            sizes = pc.cast(pc.divide(pc.binary_length(batch.column("ids")), width), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("address"), pa.array(crcs, pa.int64()), sizes], ["address", "crc", "stored"])

    return read


def _checked_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_sizes = batch.column("sizes").to_pylist()
        for key, root, n, k, sizes in zip(*(batch.column(c).to_pylist() for c in ("addresses", "root", "n_tokens", "n_chunks")), all_sizes, strict=True):
            if merkle_root(key) != root or sum(sizes) != n or not k == len(key) == len(sizes):
                raise ValueError("a recipe does not match its root")
        after = [(sum(x) - np.cumsum(x)).tolist() for x in all_sizes]
        names = ["doc_id", "start", "n_tokens", "n_chunks", "addresses", "sizes"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(after, pa.list_(pa.int64()))], [*names, "after"])


def _crc_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = shifted_crc(batch.column("crc").to_numpy(), 4 * batch.column("after").to_numpy())
        names = ["start", "doc_id", "n_tokens"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(terms.astype(np.int64))], [*names, "term"])


def verify(spark: SparkSession, folder: str) -> None:
    """Raises ValueError unless recipes, manifest and head agree: recipes give each part's row again, these the head."""
    manifest = spark.read.schema(PART).parquet(f"{folder}/manifest")
    heads = spark.read.schema(HEAD).parquet(f"{folder}/head").collect()
    n_chunks = _stored(spark, folder)
    if len(heads) == 1 and heads[0]["n_chunks"] != n_chunks:
        raise ValueError(f"{n_chunks} chunks are stored, the head says {heads[0]['n_chunks']}")
    if len(heads) != 1 or tuple(heads[0]) != tuple(_head(manifest, n_chunks).first()):
        raise ValueError("the manifest does not match the head")
    recipes = spark.read.schema(RECIPE).parquet(f"{folder}/recipes")
    columns = PART.replace(" int", "").replace(" long", "").replace(" binary", "").split(", ")
    found = _part_roots(recipes.select("part", "doc_id", "start", "n_tokens", "root"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in columns]
    bad = found.alias("x").join(manifest.alias("y"), F.expr("x.part = y.part"), "full").filter(~F.expr("true").eqNullSafe(same[0] & same[1] & same[2] & same[3] & same[4]))
    if wrong := bad.select(F.coalesce("x.part", "y.part").alias("part")).first():
        raise ValueError(f"the recipes of part {wrong['part']} do not match the manifest")


def references(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each chunk of each document, with the ids after it; recipes are checked against their roots."""
    recipes = spark.read.schema(RECIPE).parquet(f"{folder}/recipes")  # an empty store has no file to tell it
    checked = recipes.select("doc_id", "start", "n_tokens", "n_chunks", "addresses", "sizes", "root").mapInArrow(_checked_recipes, "doc_id long, start long, n_tokens long, n_chunks int, addresses array<binary>, sizes array<int>, after array<long>")
    flat = checked.select("doc_id", "start", "n_tokens", F.posexplode(F.arrays_zip("addresses", "sizes", "after")).alias("nth", "x"))
    return flat.select("doc_id", "start", "n_tokens", "nth", F.col("x.addresses").alias("address"), F.col("x.sizes").alias("size"), F.col("x.after").alias("after"))


def present(column: str, kind: str, stored: Column):
    """The column, or an error where a recipe's chunk was not found or has not the size that the recipe says."""
    wrong = F.when(stored.isNull(), "absent chunk ").otherwise("another size has chunk ")
    return F.when(F.col("size") == stored, F.col(column)).otherwise(F.raise_error(F.concat(wrong, F.hex("address"))).cast(kind))


def read_digests(spark: SparkSession, folder: str, kind: str = "<u2") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, without moving its ids.

    Each stored chunk is read, checked and reduced to its CRC-32, which is joined to the recipes and combined by length
    shifts. An absent chunk, recipe or part fails the read.
    """
    verify(spark, folder)
    crcs = spark.read.parquet(f"{folder}/chunks").select("address", "ids").mapInArrow(_checked_chunks(kind), "address binary, crc long, stored int")
    found = references(spark, folder).join(crcs, "address", "left").select("start", "doc_id", "n_tokens", present("crc", "long", F.col("stored")).alias("crc"), "after")
    terms = found.mapInArrow(_crc_terms, "start long, doc_id long, n_tokens long, term long")
    return terms.groupBy("start", "doc_id", "n_tokens").agg(F.bit_xor("term").alias("ids_crc32")).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, folder: str, kind: str = "<u2") -> DataFrame:
    """doc_id, start, ids (array of int) of every document, put together from its chunks; everything is checked as by read_digests."""
    verify(spark, folder)
    chunks = spark.read.parquet(f"{folder}/chunks").select("address", "ids")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for key, data in zip(batch.column("address").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if address(data) != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                ids.append(np.frombuffer(data, kind).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("address"), pa.array(ids, pa.list_(pa.int32()))], ["address", "ids"])

    found = references(spark, folder).join(chunks.mapInArrow(unpack, "address binary, ids array<int>"), "address", "left")
    found = found.withColumn("ids", present("ids", "array<int>", F.array_size("ids")))
    lists = found.groupBy("start", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("nth", "ids"))).alias("x"))
    return lists.select("doc_id", "start", F.flatten(F.col("x.ids")).alias("ids"))


def op8_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "store")
    write_store(table(spark, sf_dir, "documents"), folder, vocabulary())
    return read_digests(spark, folder)
