"""Removal of repeated 50-byte strings by bucket-pointer refinement over sampled positions.

A byte goes if a string of `DEPTH` bytes that covers it also starts in a document with a smaller id. Every such string has
one anchor: the q-gram in it with the smallest hash (the leftmost of equals), which is the same wherever the string
stands. Neighbouring strings with one anchor form a run, so a text has about one run per 17 bytes and only runs travel:
  1. Runs are bucketed by their anchor's q-gram. Runs that are equal as a whole (by 128 bits of two hashes of their bytes)
     need no more: all but the smallest id's are repeats. Equal runs within one part of a task are settled before the shuffle.
  2. Of anchors shared by different runs that agree on one side too, the bytes around go to their bucket, where bucket-pointer refinement sorts all
     strings by their first DEPTH bytes (refined_order); neighbours in the order are then compared byte by byte.
  3. Each text's covered bytes are merged into spans and cut out.
No key is held whole by one task: runs of a q-gram that a sample finds in more than HOT_RUNS different surroundings are
bucketed by their content hash instead, and a q-gram with more than HOT_CONTEXTS unclear runs, which are counted, is not
refined: its strings are compared by 128 bits of hashes, dealt by these. The sample decides only where runs go.
Texts that equal one with a smaller id go whole and take no part. Runs of long texts are found in overlapping pieces of
PART_BYTES; what is cut out of a text is cut in one task, in memory of a few times the text.

Defined cases: a null text is empty; texts below DEPTH bytes keep all; null ids take no part and keep all; rows repeated
with the same id and text each get the same result; of rows that share an id but not the text, only the text with the
smallest SHA-256 takes part, the others keep all; an empty table gives an empty result. Only the id and text column are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import lean, lookup_join, staged, table
from strataflow.llm.order_minhash import _powers, binary_parts, mixed

DEPTH, Q = 50, 16
PART_BYTES = 1 << 19  # of text at a time: a task holds about 150 times that
BUCKET_BITS, BUCKET_TEXT = 8, 4 << 20  # buckets at least, and bytes of text for each beyond that
BUCKET_RUNS = 250_000  # that many are in BUCKET_TEXT
POSITION_BITS = 28
_A = np.uint64(0xD1342543DE82EF95)
_BASE, _CHECK_BASE = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_CHECK = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))  # a number for each byte
_LOW40 = np.uint64((1 << 40) - 1)
HOT_RUNS, HOT_CONTEXTS = 500_000, 12_000  # of one q-gram in one task
WAVES = 8
SAMPLE, PIECE = 64, 1 << 16  # one of SAMPLE pieces of text is looked at for hot q-grams
HOT_BUCKET = 1 << 24  # buckets from here on hold runs of hot q-grams
SIDE = (DEPTH - Q) // 2  # a string around an anchor reaches this far at least to one side of it
RUNS = "bucket int, ids binary, keys binary, contents binary, starts binary, lengths binary, lefts binary, rights binary"



def runs_of(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, key, content, check, start, strings, left, right) of every run: the anchor's hash, two independent hashes of all the run's bytes and the anchor's place in them, the first string's start within its text, the number of strings, and short hashes of the anchor with SIDE bytes to its left and right (0 where the run does not reach so far)."""
    n = len(values)
    none = np.zeros(0, np.int64)
    empty = (none, *[none.astype(np.uint64)] * 3, none, none, none.astype(np.uint16), none.astype(np.uint16))
    if n < DEPTH:
        return empty
    h = mixed(values.astype(np.uint64) + np.uint64(1))
    width, factor = 1, _A
    while width < Q:
        h = h[:-width] * factor + h[width:]
        factor, width = np.uint64(int(factor) ** 2 % 2**64), 2 * width
    h = mixed(h)
    keyed = (h >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(h), dtype=np.uint64)
    window = DEPTH - Q + 1
    low, width = keyed, 1
    while width * 2 <= window:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    count = n - DEPTH + 1
    low = np.minimum(low[:count], low[window - width : window - width + count])
    anchor = (low & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:count]
    inside = np.arange(count) + DEPTH <= offsets[1:][owner]  # strings end within their text
    first = np.ones(count, bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(first & inside)
    if not len(starts):
        return empty
    last = np.zeros(count, bool)
    last[:-1] = first[1:] | ~inside[1:]
    last[-1] = True
    ends = np.flatnonzero(last & inside) + 1
    at = anchor[starts]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(values.astype(np.uint64) + np.uint64(300)) * _powers(_BASE, n), dtype=np.uint64)])
    stop = ends - 1 + DEPTH
    unshift = _powers(pow(_BASE, -1, 1 << 64), n)
    part = lambda a, b: mixed((sums[b] - sums[a]) * unshift[a])
    content = mixed(part(starts, stop) + (at - starts).astype(np.uint64) * _A + (ends - starts).astype(np.uint64))
    checks = np.concatenate([[np.uint64(0)], np.cumsum(_CHECK[values] * _powers(_CHECK_BASE, n), dtype=np.uint64)])
    check = (checks[stop] - checks[starts]) * _powers(pow(_CHECK_BASE, -1, 1 << 64), n)[starts]
    check = mixed(mixed(check) + (at - starts).astype(np.uint64) * np.uint64(_BASE) + (ends - starts).astype(np.uint64))
    short = lambda x, ok: np.where(ok, 1 + (x % np.uint64(65535)), 0).astype(np.uint16)
    left = short(part(np.maximum(at - SIDE, 0), at + Q), at - starts >= SIDE)
    right = short(part(at, np.minimum(at + Q + SIDE, n)), stop - at - Q >= SIDE)
    text = owner[starts]
    return text, h[at], content, check, starts - offsets[:-1][text], ends - starts, left, right


def pack40(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack40(data: bytes) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :5] = part
    return out.view("<u8").ravel()


def repeats_within(key: np.ndarray, content: np.ndarray, check: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, content, check, id), and in that order whether a run equals one with a smaller id."""
    order = np.lexsort((ids, check, content, key))
    k, c, d, i = key[order], content[order], check[order], ids[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])]) if len(k) else np.zeros(0, bool)
    least = i[np.flatnonzero(new)][np.cumsum(new) - 1] if len(k) else i
    return order, i > least


def met_elsewhere(key: np.ndarray, side: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Indexes whose (key, side) also occurs with another id; side 0 meets nothing."""
    order = np.lexsort((ids, side, key))
    order = order[side[order] > 0]
    if not len(order):
        return order
    k, s, i = key[order], side[order], ids[order]
    heads = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]))
    several = np.maximum.reduceat(i, heads) != np.minimum.reduceat(i, heads)
    return order[np.repeat(several, np.diff(np.append(heads, len(k))))]


def _run_batches(bits: int, hot: np.ndarray, hot_bits: int, size: int):
    """Runs packed by one of 2**bits buckets of their key, or 2**hot_bits of their content for the sorted keys in hot; bucket -1 holds runs that equal one of a smaller id in the same part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _packed_runs(batch, bits, hot, hot_bits, size)

    return pack


def _top(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def pieces(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, first byte, bytes, offsets) of parts of about `size` bytes; a longer text is cut so that each string of DEPTH bytes starts in one part, and lies in it."""
    for lo, n, values, offsets in binary_parts(batch, "body", size):
        if n > 1 or len(values) < size + DEPTH:
            yield lo, n, 0, values, offsets
            continue
        for at in range(0, len(values) - DEPTH + 1, size):
            part = values[at : at + size + DEPTH - 1]
            yield lo, 1, at, part, np.array([0, len(part)])


def _packed_runs(batch: pa.RecordBatch, bits: int, hot: np.ndarray, hot_bits: int, size: int) -> Iterator[pa.RecordBatch]:
    ids_all = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, n, at, values, offsets in pieces(batch, size):
        text, key, content, check, start, count, left, right = runs_of(values, offsets)
        ids, start = ids_all[lo : lo + n][text], start + at
        bucket = _top(key, bits)
        if len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
            bucket[is_hot] = HOT_BUCKET + _top(content[is_hot], hot_bits)
        yield _packed(bucket, ids, key, content, check, start, count, left, right)


def _packed(bucket: np.ndarray, ids: np.ndarray, key: np.ndarray, content: np.ndarray, check: np.ndarray, start: np.ndarray, count: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    order, again = repeats_within(key, content, check, ids)
    bucket = np.where(again, -1, bucket[order])
    by = np.lexsort((start[order], ids[order], bucket))
    order, bucket = order[by], bucket[by]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    rows = [(int(bucket[a]), order[a:b]) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([b for b, _ in rows], pa.int32()),
            pa.array([ids[o].tobytes() for _, o in rows], pa.binary()),
            pa.array([b"" if b < 0 else pack40(key[o]) for b, o in rows], pa.binary()),
            pa.array([b"" if b < 0 else np.stack([content[o], check[o]], 1).astype("<u8").tobytes() for b, o in rows], pa.binary()),
            pa.array([start[o].astype("<i4").tobytes() for _, o in rows], pa.binary()),
            pa.array([count[o].astype(np.uint8).tobytes() for _, o in rows], pa.binary()),
            *(pa.array([b"" if b < 0 else x[o].astype("<u2").tobytes() for b, o in rows], pa.binary()) for x in (left, right)),
        ],
        ["bucket", "ids", "keys", "contents", "starts", "lengths", "lefts", "rights"],
    )


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, runs: how many different runs of each key every part has."""
    for batch in batches:
        for _, _, values, offsets in binary_parts(batch, "body", PART_BYTES):
            _, key, content, check, *_ = runs_of(values, offsets)
            order, again = repeats_within(key, content, check, np.arange(len(key)))
            keys, runs = np.unique(key[order][~again], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(runs, pa.int64())], ["key", "runs"])


def hot_keys(texts: DataFrame, sample: int, most: int) -> tuple[np.ndarray, int]:
    """Sorted keys that a sample finds in more than `most` different runs, and the runs that they have by it. There are at most total runs / most of them."""
    pieces = F.expr(f"filter(sequence(0L, (octet_length(body) - 1) div {PIECE}), i -> pmod(xxhash64(doc_id, i), {sample}) = 0)")
    cut = texts.withColumn("i", F.explode(pieces)).select("doc_id", F.expr(f"substring(body, cast(i * {PIECE} + 1 as int), {PIECE})").alias("body"))
    counted = cut.mapInArrow(lean(_key_counts), "key long, runs long").groupBy("key").agg(F.sum("runs").alias("runs"))
    found = counted.filter(F.col("runs") * sample > most).collect()
    return np.sort(np.array([r["key"] for r in found], np.int64).view(np.uint64)), sample * sum(r["runs"] for r in found)


def _settled(bucket: int, blobs: list[list[bytes]]) -> pa.RecordBatch:
    """Rows doc_id, start, strings, key of one bucket: repeats (no key), and runs whose anchor others share (key); in buckets of hot keys all that are left."""
    ids = np.frombuffer(b"".join(b[0] for b in blobs), np.int64)
    start = np.frombuffer(b"".join(b[3] for b in blobs), "<i4")
    count = np.frombuffer(b"".join(b[4] for b in blobs), np.uint8)
    if bucket < 0:
        out, key, shown = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    else:
        k, c = unpack40(b"".join(b[1] for b in blobs)), np.frombuffer(b"".join(b[2] for b in blobs), "<u8").reshape(-1, 2)
        order, again = repeats_within(k, c[:, 0], c[:, 1], ids)
        if bucket >= HOT_BUCKET:
            out, shown = order, ~again
            key = (k[order] | (np.uint64(1) << np.uint64(63))).astype(np.int64)
            return _settled_rows(ids[out], start[out], count[out], key, shown)
        k2, c2, i2 = k[order], c[order], ids[order]
        heads = np.flatnonzero(np.concatenate([[True], k2[1:] != k2[:-1]]))
        size = np.diff(np.append(heads, len(k2)))
        varied = (c2[heads] != c2[heads + size - 1]).any(1)
        several = np.maximum.reduceat(i2, heads) != np.minimum.reduceat(i2, heads)
        unclear = np.repeat(varied & several, size) & ~again
        where = np.flatnonzero(unclear)
        unclear[:] = False
        for side in (5, 6):  # strings can only be equal where one side is: other chance meetings of a q-gram end here
            s = np.frombuffer(b"".join(b[side] for b in blobs), "<u2")[order[where]]
            unclear[where[met_elsewhere(k2[where], s, i2[where])]] = True
        keep = again | unclear
        out, shown = order[keep], unclear[keep]
        key = (k2[keep] | (np.uint64(bucket) << np.uint64(40))).astype(np.int64)
    return _settled_rows(ids[out], start[out], count[out], key, shown)


def _settled_rows(ids: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray, shown: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(key, mask=~shown)], ["doc_id", "start", "strings", "key"])


def _settle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket; one bucket is held, those of -1 are passed on as they come."""
    held, blobs = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "ids", "keys", "contents", "starts", "lengths", "lefts", "rights")]
        for bucket, *blob in zip(*columns, strict=True):
            if bucket < 0:
                yield _settled(bucket, [blob])
                continue
            if bucket != held and blobs:
                yield _settled(held, blobs)
                blobs = []
            held = bucket
            blobs.append(blob)
    if blobs:
        yield _settled(held, blobs)


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each unclear run, and where they start."""
    for batch in batches:
        for i in range(batch.num_rows):
            body, doc = batch.column("body")[i].as_buffer(), batch.column("doc_id")[i].as_py()
            runs = batch.column("runs")[i].as_py()
            data = [body[r["start"] : r["start"] + r["strings"] - 1 + DEPTH].to_pybytes() for r in runs]
            yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in runs], pa.int64()), pa.array([doc] * len(runs), pa.int64()), pa.array([r["start"] for r in runs], pa.int32()), pa.array(data, pa.binary())], ["key", "doc_id", "start", "bytes"])


def refined_order(text: np.ndarray, waves: int = WAVES) -> tuple[np.ndarray, np.ndarray]:
    """(order, pointer) of all suffixes by at least their first DEPTH bytes, by bucket-pointer refinement; beyond its end the text counts as zeros.

    Suffixes start in buckets of their Q-grams. A bucket's pointer is the index of its first suffix in the order. A bucket
    is refined by sorting its suffixes by the pointers Q bytes further on; the new buckets get their pointers at once and
    are refined by those another Q bytes further on, before the next buckets have their turn, which then sort by the
    pointers already moved. `waves` tells in how many turns the first buckets are taken.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(DEPTH + 2 * Q, np.uint8)])
    grams = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 8].copy().view(">u8").ravel().astype(np.uint64)
    order = np.lexsort((grams[8:], grams[:n]))
    first = grams[order]
    second = grams[order + 8]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    pointer = np.full(n + DEPTH + Q, -1, np.int64)  # suffixes beyond the end come first
    pointer[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))

    def refine(lo: int, hi: int, shift: int) -> None:
        members = order[lo:hi]
        own = pointer[members]
        size = np.bincount(own - lo, minlength=hi - lo)
        places = lo + np.flatnonzero(size[own - lo] > 1)
        members = order[places]
        if not len(members):
            return
        later = pointer[members + shift]
        by = np.lexsort((later, pointer[members]))
        members, later = members[by], later[by]
        own = pointer[members]
        order[places] = members
        head = np.concatenate([[True], (own[1:] != own[:-1]) | (later[1:] != later[:-1])])
        pointer[members] = np.maximum.accumulate(np.where(head, places, 0))
        if shift + Q < DEPTH:
            refine(lo, hi, shift + Q)

    heads = np.flatnonzero(new)
    cuts = np.unique(heads[np.searchsorted(heads, np.arange(0, n, max(1, -(-n // waves))), side="right") - 1])
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=True):
        refine(lo, hi, Q)
    return order, pointer[:n]


def equal_strings(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each start, the same for equal strings of DEPTH bytes, which the order puts side by side; neighbours are compared byte by byte."""
    _, pointer = refined_order(text)
    by = np.argsort(pointer[starts], kind="stable")
    ranked = starts[by]
    new = np.ones(len(ranked), bool)
    new[1:] = pointer[ranked[1:]] != pointer[ranked[:-1]]
    view = np.lib.stride_tricks.sliding_window_view(text, DEPTH)
    apart = np.flatnonzero(new[1:]) + 1
    for lo in range(0, len(apart), 1 << 15):
        at = apart[lo : lo + (1 << 15)]
        new[at] = (view[ranked[at]] != view[ranked[at - 1]]).any(1)
    group = np.empty(len(starts), np.int64)
    group[by] = np.cumsum(new)
    return group


def _refine_bucket(ids: list[int], first: list[int], data: list[bytes]) -> pa.RecordBatch:
    """doc_id, start, strings of the strings that also stand in a smaller id's context."""
    sizes = np.array([len(x) for x in data])
    text = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.cumsum(sizes) - sizes
    count = sizes - DEPTH + 1
    owner = np.repeat(np.arange(len(data)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    group = equal_strings(text, offsets[owner] + nth)
    doc = np.array(ids)[owner]
    order = np.lexsort((doc, group))
    g, d = group[order], doc[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    hit = np.zeros(len(doc), bool)
    hit[order] = d > least
    # neighbouring strings of a context are joined
    begin = hit & ~(np.concatenate([[False], hit[:-1]]) & (nth > 0))
    a = np.flatnonzero(begin)
    b = np.flatnonzero(hit & ~(np.concatenate([hit[1:], [False]]) & np.concatenate([nth[1:] > 0, [False]])))
    where = owner[a]
    return pa.RecordBatch.from_arrays([pa.array(doc[a], pa.int64()), pa.array((np.array(first)[where] + nth[a]).astype(np.int32)), pa.array((b - a + 1).astype(np.int32))], ["doc_id", "start", "strings"])


def _refine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts come by key, so equal strings come together; whole keys are refined about PART_BYTES at a time."""
    held: tuple[list, list, list] = ([], [], [])
    last, size = None, 0
    for batch in batches:
        for key, doc, start, data in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "start", "bytes")), strict=True):
            if key != last and size > PART_BYTES:
                yield _refine_bucket(*held)
                held, size = ([], [], []), 0
            last = key
            for x, y in zip(held, (doc, start, data), strict=True):
                x.append(y)
            size += len(data)
    if held[0]:
        yield _refine_bucket(*held)


def string_hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the DEPTH bytes from each place."""
    n = len(values) - DEPTH + 1
    out = []
    for numbers, base in ((mixed(np.arange(256, dtype=np.uint64) + np.uint64(300)), _BASE), (_CHECK, _CHECK_BASE)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(numbers[values] * _powers(base, len(values)), dtype=np.uint64)])
        out.append(mixed((sums[DEPTH:] - sums[:n]) * _powers(pow(base, -1, 1 << 64), n)))
    return out[0], out[1]


def _string_batches(bits: int):
    """The strings of contexts, packed like runs by one of 2**bits buckets of their hash."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, values, offsets in binary_parts(batch, "bytes", PART_BYTES // 8):  # a context has 20 times its bytes in strings
                count = np.diff(offsets) - DEPTH + 1
                owner = np.repeat(np.arange(n), count)
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                content, check = (x[offsets[:-1][owner] + nth] for x in string_hashes(values))
                ids = batch.column("doc_id").to_numpy()[lo : lo + n][owner]
                start = batch.column("start").to_numpy()[lo : lo + n][owner] + nth
                none = np.zeros(len(ids), np.uint64)
                yield _packed(_top(content, bits), ids, none, content, check, start, none + np.uint64(1), none, none)

    return pack


def _settle_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, start, strings of the strings that have a smaller id's equal."""
    for batch in _settle_batches(batches):
        yield batch.filter(batch.column("key").is_null()).select(["doc_id", "start", "strings"])


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, spans (start, end), kept text of rows with their covered strings."""
    for batch in batches:
        ids, spans, kept = batch.column("doc_id"), [], []
        for i in range(batch.num_rows):
            body = np.frombuffer(batch.column("body")[i].as_buffer(), np.uint8)
            runs = batch.column("runs")[i].values
            start = runs.field("start").to_numpy()
            stop = start + runs.field("strings").to_numpy() - 1 + DEPTH
            depth = np.zeros(len(body) + 1, np.int32)
            np.add.at(depth, start, 1)
            np.add.at(depth, stop, -1)
            gone = np.cumsum(depth[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            spans.append(edge.tolist())
            kept.append(body[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([ids, pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.binary())], ["doc_id", "edges", "kept"])


def meeting(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """doc_id, body, runs of texts that have a list. Lists are as wide as texts, so they are shuffled; texts without one are left out before."""
    some = lookup_join(texts.select("doc_id", "body"), lists.select("doc_id"), ["doc_id"], "left_semi", ["doc_id"])
    return some.join(lists.hint("merge"), "doc_id").select("doc_id", "body", "runs")


def bucket_bits(rows: int) -> int:
    return min(20, max(BUCKET_BITS, int(np.ceil(np.log2(max(rows, 1) / BUCKET_RUNS)))))


def by_bucket(runs: DataFrame) -> DataFrame:
    """One bucket's rows in one task, one after the other; bucket -1 is spread."""
    return runs.repartition(F.col("bucket"), F.when(F.col("bucket") < 0, F.xxhash64("ids"))).sortWithinPartitions("bucket")


def contexts_of(texts: DataFrame, unclear: DataFrame) -> DataFrame:
    """key, doc_id, start, bytes of unclear runs."""
    lists = unclear.groupBy("doc_id").agg(F.collect_list(F.struct("start", "strings", "key")).alias("runs"))
    return meeting(texts, staged(lists, "substring-unclear")).mapInArrow(lean(_context_batches), "key long, doc_id long, start int, bytes binary")


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(prints, cut): doc_id, n_bytes, sha, whole (goes as a copy) of every row; doc_id, sha, edges (starts and ends of removed spans in turn), kept (bytes left) of rows that lose a part."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    docs = docs.withColumn("sha", F.unhex(F.sha2("body", 256)))
    prints = staged(docs.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), "sha"), "substring-prints")
    odd = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi")).filter("lo != hi").select("doc_id", "lo")
    odd = staged(odd, "substring-odd")
    part = lookup_join(prints.filter("doc_id is not null"), odd, ["doc_id"], "left", ["doc_id"]).filter("lo is null or sha = lo").drop("lo")
    first = staged(part.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"), "substring-first")

    texts = lookup_join(docs.filter(f"doc_id is not null and octet_length(body) >= {DEPTH}"), odd, ["doc_id"], "left", ["doc_id"]).filter("lo is null or sha = lo").drop("lo")
    texts = lookup_join(texts, first, ["sha"], "left", ["doc_id"]).filter("first is null or doc_id = first").select("doc_id", "sha", "body")

    total = prints.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(20, max(BUCKET_BITS, int(np.ceil(np.log2(max(total, 1) / BUCKET_TEXT)))))  # so a bucket does not grow with the corpus
    hot, n_hot = hot_keys(texts.select("doc_id", "body"), SAMPLE, HOT_RUNS)
    runs = texts.select("doc_id", "body").mapInArrow(lean(_run_batches(bits, hot, bucket_bits(n_hot), PART_BYTES)), RUNS)
    found = staged(by_bucket(runs).mapInArrow(lean(_settle_batches), "doc_id long, start int, strings int, key long"), "substring-runs")

    unclear = found.filter("key is not null")
    many = staged(unclear.groupBy("key").agg(F.count("*").alias("runs")).filter(F.col("runs") > HOT_CONTEXTS), "substring-hot")
    n_many = many.agg(F.sum("runs")).first()[0] or 0
    many = many.select("key")
    contexts = contexts_of(texts, lookup_join(unclear, many, ["key"], "left_anti", ["doc_id"]) if n_many else unclear)
    sorted_contexts = contexts.repartition("key").sortWithinPartitions("key")
    more = staged(sorted_contexts.mapInArrow(lean(_refine_batches), "doc_id long, start int, strings int"), "substring-more")
    if n_many:
        contexts = contexts_of(texts, lookup_join(unclear, many, ["key"], "left_semi", ["doc_id"]))
        strings = contexts.mapInArrow(_string_batches(bucket_bits(n_many * (DEPTH - Q + 1))), RUNS)
        more = more.unionByName(staged(by_bucket(strings).mapInArrow(lean(_settle_strings), "doc_id long, start int, strings int"), "substring-strings"))

    covered = found.filter("key is null").select("doc_id", "start", "strings").unionByName(more).groupBy("doc_id").agg(F.collect_list(F.struct("start", "strings")).alias("runs"))
    cut = meeting(texts, staged(covered, "substring-covered"))
    cut = cut.mapInArrow(lean(_cut_batches), "doc_id long, edges array<int>, kept binary")
    whole = lookup_join(prints, first, ["sha"], "left", ["doc_id"])
    whole = lookup_join(whole, odd, ["doc_id"], "left", ["doc_id"])
    whole = whole.withColumn("takes_part", F.expr("doc_id is not null and (lo is null or sha = lo)")).drop("lo")
    gone = F.coalesce(F.expr(f"takes_part and doc_id > first and n_bytes >= {DEPTH}"), F.lit(False))
    return whole.select("doc_id", "n_bytes", "sha", "takes_part", gone.alias("whole")), cut


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints, cut = deduplicated(table(spark, sf_dir, "documents"))
    kept = cut.select("doc_id", (F.size("edges") / 2).cast("long").alias("spans"), F.octet_length("kept").cast("long").alias("left"), F.unhex(F.sha2("kept", 256)).alias("kept_sha"))
    kept = staged(kept, "substring-cut").withColumn("takes_part", F.lit(True))
    out = lookup_join(prints, kept.distinct(), ["doc_id", "takes_part"], "left", ["doc_id"])
    cut_here = F.col("spans").isNotNull() & ~F.col("whole")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).when(cut_here, F.col("n_bytes") - F.col("left")).otherwise(0).cast("long").alias("n_removed"),
        F.when(F.col("whole"), 1).when(cut_here, F.col("spans")).otherwise(0).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(digest(b""))).when(cut_here, F.lower(F.hex("kept_sha"))).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


#: By another way: every string of 50 bytes, in hexadecimal digits, with the smallest document that has it.
OP5_SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d WHERE len(h) >= 100)),
f AS (SELECT k, min(doc_id) AS lo FROM s GROUP BY k),
r AS (SELECT doc_id, p FROM s JOIN f USING (k) WHERE doc_id > lo),
g AS (SELECT doc_id, p, sum(CASE WHEN p - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, run),
cut AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS n, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(1, n + 2), lambda i: CASE WHEN i = 1 THEN substr(h, 1, 2 * starts[1]) WHEN i = n + 1 THEN substr(h, 2 * stops[n] + 1) ELSE substr(h, 2 * stops[i - 1] + 1, 2 * (starts[i] - stops[i - 1])) END), '') END AS left_hex FROM d LEFT JOIN cut USING (doc_id))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(left_hex)) AS kept_sha256 FROM kept
"""
