"""Numeric statistics of whole texts, computed batch by batch from their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from strataflow.llm.order_minhash import _letters, binary_parts, mixed, word_hashes

_SINGLE = "!|%$&#*.,;:?'\"-/<>@_=()[]{}+~\\`^"
#: Names of the statistics, in order.
STATS = [
    "log_bytes", "log_words", "lower", "upper", "digit", "space", "newline", "high", "control",
    *(f"byte_{ord(c)}" for c in _SINGLE),
    "entropy", "word_bytes", "word_bytes_sd", "short_words", "long_words", "distinct_words", "distinct_weighted", "repeated_runs", "words_per_line",
    "upper_words",
]


def doc_stats(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATS for each text; an empty text has zeros only."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    counts = np.zeros((n, 256))
    for lo in range(0, n, 256):  # bounded: 256 texts of a part at a time
        hi = min(n, lo + 256)
        owner = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        counts[lo:hi] = np.bincount(owner * 256 + values[offsets[lo] : offsets[hi]], minlength=(hi - lo) * 256).reshape(-1, 256)
    share = counts / np.maximum(sizes, 1)[:, None]
    lowered = values.copy()
    capital = (values >= 65) & (values <= 90)
    lowered[capital] += 32
    words, owner = word_hashes(lowered, offsets)
    per = np.bincount(owner, minlength=n)
    some = np.maximum(per, 1)
    length = word_lengths(lowered, offsets)
    mean = np.bincount(owner, length, n) / some
    square = np.bincount(owner, length * length, n) / some
    own = words ^ mixed(owner.astype(np.uint64) + np.uint64(5))
    order = np.argsort(own, kind="stable")
    kinds = own[order]
    first = np.concatenate([[True], kinds[1:] != kinds[:-1]]) if len(kinds) else np.zeros(0, bool)
    distinct = np.bincount(owner[order][first], minlength=n)
    repeats = repeated_runs(words, owner, n)
    log_bytes, log_words = np.log1p(sizes), np.log1p(per)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    lines = counts[:, 10] + 1
    columns = [
        log_bytes, log_words, share[:, 97:123].sum(1), share[:, 65:91].sum(1), share[:, 48:58].sum(1), share[:, 32], share[:, 10], share[:, 128:].sum(1), share[:, :32].sum(1) - share[:, 10],
        *(share[:, ord(c)] for c in _SINGLE),
        entropy, mean, np.sqrt(np.maximum(square - mean**2, 0)), np.bincount(owner, length <= 3, n) / some, np.bincount(owner, length >= 12, n) / some, distinct / some, distinct / np.sqrt(some), repeats / some, np.log1p(per / lines),
        np.minimum(share[:, 65:91].sum(1) / np.maximum(share[:, 97:123].sum(1) + share[:, 65:91].sum(1), 1e-9), 1),
    ]
    return np.where(sizes[:, None] > 0, np.column_stack(columns), 0.0)


def word_lengths(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    on = _letters[values]
    first = np.zeros(len(values) + 1, bool)
    first[offsets[:-1]] = True
    starts = np.flatnonzero(on & (first[:-1] | ~np.concatenate([[False], on[:-1]]))) if len(values) else np.zeros(0, np.int64)
    ends = np.flatnonzero(on & (first[1:] | ~np.concatenate([on[1:], [False]]))) + 1 if len(values) else starts
    return (ends - starts).astype(np.float64)


def repeated_runs(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many of each text's three-word runs have occurred in it before."""
    if len(words) < 3:
        return np.zeros(n)
    run = words[:-2] + np.uint64(3) * words[1:-1] + np.uint64(7) * words[2:]
    inside = owner[:-2] == owner[2:]
    who = owner[:-2][inside]
    key = mixed(run[inside] ^ mixed(who.astype(np.uint64) + np.uint64(9)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    again = np.concatenate([[False], ranked[1:] == ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    return np.bincount(who[order][again], minlength=n).astype(float)


def stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, stats of rows doc_id, body (binary)."""
    for batch in batches:
        for lo, n, values, offsets in binary_parts(batch, "body"):
            x = doc_stats(values, offsets).astype(np.float32)
            stats = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), stats], ["doc_id", "stats"])


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))
