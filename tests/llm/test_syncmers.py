"""Closed syncmers against a plain Python version, and the neighbours' query against one on whole tables."""

import hashlib
import struct

import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import DATA
from llm_helpers import prose
from strataflow.llm import syncmers
from strataflow.llm.syncmers import K, S


def hashed(*values) -> int:
    """Signed 64-bit hash of strings and longs, chained as xxhash64() does."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v) if isinstance(v, bool) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def anchors_of(text: str) -> list[tuple[int, int]]:
    inner = [hashed(text[i : i + S]) for i in range(len(text) - S + 1)]
    found = []
    for i in range(len(text) - K + 1):
        h = inner[i : i + K - S + 1]
        if h.index(min(h)) in (0, K - S):
            found.append((i, hashed(*inner[i : i + K : S][: K // S]) & 0xFFFFFFFF))
    return found


def spots_of(text: str) -> list[tuple[int, int]]:
    return anchors_of(text) or [(-1, hashed(text) & 0xFFFFFFFF)]


def prints_of(text: str) -> list[tuple[int, int]]:
    spots = spots_of(text)
    return [spots[0], *((b[0] - a[0], b[1]) for a, b in zip(spots, spots[1:]))]


def written(text: str) -> str:
    return ",".join(f"={h:x}" if g < 0 else f"{g:x}:{h:x}" for g, h in prints_of(text))


def like(a: str, b: str) -> float:
    def dice(x: set, y: set) -> float:
        return 2 * len(x & y) / (len(x) + len(y))

    def links(t: str) -> set:
        p = prints_of(t)
        return {(None, p[0][0] < 0, p[0][1]), *((u[1], v[0], v[1]) for u, v in zip(p, p[1:]))}

    return max(dice(set(spots_of(a)), set(spots_of(b))), dice(links(a), links(b)))


def expected(rows: list[tuple]) -> list[tuple]:
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, (hashed(r[1]) & ((1 << 64) - 1)) >> 1))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(t), written(edited), round(like(t, edited), 9), round(like(t, after), 9)))
    return sorted(out, key=repr)


def got(frame) -> list[tuple]:
    found = frame.select("doc_id", "n_chars", "edited_sha256", syncmers.written(F.col("prints")), syncmers.written(F.col("edited_prints")), F.round("near_edited", 9), F.round("near_next", 9)).collect()
    return sorted((tuple(r) for r in found), key=repr)


def test_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    out = syncmers.op11_syncmers(spark, DATA)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    found = sorted(((r[0], *r[1:5], round(r[5], 9), round(r[6], 9)) for r in out.collect()), key=repr)
    assert found == expected(list(zip(docs.doc_id.tolist(), docs.text.tolist())))


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 20_000, 500])
def test_awkward_documents(spark, awkward, bucket_bytes):
    more = [(50, "aé😀" * 40), (51, "x" * 300), (52, "ab" * 200), (53, "x" * 299 + "y"), (54, "日" * 25), (-7, "short"), (55, prose(9, 200)), (56, "new " + prose(9, 200))]
    more += [(60, f"{i} same id") for i in range(40)]  # an id so frequent that it is dealt over buckets
    frame = awkward.drop("bucket").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).withColumns({"bucket": F.lit(1), "again": F.lit(True), "key": F.lit("k"), "tie": F.lit(None)})
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    assert got(syncmers.neighbour_prints(frame, bucket_bytes=bucket_bytes)) == expected(rows)


def test_one_row_and_none(spark, nothing):
    assert syncmers.neighbour_prints(nothing).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert got(syncmers.neighbour_prints(one)) == expected([(1, None)])


def test_edits_move_few_anchors(spark):
    base = prose(11, 2000)
    moved = "a new head. " + base[:6000] + "!" + base[6000:]
    frame = spark.createDataFrame([(1, base, moved, prose(12, 2000))], "i int, a string, b string, c string")
    spots = frame.select(*(syncmers.or_whole(syncmers.anchors(F.col(c)), F.col(c)).alias(c) for c in "abc"))
    joined = spots.select("*", *(syncmers.links(syncmers.fingerprint(F.col(c))).alias(f"l{c}") for c in "abc"))
    near, far = joined.select(*(syncmers.likeness(F.col("a"), F.col("la"), F.col(c), F.col(f"l{c}")) for c in "bc")).first()
    assert near > 0.97 and far < 0.05


def test_plan_has_no_python(spark):
    plan = syncmers.op11_syncmers(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_each_place_is_compared_on_one_side_only(spark):
    """Every comparison is interpreted once a code point: the two edges once, then the others with the lesser edge only."""
    text = spark.createDataFrame([("x",)], "text string")
    plan = text.select(syncmers.anchors(F.col("text")).alias("a"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("<") <= 1 + 2 * (K - S - 1), plan.count("<")
    short = ["x" * n for n in range(K + 3)] + [prose(n, 9)[: K + n] for n in range(40)]  # blocks that end within a k-mer
    found = spark.createDataFrame([(t,) for t in short], "text string").select("text", syncmers.anchors(F.col("text")).alias("a")).collect()
    assert all([(a >> 32, a & 0xFFFFFFFF) for a in r.a] == anchors_of(r.text) for r in found)
