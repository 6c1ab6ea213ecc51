"""The filter audit against its SQL and against walking each document through each order."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from helpers import DATA, rows_of
from strataflow.llm import filter_audit as audit

LABELS = "doc_id long, quality int, toxic int, mask string, part string"


def walked(rows: list[tuple], labels: list[tuple]) -> dict[tuple, list[int]]:
    """(part, order, step): metrics, by brute force; rows are (doc_id, text, part)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = []
    for i, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = [j for j, other, _ in rows if j is not None and (other or "") == t]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and min(smaller) < i}
        judged.append((part or "", i, {k for k, v in fails.items() if v}))
    out = collections.defaultdict(lambda: [0] * 6)
    for part, i, fails in judged:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                m, before = out[part, order, step], set(order[: step - 1]) & fails
                gone, here = bool(before), letter in fails
                for k, v in enumerate((not gone and not here, not gone and here, gone and here, fails == {letter}, not gone and here and i in good, not gone and here and i in toxic)):
                    m[k] += int(v)
    shapley = collections.Counter()
    for (part, order, step), m in out.items():
        shapley[part, order[step - 1]] += m[1]
    return {(p, o, s): [*m, shapley[p, o[s - 1]]] for (p, o, s), m in out.items()}


def got(frame) -> dict[tuple, list[int]]:
    return {(r.part, r.filter_order, r.step): [*(r[c] for c in audit.METRICS), r.shapley] for r in frame.collect()}


def test_query_equals_sql(spark, duck):
    assert rows_of(audit.op13_filter_audit(spark, DATA).toPandas()) == rows_of(duck.execute(audit.OP13_SQL).df())


def test_awkward_rows_equal_brute_force(spark, awkward):
    many = " ".join(f"w{i}" for i in range(300))
    more = [(20, many, "a"), (21, many, "b"), (19, many, None), (22, many + " #", "a"), (22, many + " #", "a"), (22, "Other TEXT", "a"), (None, many, "a"), (23, "x " * 400, "b"), (24, many.upper(), "b"), (25, "tab\tand\x0bline\x0c" * 100, "")]
    frame = awkward.select("doc_id", "text", F.col("lang").alias("source"), "kept").unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    frame = frame.withColumn("mask", F.lit("clash")).withColumn("copies", F.lit(7)).withColumn("words", F.lit(1)).withColumn("part", F.lit(2.0))
    labels = [(1, 1, 0), (2, None, 1), (20, 1, None), (20, 0, 1), (22, 1, 1), (None, 1, 1), (21, 1, 0), (999, 1, 1)]
    marked = spark.createDataFrame([(*x, "m", "p") for x in labels], LABELS)
    rows = [(r.doc_id, r.text, r.source) for r in frame.collect()]
    assert got(audit.interactions(frame, marked)) == walked(rows, labels)


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], LABELS)
    assert audit.interactions(nothing.withColumn("source", F.col("lang")), labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    found = got(audit.interactions(one, labels))
    assert len(found) == 600 and {k[0] for k in found} == {""}


def test_a_level_for_each_step(spark):
    counts = spark.createDataFrame([("p", [1] * 32, [0] * 32, [0] * 32)], "part string, n array<long>, good array<long>, toxic array<long>")
    found = audit.levels(counts)
    assert {r.step: r["count"] for r in found.groupBy("step").count().collect()} == {1: 5, 2: 20, 3: 60, 4: 120, 5: 120}
    # of 32 masks each once, a filter fails 16; over all orders a mask of k filters gives each of them 120 / k removals
    row = found.filter("prefix = 'A'").first()
    assert (row.kept, row.removed, row.redundant, row.unique_fails) == (16, 16, 0, 1)
    by_closed_form = sum(120 / bin(m).count("1") for m in range(32) if m & 1)
    assert found.filter("letter = 'A'").agg(F.sum(F.col("removed") * F.factorial(5 - F.col("step")))).first()[0] == pytest.approx(by_closed_form)
