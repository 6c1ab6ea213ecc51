"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import lookup_join, staged


def components(links: DataFrame) -> DataFrame:
    """id, class_id (the smallest id of the component) for each id in links(a, b).

    In each round every node points to its smallest neighbour or itself, and links are carried over to the nodes pointed
    to, until none is left; the rounds grow with the logarithm of the longest path. A node with many links is
    pre-aggregated before each shuffle and met through a counted broadcast or a salted join.
    """
    edges = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = staged(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("to")), "parents")
        rounds.append(to)
        half = lookup_join(edges, to.withColumnsRenamed({"id": "a", "to": "ta"}), ["a"], "inner", ["b"])
        moved = lookup_join(half, to.withColumnsRenamed({"id": "b", "to": "tb"}), ["b"], "inner", ["a"])
        edges = staged(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a < b").distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("a").alias("class_id")).limit(0)
    found = rounds[0].select("id", F.col("to").alias("class_id"))
    for to in rounds[1:]:
        step = lookup_join(found, to.withColumnsRenamed({"id": "class_id"}), ["class_id"], "left", ["id"])
        found = step.select("id", F.coalesce("to", "class_id").alias("class_id"))
    return staged(found, "components")
