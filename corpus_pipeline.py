"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage works on all rows that the one before it kept, and all but the last return the columns of documents. Rows are
carried through by joining decisions back to them by doc_id; a null id is kept by every filter but the quality score,
which judges its text like any other. Rows repeated with their id stay or go together; of texts that tie, the operator's
own rule says which stays; null texts count as empty; an empty table gives empty stages. Long texts are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import bpe_automaton, decontaminate, exact_dedup, order_minhash, quality
from strataflow.llm.common import lookup_join, shared_dir, staged, table, unused

#: Rows of dropped ids that are broadcast at most: the driver collects them, builds their table and serves it.
DROPPED_ROWS = 250_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in dropped(doc_id).

    Ids are met as bits of words of 64 neighbouring ids, a row a word: where ids are dense, what is broadcast has a row for
    64 documents, and never more rows than ids.
    """
    word, bits = (unused(n, docs) for n in ("_word", "_bits"))
    part, bit = (lambda v: F.shiftright(v, 6)), (lambda v: v.bitwiseAND(63).cast("int"))
    own, gone = F.col("doc_id").cast("long"), F.col("doc_id").cast("long")
    ids = dropped.filter("doc_id is not null").groupBy(part(gone).alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(gone))).alias(bits))
    met = lookup_join(docs.withColumn(word, part(own)), staged(ids, "dropped"), [word], "left", ["doc_id"], most=DROPPED_ROWS)
    kept = F.col(bits).isNull() | (F.call_function("shiftright", F.col(bits), bit(own)).bitwiseAND(1) == 0)
    return met.filter(kept).select(*(F.col(f"`{c}`") for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts (score of 0.5 or more). Rows that share an id go only if all are rejected."""
    scores = staged(quality.quality_scores(docs, table(spark, sf_dir, "labels")), "pipeline-quality")
    verdict = scores.groupBy("doc_id").agg(F.max("predicted").alias("best")).filter("best = 0").select("doc_id")
    return without(docs, verdict)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest id; rows repeated with that id all stay."""
    groups = exact_dedup.exact_groups(docs)
    return without(docs, groups.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id."""
    classes = order_minhash.near_classes(docs)
    return without(docs, classes.filter("not kept").select("doc_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, by the automaton."""
    return bpe_automaton.digests(bpe_automaton.encode_documents(docs, bpe_automaton.vocabulary(), decode=True))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("bpe encoding", encoding_stage),
]

#: SQL cannot express the classifier, the sketches and the encoding; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
