"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents its predecessor kept and returns documents; the last one
returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import cotraining, credentials, decontamination, jaccard, packing
from lamella.llm.common import counted, distinct_labels, joined_hot, stored, table, tuned

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers score as good."""
    labels = distinct_labels(table(spark, sf_dir, "labels"), "quality")
    scored = cotraining.quality_scores(docs, labels, carry=COLUMNS[1:])
    return scored.where(F.col("score") >= cotraining.KEEP).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``_key`` of its own for every text of an id that comes several times.

    The greatest text of such an id keeps the id, so that no null or empty one takes the
    place of a real one; its other texts get keys beyond all ids, equal ones one key. Those
    without a word say nothing beside it and go.
    """
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = counted(ids.where("n > 1").select("doc_id"), "repeated")
    if not repeated.n_rows:
        return docs.withColumn("_key", F.col("doc_id"))
    rest = F.min(F.struct(*COLUMNS[2:])).alias("_rest")
    several = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(rest)
    several = stored(several.withColumn("_at", F.monotonically_increasing_id()), "several")
    first = several.groupBy("doc_id").agg(F.max("text").alias("_first"))
    beyond = docs.agg(F.max("doc_id").alias("most")).first()["most"] + 1
    own = F.col("text").eqNullSafe(F.col("_first"))
    texts = joined_hot(several, first, "doc_id").where(own | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    key = F.when(own, F.col("doc_id")).otherwise(F.col("_at") + F.lit(beyond))
    named = texts.select("doc_id", "text", *[F.col("_rest")[c].alias(c) for c in COLUMNS[2:]], key.alias("_key"))
    return stored(docs.join(repeated, "doc_id", "left_anti").withColumn("_key", F.col("doc_id")).unionByName(named), "keyed")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group: the one with the least id.

    Different texts of one id are documents of their own here: each stays unless it equals
    or links with one that does. Rows without an id cannot be grouped and stay.
    """
    own = keyed(docs.select(*COLUMNS))
    groups = jaccard.jaccard_components(own, id_col="_key")
    copies = counted(groups.where(F.col("_key") != F.col("component_id")).select(F.col("_key").alias("id")), "copies")
    # Only documents that may be copies are joined and shuffled.
    marked = jaccard.with_maybe(own, copies, "_key", copies.n_rows)
    rest = marked.where("_maybe").join(copies.withColumnRenamed("id", "_key"), "_key", "left_anti")
    return marked.where("NOT _maybe").select(*COLUMNS).unionByName(rest.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    leaks = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:])
    return leaks.where("n_hit = 0").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret and ``n_chars`` of the new text."""
    clean = credentials.redact_secrets(docs, carry=COLUMNS[2:])
    changed = F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("bigint"))
    return clean.withColumn("n_chars", changed).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences of several sizes."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack_sequences),
]

#: Trained models, tokens and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder; each stage's documents are stored."""
    docs = table(tuned(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
