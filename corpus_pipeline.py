"""A corpus pipeline of four stages over ``documents``.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyframe.llm import packing, pii, quality, simhash
from polyframe.llm.common import Scratch, load

VOCABULARY = "word_bpe_49k.json"
#: Ids of documents to drop that are broadcast, at some 50 bytes each; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged."""
    scored = quality.score(docs, quality.fit(docs, load(spark, sf_dir, "labels")), docs.columns)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, unchanged.

    Of rows that repeat an id one stays; rows without an id belong to no group and all stay.
    Up to ``BROADCAST_IDS`` ids to drop, which are counted, go to all tasks and texts stay where
    they are; beyond that texts are shuffled once, against the hashed ids of a partition.
    """
    scratch = Scratch(spark, "dedup")
    found = scratch.keep(simhash.near_duplicates(docs).select("doc_id", "component_id"))
    gone = scratch.keep(found.where("doc_id is not null and doc_id != component_id").select("doc_id").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("shuffle_hash")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    order = Window.partitionBy("doc_id").orderBy(*(F.col(c) for c in docs.columns))
    once = kept.join(repeated, "doc_id", "left_semi").withColumn("__nth", F.row_number().over(order)).where("__nth = 1").select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(once)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by placeholders; n_chars follows the text."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", quality_filter), ("simhash", near_dedup), ("pii", redact_pii), ("packing", pack)]

#: SQL can express none of these stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)  # the next stage's table is written: nothing reads this one again
    return STAGES[-1][1](spark, docs, sf_dir)
