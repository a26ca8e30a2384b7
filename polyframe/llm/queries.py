"""Queries of this subpackage for the registry: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, hnsw, licenses, media, packing, pii, quality, simhash, urls
from .common import load
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

VOCABULARY = "word_bpe_49k.json"


def op1_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(load(spark, sf_dir, "embeddings"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures: each row of ``embeddings`` is rendered as one."""
    return media.copies(media.rendered(load(spark, sf_dir, "embeddings")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(load(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(load(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


#: A conversation whose texts hold control strings; the registered query formats it with the table's.
CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(1).select(F.inline(F.array(*(F.struct(*map(F.lit, t)) for t in CONTROL_TURNS)))).toDF(*turns.columns)
    return chat.read_digests(chat.format_turns(turns.union(control)))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hnsw_near_dedup,
        op2_simhash_near_dedup,
        op3_license_scans,
        op4_media_columns,
        op5_packing,
        op6_bpe,
        op7_quality_classifier,
        op8_chat_formatting,
        op9_url_filters,
        op10_pii,
    )
}
