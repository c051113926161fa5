"""The corpus operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat_format import chat_format
from .common import table
from .embedding_dedup import embedding_groups
from .license_scan import license_scan
from .lm_scoring import lm_scores
from .merkle import merkle_manifest
from .oracles import ORACLES
from .packing import pack
from .phrases import collocations
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .secret_scan import secret_scan
from .sentencepiece_nbest import encode_nbest
from .sharding import shard_map
from .simhash import simhash_groups


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_nbest(table(spark, sf_dir, "documents"), with_ids=False)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), with_text=False)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"), with_text=False)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_map(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_license_scan,
        op3_chat_format,
        op4_simhash_dedup,
        op5_embedding_dedup,
        op6_sentencepiece_nbest,
        op7_quality_rules,
        op8_packing,
        op9_secret_scan,
        op10_quality_classifier,
        op11_hilbert_shards,
        op12_collocations,
        op13_merkle_manifest,
    )
}
