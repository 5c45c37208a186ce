"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import fill_middle, hard_negatives, html_extract, licences, mixing, neardup, packing, pii, quality, spotsigs, substrings, token_counts, top_k
from auditloom.llm.common import table


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, notices = (licences.registry(spark, x) for x in (licences.LICENCES, licences.NOTICES))
    return licences.scan(table(spark, sf_dir, "documents"), known, notices)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.cut(table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_licence_scan, op2_html_extraction, op3_mixing, op4_packing, op5_token_counts, op6_minhash, op7_spotsigs, op8_suffix_dedup, op9_quality_rules, op10_pii, op11_fill_middle, op12_hard_negatives, op13_top_k]
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licence_scan": licences.sql(),
        "op7_spotsigs": spotsigs.SQL,
        "op9_quality_rules": quality.SQL,
        "op11_fill_middle": fill_middle.SQL,
        "op12_hard_negatives": hard_negatives.SQL,
        "op13_top_k": top_k.SQL,
    }
