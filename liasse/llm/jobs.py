"""The registered query of each operator, on its whole intended table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from liasse.llm import alignment, bpe, decontam, digest, html, licenses, minhash, oracles, phrases, quality, rules, secrets, sharding, toxicity
from liasse.session import spread

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ALIGNED_A, ALIGNED_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def op1_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.report(_table(spark, d, "documents"))


def op2_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.report(_table(spark, d, "documents"))


def op3_minhash(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, d, "documents")).drop("text_key")


def op4_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.classified(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op5_bpe(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    return bpe.digests(bpe.round_trip(_table(spark, d, "documents").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN))


def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.report(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


def op7_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.report(_table(spark, d, "documents"))


def rule_ablations(spark: SparkSession, d: str) -> DataFrame:
    return rules.ablations(rules.ledger(_table(spark, d, "documents").select("text"), []))


def op8_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.report(_table(spark, d, "documents"))


def op9_html(spark: SparkSession, d: str) -> DataFrame:
    return html.report(_table(spark, d, "pages"))


def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.classified(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op11_phrases(spark: SparkSession, d: str) -> DataFrame:
    return phrases.collocations(_table(spark, d, "documents"))


def op12_digest(spark: SparkSession, d: str) -> DataFrame:
    return digest.compared_with_next(_table(spark, d, "documents"))


def op13_alignment(spark: SparkSession, d: str) -> DataFrame:
    models = (alignment.read_model(public_tokenizers.path(name)) for name in (ALIGNED_A, ALIGNED_B))
    return alignment.report(_table(spark, d, "documents"), *models)


QUERIES = {f.__name__: f for f in (op1_secrets, op2_licenses, op3_minhash, op4_quality, op5_bpe, op6_decontamination, op7_rules,
                                   op8_sharding, op9_html, op10_toxicity, op11_phrases, op12_digest, op13_alignment,
                                   rule_ablations)}
ORACLE = oracles.ORACLE
