"""One thin query per operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, language, mixing, near_dedup, quality, sharding, site_tree, token_store, toxicity
from ._common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(language.document_evidence(table(spark, sf_dir, "documents")))


def op2_page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on raw pages, which declare a language and have an
    address: suffix, host and site are evidence too."""
    return language.identify(language.page_evidence(table(spark, sf_dir, "pages")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(table(spark, sf_dir, "pages"))


def op5_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_cnn, op2_language_evidence, op3_mixing, op4_site_tree, op5_subword_toxicity, op6_sharding, op7_circulant_minhash, op8_token_planes,
        op9_latent_decontamination, op10_exact_dedup, op2_page_evidence,
    )
}
QUERIES["pages_language"] = op2_page_evidence  # its name so far

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op6_sharding": sharding.ORACLE,
    "op7_circulant_minhash": near_dedup.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
