"""The registered query of each operator: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, lang_kernel, merge_replay, near_dedup, packing, pii, pseudo_lm, syncmers, token_store, url_rules


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.production_rules())


def op5_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return merge_replay.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


#: Of the registered query and the pipeline. Whoever publishes results keeps a key of their own.
PII_KEY = "public demonstration key"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.pseudonymize(docs.select("doc_id", "text"), PII_KEY).select("doc_id", "text", "n_entities", "entities")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)


def op9_lang_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_kernel.identify(table(spark, sf_dir, "documents"))


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nn_descent": op1_nn_descent,
    "op2_token_store": op2_token_store,
    "op3_near_dedup": op3_near_dedup,
    "op4_url_rules": op4_url_rules,
    "op5_merge_replay": op5_merge_replay,
    "op6_pseudo_likelihood": op6_pseudo_likelihood,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_lang_kernel": op9_lang_kernel,
    "op10_syncmers": op10_syncmers,
}

ORACLES: dict[str, str] = {"op3_near_dedup": near_dedup.oracle(3, 85), "op4_url_rules": url_rules.oracle()}
