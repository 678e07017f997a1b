"""Documents to packed training sequences: language, near duplicates, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm import lang_kernel, near_dedup, packing, pii
from ashlar.llm.queries import PII_KEY, tokenizer
from ashlar.llm.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and in one of the languages that the model learns from their labels.

    Texts that are null, empty or without letters go, and all if no text is labelled; repeated rows are treated alike;
    an empty table stays empty; other columns, whatever their names, stay as they are.
    """
    return lang_kernel.in_known_languages(docs, lang_kernel.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, that with the least doc_id.

    Texts that are null or without words are linked with nothing and stay, as do rows without a doc_id; rows that share
    the doc_id that stays all stay; an empty table stays empty; other columns stay as they are.
    """
    return near_dedup.without_near_duplicates(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data and secrets, and n_chars of the new texts.

    Null and empty texts and their n_chars stay as they are; repeated rows are treated alike; an empty table stays
    empty; columns named as the operator's own results are replaced by nothing: all columns of the input stay.
    """
    columns = docs.columns
    marked = docs.toDF(*(c if c in ("text", "n_chars") else f"c{k}" for k, c in enumerate(columns)))
    out = pii.pseudonymize(marked, PII_KEY)
    changed = F.col("n_entities") > 0
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*marked.columns).toDF(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens.

    A null text is the empty one, which has the end id only; rows with equal or null ids stay apart; an empty table has
    no pieces; other columns are ignored.
    """
    return packing.pack(spark, docs, tokenizer("byte_bpe_50k.json"), end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: No SQL expresses the language model, the surrogates or the packing; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
