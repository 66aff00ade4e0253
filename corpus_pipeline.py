"""Document cleaning from end to end: toxicity, near-duplicates, benchmark passages, secrets, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sonorisk.llm.bpe import encode_documents
from sonorisk.llm.common import table
from sonorisk.llm.decontaminate import find_contamination
from sonorisk.llm.near_dups import deduplicate
from sonorisk.llm.secrets import find_secrets, masked
from sonorisk.llm.toxicity import score_toxicity
from sonorisk.plans.registry import ship_package
from sonorisk.scale import shared_path

RANKS = "byte_bpe_multi_50k.tiktoken"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer predicts toxic go."""
    ship_package(spark)
    return score_toxicity(docs, table(spark, sf_dir, "labels"), keep=None).filter("predicted = 0").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of least id."""
    ship_package(spark)
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    ship_package(spark)
    return find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=None).filter("n_hit = 0").select("doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret spans are masked, and ``n_chars`` follows where a text changed."""
    ship_package(spark)
    found = find_secrets(docs, keep=None)
    text = masked(F.col("doc.text"), F.col("spans"))
    changed = {"text": text} | ({"n_chars": F.when(F.size("spans") > 0, F.char_length(text)).otherwise(F.col("doc.n_chars"))} if "n_chars" in docs.columns else {})
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"doc.`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    ship_package(spark)
    return encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("token_ids", token_ids)]
#: Neither the learned scorer nor the components of links can be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
