"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonorisk.llm import oracles
from sonorisk.llm.common import table
from sonorisk.plans.registry import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return run

    return add


@query("op2_interleaved_shards", oracles.SHARDS)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from sonorisk.llm.sharding import interleaved_shards

    return interleaved_shards(table(spark, sf, "documents"), n_shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


@query("op8_secret_ownership", oracles.SECRETS)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from sonorisk.llm.secrets import digests, find_secrets

    return digests(find_secrets(table(spark, sf, "documents"))).select("doc.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")


@query("op10_host_reputation", oracles.URLS)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from sonorisk.llm.url_filter import judge_urls

    outcomes = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return judge_urls(table(spark, sf, "pages"), outcomes, oracles.URL_RULES).select("doc.page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad")


@query("op1_host_quality", oracles.QUALITY)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from sonorisk.llm.host_quality import COUNTS, judge_documents

    return judge_documents(table(spark, sf, "documents")).select("doc.doc_id", *COUNTS, "base_failed", "kept")


@query("op3_wu_manber", oracles.DECONTAMINATION)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from sonorisk.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op9_bpe")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from sonorisk.llm.bpe import encode_documents

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN).select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op4_toxicity_neighbours")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from sonorisk.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).select("doc.doc_id", "held_out", "score", "predicted", "evidence")


@query("op6_main_text")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from sonorisk.llm.html_text import extract_main_text

    return extract_main_text(table(spark, sf, "pages")).select("doc.page_id", "doc.url", "text", "n_chars")


@query("op5_count_min_repeats", oracles.REPEATS)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from sonorisk.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf, "documents")).select("doc.doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_prob_minhash")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from sonorisk.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf, "documents")).select("doc.doc_id", "class_id", "is_first")


@query("op11_whitening")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from sonorisk.llm.whitening import whiten

    return whiten(table(spark, sf, "embeddings")).select("doc.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query("op12_spelling_variants", oracles.SPELLING)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from sonorisk.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf, "documents"))


@query("op13_divide_skip", oracles.OVERLAP)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from sonorisk.llm.overlap_join import overlap_components

    return overlap_components(table(spark, sf, "documents")).select("doc.doc_id", "n_shingles", "component_id")
