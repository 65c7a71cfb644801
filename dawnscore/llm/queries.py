"""The registered queries of this package: op<N>_<name>, pipeline, and check SQL where there is one."""
from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnscore.llm.byte_bpe import round_trip
from dawnscore.llm.common import table
from dawnscore.llm.conversation_repair import repair_report
from dawnscore.llm.decontaminate import leaks
from dawnscore.llm.hosts import filter_urls
from dawnscore.llm.hosts import oracle_sql as host_sql
from dawnscore.llm.language import predict
from dawnscore.llm.near_dup import near_duplicates
from dawnscore.llm.near_dup import oracle_sql as near_dup_sql
from dawnscore.llm.personal import personal_data
from dawnscore.llm.pseudo_likelihood import score
from dawnscore.llm.quality_model import quality
from dawnscore.llm.repair import read_shards, write_shards
from dawnscore.llm.repetition import oracle_sql as repetition_sql
from dawnscore.llm.repetition import repetition
from dawnscore.llm.secrets import oracle_sql as secret_sql
from dawnscore.llm.secrets import secret_scan
from dawnscore.llm.target_weights import resample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = repetition(table(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (facts.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~F.col("repeats"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "dup_line_chars", "covered_5", "covered_10"))


ORACLE["op1_repetition_coverage"] = repetition_sql()


@query
def op8_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op8_tensored_minhash"] = near_dup_sql()


@query
def op6_bm25_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live")


@query
def op9_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query
def op2_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents")))


@query
def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE["op10_host_reputation"] = host_sql()


@query
def op5_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))


ORACLE["op3_ownership_secrets"] = secret_sql()


@query
def op7_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("found")


@query
def op4_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


@query
def op13_interval_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


@query
def op12_head_tail_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_naive_bayes_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
