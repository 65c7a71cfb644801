"""Corpus pipeline: quality rules, near-dedup, decontamination, secret scan, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. Rows without an id
pass every filter that needs one; rows that repeat an id pass or go together, except that of rows
kept by near-dedup one per id stays. Empty tables give empty tables. Each operator's docstring has
what null, empty and very long texts give.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dawnscore.llm.byte_bpe import round_trip
from dawnscore.llm.common import staged, table
from dawnscore.llm.decontaminate import leaks
from dawnscore.llm.near_dup import near_duplicates
from dawnscore.llm.repetition import repetition
from dawnscore.llm.secrets import redacted

BROADCAST_IDS = 1_000_000  # 8 MB of ids; with more, rows are shuffled to them


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not among ids (one column, `id`)."""
    ids = staged(ids.filter("id is not null").distinct(), "pipeline-ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == ids["id"], "left_anti").select(*(docs[c] for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with too few words, too many repeated words or too much repetition coverage."""
    facts = repetition(docs)
    failed = facts.filter((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
                          | F.col("repeats"))
    # a null id cannot be named in a list of ids: such rows are judged, but stay
    return _without(docs, failed.select(F.col("doc_id").alias("id")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, one row per id."""
    found = near_duplicates(docs)
    rest = _without(docs, found.filter(~F.col("kept")).select(F.col("doc_id").alias("id")))
    repeated = staged(found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
                      .filter("n > 1").select(F.col("doc_id").alias("id")), "pipeline-repeated")
    if repeated.limit(1).count() == 0:
        return rest
    again = rest.join(repeated, rest["doc_id"] == repeated["id"], "left_semi").withColumn(
        "_row", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())))
    return _without(rest, repeated).unionByName(again.filter("_row = 1").drop("_row"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(F.col("doc_id").alias("id")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; all documents stay."""
    return redacted(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what the other stages left."""
    return round_trip(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("byte_bpe", byte_bpe)]
# Rolling hashes, minhash tables and byte pair merges have no SQL form: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
