"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, secret scan, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. Empty tables give empty results; further columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolomill.llm import exact_dedup, language_id, minhash_dedup, packing, secret_scan
from rolomill.llm.common import stage

#: Documents whose likeliest language has a smaller share than this are rejected, as are those without a letter.
LEAST_SHARE = 0.5
#: Near copies are documents with at least this Jaccard similarity (or linked by such), in percent.
NEAR_PERCENT = 80


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null texts too) or without a main language and sets lang to the predicted language; each row is judged, whatever ids repeat.

    A table without any labelled text gives a model that knows no language: then all documents are rejected.
    """
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.keep_identified(docs, model, LEAST_SHARE)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, staged with an id of each row, and the id's column: repeated rows, null doc_ids and shared doc_ids can thus be told apart."""
    row = "row_id"
    while row in docs.columns:
        row += "_"
    return stage(docs.withColumn(row, F.monotonically_increasing_id())), row


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts: that with the largest doc_id (a null one is the smallest), of those the first."""
    d, row = numbered(docs)
    keyed = d.select(F.struct("doc_id", (-F.col(row)).alias("less")).alias("doc_id"), "text")
    drop = exact_dedup.exact_groups(keyed).where("not kept").select((-F.col("doc_id.less")).alias(row))
    return d.join(drop, row, "left_anti").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that with the smallest doc_id (a null one is the largest), of those the first."""
    d, row = numbered(docs)
    groups = minhash_dedup.near_groups(d, key=row, percent=NEAR_PERCENT).select(F.col("doc_id").alias(row), "component_id")
    groups = stage(groups.join(d.select(row, "doc_id"), row))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("first")
    kept = groups.groupBy("component_id").agg(first, F.count("*").alias("size")).where("size > 1").select("component_id", F.col(f"first.{row}").alias("kept_row"))
    drop = groups.join(kept, "component_id").where(F.col(row) != F.col("kept_row")).select(row)
    return d.join(drop, row, "left_anti").select(docs.columns)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by their kinds and sets n_chars anew; all rows stay, null texts as they are."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens; null texts count as empty, rows with shared or null ids are packed like others."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", by_language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("secret_scan", secrets_out), ("packing", packed)]
#: SQL can't express the learned language model or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, f) in enumerate(STAGES, 1):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stage(docs)
    return docs
