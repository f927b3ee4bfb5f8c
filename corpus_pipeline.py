"""A corpus from raw documents to packed training sequences: five stages, each one operator over all that is left.

Each stage takes (spark, docs, sf_dir), and all but the last return the columns of ``documents``. ``run`` writes each
stage's result as Parquet into the shared folder and reads it again as the next stage's input.

Null ids, null and empty texts, repeated rows, empty tables and other columns of any names are handled by every stage: a null id stays
unless its row is rejected by itself, a null or empty text has no language and goes in the first stage, rows that are equal are near
duplicates of each other and share an id, so they stay together, and an empty table leaves an empty one. Texts are read whole.

Documents that a stage rejects go by a filter, or by an anti join with the table of rejected ids, so that texts aren't
shuffled where that table is small enough for Spark to broadcast. Rows that share a doc_id stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import langid, linedup, packing, quality, simhash
from chartloom.llm.shared import table, written


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Documents but those whose every verdict (doc_id, kept) is false."""
    rejected = written(judged.groupBy(F.col("doc_id").alias("rejected_id")).agg(F.max("kept").alias("any_kept")).filter(~F.col("any_kept")), "rejected")
    given = docs.select(F.struct("*").alias("o"))
    return given.join(rejected, F.col("o.doc_id").cast("long").eqNullSafe(F.col("rejected_id")), "left_anti").select("o.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a text to judge, or without a language that is more likely than not, go."""
    return _without(docs, langid.identify(langid.document_evidence(docs)).withColumnRenamed("id", "doc_id"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or one of the rules learned from ``labels`` go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted; documents of which no word is left go."""
    own = {c: f"given_{c}" for c in docs.columns if c.startswith("removed_")}  # the operator has columns of such names
    left = linedup.dedup_lines(docs.withColumnsRenamed(own), min_words=50)
    gone = (F.col("removed_lines") > 0) & (F.btrim("text", F.lit(quality.SPACES)) == "")
    return left.filter(~gone).withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, and all rows of that id; a null id stays."""
    found = simhash.near_duplicates(docs, shingle=5, budget=4, similarity=0.8)
    return _without(docs, found.select("doc_id", (F.col("doc_id") <= F.col("component_id")).alias("kept")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens at most; a row per piece, whatever columns the documents have."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("language", language), ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: Learned models, suffix ranks and fingerprints aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
