"""Putting a document's parts together, and the guard that compares its summary with two sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.operators import validate


def assemble_document(catalogue: DataFrame, parts: dict[str, DataFrame], by: str = "doc_id") -> DataFrame:
    """A catalogue with one struct per part (a table with one row per document), null where a document lacks it."""
    packed = ((name, df.select(by, F.struct(*[c for c in df.columns if c != by]).alias(name))) for name, df in parts.items())
    return reduce(lambda a, b: a.join(b[1], by, "left"), packed, catalogue)


def two_source_deviation(terms: DataFrame, ocr: DataFrame, refined: DataFrame) -> DataFrame:
    """Terms (doc_id, term) with their deviation from the OCR text and from the refined one, which the OCR text stands in for."""
    joined = terms.join(ocr.select("doc_id", F.col("text").alias("ocr_text")), "doc_id", "left").join(refined.select("doc_id", F.col("text").alias("refined_text")), "doc_id", "left")
    first = validate.term_deviation(joined.withColumn("refined_text", F.coalesce("refined_text", "ocr_text")), "ocr_text").withColumnRenamed("deviation", "deviation_ocr")
    return validate.term_deviation(first, "refined_text").withColumnRenamed("deviation", "deviation_refined").drop("ocr_text", "refined_text")


def guard_route(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that the deviation gate flagged: those to review, and the audit rows about them."""
    flagged = gated.filter("flagged")
    log = flagged.select(F.col("doc_id").cast("string").alias("document_id"), F.lit("system").alias("user_id"), F.lit("OCR_GUARD").alias("change_type"), F.lit(None).cast("string").alias("before_state"), F.to_json(F.struct("max_deviation", "terms")).alias("after_state"), F.lit(None).cast("string").alias("metadata"))
    return flagged, log


def save_vectors(vectors: DataFrame, path: str) -> None:
    """A vector table with whatever columns describe its rows."""
    vectors.write.mode("overwrite").parquet(path)


def load_vectors(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def audit_union(*checks: DataFrame) -> DataFrame:
    """Rows of validation and of the guard in one list."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), checks)
