"""Writers: the daily export, its log and manifest, envelopes, summaries by role, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.privacy import mask_by_role, mask_patterns

CATEGORY_FOLDERS = ["ner", "layout", "summarization"]


def export_rows(rows: DataFrame, day: str) -> DataFrame:
    folder = F.when(F.col("category").isin(CATEGORY_FOLDERS), F.col("category")).otherwise("feedback")
    return rows.withColumn("export_date", F.lit(day)).withColumn("category", folder)


def write_export(rows: DataFrame, path: str, day: str) -> None:
    """One Parquet folder per date and category. Only the partitions that it writes are replaced, so a day can be run again.

    A large category is split over tasks by its size, a small one is one file.
    """
    out = export_rows(rows, day)
    out.hint("rebalance", "category").write.partitionBy("export_date", "category").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def export_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("record_count")).withColumn("status", F.when(F.col("record_count") > 0, "exported").otherwise("skipped"))


def append_log(summary: DataFrame, path: str, day: str) -> None:
    summary.withColumn("export_date", F.lit(day)).coalesce(1).write.mode("append").json(path)


def manifest(files: DataFrame, dataset_type: str) -> DataFrame:
    """One JSON value: type, count and the list of files."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("uri").alias("source"), "size", F.col("last_modified").cast("string").alias("last_modified"))))
    return files.agg(F.to_json(F.struct(F.lit(dataset_type).alias("type"), F.current_timestamp().cast("string").alias("created_at"), F.count("*").alias("count"), listed.alias("files"))).alias("value"))


def write_manifest(files: DataFrame, dataset_type: str, path: str) -> None:
    manifest(files, dataset_type).coalesce(1).write.mode("overwrite").text(path)


def audit_json(events: DataFrame, filter_text: str, most: int = 1000) -> DataFrame:
    """Filtered events as JSON values of at most ``most`` entries, newest first: document_id, part (from 0), value.

    A document's numbered parts are its whole log; most documents have one. Each value names the log's total. Entries are numbered
    in a sorted stream and gathered by part, so a document with very many events is in no row whole.
    """
    keys = ["timestamp", "audit_id", "user_id", "change_type", "before_state", "after_state", "metadata"]
    newest = Window.partitionBy("document_id").orderBy(F.desc("timestamp"), F.desc("audit_id"))
    numbered = events.select("document_id", *keys).withColumn("n", F.row_number().over(newest))
    parts = numbered.groupBy("document_id", F.floor((F.col("n") - 1) / most).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("n", F.struct(*keys).alias("e")))).alias("es"))
    totals = events.groupBy("document_id").agg(F.count("*").alias("total"))
    value = F.to_json(F.struct(F.lit(filter_text).alias("filter"), F.col("t.total").alias("total_entries"), F.transform("es", lambda x: x.e).alias("audit_entries")))
    return parts.alias("p").join(totals.alias("t"), F.col("p.document_id").eqNullSafe(F.col("t.document_id"))).select("p.document_id", "part", value.alias("value"))


def envelope(document: Column, exported_at: Column, payload: Column, fmt: str = "json") -> Column:
    """The payload wrapped for a receiver; hl7_fhir adds the bundle's fields."""
    parts = [document.alias("document_id"), exported_at.alias("exported_at"), F.lit(fmt).alias("format"), payload.alias("payload")]
    if fmt == "hl7_fhir":
        parts += [F.lit("Bundle").alias("resourceType"), F.lit("collection").alias("type")]
    return F.to_json(F.struct(*parts))


def masked_summaries(summaries: DataFrame) -> DataFrame:
    """Summaries by role; only clinicians see them unmasked."""
    masked = lambda c: F.when(F.col("role") == "clinician", F.col(c)).otherwise(F.transform(c, lambda x: mask_patterns(x)))
    lists = {c: masked(c) for c in ("key_points", "diagnoses", "follow_up_actions") if c in summaries.columns}
    return summaries.withColumns({"summary": mask_by_role(F.col("role"), F.col("summary"))} | lists)


def write_role_summaries(summaries: DataFrame, path: str) -> None:
    masked_summaries(summaries).write.partitionBy("role").mode("overwrite").parquet(path)


def fan_out(routed: DataFrame, paths: dict[str, list[str]]) -> None:
    """Each route's rows to all of its folders; the rows are computed once."""
    kept = routed.persist()
    try:
        for route, targets in paths.items():
            for target in targets:
                kept.filter(F.col("route") == route).write.mode("append").parquet(target)
    finally:
        kept.unpersist()
