"""How tables lie on disk: buckets and order by the key that they are looked up by, partitions by day where ranges of time are read.

A lookup by key then reads one bucket, a range of days reads their partitions, and grouping or windows by the key need no shuffle.
An index with another key is a second table with all columns.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.sources import schemas


class Layout(NamedTuple):
    schema: str
    key: str
    order: tuple[str, ...]
    #: The time whose UTC day is the partition; none for tables that are read by key alone.
    time: str | None = None


#: Tables, the key that each is looked up by, and the order of its rows under a key.
LAYOUTS = {
    "documents": Layout(schemas.DOCUMENTS, "document_id", ("document_id",)),
    "audit_logs": Layout(schemas.AUDIT_LOGS, "document_id", ("document_id", "timestamp"), "timestamp"),
    "audit_logs_by_user": Layout(schemas.AUDIT_LOGS, "user_id", ("user_id", "timestamp"), "timestamp"),
    "audit": Layout(schemas.AUDIT, "audit_id", ("audit_id",)),
    "audit_document_index": Layout(schemas.AUDIT, "document_id", ("document_id", "timestamp")),
    "audit_user_index": Layout(schemas.AUDIT, "user_id", ("user_id", "timestamp")),
    "user_sessions": Layout(schemas.USER_SESSIONS, "user_id", ("user_id", "login")),
    "feedback_loop": Layout(schemas.FEEDBACK_LOOP, "document_id", ("document_id", "timestamp"), "timestamp"),
}


def conformed(df: DataFrame, layout: Layout) -> DataFrame:
    """The layout's columns in its types, and ``day`` where it has partitions."""
    given = df.to(df.sparkSession.createDataFrame([], layout.schema).schema)
    return given.withColumn("day", F.substring(F.col(layout.time), 1, 10)) if layout.time else given


def write_layout(df: DataFrame, name: str, table: str, path: str, buckets: int) -> DataFrame:
    """Write a table in its layout, registered as ``table``. Rows are dealt by the key once, so that each bucket of a day is one file."""
    layout = LAYOUTS[name]
    out = conformed(df, layout).repartition(buckets, layout.key).write.bucketBy(buckets, layout.key).sortBy(*layout.order).option("path", path)
    (out.partitionBy("day") if layout.time else out).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def open_layout(spark: SparkSession, name: str, table: str, path: str, buckets: int) -> DataFrame:
    """Register a table that was written before, in this session's catalog."""
    layout = LAYOUTS[name]
    day, parts = (", day string", " PARTITIONED BY (day)") if layout.time else ("", "")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({layout.schema}{day}) USING parquet{parts} CLUSTERED BY ({layout.key}) SORTED BY ({', '.join(layout.order)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    if layout.time:
        spark.sql(f"MSCK REPAIR TABLE {table}")
    return spark.table(table)


def between_days(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the partitions that hold times from ``start`` to ``end``."""
    return df.filter(F.col("day").between(start[:10], end[:10]))
