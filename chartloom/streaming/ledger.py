"""Exactly-once tables of a stream: a folder per run and batch that a repeated batch replaces, and a ledger of finished batches.

A batch writes its rows to each table and then its line of the ledger. Readers see the rows of batches in the ledger only, so a
batch that failed between two tables is invisible; run again it replaces what it wrote, and a batch that is in the ledger
writes nothing. A run is a stream's checkpoint: the same one after a restart, another one after a new beginning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.sources.scratch import exists

_BATCH = T.StructType([T.StructField("tables", T.ArrayType(T.StringType())), T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])


def _run_of(spark: SparkSession) -> str:
    """The id of the stream that calls, which its checkpoint keeps."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def write_batch(spark: SparkSession, outputs: dict[str, DataFrame], ledger: str, batch: int) -> bool:
    """Write a batch's rows by table; False if it was finished before."""
    part = f"run={_run_of(spark)}/batch={batch}"
    if exists(spark, f"{ledger}/{part}/_SUCCESS"):
        return False
    for path, rows in outputs.items():
        rows.write.mode("overwrite").parquet(f"{path}/{part}")
    spark.createDataFrame([(sorted(outputs),)], "tables array<string>").coalesce(1).write.mode("overwrite").parquet(f"{ledger}/{part}")
    return True


def exactly_once(outputs: Callable[[DataFrame, int], dict[str, DataFrame]], ledger: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``track_stream``: the batch's rows by table, kept while they are written."""

    def sink(df: DataFrame, n: int) -> None:
        kept = df.persist()
        try:
            write_batch(kept.sparkSession, outputs(kept, n), ledger, n)
        finally:
            kept.unpersist()

    return sink


def finished_batches(spark: SparkSession, ledger: str) -> DataFrame:
    """run and batch of all finished batches."""
    return spark.read.schema(_BATCH).option("basePath", ledger).parquet(ledger).select("run", "batch")


def read_finished(spark: SparkSession, path: str, ledger: str) -> DataFrame:
    """A table's rows of finished batches, without their run and batch. Batches without rows have files with a schema."""
    rows = spark.read.option("basePath", path).parquet(path).withColumns({"run": F.col("run").cast("string"), "batch": F.col("batch").cast("long")})
    return rows.join(finished_batches(spark, ledger), ["run", "batch"], "left_semi").drop("run", "batch")
