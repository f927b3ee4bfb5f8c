"""Tables that are merged into: a merge rewrites the parts that it touches and is seen whole or not at all.

Rows are dealt into a fixed number of parts by a hash of their key. A merge writes new files of the parts that its changes fall into and
then a manifest that names each part's current files; readers follow the newest finished manifest. A merge that failed before
its manifest leaves no trace, and a batch that a manifest names isn't merged again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.sources.scratch import exists

_MANIFEST = "part int, generation long, batch string, n long"


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    """Finished manifests: a row per part, and a batch's row without a part."""
    if not exists(spark, f"{path}/manifests"):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifests")


def _newest(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The newest manifest's number and each part's generation: at most as many rows as there are parts."""
    n = _manifests(spark, path).agg(F.max("n")).first()[0]
    if n is None:
        return -1, {}
    return n, {r.part: r.generation for r in _manifests(spark, path).filter((F.col("n") == n) & F.col("part").isNotNull()).collect()}


def read_current(spark: SparkSession, path: str, schema: str, parts: set[int] | None = None) -> DataFrame:
    """The current rows, or those of some parts."""
    files = [f"{path}/data/generation={g}/part={p}" for p, g in _newest(spark, path)[1].items() if parts is None or p in parts]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def merge(spark: SparkSession, path: str, schema: str, key: str, changes: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], batch: str, parts: int = 64) -> bool:
    """Replace the parts that ``changes`` fall into by ``merged(current rows of them, changes)``; False if the batch was merged before."""
    if _manifests(spark, path).filter(F.col("batch") == batch).limit(1).count():
        return False
    n, current = _newest(spark, path)
    touched = {r.part for r in changes.select(part_of(key, parts).alias("part")).distinct().collect()}  # at most ``parts`` rows
    rows = merged(read_current(spark, path, schema, touched), changes).withColumn("part", part_of(key, parts))
    rows.repartition(max(1, len(touched)), "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/generation={n + 1}")
    new = [(p, g) for p, g in current.items() if p not in touched] + [(p, n + 1) for p in touched if exists(spark, f"{path}/data/generation={n + 1}/part={p}")]
    manifest = spark.createDataFrame([(p, g, None, n + 1) for p, g in new] + [(None, None, batch, n + 1)], _MANIFEST)
    manifest.coalesce(1).write.mode("append").parquet(f"{path}/manifests")
    return True
