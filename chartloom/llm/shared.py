"""What the operators of this subpackage share: tables, the shared folder, files that executors write."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors see.

    Only where that setting is missing and Spark runs in one process (tests) a temporary folder stands in for it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chartloom/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder, read again: it survives lost executors and cuts the lineage."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """A table that ``written`` made, or a part of it, to be broadcast if its files are of ``most`` bytes at most."""
    spark, size = df.sparkSession, 0
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return F.broadcast(df) if size <= most else df


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder's address, for tasks that write or read files of their own format."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of ``column``, so that a task's memory doesn't follow row sizes."""
    for batch in batches:
        at, held = 0, 0
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist() if batch.num_rows else []
        for i, size in enumerate(sizes):
            held += size or 0
            if held >= most:
                yield batch.slice(at, i + 1 - at)
                at, held = i + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)


def bounded(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """The same rows, for a pass through Python: its session sends Arrow batches of about ``most`` bytes at most from now on."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if int(conf.get(name).removesuffix("b")) > most:
        conf.set(name, str(most))
    return df


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)
