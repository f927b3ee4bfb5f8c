"""Token ids as flat files of unsigned integers, with 64-bit document offsets, read through memory maps.

Documents are range-partitioned by doc_id and sorted; each task encodes its part and writes three flat files: the ids
(16 bits where the vocabulary allows, else 32), the document offsets within the part (unsigned 64 bits, one more than
there are documents) and the doc_ids (64 bits). A table of parts keeps names and counts; the place of a part in the whole
corpus is the prefix sum of the counts before it. Names hold the task attempt, and only parts that a finished task
reported are listed, so lost executors and repeated tasks leave no trace in the result.

Edge cases: a null text is written as the end id alone; a null doc_id comes first, stored as the smallest 64-bit number and read
back as null; rows that share a doc_id keep one entry each, in order of a hash of their texts, by which they are also dealt to
ranges, so that a frequent id fills no single task unless its texts are equal; a table without rows gives no parts; extra
columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.pieces import spaced_encoder
from chartloom.llm.shared import batch_of, blocks, bounded, filesystem, new_folder, written

_PART = pa.schema([("part", pa.int64()), ("name", pa.string()), ("width", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first_doc", pa.int64())])
_NULL_ID = -(1 << 63)
_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def id_width(vocabulary: str, end_id: int) -> int:
    """Bytes that hold every id of a tokenizer's file, and the end id."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    return 2 if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", [])), end_id]) < 1 << 16 else 4


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2) -> DataFrame:
    """Write the files into ``folder`` and return the table of parts (part, name, width, docs, tokens, first_doc)."""
    width = id_width(vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = filesystem(folder)
        name, encoder = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", spaced_encoder(vocabulary)
        ids, offsets, tokens, first = None, [np.zeros(1, "<u8")], 0, None
        for block in blocks(batches, "text", 4 << 20):
            if ids is None:
                fs.create_dir(base, recursive=True)
                ids, keys = fs.open_output_stream(f"{base}/{name}.ids"), fs.open_output_stream(f"{base}/{name}.docs")
            found, counts = encoder.encode(block["text"])
            ids.write(np.insert(found, np.cumsum(counts), end_id).astype(f"<u{width}").tobytes())
            keys.write(block["doc_id"].to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            offsets.append((tokens + np.cumsum(counts + 1)).astype("<u8"))
            tokens, first = int(offsets[-1][-1]), block["doc_id"][0].as_py() if first is None else first
        if ids is None:
            return
        for f in (ids, keys):
            f.close()
        ends = np.concatenate(offsets)
        with fs.open_output_stream(f"{base}/{name}.offsets") as f:
            f.write(ends.tobytes())
        yield batch_of(_PART, {"part": [task.partitionId()], "name": [name], "width": [width], "docs": [len(ends) - 1], "tokens": [tokens], "first_doc": [first]})

    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col("text").cast("string"))
    ordered = given.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return written(bounded(ordered).mapInArrow(run, "part long, name string, width int, docs long, tokens long, first_doc long"), "parts")


def with_bases(parts: DataFrame) -> DataFrame:
    """Add to each part the number of tokens and of documents before it. One small row per file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("token_base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("doc_base", F.coalesce(F.sum("docs").over(before), F.lit(0)))


def _mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A memory map where the folder is a mounted one, else the file's bytes."""
    if fs.get_file_info(path).size == 0:
        return np.empty(0, kind)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def read_tokens(parts: DataFrame, folder: str) -> DataFrame:
    """Read the files back: doc_id, start (tokens of the corpus before it), n_tokens, ids_crc32 (of the ids as uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids = _mapped(fs, f"{base}/{row['name']}.ids", f"<u{row['width']}")
                ends, keys = _mapped(fs, f"{base}/{row['name']}.offsets", "<u8").astype(np.int64), _mapped(fs, f"{base}/{row['name']}.docs", "<i8")
                for at in range(0, len(keys), 8192):
                    cut = ends[at : at + 8193]
                    crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(cut, cut[1:], strict=False)]
                    yield batch_of(_DOC, {"doc_id": keys[at : at + 8192].copy(), "start": cut[:-1] + row["token_base"], "n_tokens": np.diff(cut), "ids_crc32": crcs})

    based = with_bases(parts)
    n = max(1, parts.count())
    found = based.repartition(n, F.rand(7)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")))


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write, then read back what was written."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, vocabulary, folder, end_id), folder)
