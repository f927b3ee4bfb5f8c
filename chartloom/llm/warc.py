"""Web archives: WARC files with revisit records, read back into a globally ordered capture index.

Write: pages join the first holder of their payload's digest, are sorted by URL key and time within each task, and each
task streams one archive of gzip members, so its own order is a sorted run. Read: each archive is streamed member by
member, payload digests are checked, and its captures go to a run file of index blocks.

Method (external index merge): run files are merged by a loser tree on (URL key, time, page id). Key ranges are cut at a
bounded sample of the keys; each task merges the part of every run that lies in its range, seeking by bisection over the
run's blocks and holding one block of each run. If there are more runs than ``fan_in``, groups of that many are merged into
longer runs first. The rows of range 0, 1, 2, ... in order of ``position`` are the capture histories in global order.

File names hold the task attempt, and only files that a finished task reported are read, so repeated tasks leave no trace.

Edge cases: a null html is an empty payload; a null url has the empty key; a null page_id is stored as the largest 64-bit
number and read back as null, so it is a response to a payload that no page with an id has, and never a target; rows that
repeat a response's page_id are responses as well; line breaks in a url are percent-encoded; payloads of any length are stored
whole; extra columns are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import calendar
import hashlib
import re
import time
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.shared import batch_of, bounded, filesystem, new_folder, written

_FILE = pa.schema([("name", pa.string()), ("records", pa.int64())])
_ENTRY = pa.schema(
    [("url_key", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("at", pa.int64())]
)
_INDEX = _ENTRY.append(pa.field("range_id", pa.int32())).append(pa.field("position", pa.int64()))
_INDEX_DDL = "url_key string, ts long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, at long, range_id int, position long"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLOCK = 2048
_NULL_ID = (1 << 63) - 1


def url_key(url):
    """Host labels from last to first, then path and query: pages of one site stand together."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\d*\.", "")
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(host == "", F.coalesce(url, F.lit(""))).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


def with_holders(captures: DataFrame, least: int = 100) -> DataFrame:
    """Add refers_to: the smallest page_id with the same payload, where that is another and the payload has ``least`` bytes."""
    hashed = captures.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "utf-8")).drop("html").withColumn("digest", F.sha2("payload", 256))
    shared = hashed.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return hashed.join(shared.select("digest", "first"), "digest", "left").withColumn("refers_to", F.when(F.col("first") < F.col("page_id"), F.col("first"))).drop("first")


def record(kind: str, page: int, url: str, ts: int, digest: str, size: int, payload: bytes, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {time.strftime('%Y-%m-%dT%H:%M:%SZ', time.gmtime(ts))}",
        f"WARC-Target-URI: {urllib.parse.quote(url, safe="/:?#[]@!$&'()*+,;=~|{}^")}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(payload)}",
    ]
    if refers is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def members(stream) -> Iterator[tuple[int, bytes]]:
    """Place and content of each gzip member of a stream."""
    at, held = 0, b""
    while held or (held := stream.read(1 << 20)):
        unzip, parts, size = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not held and not (held := stream.read(1 << 20)):
                raise ValueError("the archive ends within a record")
            parts.append(unzip.decompress(held))
            size += len(held)
            held = unzip.unused_data
        size -= len(held)
        yield at, b"".join(parts)
        at += size


def parsed(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what was written")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": int(fields["WARC-Record-ID"][10:-1]), "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": int(refers[10:-1]) if refers else None}


def write_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Write captures (page_id, url, url_key, ts, payload, digest, refers_to); returns the archives' names and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        name, out, n = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc.gz", None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            for r in batch.to_pylist():
                revisit = r["refers_to"] is not None
                data = record("revisit" if revisit else "response", r["page_id"], r["url"], r["ts"], r["digest"], len(r["payload"]), b"" if revisit else r["payload"], r["refers_to"])
                zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(zipped.compress(data) + zipped.flush())
                n += 1
        if out is not None:
            out.close()
            yield batch_of(_FILE, {"name": [name], "records": [n]})

    ordered = captures.select("page_id", "url", "url_key", "ts", "payload", "digest", "refers_to").sortWithinPartitions("url_key", "ts", "page_id")
    return written(bounded(ordered).mapInArrow(run, "name string, records long"), "archives")


class RunWriter:
    """Writes entries as blocks of an Arrow file."""

    def __init__(self, fs, path: str) -> None:
        self.out = fs.open_output_stream(path)
        self.file, self.rows, self.count = pa.ipc.new_file(self.out, _ENTRY), [], 0

    def add(self, row: dict) -> None:
        self.rows.append(row)
        self.count += 1
        if len(self.rows) == _BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.file.write_batch(pa.RecordBatch.from_pylist(self.rows, schema=_ENTRY))
            self.rows = []

    def close(self) -> None:
        self.flush()
        self.file.close()
        self.out.close()


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Read every archive and write its captures as a sorted run; returns the runs' names and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for name in (x for batch in batches for x in batch["name"].to_pylist()):
            run_name = f"run-{name}-{TaskContext.get().taskAttemptId()}"
            out, entries = RunWriter(fs, f"{base}/{run_name}"), []
            with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for at, data in members(stream):
                    head = data[: data.index(b"\r\n\r\n")].decode()
                    uri = urllib.parse.unquote(head.split("WARC-Target-URI: ")[1].split("\r\n")[0])
                    date = head.split("WARC-Date: ")[1].split("\r\n")[0]
                    entries.append(parsed(data) | {"url_key": surt(uri), "ts": int(calendar_seconds(date)), "archive": name, "at": at})
            for entry in sorted(entries, key=key):  # nearly in order already: archives are written so
                out.add(entry)
            out.close()
            yield batch_of(_FILE, {"name": [run_name], "records": [out.count]})

    n = max(1, archives.count())
    return written(archives.repartition(n, F.rand(5)).mapInArrow(run, "name string, records long"), "runs")


def calendar_seconds(date: str) -> int:
    return calendar.timegm(time.strptime(date, "%Y-%m-%dT%H:%M:%SZ"))


def surt(url: str) -> str:
    """``url_key`` for a single value."""
    if not (m := re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)[^/?#]*([^#]*)", url, re.S)) or not (host := re.sub(r"^www\d*\.", "", m[1].lower())):
        return url
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


class Run:
    """The entries of one run file from a key on, one block in memory at a time."""

    def __init__(self, fs, path: str, low: tuple | None, high: tuple | None) -> None:
        self.file = pa.ipc.open_file(fs.open_input_file(path))
        self.high, self.block, self.rows, self.at = high, -1, [], 0
        lo, hi = 0, self.file.num_record_batches
        while low is not None and lo < hi:  # the first block that begins at or after the low key
            mid = (lo + hi) // 2
            first = self.file.get_batch(mid).slice(0, 1).to_pylist()[0]
            lo, hi = (mid + 1, hi) if key(first) < low else (lo, mid)
        self.block = max(0, lo - 1) - 1
        self.row = None
        self.next()
        while low is not None and self.row is not None and key(self.row) < low:
            self.next()

    def next(self) -> None:
        if self.at >= len(self.rows):
            self.block += 1
            if self.block >= self.file.num_record_batches:
                self.row = None
                return
            self.rows, self.at = self.file.get_batch(self.block).to_pylist(), 0
        self.row = self.rows[self.at]
        self.at += 1
        if self.high is not None and key(self.row) >= self.high:
            self.row = None
            self.rows, self.block = [], self.file.num_record_batches


def key(row: dict) -> tuple:
    return row["url_key"], row["ts"], row["page_id"]


def loser_tree(runs: list[Run]) -> Iterator[dict]:
    """Merge sorted runs: inner nodes hold the losers of their matches, so each next entry costs one path of matches."""
    k = 1
    while k < len(runs):
        k *= 2
    ended = ("\U0010ffff" * 4, 1 << 62, 1 << 62, 1)
    keys = [(*key(r.row), 0) if r.row is not None else ended for r in runs] + [ended] * (k - len(runs))
    losers, winners = [0] * k, [*[0] * k, *range(k)]
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if (keys[a], a) <= (keys[b], b) else (b, a)
    best = winners[1] if k > 1 else 0
    while keys[best] is not ended:
        run = runs[best]
        yield run.row
        run.next()
        keys[best] = (*key(run.row), 0) if run.row is not None else ended
        node = (best + k) // 2
        while node:
            other = losers[node]
            if (keys[other], other) < (keys[best], best):
                losers[node], best = best, other
            node //= 2


def merged_runs(runs: DataFrame, folder: str, fan_in: int) -> DataFrame:
    """One pass: each task merges ``fan_in`` whole runs into one."""
    numbered = runs.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("name")) - 1) / fan_in))
    groups = numbered.groupBy("batch").agg(F.collect_list("name").alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for row in (x for batch in batches for x in batch.to_pylist()):
            name = f"merged-{row['batch']}-{TaskContext.get().taskAttemptId()}"
            out = RunWriter(fs, f"{base}/{name}")
            for entry in loser_tree([Run(fs, f"{base}/{n}", None, None) for n in sorted(row["names"])]):
                out.add(entry)
            out.close()
            yield batch_of(_FILE, {"name": [name], "records": [out.count]})

    return written(groups.repartition(F.col("batch")).mapInArrow(run, "name string, records long"), "runs")


def sampled_keys(runs: DataFrame, folder: str, total: int, most: int) -> list[tuple]:
    """Keys of about ``most`` entries, evenly spaced within each run."""
    step = max(1, total // most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        schema = pa.schema(list(_ENTRY)[:3])
        for name in (x for batch in batches for x in batch["name"].to_pylist()):
            file, at = pa.ipc.open_file(fs.open_input_file(f"{base}/{name}")), step // 2
            for b in range(file.num_record_batches):
                block = file.get_batch(b)
                yield from (pa.RecordBatch.from_arrays(block.slice(i, 1).columns[:3], schema=schema) for i in range(at, block.num_rows, step))
                at = (at - block.num_rows) % step if at < block.num_rows else at - block.num_rows

    return sorted((r.url_key, r.ts, r.page_id) for r in runs.repartition(F.col("name")).mapInArrow(run, "url_key string, ts long, page_id long").collect())


def merge_index(runs: DataFrame, folder: str, fan_in: int = 64, range_rows: int = 100_000, sample: int = 8192) -> DataFrame:
    """The global index over sorted run files, a row per capture with range_id and position."""
    spark = runs.sparkSession
    while (count := runs.count()) > fan_in:
        runs = merged_runs(runs, folder, fan_in)
    if not count:
        return spark.createDataFrame([], _INDEX_DDL)
    total = runs.agg(F.sum("records")).first()[0]
    names = sorted(r.name for r in runs.select("name").collect())  # at most fan_in
    ranges = max(spark.sparkContext.defaultParallelism, total // range_rows)
    keys = sampled_keys(runs, folder, total, max(sample, 8 * ranges))
    cuts = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for i in (x for batch in batches for x in batch["id"].to_pylist()):
            low, high = cuts[i - 1] if i else None, cuts[i] if i < len(cuts) else None
            rows, position = [], 0
            for entry in loser_tree([Run(fs, f"{base}/{n}", low, high) for n in names]):
                rows.append(entry | {"range_id": i, "position": position})
                position += 1
                if len(rows) == _BLOCK:
                    yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)

    return spark.range(0, len(cuts) + 1, 1, len(cuts) + 1).mapInArrow(run, _INDEX_DDL)


def capture_index(captures: DataFrame, least: int = 100, fan_in: int = 64) -> DataFrame:
    """Write captures (page_id, url, ts, html) as archives, read these back, and return the merged index."""
    folder = new_folder(captures.sparkSession, "warc")
    given = captures.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_NULL_ID)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("ts").cast("long"), F.lit(0)).alias("ts"), F.col("html").cast("string"))
    archives = write_archives(with_holders(given.withColumn("url_key", url_key(F.col("url"))), least), folder)
    index = merge_index(read_archives(archives, folder), folder, fan_in)
    return index.withColumn("page_id", F.when(F.col("page_id") != _NULL_ID, F.col("page_id")))
