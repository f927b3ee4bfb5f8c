"""Streaming jobs: the batch operators on micro-batches, retries, time-to-live de-duplication, depths and alarms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from chartloom.streaming.ledger import exactly_once


def read_stream(spark, path: str, schema, files: int = 10, timestamps: tuple[str, ...] = ("ts",)) -> DataFrame:
    """A stream of Parquet files, a few per trigger; times become zoned, as watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in timestamps if c in rows.columns})


def track_stream(rows: DataFrame, work: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, realtime: bool = False) -> StreamingQuery:
    """Apply a batch operator to each micro-batch and write it; the checkpoint acknowledges what was written."""
    out = rows.writeStream.foreachBatch(lambda df, n: sink(work(df), n)).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime="30 seconds") if realtime else out.trigger(availableNow=True)).start()


def routing_stream(components: DataFrame, paths: dict[str, str], audit_path: str, checkpoint: str, threshold: float = 0.85, ledger: str | None = None) -> StreamingQuery:
    """Route scored documents: each micro-batch goes to its routes' tables, with an audit row per document.

    Tables are read with ``ledger.read_finished``: a batch that fails halfway or runs again leaves each row once.
    """
    from chartloom.operators import routing

    def outputs(df: DataFrame, n: int) -> dict[str, DataFrame]:
        log = df.select("doc_id", "final_score", "route", "payload", F.current_timestamp().alias("at"))
        return {path: df.filter(F.col("route") == route) for route, path in paths.items()} | {audit_path: log}

    sink = exactly_once(outputs, ledger or f"{audit_path}_ledger")
    return track_stream(components, lambda df: routing.route_payload(routing.route_final(df, threshold)), sink, checkpoint)


def split_retries(results: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with ok and attempts: done, to be tried again (attempts + 1), and dead ones with reason and time."""
    failed = results.filter(~F.col("ok")).withColumn("attempts", F.col("attempts") + 1)
    dead = failed.filter(F.col("attempts") >= most).withColumn("failed_at", F.current_timestamp())
    return results.filter("ok"), failed.filter(F.col("attempts") < most), dead


def export_attempts(results: DataFrame, direct: int = 3, queued: int = 6) -> DataFrame:
    """The event that an export's number of failures leads to: done, again, queued or unresolved."""
    event = F.when(F.col("ok"), "EXPORT_SUCCESS").when(F.col("attempts") < direct, "EXPORT_RETRY").when(F.col("attempts") < direct + queued, "EXPORT_QUEUED").otherwise("EXPORT_UNRESOLVED")
    return results.withColumn("event", event)


def _chain_ends(times: np.ndarray, ttl: int) -> np.ndarray:
    """For each of the sorted times of a block: until when the last arrival lasts that is accepted in the block if this one is."""
    following = np.searchsorted(times, times + ttl)
    last = np.where(following < len(times), following, np.arange(len(times)))
    while not np.array_equal(last, ends := last[last]):
        last = ends
    return times[last] + ttl


def _expiry_of_block(ttl: int):
    """A block's effect on an expiry: rows of (at, until), until which time its arrivals last if that of ``at`` is the first accepted.

    An expiry from before the block lies less than ``ttl`` after its beginning, so later arrivals are first only if none is earlier.
    """

    def run(got: pa.Table) -> pa.Table:
        times = np.sort(got["at"].to_numpy())
        first = int(np.searchsorted(times, times[0] + ttl)) + 1
        until = _chain_ends(times, ttl)[:first]
        return pa.table({"key": got["key"][: len(until)], "block": got["block"][: len(until)], "at": times[: len(until)], "until": until})

    return run


def _after(at: np.ndarray, until: np.ndarray, expiry: np.ndarray) -> np.ndarray:
    """Expiries carried over a block."""
    place = np.searchsorted(at, expiry)
    return np.where(place < len(at), until[np.minimum(place, len(at) - 1)], expiry)


def _children(got: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The blocks of a group in order of time, each with its (at, until)."""
    block, at, until = (got[c].to_numpy() for c in ("block", "at", "until"))
    order = np.lexsort((at, block))
    block, at, until = block[order], at[order], until[order]
    return [(int(block[i[0]]), at[i], until[i]) for i in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1) if len(i)]


def _composed(got: pa.Table) -> pa.Table:
    """The effect of several blocks, one after another, as that of one."""
    blocks = _children(got)
    at = np.append(blocks[0][1], blocks[1][1][:1] if len(blocks) > 1 else [])
    until = at
    for _, a, u in blocks:
        until = _after(a, u, until)
    return pa.table({"key": got["key"].take([0] * len(at)), "block": got["parent"].take([0] * len(at)), "at": at.astype(np.int64), "until": until.astype(np.int64)})


def _handed_down(left: pa.Table, right: pa.Table) -> pa.Table:
    """The expiry that each block begins with, from that of the group."""
    blocks, expiry, begins = _children(left), right["expiry"].to_numpy()[:1], []
    for _, a, u in blocks:
        begins.append(expiry[0])
        expiry = _after(a, u, expiry)
    return pa.table({"key": left["key"].take([0] * len(blocks)), "block": pa.array([b for b, *_ in blocks], pa.int64()), "expiry": pa.array(begins, pa.int64())})


def _accepted(ttl: int):
    """The arrivals of a block that are accepted, given the expiry that it begins with."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left["at"].to_numpy(), kind="stable")
        times, expiry, taken = left["at"].to_numpy()[order], right["expiry"].to_numpy()[0], np.zeros(len(order), bool)
        while (i := int(np.searchsorted(times, expiry))) < len(times):
            taken[i], expiry = True, times[i] + ttl
        return pa.table({"key": left["key"].take(order), "at": times, "n": left["n"].take(order), "accepted": taken})

    return run


def _in_streams(given: DataFrame, ttl: int) -> DataFrame:
    """Arrivals sorted by key and time within partitions, read as a stream: a task holds a batch and the current key's expiry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, until = None, None
        for batch in batches:
            found = []
            for k, t in zip(batch["key"].to_pylist(), batch["at"].to_pylist(), strict=True):
                if k != key:
                    key, until = k, None
                found.append(until is not None and t < until)
                until = until if found[-1] else t + ttl
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], names=["key", "arrived_at", "duplicate"])

    kind = given.schema["key"].dataType.simpleString()
    return given.repartition("key").sortWithinPartitions("key", "at").mapInArrow(run, f"key {kind}, arrived_at long, duplicate boolean")


def dedupe_ttl(requests: DataFrame, ttl: int, most: int = 100_000, fan: int = 16) -> DataFrame:
    """Add duplicate to (key, arrived_at): an arrival before its key's accepted one has expired. Duplicates don't extend it.

    Keys of up to ``most`` rows are dealt out by key and read in order. Keys with more are cut into blocks of time, see ``_in_blocks``,
    so that a hot key's rows spread over tasks; the rows are the same. Null times are left out; null keys are one key.
    """
    given = requests.filter("arrived_at IS NOT NULL").select("key", F.col("arrived_at").cast("long").alias("at"))
    if ttl <= 0:  # expired at once
        return given.select("key", F.col("at").alias("arrived_at"), F.lit(False).alias("duplicate"))
    large = given.groupBy("key").count().filter(F.col("count") > most).select(F.col("key").alias("large"))
    few = large.limit(10_001).count()
    if few == 0:
        return _in_streams(given, ttl)
    large = F.broadcast(large) if few <= 10_000 else large  # as many keys at most
    same = F.col("key").eqNullSafe(F.col("large"))
    return _in_streams(given.join(large, same, "left_anti"), ttl).unionByName(_in_blocks(given.join(large, same, "left_semi"), ttl, most, fan))


def _in_blocks(given: DataFrame, ttl: int, least_block: int, fan: int) -> DataFrame:
    """The same by composing what blocks of time do to a key's expiry.

    A block maps the expiry that it begins with to the one that it ends with. Equal arrivals are counted first, so a block of
    ``least_block`` seconds (or ``ttl``, if that is more) has no more distinct times than seconds, however many rows a key has. Maps of
    ``fan`` neighbouring blocks are composed level by level to one for each key, and expiries are handed down again; a task sees one
    block or the maps of ``fan`` blocks.
    """
    kind = given.schema["key"].dataType.simpleString()
    span = given.agg(F.min("at"), F.max("at")).first()
    first, width = span[0] or 0, max(ttl, least_block)
    block = F.floor((F.col("at") - first) / width).cast("long")
    counted = given.groupBy("key", block.alias("block"), "at").agg(F.count("*").alias("n"))
    levels = [counted.groupBy("key", "block").applyInArrow(_expiry_of_block(ttl), f"key {kind}, block long, at long, until long")]
    blocks = ((span[1] or 0) - first) // width + 1
    while blocks > 1:
        grouped = levels[-1].withColumn("parent", F.floor(F.col("block") / fan).cast("long"))
        levels.append(grouped.groupBy("key", "parent").applyInArrow(_composed, f"key {kind}, block long, at long, until long"))
        blocks = -(-blocks // fan)
    expiry = levels[-1].select("key", "block").distinct().withColumn("expiry", F.lit(first - ttl).cast("long"))
    for level in reversed(levels[:-1]):
        parents = level.withColumn("parent", F.floor(F.col("block") / fan).cast("long")).groupBy("key", "parent")
        expiry = parents.cogroup(expiry.withColumnRenamed("block", "parent").groupBy("key", "parent")).applyInArrow(_handed_down, f"key {kind}, block long, expiry long")
    judged = counted.groupBy("key", "block").cogroup(expiry.groupBy("key", "block")).applyInArrow(_accepted(ttl), f"key {kind}, at long, n long, accepted boolean")
    many = 1 << 16
    runs = judged.select("key", "at", "n", "accepted", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(many).cast("long"))).alias("run"))
    every = runs.select("key", F.col("at").alias("arrived_at"), "accepted", F.explode(F.sequence("run", F.least(F.col("run") + (many - 1), F.col("n") - 1))).alias("copy"))
    return every.select("key", "arrived_at", (~F.col("accepted") | (F.col("copy") > 0)).alias("duplicate"))


class TtlState(StatefulProcessor):
    """The same on a stream: a key's state is the time at which its accepted arrival expires."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        arrivals = sorted(t for batch in rows for t in batch["arrived_at"])
        until = self.until.get()[0] if self.until.exists() else None
        out = []
        for t in arrivals:
            duplicate = until is not None and t < until
            until = until if duplicate else t + self.ttl
            out.append((key[0], t, duplicate))
        self.until.update((until,))
        yield pd.DataFrame(out, columns=["key", "arrived_at", "duplicate"])

    def close(self) -> None:
        pass


def dedupe_ttl_stream(requests: DataFrame, ttl: int) -> DataFrame:
    return requests.groupBy("key").transformWithStateInPandas(TtlState(ttl), "key string, arrived_at long, duplicate boolean", "append", "none")


def cache_lookup(requests: DataFrame, cache: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Requests with a fresh value, and the distinct keys that must be computed. ``cache``: key, value, expires_at."""
    fresh = cache.filter(F.col("expires_at") > now).groupBy("key").agg(F.max_by("value", "expires_at").alias("value"))
    joined = requests.join(fresh, "key", "left")
    return joined.filter("value IS NOT NULL"), joined.filter("value IS NULL").select("key").distinct()


def cache_put(values: DataFrame, now: int, ttl: int = 7 * 86400) -> DataFrame:
    """Rows to append; a later row of a key extends it."""
    return values.withColumn("expires_at", F.lit(now + ttl).cast("long"))


def drop_seen(rows: DataFrame, seen: DataFrame, now: int, key: str = "key") -> DataFrame:
    """Rows whose key hasn't been processed within its time to live."""
    return rows.join(seen.filter(F.col("expires_at") > now).select(key), key, "left_anti")


def depth_stream(events: DataFrame) -> DataFrame:
    """Outstanding messages per queue from events with delta +1 or -1; for output mode update or complete."""
    return events.groupBy("queue").agg(F.sum("delta").alias("depth"))


def metric_windows(points: DataFrame, by: list[str], period: int, statistic: str = "avg", late: str = "10 minutes") -> DataFrame:
    """A metric's statistic by tumbling window, for streams and tables alike; alarms are raised over its rows."""
    rows = points.withWatermark("ts", late) if points.isStreaming else points
    stat = getattr(F, statistic)("value").alias("stat")
    return rows.groupBy(*by, F.window("ts", f"{period} seconds")).agg(stat).select(*by, F.unix_seconds("window.start").alias("start"), "stat")


def breaches(windows: DataFrame, by: list[str], threshold: float, period: int, periods: int) -> DataFrame:
    """Windows that end ``periods`` breaches in a row; a missing window doesn't breach."""
    flagged = windows.withColumn("breach", (F.col("stat") > threshold).cast("int"))
    back = Window.partitionBy(*by).orderBy("start").rangeBetween(-(periods - 1) * period, 0)
    return flagged.withColumn("alarm", F.sum("breach").over(back) == periods)


class AlarmState(StatefulProcessor):
    """Breaches in a row of one metric: the last window's start and their number. A timer ends the row when the next window stays away."""

    def __init__(self, threshold: float, period: int, periods: int) -> None:
        self.threshold, self.period, self.periods = threshold, period, periods

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "start long, breaches int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        start, breaches = self.last.get() if self.last.exists() else (None, 0)
        if start is not None:
            self.handle.deleteTimer(self._missed(start))
        out = []
        for at, stat in sorted((a, s) for batch in rows for a, s in zip(batch["start"], batch["stat"], strict=True)):
            breach = bool(stat > self.threshold)
            follows = start is not None and at - start == self.period
            start, breaches = int(at), (breaches if follows else 0) + 1 if breach else 0
            out.append((*key, start, stat, breaches >= self.periods))
        self.last.update((start, breaches))
        self.handle.registerTimer(self._missed(start))
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def _missed(self, start: int) -> int:
        """When the window after this one has ended, in milliseconds."""
        return (start + 2 * self.period) * 1000

    def close(self) -> None:
        pass


def alarm_stream(points: DataFrame, by: list[str], threshold: float, period: int, periods: int, statistic: str = "avg", late: str = "10 minutes") -> DataFrame:
    """``metrics.alarms`` on a stream of (by, ts, value): a row per window once no point can join it, with by, start, stat, alarm.

    Windows are aggregated before they reach the state, so a metric's points spread over tasks; its windows are few.
    """
    stat = getattr(F, statistic)("value").alias("stat")
    closed = points.withWatermark("ts", late).groupBy(*by, F.window("ts", f"{period} seconds")).agg(stat)
    rows = closed.select(*by, F.window_time("window").alias("seen"), F.unix_seconds("window.start").alias("start"), "stat").filter("stat IS NOT NULL")
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*by).schema)
    return rows.groupBy(*by).transformWithStateInPandas(AlarmState(threshold, period, periods), f"{named}, start long, stat double, alarm boolean", "append", "eventtime")
