"""Sharding by sampled splitters: shards of nearly equal bytes from a range partition of the texts' hashes.

Method: a size-weighted sample of the keys gives quantiles, which cut the key space into fine ranges; each range's exact bytes and
rows are summed, and prefix sums over the ranges give each its place in the whole. Rows are ordered within their range,
so the byte position of each row is known exactly, and a shard's boundary is the very row where its bytes are used up: ranges
that are overfull for one shard are subdivided there.

The law: shards have nearly equal bytes, and equal texts (a group) stay in one shard unless they don't fit. Large groups
(over ``large`` of a shard's bytes; at most ``shards / large`` of them) take the shard with most room, largest group first;
only a group for which no shard has room left is cut, at the row where the room ends, and its rest goes on in the same
way. All other groups follow in the order of their hashes into the room that is left, each whole in the shard where its first
byte falls. So every group that fits is whole at any size, and a shard exceeds an equal share by at most ``large`` of it and a row.

Groups of many rows are spread over ranges by their rows' numbers, so that no task has to hold them; whether a group is spread
doesn't change where it goes. The sample, the ranges and the list of large groups are bounded by parameters.

Edge cases: a null text has no bytes and the checksum 0; all null texts are one group; repeated rows, rows without a doc_id and
rows that share one are separate rows; ties are ordered by the row's place in the input; texts of any length count whole;
extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.shared import written

#: Bytes of a record besides its text.
RECORD_BYTES = 8


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, h (the group's key) and uid, a number of the row in this reading of the table."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "utf-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("uid"),
    )


def placed_groups(groups: list[tuple[int, int, int]], shards: int, total: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Pieces (h, first row, shard, rows) of large groups (h, rows, bytes of all rows), and the bytes left in each shard."""
    share = [total * (i + 1) // shards - total * i // shards for i in range(shards)]
    rooms = [(-room, i) for i, room in enumerate(share)]
    heapq.heapify(rooms)
    out = []
    for h, rows, size in sorted(groups, key=lambda g: (-g[2], g[0])):
        each, first = size // rows, 0
        while rows:
            room, i = heapq.heappop(rooms)
            fit = min(rows, max(1, -room // each))
            out.append((h, first, i, fit))
            heapq.heappush(rooms, (room + fit * each, i))
            first, rows = first + fit, rows - fit
    left = [0] * shards
    for room, i in rooms:
        left[i] = max(0, -room)
    return out, left


def shard(records: DataFrame, shards: int = 24, large: float = 0.02, sample: int = 16_384, most_ranges: int = 65_536, range_rows: int = 50_000) -> DataFrame:
    """Add shard and slot (gapless from 0 within it) to records with size, h (a hash of the group's key) and uid, a number of the row."""
    spark = records.sparkSession
    rows, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not rows:
        return records.select(*records.columns, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    of_group = records.groupBy("h").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    heavy = F.col("b") > large * total / shards
    spread = written(of_group.filter(heavy | (F.col("n") > range_rows)).select("h", heavy.alias("heavy"), "b", "n"), "spread")
    pieces, left = placed_groups([(r.h, r.n, r.b) for r in spread.filter("heavy").collect()], shards, total)
    placed = records.join(spread.select("h", "heavy"), "h", "left").withColumn("sub", F.when(F.col("heavy").isNull(), 0).otherwise(F.xxhash64("uid")))

    ranges = int(min(most_ranges, max(16 * shards, rows // range_rows)))
    chance = F.pmod(F.xxhash64("uid", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # by bytes and by rows alike, so that neither long texts nor many short ones fill a range
    weight = F.col("size") * (max(sample, 4 * ranges) / (2 * total)) + max(sample, 4 * ranges) / (2 * rows)
    keys = sorted((r.h, r.sub) for r in placed.filter(chance < weight).select("h", "sub").collect())
    splitters = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    given = spark.sparkContext.broadcast((np.array([k[0] for k in splitters], np.int64), [k[1] for k in splitters]))

    @F.pandas_udf("int")
    def range_of(h: pd.Series, sub: pd.Series) -> pd.Series:
        hashes, subs = given.value
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        return pd.Series([a if a == b else bisect.bisect_right(subs, s, a, b) for a, b, s in zip(low, high, sub, strict=True)], dtype="int32")

    light = F.when(F.coalesce("heavy", F.lit(False)), 0).otherwise
    ranged = written(placed.withColumn("range_id", range_of("h", "sub")), "ranged")
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range_id").agg(F.sum(light(F.col("size"))).alias("b"), F.sum(light(1)).alias("l"), F.count("*").alias("n"))  # at most most_ranges rows
    bases = sums.select("range_id", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_base") for c in ("b", "l", "n")])

    # at: light bytes before the row; line: light rows before it; row: rows before it
    inside = Window.partitionBy("range_id").orderBy("h", "sub", "uid")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.col("b_base") + F.sum(light(F.col("size"))).over(upto) - light(F.col("size"))
    line = F.col("l_base") + F.sum(light(1)).over(upto) - light(1)
    counted = ranged.join(F.broadcast(bases), "range_id").select(*records.columns, "heavy", "range_id", at.alias("at"), line.alias("line"), (F.col("n_base") + F.row_number().over(inside) - 1).alias("row"))
    group = Window.partitionBy("range_id", "h").orderBy("at")
    # a group that isn't spread lies within one range; of spread ones the first row is looked up
    marked = written(counted.withColumn("begins", F.when(F.col("heavy").isNull(), F.first("at").over(group))), "counted")
    firsts = marked.filter("heavy IS NOT NULL").groupBy("h").agg(F.min("at").alias("first_at"), F.min("row").alias("first_row"))
    known = marked.join(written(firsts, "firsts"), "h", "left")

    cuts = np.cumsum([0, *left]).tolist()
    starts = F.coalesce("begins", "first_at")
    of_light = F.least(F.lit(shards - 1), F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts[1:]]), lambda c: c <= starts)))
    whole = known.filter("NOT coalesce(heavy, false)").select(*records.columns, of_light.cast("int").alias("shard"), F.col("line").alias("place"))
    found = written(whole, "light")
    sizes = {r.shard: (r.first, r.n) for r in found.groupBy("shard").agg(F.min("place").alias("first"), F.count("*").alias("n")).collect()}  # a row per shard
    first_of = F.array(*[F.lit(sizes.get(i, (0, 0))[0]).cast("long") for i in range(shards)])
    out = found.select(*records.columns, "shard", (F.col("place") - F.get(first_of, F.col("shard"))).alias("slot"))
    if not pieces:
        return out
    taken, based = {i: n for i, (_, n) in sizes.items()}, []
    for h, first, i, n in pieces:
        based.append((h, first, first + n, i, taken.get(i, 0)))
        taken[i] = taken.get(i, 0) + n
    table = spark.createDataFrame(based, "piece_h long, piece_first long, piece_end long, shard int, base long")  # at most shards / large pieces, and one more a shard
    number = F.col("row") - F.col("first_row")
    cut = known.filter("heavy").join(F.broadcast(table), (F.col("h") == F.col("piece_h")) & (number >= F.col("piece_first")) & (number < F.col("piece_end")))
    return out.unionByName(cut.select(*records.columns, "shard", (number - F.col("piece_first") + F.col("base")).alias("slot")))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    return shard(written(keyed(docs), "records"), shards).drop("uid")
