"""Best-fit packing of tokenized documents into training sequences of a fixed length.

Method (best-two-fit): a bin takes the longest piece that is left, then again and again the longest that still fits.
When none fits, its smallest piece is given back if two unpacked pieces fill the widened gap more tightly.

Distribution: documents are tokenized where they are read, so only (document, piece, length) rows are shuffled. These
are dealt by a hash into groups of about ``group_rows`` pieces; each group is packed alone by a task that works on a
table of counts by length, and the few sequences that a group leaves loosely filled are packed again together with
those of ``tail_fan`` other groups. Waste is thus about one sequence for every ``tail_fan`` groups.

Edge cases: a null or empty text is a document of one token (the end id); a text of any length is cut into whole pieces and a rest; a null
doc_id stays null; pieces of equal lengths are taken in order of doc_id and piece; extra columns are dropped; rows with an equal
doc_id are packed as separate pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.pieces import word_encoder
from chartloom.llm.shared import batch_of, blocks, bounded, written

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_IDS = _PIECE.append(pa.field("ids", pa.binary()))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """A row per piece of each document: doc_id, piece, start, length, ids_crc32, and with ``keep_ids`` the ids (uint32)."""
    schema = _IDS if keep_ids else _PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        for block in blocks(batches, "text", 4 << 20):
            rows: list[tuple] = []
            ids, counts = encoder.encode(block["text"])
            ends = np.cumsum(counts)
            for doc, a, b in zip(block["doc_id"].to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity].tobytes()
                    rows.append((doc, k, at, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else [])))
            yield batch_of(schema, dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return bounded(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, out)


class _Lengths:
    """How many unpacked pieces there are of each length; the longest of at most n is found in one step on a bit set."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.of: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        for i in range(len(lengths) - 1, -1, -1):
            self.put(i, lengths[i])

    def put(self, item: int, length: int) -> None:
        self.of[length].append(item)
        self.bits |= 1 << length

    def take(self, length: int) -> int:
        item = self.of[length].pop()
        if not self.of[length]:
            self.bits ^= 1 << length
        return item

    def longest(self, most: int) -> int:
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    def pair(self, most: int, over: int) -> tuple[int, int] | None:
        """The two lengths whose sum is largest, over ``over`` and at most ``most``."""
        best, found, a = over, None, self.longest(most - 1)
        while a > 0 and 2 * a > best:
            b = self.longest(min(most - a, a if len(self.of[a]) > 1 else a - 1))
            if b > 0 and a + b > best:
                best, found = a + b, (a, b)
                if best == most:
                    break
            a = self.longest(a - 1)
        return found


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``; each length is 1 to ``capacity``."""
    left, bins = _Lengths(lengths, capacity), []
    while left.bits:
        gap, items = capacity, []
        while (n := left.longest(gap)) > 0:
            items.append(left.take(n))
            gap -= n
        if gap and len(items) > 1:
            small = lengths[items[-1]]  # lengths fall, so the last is the smallest
            if two := left.pair(gap + small, small):
                out = items.pop()
                items += [left.take(n) for n in two]
                left.put(out, small)
        bins.append(items)
    return bins


def _packer(capacity: int, tail: bool):
    """Packs one group. Loose bins of a first pass come without a sequence, for the second."""

    def run(key: tuple, got: pa.Table) -> pa.Table:
        got = got.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        lengths, group = got["length"].to_pylist(), key[0].as_py()
        sequence, offset = [None] * len(lengths), [None] * len(lengths)
        bins = best_two_fit(lengths, capacity)
        for number, items in enumerate(bins):
            if not tail and sum(lengths[i] for i in items) < capacity - capacity // 200:
                continue
            at = 0
            for i in items:
                sequence[i], offset[i] = (int(tail) << 62) + (group << 32) + number, at
                at += lengths[i]
        keep = [got[n] for n in (*_PIECE.names, "group_id")]
        return pa.table([*keep, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*_PIECE.names, "group_id", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = 4096, group_rows: int = 8192, tail_fan: int = 64) -> DataFrame:
    """Add sequence_id and offset to pieces of at most ``capacity`` tokens. ``pieces`` is read more than once."""
    groups = max(1, -(-pieces.count() // group_rows))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, group_id long, sequence_id long, offset long"
    dealt = pieces.select(*_PIECE.names).withColumn("group_id", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    first = written(dealt.groupBy("group_id").applyInArrow(_packer(capacity, False), out), "packed")
    loose = first.filter("sequence_id IS NULL").drop("sequence_id", "offset").withColumn("group_id", F.floor(F.col("group_id") / tail_fan))
    second = loose.groupBy("group_id").applyInArrow(_packer(capacity, True), out)
    return first.filter("sequence_id IS NOT NULL").unionByName(second).drop("group_id")


def packed_sequences(pieces_with_ids: DataFrame, placed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, the ids of its pieces in order, and the documents' ids and offsets."""
    joined = pieces_with_ids.select("doc_id", "piece", "ids").join(placed, ["doc_id", "piece"])
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return joined.groupBy("sequence_id").agg(inside.alias("parts")).select("sequence_id", F.transform("parts", lambda p: F.struct(p.offset.alias("offset"), p.doc_id.alias("doc_id"), p.piece.alias("piece"))).alias("parts"), F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p.ids)).alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenize and pack: a row per piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(token_pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
