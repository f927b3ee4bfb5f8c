"""Fill-in-middle: texts cut into prefix, middle and suffix, put in another order, and restored.

Method (seekable compressed frames): a text is stored as independent zstandard frames of a bounded number of bytes, with an index
of the units and characters before each. A place given in units is found by a search in the index and by decompressing the
one frame that it lies in. The output is a list of frames too: those wholly in one part are passed on as they are, only cut ones are
compressed anew, and marks are frames of their own; joined, they are a valid zstandard file. Digests are taken over frames one
after another, and restoring reads only the ranges of bytes that it needs, so no whole text is held once it is stored.

A unit is a run of ASCII letters or any other single character. The draws are parts of a SHA-256 of a seed and the doc_id, as column
expressions.

Edge cases: a null text is empty, and an empty text is plain; a text that holds a mark is plain, so that restoring is never in doubt;
a null doc_id draws as an empty string would; rows that share a doc_id draw alike and stay apart; texts of any length, and runs of letters
of any length, are cut into frames at any byte; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.shared import batch_of, blocks, bounded, written

#: Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_FRAME = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("inside", pa.bool_()), ("data", pa.binary())])
_STORED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("n_chars", pa.int64()), ("marked", pa.bool_()), ("frames", pa.list_(_FRAME))])
_STORED_DDL = "doc_id long, n long, n_chars long, marked boolean, frames array<struct<units: long, chars: long, inside: boolean, data: binary>>"
_FILLED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.list_(pa.binary()))])
_FILLED_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"
_DIGESTS = pa.schema([*list(_FILLED)[:5], ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def starts(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Masks of the bytes that start a unit and that start a character; whether the last is a letter. ``inside``: a letter stands before."""
    given = np.frombuffer(data, np.uint8)
    letter = ((given | 32) - np.uint8(97)) < 26
    chars = (given & 0xC0) != 0x80
    units = chars & ~(letter & np.append(inside, letter[:-1]))
    return units, chars, bool(letter[-1])


def to_frames(text: bytes, frame_bytes: int, packer: zstandard.ZstdCompressor) -> tuple[int, int, list[tuple]]:
    """Units and characters of a text, and its frames: units, characters before; whether a letter stands before; data."""
    units = chars = 0
    inside, frames = False, []
    for at in range(0, len(text), frame_bytes):
        part = text[at : at + frame_bytes]
        unit, char, after = starts(part, inside)
        frames.append((units, chars, inside, packer.compress(part)))
        units, chars, inside = units + int(unit.sum()), chars + int(char.sum()), after
    return units, chars, frames


def store(docs: DataFrame, frame_bytes: int = 1 << 16, level: int = 3) -> DataFrame:
    """A row per document: doc_id, n (units), n_chars, marked (it holds a mark), frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level)
        for block in blocks(batches, "text", 4 << 20):
            texts = block["text"].to_pylist()
            found = [to_frames(t, frame_bytes, packer) for t in texts]
            frames = pa.array([[dict(zip(("units", "chars", "inside", "data"), f, strict=True)) for f in x[2]] for x in found], _STORED.field("frames").type)
            marked = [any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts]
            yield batch_of(_STORED, {"doc_id": block["doc_id"], "n": [x[0] for x in found], "n_chars": [x[1] for x in found], "marked": marked, "frames": frames})

    given = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return bounded(given).mapInArrow(run, _STORED_DDL)


def drawn(stored: DataFrame, seed: int = 1, infill_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """Add form (plain, psm, spm), low and high: the units before the middle and before the suffix."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    plain = (F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= infill_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    a, b = (x % (F.col("n") + 1) for x in h[:2])
    return stored.select("*", form.alias("form"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


class Place(NamedTuple):
    frame: int
    byte: int
    chars: int


def find(frames: list[dict], n: int, chars: int, unit: int) -> Place:
    """Where a text's unit starts, by decompressing one frame; the end of the text if there is none left."""
    if unit >= n:
        return Place(len(frames), 0, chars)
    at = bisect_right(frames, unit, key=lambda f: f["units"]) - 1
    data = zstandard.decompress(frames[at]["data"])
    units, char, _ = starts(data, frames[at]["inside"])
    byte = int(np.flatnonzero(units)[unit - frames[at]["units"]])
    return Place(at, byte, frames[at]["chars"] + int(char[:byte].sum()))


def between(frames: list[dict], a: Place, b: Place, packer: zstandard.ZstdCompressor) -> list[bytes]:
    """Frames of the text from one place to another: whole ones as they are, cut ones compressed anew."""
    out = []
    for i in range(a.frame, min(b.frame + 1, len(frames))):
        first, last = a.byte if i == a.frame else 0, b.byte if i == b.frame else None
        if first == 0 and last is None:
            out.append(frames[i]["data"])
        elif part := zstandard.decompress(frames[i]["data"])[first:last]:
            out.append(packer.compress(part))
    return out


def fill_in_middle(stored: DataFrame, seed: int = 1, infill_percent: int = 90, spm_percent: int = 20, level: int = 3) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars and middle_chars (null if plain), output (frames of the new text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level)
        mark = {m: packer.compress(m) for m in (PREFIX, SUFFIX, MIDDLE)}
        for batch in batches:
            rows = []
            for doc, n, chars, _, frames, form, low, high in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
                if form == "plain":
                    rows.append((doc, n, form, None, None, [f["data"] for f in frames]))
                    continue
                a, b = find(frames, n, chars, low), find(frames, n, chars, high)
                prefix, middle, suffix = (between(frames, x, y, packer) for x, y in ((Place(0, 0, 0), a), (a, b), (b, Place(len(frames), 0, chars))))
                order = ((PREFIX, prefix), (SUFFIX, suffix)) if form == "psm" else ((SUFFIX, suffix), (PREFIX, prefix))
                rows.append((doc, n, form, a.chars, b.chars - a.chars, [f for m, part in (*order, (MIDDLE, middle)) for f in (mark[m], *part)]))
            yield batch_of(_FILLED, dict(zip(_FILLED.names, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in _FILLED.names})

    return bounded(drawn(stored, seed, infill_percent, spm_percent)).mapInArrow(run, _FILLED_DDL)


class Output:
    """An output's bytes, read frame by frame."""

    def __init__(self, frames: list[bytes]) -> None:
        self.frames = frames
        self.ends = np.cumsum([zstandard.frame_content_size(f) for f in frames], dtype=np.int64).tolist()
        self.size = self.ends[-1] if frames else 0

    def read(self, first: int, last: int) -> Iterator[bytes]:
        for i in range(bisect_right(self.ends, first), len(self.frames)):
            base = self.ends[i - 1] if i else 0
            if base >= last:
                return
            yield zstandard.decompress(self.frames[i])[max(first - base, 0) : last - base]

    def digest(self, *ranges: tuple[int, int]) -> str:
        found = hashlib.sha256()
        for first, last in ranges:
            for part in self.read(first, last):
                found.update(part)
        return found.hexdigest()

    def find(self, mark: bytes, first: int) -> int:
        """Where a mark stands next, even if two frames share it."""
        at, tail = first, b""
        for part in self.read(first, self.size):
            if (found := (tail + part).find(mark)) >= 0:
                return at - len(tail) + found
            at, tail = at + len(part), (tail + part)[1 - len(mark) :]
        raise ValueError("an output without its marks")

    def restored(self, form: str) -> str:
        """Digest of the text that was given, from the output and its form alone."""
        if form == "plain":
            return self.digest((0, self.size))
        second = self.find(SUFFIX if form == "psm" else PREFIX, len(PREFIX))
        third = self.find(MIDDLE, second + len(PREFIX))
        one, two, middle = (len(PREFIX), second), (second + len(PREFIX), third), (third + len(MIDDLE), self.size)
        return self.digest(one, middle, two) if form == "psm" else self.digest(two, middle, one)


def digests(filled: DataFrame) -> DataFrame:
    """Instead of the output its SHA-256, and that of the text restored from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs = [Output(x) for x in batch["output"].to_pylist()]
            restored = [o.restored(form) for o, form in zip(outputs, batch["form"].to_pylist(), strict=True)]
            yield batch_of(_DIGESTS, {c: batch[c] for c in _DIGESTS.names[:5]} | {"output_sha256": [o.digest((0, o.size)) for o in outputs], "restored_sha256": restored})

    return bounded(filled).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def stored_and_filled(docs: DataFrame, seed: int = 1, infill_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """Write the frames, then make the outputs from them."""
    return fill_in_middle(written(store(docs), "frames", "uncompressed"), seed, infill_percent, spm_percent)
