"""Media columns: motion-JPEG in AVI files, held in a binary column.

Write: bytes become grey frames of 24 x 24 samples of 8 bits. Each frame is one lossless JPEG (process 14, predictor 1, so
the samples come back exactly), a chunk of the file's ``movi`` list and an entry of its ``idx1`` index. The Huffman table gives a
difference of n bits a code of 16 - n bits: each sample takes two whole bytes, all samples of a file are coded and decoded
at once, and repeated content stays visible to the table's compression.

Read: the RIFF chunks are parsed, frames are found through the index and decoded, and shots are cut where the
difference of two neighbouring frames' grey histograms is over an adaptive threshold: the mean plus two deviations
of the differences up to there, and a quarter of the largest possible difference at least. Each shot is a clip with its
first and last frame and its times.

Work is row by row where rows are read; the stored table is the only thing between the two passes, and nothing is
shuffled. Edge cases: null and empty texts are one frame of padding; texts are stored whole up to about 1 GB (a file's sizes are 32 bits
wide and a sample takes two bytes; a longer text raises an error); rows that are equal or share a doc_id stay apart; extra columns are
ignored; an empty table gives an empty one. A file with another code length than this writer's raises ValueError.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.shared import batch_of, blocks, bounded

SIDE, RATE = 24, 24
FRAME = SIDE * SIDE
_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_CLIP = pa.struct([("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.int32()), ("clips", pa.list_(_CLIP)), ("mean_grey", pa.float64())])
_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, clips array<struct<first_frame: int, last_frame: int, start_s: double, end_s: double>>, mean_grey double"


def huffman(counts: bytes, values: bytes) -> dict[int, tuple[int, int]]:
    """Length and code of each category, from a table as a DHT segment holds it."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[at]] = (length, code)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def coded(table: dict[int, tuple[int, int]]) -> np.ndarray:
    """The 16 bits of each difference from -255 to 255: the code of its number of bits, then those bits."""
    words = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        length, code = table[n]
        if length + n != 16:
            raise ValueError("only codes that fill 16 bits a sample are supported")
        words[d + 255] = code << n | (d if d >= 0 else d + (1 << n) - 1)
    return words


_COUNTS, _VALUES = bytes(7) + bytes([1] * 9), bytes(range(8, -1, -1))
_HEAD = (
    b"\xff\xd8"
    + struct.pack(">HHBHHBBBB", 0xFFC3, 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    + struct.pack(">HHB", 0xFFC4, 2 + 1 + 16 + len(_VALUES), 0)
    + _COUNTS
    + _VALUES
    + struct.pack(">HHBBBBBB", 0xFFDA, 8, 1, 1, 0, 1, 0, 0)
)
_WORDS = coded(huffman(_COUNTS, _VALUES))


def encode_frames(payload: bytes) -> list[bytes]:
    frames = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE).astype(np.int16)
    guess = np.empty_like(frames)
    guess[:, :, 1:] = frames[:, :, :-1]
    guess[:, 1:, 0] = frames[:, :-1, 0]
    guess[:, 0, 0] = 128
    data = _WORDS[frames - guess + 255].astype(">u2").tobytes()
    return [_HEAD + data[i : i + 2 * FRAME].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(data), 2 * FRAME)]


def riff(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """``payload``: a positive multiple of FRAME bytes."""
    frames = encode_frames(payload)
    most = max(map(len, frames))
    main = riff(b"avih", struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0))
    stream = riff(b"strh", b"vids", b"MJPG", struct.pack("<10I4H", 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, FRAME, 0, 0, SIDE, SIDE))
    form = riff(b"strf", struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0))
    chunks, entries, at = [], [], 4
    for f in frames:
        chunks.append(riff(b"00dc", f))
        entries.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(chunks[-1])
    header = riff(b"LIST", b"hdrl", main, riff(b"LIST", b"strl", stream, form))
    return riff(b"RIFF", b"AVI ", header, riff(b"LIST", b"movi", *chunks), riff(b"idx1", *entries))


def chunks_of(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, first byte and length of each chunk."""
    while at + 8 <= end:
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        yield kind, at + 8, size
        at += 8 + size + (size & 1)


def read_index(media: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Frames a second, and the place and length of each frame, from the index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, found = float(RATE), 0, []
    for kind, at, size in chunks_of(media, 12, len(media)):
        if kind == b"LIST" and media[at : at + 4] == b"hdrl":
            rate = round(1e6 / next(int.from_bytes(media[a : a + 4], "little") for k, a, _ in chunks_of(media, at + 4, at + size) if k == b"avih"), 3)
        elif kind == b"LIST" and media[at : at + 4] == b"movi":
            movi = at
        elif kind == b"idx1":
            entries = np.frombuffer(media, "<u4", size // 4, at).reshape(-1, 4)
            found = [(movi + int(o) + 8, int(n)) for o, n in entries[:, 2:]]
    return rate, found


@functools.cache
def frame_head(head: bytes) -> tuple[int, int, np.ndarray]:
    """Height, width and the difference of each 16-bit word, from a frame's segments before its samples."""
    at, table, shape = 2, {}, (0, 0)
    while at < len(head):
        marker, size = struct.unpack_from(">HH", head, at)
        body = head[at + 4 : at + 2 + size]
        if marker == 0xFFC3:
            shape = struct.unpack_from(">HH", body, 1)
        elif marker == 0xFFC4:
            table = huffman(body[1:17], body[17:])
        at += 2 + size
    words = coded(table)
    back = np.zeros(int(words.max()) + 1, np.int16)
    back[words] = np.arange(-255, 256)
    return *shape, back


def decode_frames(media: bytes, index: list[tuple[int, int]]) -> np.ndarray:
    """All frames as an array of (frame, row, column)."""
    heads, scans = set(), []
    for at, size in index:
        frame = media[at : at + size]
        cut = frame.index(b"\xff\xda")
        cut += 2 + int.from_bytes(frame[cut + 2 : cut + 4], "big")
        heads.add(frame[:cut])
        scans.append(frame[cut:-2].replace(b"\xff\x00", b"\xff"))
    if len(heads) != 1:
        raise ValueError("frames of one file differ in size or table")
    height, width, back = frame_head(heads.pop())
    steps = back[np.frombuffer(b"".join(scans), ">u2")].reshape(-1, height, width).astype(np.int32)
    steps[:, 0, 0] += 128
    steps[:, :, 0] = np.cumsum(steps[:, :, 0], axis=1)
    return np.cumsum(steps, axis=2).astype(np.uint8)


def shots(frames: np.ndarray, bins: int = 16, deviations: float = 2.0, least: float = 0.25) -> list[tuple[int, int]]:
    """First and last frame of each shot."""
    n, area = len(frames), frames[0].size
    places = (frames.reshape(n, -1).astype(np.int64) * bins >> 8) + bins * np.arange(n)[:, None]
    histograms = np.bincount(places.ravel(), minlength=n * bins).reshape(n, bins)
    steps = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / (2 * area)
    count = np.arange(1, len(steps) + 1)
    mean = np.cumsum(steps) / count
    spread = np.sqrt(np.maximum(0, np.cumsum(steps**2) / count - mean**2))
    cuts = (np.flatnonzero(steps > np.maximum(least, np.append(least, (mean + deviations * spread)[:-1]))) + 1).tolist() if n > 1 else []
    return list(zip([0, *cuts], [*(c - 1 for c in cuts), n - 1], strict=True))


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text and media, the AVI file that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 4 << 20):
            made = [(n, write_avi(payload)) for n, payload in map(padded, block["text"].to_pylist())]
            yield batch_of(_MEDIA, {"doc_id": block["doc_id"], "n_bytes": [m[0] for m in made], "media": [m[1] for m in made]})

    return bounded(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Payload and media digests, the number of frames, the clips and the mean grey of each file."""

    def row(doc: int, n: int, data: bytes) -> tuple:
        rate, index = read_index(data)
        frames = decode_frames(data, index)
        payload = frames.tobytes()
        clips = [{"first_frame": a, "last_frame": b, "start_s": round(a / rate, 3), "end_s": round((b + 1) / rate, 3)} for a, b in shots(frames)]
        return doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), len(frames), clips, round(float(frames.mean()), 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "media", 8 << 20):
            rows = [row(*x) for x in zip(block["doc_id"].to_pylist(), block["n_bytes"].to_pylist(), block["media"].to_pylist(), strict=True)]
            yield batch_of(_READ, dict(zip(_READ.names, zip(*rows, strict=True), strict=True)))

    return bounded(media).mapInArrow(run, _DDL)


def clip_rows(read: DataFrame) -> DataFrame:
    """A row per clip."""
    return read.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")
