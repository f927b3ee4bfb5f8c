"""Byte-pair encoding and decoding of whole texts with a byte-level vocabulary, without a shuffle.

Method (pair occurrence index): a task gathers the distinct pieces of a block of texts that it hasn't met yet and lays
all their symbols out in one array with links to both neighbours. An index maps each adjacent pair that has a rank to all
its positions. Active ranks are applied in ascending order; merging a pair at all its positions makes new pairs with the
neighbours, whose lists are extended. A merged symbol can only take part in merges of a higher rank, so one ascending
pass is enough. Positions whose symbols changed meanwhile are dropped when their list comes up.

Edge cases: rows that share a doc_id stay apart and an empty table gives no rows; other columns are ignored; null is an empty text (no ids); a special token's string within a text gives that token's id, as in the
library; the vocabulary's ids decode to exact bytes, so texts of any bytes and length come back whole.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.pieces import MOST_KEPT, Kept, Library, byte_letters, gather
from chartloom.llm.shared import batch_of, blocks, bounded

_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: Fixed values of the format: the pre-tokenization pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """Ids of bytes, ranks and results of merges, and the bytes of each id, read from a tokenizer's JSON file.

    A file with other settings than those that pre-tokenization and cuts are made for raises ValueError.
    """

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges", "type", "end_of_word_suffix")}
        odd = [t["content"] for t in spec.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"[\s.,;:!?]", t["content"])]
        if spec["model"]["type"] != "BPE" or any(model.values()) or spec["normalizer"] or spec["pre_tokenizer"] != Library.pre_tokenizer or spec["post_processor"] or odd:
            raise ValueError("only byte-level vocabularies without normalizer, with the usual pre-tokenization and plain special tokens are known")
        ids, letters = spec["model"]["vocab"], {c: b for b, c in byte_letters().items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        self.left, self.right = ([ids[m[i]] for m in merges] for i in (0, 1))
        self.made = [ids[a + b] for a, b in merges]
        self.rank = {a << 20 | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in ids.items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        wanted = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], -1)

    def pretokens(self, piece: str) -> list[str | int]:
        parts = self.split_special.split(piece) if self.split_special and any(s in piece for s in self.special) else [piece]
        return [w for p in parts for w in ([self.special[p]] if p in self.special else self.words.findall(p))]

    def merged(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(lengths)
        first = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(first)
        links = np.arange(n + 2, dtype=np.int32)
        links[ends] = n  # the position after a word's last symbol
        after = array("i", np.append(links[1 : n + 1], n).astype(np.int32).tobytes())
        links = np.arange(-1, n + 1, dtype=np.int32)
        links[ends - lengths] = n
        before = array("i", links.tobytes())
        symbol = array("i", np.append(first, -1).astype(np.int32).tobytes())

        inside = np.ones(max(n, 1), bool)
        inside[ends - 1] = False
        at = np.flatnonzero(inside[:n])
        rank = self.ranks(first[at], first[at + 1])
        at, rank = at[rank >= 0], rank[rank >= 0]
        by = np.argsort(rank, kind="stable")
        at, rank = at[by], rank[by]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        index: dict[int, list[int]] = {int(x[0]): p.tolist() for x, p in zip(np.split(rank, cuts), np.split(at, cuts), strict=True) if len(p)}
        active = sorted(index)
        rank_of = self.rank.get
        while active:
            r = heapq.heappop(active)
            positions, a, b, c = index.pop(r), self.left[r], self.right[r], self.made[r]
            if a == b:
                positions.sort()  # of overlapping pairs the left one is merged
            for p in positions:
                q = after[p]
                if symbol[p] != a or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = c, -1
                after[p] = f = after[q]
                if f != n:
                    before[f] = p
                    if (new := rank_of(c << 20 | symbol[f])) is not None:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heapq.heappush(active, new)
                if (g := before[p]) != n and (new := rank_of(symbol[g] << 20 | c)) is not None:
                    if new in index:
                        index[new].append(g)
                    else:
                        index[new] = [g]
                        heapq.heappush(active, new)
        last = np.frombuffer(symbol, np.int32)[:n]
        stands = last >= 0
        counts = np.add.reduceat(stands.astype(np.int64), ends - lengths) if n else []
        return np.split(last[stands], np.cumsum(counts)[:-1])


class Pieces(Kept):
    """The ids of pieces by the merges above, and the strings that ids stand for as runs of one array of bytes."""

    def __init__(self, path: str, most: int = MOST_KEPT) -> None:
        super().__init__(most)
        self.vocabulary = v = Vocabulary(path)
        top = max(v.bytes) + 1
        self.decimal = self.runs([f"{i},".encode() for i in range(top)])
        self.decoded = self.runs([v.bytes.get(i, b"") for i in range(top)])

    @staticmethod
    def runs(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in strings], np.int64)
        return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths

    def ids_of(self, pieces: list[str], lead: bool) -> Iterator[list[int]]:
        v = self.vocabulary
        for part in batched(pieces, 50_000):
            cut = [v.pretokens(" " * lead + p) for p in part]
            words = list({w for c in cut for w in c if isinstance(w, str)})
            ids = dict(zip(words, (x.tolist() for x in v.merged(words)), strict=True)) if words else {}
            for c in cut:
                yield [i for w in c for i in ([w] if isinstance(w, int) else ids[w])]


def strings(ids: np.ndarray, counts: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray], most: int = 1 << 18) -> Iterator[bytes]:
    """For each document the strings of its ids, joined. About ``most`` ids are looked up at once."""
    values, starts, lengths = runs
    ends = np.append(0, np.cumsum(counts))
    first = 0
    while first < len(counts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        part = ids[ends[first] : ends[last]]
        own = lengths[part]
        joined, cuts = gather(values, starts[part], own).tobytes(), np.append(0, np.cumsum(own))[ends[first : last + 1] - ends[first]].tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield joined[a:b]
        first = last


@functools.cache
def pieces_of(path: str) -> Pieces:
    """One for all tasks of a Python worker."""
    return Pieces(path)


def encode_and_decode(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """Per document: n_tokens, SHA-256 of the ids in decimal joined by commas, and of the decoded text; ids on demand."""
    schema = _OUT.append(pa.field("ids", pa.list_(pa.int32()))) if keep_ids else _OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces_of(vocabulary)
        for block in blocks(batches, "text", 4 << 20):
            ids, counts = known.encode(block["text"])
            columns = {
                "doc_id": block["doc_id"],
                "n_tokens": counts,
                "ids_sha256": [hashlib.sha256(x[:-1]).hexdigest() for x in strings(ids, counts, known.decimal)],
                "decoded_sha256": [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in strings(ids, counts, known.decoded)],
            }
            if keep_ids:
                columns["ids"] = [x.tolist() for x in np.split(ids.astype(np.int32), np.cumsum(counts)[:-1])]
            yield batch_of(schema, columns)

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return bounded(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, out)
