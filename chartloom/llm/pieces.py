"""Cutting texts into pieces that a tokenizer treats alone, and keeping each piece's ids.

Words repeat, so a task encodes each distinct piece once and joins the kept ids of a document's pieces. The cuts are
only made where the tokenizer's own pre-tokenization always cuts, so the ids equal those of the whole text. A tokenizer whose
file has other settings than those that the cuts were made for encodes whole texts. Kept pieces are bounded by bytes.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterable, Sequence
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than a single space: where it occurs, cuts need a look at both neighbours.
_OTHER = ("  ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\n ", " \n")
_WIDE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MARKED = r"(?s)^(?P<stem>.*[\p{L}\p{N}])(?P<marks>[.,;:!?]+)$"
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def spaced(text: str) -> bool:
    """Whether every white space that touches a space is that space alone, between two other characters."""
    return not (any(x in text for x in _OTHER) or text[:1] == " " or text[-1:] == " " or (not text.isascii() and _WIDE.search(text)))


def at_spaces(text: str) -> list[str]:
    """Cut at single spaces between two characters that aren't white space; such a space starts the next piece."""
    return text.split(" ") if spaced(text) else _SAFE.split(text)


_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Letters with or without marks after them, twice at most around a line break: the pre-tokens of such a piece are plain.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)(?:\n([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*))?")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = byte_letters()


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    at = np.ones(total, np.int64)
    some = lengths > 0
    first, start = (ends - lengths)[some], starts[some]
    if total:
        at[first[0]] = start[0]
        at[first[1:]] = start[1:] - (start[:-1] + lengths[some][:-1] - 1)
    return values[np.cumsum(at)]


#: Bytes of kept pieces in a Python worker, and what a piece takes besides its string and its ids.
MOST_KEPT, _ENTRY = 32 << 20, 40


class Kept:
    """Ids by piece: a number for each piece met, and for each number a run of one array. Emptied beyond ``most`` bytes.

    Pieces are kept and looked up as Arrow strings; only those that are new become Python's.
    """

    def __init__(self, most: int = MOST_KEPT) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.seen = {lead: (pa.array([], pa.string()), np.zeros(0, np.int64)) for lead in (True, False)}
        self.held = 0
        self.values, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def ids_of(self, pieces: list[str], lead: bool) -> Iterable[Sequence[int]]:
        """The ids of pieces; ``lead``: with the space that they stand for."""
        raise NotImplementedError

    def numbers(self, pieces: pa.Array, lead: bool) -> np.ndarray:
        """The numbers of distinct pieces."""
        known, own = self.seen[lead]
        at = pc.index_in(pieces, value_set=known)
        new = at.is_null()
        missing = pieces.filter(new)
        found, new = np.append(own, 0)[at.fill_null(len(own)).to_numpy()], new.to_numpy(zero_copy_only=False)
        if len(missing):
            found[new] = self.kept(missing, lead)
            self.seen[lead] = pa.concat_arrays([known, missing]), np.append(own, found[new])
        return found

    def kept(self, missing: pa.Array, lead: bool) -> np.ndarray:
        """New numbers of new pieces."""
        flat, lengths = array("I"), array("q")
        for part in batched(missing.to_pylist(), 4096):
            found = list(self.ids_of(list(part), lead))
            lengths.extend(map(len, found))
            flat.extend(chain.from_iterable(found))
        self.held += pc.sum(pc.binary_length(missing)).as_py() + 4 * len(flat) + _ENTRY * len(missing)
        n, new = self.used + len(flat), self.count + len(lengths)
        if n > len(self.values):
            self.values = np.append(self.values, np.zeros(max(n, len(self.values)), np.uint32))
        if new > len(self.starts):
            self.starts, self.lengths = (np.append(x, np.zeros(max(new, len(x)), np.int64)) for x in (self.starts, self.lengths))
        self.values[self.used : n] = flat
        self.lengths[self.count : new] = lengths
        self.starts[self.count : new] = self.used + np.cumsum(lengths, dtype=np.int64) - np.asarray(lengths)
        first, self.used, self.count = self.count, n, new
        return np.arange(first, new)

    def taken(self, numbers: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and the number of ids of each; docs: pieces of each document."""
        lengths = self.lengths[numbers]
        ends = np.append(0, np.cumsum(lengths))
        return gather(self.values, self.starts[numbers], lengths), np.diff(ends[np.append(0, np.cumsum(docs))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.held > self.most:
            self.clear()
        return self.pieces(pc.fill_null(texts, ""))

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cut at spaces, see ``at_spaces``."""
        cut = pc.split_pattern(texts, " ")
        odd = [(i, at_spaces(x)) for i, x in enumerate(texts.to_pylist()) if not spaced(x)]
        if odd:
            runs, at = [], 0
            for i, own in odd:
                runs += [cut.slice(at, i - at), pa.array([own], cut.type)]
                at = i + 1
            cut = pa.concat_arrays([*runs, cut.slice(at)])
        coded, docs = cut.flatten().dictionary_encode(), pc.list_value_length(cut).to_numpy()
        codes = coded.indices.to_numpy()
        at = np.cumsum(docs) - docs
        is_head = np.zeros(len(codes), bool)
        is_head[at] = True
        words = coded.dictionary
        inner, heads = np.unique(codes[~is_head]), np.unique(codes[at])
        word, marks = np.zeros(len(words), np.int64), np.full(len(words), -1)
        word[inner], marks[inner] = self.stems(words.take(pa.array(inner)))
        first, second = word[codes], marks[codes]
        word[heads] = self.numbers(words.take(pa.array(heads)), False)
        first[at], second[at] = word[codes[at]], -1
        ends = np.cumsum(1 + (second >= 0))
        numbers = np.empty(ends[-1] if len(ends) else 0, np.int64)
        numbers[np.append(0, ends[:-1])[: len(first)]] = first
        numbers[ends[second >= 0] - 1] = second[second >= 0]
        return self.taken(numbers, np.diff(np.append(0, ends)[np.append(0, np.cumsum(docs))]))

    def stems(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of pieces without the marks at their end, and of those marks, or -1: a word with and without a comma is encoded once.

        Letters or digits and a mark after them are never in one pre-token.
        """
        parts = pc.extract_regex(pieces, _MARKED)
        has = pc.is_valid(parts)
        stem = pc.if_else(has, pc.struct_field(parts, "stem"), pieces).dictionary_encode()
        mark = pc.struct_field(parts, "marks").filter(has).dictionary_encode()
        marks = np.full(len(pieces), -1)
        marks[has.to_numpy(zero_copy_only=False)] = self.numbers(mark.dictionary, False)[mark.indices.to_numpy()]
        return self.numbers(stem.dictionary, True)[stem.indices.to_numpy()], marks


class Library(Kept):
    """Plain pieces go straight to the library's merge model; all others through its whole path."""

    lower = False
    #: Fixed values of the format: the settings that the cuts and the plain pieces were made for.
    normalizer = None
    pre_tokenizer = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

    def __init__(self, path: str, most: int = MOST_KEPT) -> None:
        from tokenizers import Tokenizer

        super().__init__(most)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.marks: dict[str, list[int]] = {"": []}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = not any(re.search(r"[\s.,;:!?]", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", []))
        model = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges", "type", "end_of_word_suffix")}
        self.known = plain and spec["model"]["type"] == "BPE" and not any(model.values()) and (spec["normalizer"], spec["pre_tokenizer"]) == (self.normalizer, self.pre_tokenizer) and not spec["post_processor"]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.known:
            return super().encode(texts)
        found = [e.ids for part in batched(pc.fill_null(texts, "").to_pylist(), 256) for e in self.tokenizer.encode_batch_fast(list(part), add_special_tokens=False)]
        return np.fromiter((i for ids in found for i in ids), np.uint32), np.array([len(ids) for ids in found], np.int64)

    def model(self, word: str, before: str = "") -> list[int]:
        """The ids of one pre-token; ``before``: letters of bytes that it begins with."""
        return [t.id for t in self.tokenizer.model.tokenize(before + (word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)))]

    def ids_of(self, pieces: list[str], lead: bool) -> Iterable[Sequence[int]]:
        model, marks, lower = self.model, self.marks, self.lower
        before, line = ("", []) if lower else (_LETTERS[32] * lead, self.model("", _LETTERS[10]))
        matches = [_WORD.fullmatch(p) or _PLAIN.fullmatch(p) for p in pieces]
        others = [" " * lead + p for p, m in zip(pieces, matches, strict=True) if m is None]
        ready = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else ())
        for piece, match in zip(pieces, matches, strict=True):
            if match is None:
                yield next(ready).ids
                continue
            if match.re is _WORD:
                yield model(piece.lower() if lower else piece, before)
                continue
            first, after, second, more = match.groups()
            for x in (after, more or ""):
                if x not in marks:
                    marks[x] = model(x)
            ids = model(first.lower() if lower else first, before) + marks[after]
            yield ids + line + model(second.lower() if lower else second) + marks[more] if second else ids


class WordEncoder(Library):
    """For a tokenizer that lower-cases and drops white space: words between ASCII white space are encoded alone."""

    lower = True
    normalizer = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    pre_tokenizer = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.ascii_split_whitespace(texts)
        coded = cut.flatten().dictionary_encode()
        return self.taken(self.numbers(coded.dictionary, False)[coded.indices.to_numpy()], pc.list_value_length(cut).to_numpy())


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a Python worker."""
    return WordEncoder(path)


@functools.cache
def spaced_encoder(path: str) -> Library:
    return Library(path)
