"""The registered queries themselves, with their production parameters, against brute force over whole given tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from chartloom.llm import registry, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, texts):
    prints = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    of, changed = {i: i for i in texts}, True
    linked = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    while changed:
        changed = False
        for a, b in linked:
            least = min(of[a], of[b])
            changed |= of[a] != least or of[b] != least
            of[a] = of[b] = least
    got = rows(spark, "op1_simhash")
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", of[i]) for i in texts} and len(got) == len(texts)


def test_op4(spark, texts):
    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for i, t in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            pieces[i, k] = (at, len(ids[at : at + 4096]), crc(ids[at : at + 4096]))
    got = rows(spark, "op4_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)
    inside = defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
    for parts in inside.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(inside) <= -(-sum(n for _, n, _ in pieces.values()) // 4096) * 1.02 + 1


def test_op5(spark, texts):
    got = rows(spark, "op5_sharding")
    size = lambda t: len(t.encode()) + 8
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, size(t), zlib.crc32(t.encode())) for i, t in texts.items()} and len(got) == len(texts)
    slots, bytes_of, shards = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        bytes_of[r.shard] += r.size
        shards[texts[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    mean, largest = sum(bytes_of.values()) / 24, max(map(size, texts.values()))
    assert all(abs(b - mean) <= largest for b in bytes_of.values())
    assert {r.law for r in got} == {"bytes"} and all(len(s) == 1 for s in shards.values())


def test_op7(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op7_quality")}
    for i, t in texts.items():
        w = WORD.findall(t)
        seen, repeated = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2)), set()
        for k in range(len(w) - 2):
            if seen[tuple(w[k : k + 3])] > 1:
                repeated |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r.base_failed and r.kept)
    assert len(got) == len(texts) and any(r.kept for r in got.values())


def test_op8(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op8_avi")}
    for i, t in texts.items():
        raw = t.encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert got[i].media_bytes > 0 and len(got[i].media_sha256) == 64 and got[i].feature
    assert len(got) == len(texts)


def test_op9_and_op10(spark, texts):
    tokenizer, start, files, digests = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, set(), set()
    for i in sorted(texts):
        ids = tokenizer.encode(texts[i], add_special_tokens=False).ids
        files.add((i, start, len(ids) + 1, crc([*ids, 2])))
        start += len(ids) + 1
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        digests.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op9_token_files")} == files
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op10_bpe")} == digests


def test_recall_of_the_near_duplicate_stage(spark):
    """All pairs of texts of sf0.1 at a similarity of 0.8 or more, by an exact join on rare shingles; the stage links nine in ten at least."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sets = {}
    for i, t in duckdb.sql("SELECT doc_id, coalesce(text, '') FROM '/root/testdata/sf0.1/documents.parquet'").fetchall():
        w = WORD.findall(t.translate(LOWER))
        if s := frozenset(hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)):
            sets.setdefault(s, i)
    often, by = Counter(x for s in sets for x in s), defaultdict(list)
    for s in sets:
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-len(s) * 4 // 5) + 1]:  # one of so many rarest is shared
            by[x].append(s)
    pairs = {frozenset((a, b)) for found in by.values() for n, a in enumerate(found) for b in found[n + 1 :] if 5 * len(a & b) >= 4 * len(a | b)}
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, budget=4, similarity=0.8).collect()}
    linked = sum(component[sets[a]] == component[sets[b]] for a, b in pairs)
    assert len(pairs) >= 40 and linked >= 0.9 * len(pairs)
