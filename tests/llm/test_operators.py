"""Each operator against a brute-force version, and its edge cases: nulls, empty and long texts, ties, repeats, no rows."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chartloom.llm import avi, bpe, langid, linedup, packing, pieces, quality, registry, sharding, simhash, tokenfiles, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "  a  b", " lead", "x  \n y\t z", "a b", "foo<|endoftext|>bar <|endoftext|>", "aaaaaaa aaaa aaaaa", "it's  we'll 123 !!??", "\n\n\n", "é ü 漢字 　x", "a\x1fb c\x1c d", "a\nb\n\nc d.\nEf, g.\n", "ÀÉ Straße.\nÀb", "word " * 3000]


def words_of(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 8))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts = list(ODD)
    for _ in range(60):
        texts.append("\n".join(sentence(rng.randint(3, 30)) for _ in range(rng.randint(1, 8))))
    passage = "\n".join(sentence(20) for _ in range(4))
    for _ in range(12):
        base = rng.choice(texts[len(ODD) :]).split("\n")
        texts.append("\n".join([*base[:1], passage, *base[1:]]))
    texts += [texts[20], texts[20], texts[21] + " x"]
    texts.append("same line here\n" * 40)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[20]], DOCS).withColumn("rank", F.lit(1)).withColumn("pos", F.lit("clash")).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def components(nodes, linked):
    of = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            least = min(of[a], of[b])
            if of[a] != least or of[b] != least:
                of[a] = of[b] = least
                changed = True
    return of


# near duplicates


def test_fingerprints_and_components(docs, empty):
    import xxhash

    def plain(text):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words_of(text)]
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = by_id(simhash.near_duplicates(docs, 4, 4, None).select("doc_id", simhash.hex_digits("fp").alias("fp"), "component_id"))
    expected = {r.doc_id: plain(r.text) for r in docs.collect()}
    assert {k: f"{v:016x}" for k, v in expected.items()} == {k: r.fp for k, r in got.items()}
    ids = sorted(expected)
    linked = [(a, b) for a, b in product(ids, ids) if a < b and (expected[a] ^ expected[b]).bit_count() <= 4]
    of = components(ids, linked)
    assert {k: r.component_id for k, r in got.items()} == of
    assert simhash.near_duplicates(empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(2, 400))
def test_trie_walk_finds_every_component(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 4, np.uint64)
    keys = [int(c) for c in centres]
    for _ in range(n):
        x = int(rng.choice(centres)) if rng.random() < 0.7 else int(rng.integers(0, 1 << 63))
        for bit in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= 1 << int(bit)
        keys.append(x)
    keys = np.unique(np.array(keys, np.uint64))
    n = len(keys)
    pairs = [(a, b) for a in range(n) for b in np.flatnonzero(np.bitwise_count(keys ^ keys[a]) <= 4).tolist()]
    assert simhash.walk(keys, 0, 0, 4, 4).tolist() == list(components(range(n), pairs).values())
    walked = simhash.walk(keys, 0, 0, 2, 4).tolist()  # the first half decides; the other walk finds the other pairs
    assert all(walked[a] == walked[b] for a, b in pairs if (int(keys[a] ^ keys[b]) >> 32).bit_count() <= 2)


def test_links_are_whole_when_pairs_of_nodes_are_walked_down_further(spark):
    rng = np.random.default_rng(3)
    keys = {int(rng.integers(0, 1 << 62)) for _ in range(100)}
    centre, high = 0x0123456789ABCDEF, 0x0F0F0F0F << 32
    for bits in rng.integers(0, 64, (300, 3)):  # many within a few bits of each other
        keys.add(centre ^ (1 << int(bits[0] % 62)) ^ (1 << int(bits[1] % 62)))
    keys |= {high | int(x) for x in rng.integers(0, 1 << 32, 400)}  # many under one prefix of 32 bits
    keys |= {k ^ 0b10011 for k in sorted(keys)[::7]} | {k ^ (0b111 << 40) for k in sorted(keys)[::5]}
    rows = spark.createDataFrame([(k,) for k in keys], "fp long")
    got = {r.node: r.component for r in simhash.components(simhash.links(rows, 4, subtree=16)).collect()}
    ids = sorted(keys)
    array = np.array(ids, np.uint64)
    pairs = [(a, ids[j]) for a in ids for j in np.flatnonzero(np.bitwise_count(array ^ np.uint64(a)) <= 4)]
    assert {k: got.get(k, k) for k in ids} == components(ids, pairs)


def test_rows_without_an_id_or_with_a_shared_one_keep_their_own_component(spark):
    rows = [(None, "one two three four five six", "en", "s", 0), (None, "seven eight nine ten eleven twelve", "en", "s", 0), (5, "one two three four five six", "en", "s", 0)]
    rows += [(7, "red orange yellow green blue", "en", "s", 0), (7, "ant bee cat dog eel", "en", "s", 0), (3, "ant bee cat dog eel", "en", "s", 0)]
    for similarity in (None, 0.8):
        got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 0, similarity).collect() if r.doc_id is not None)
        assert got == [(3, 3), (5, 5), (7, 3), (7, 7)]
        found = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 0, similarity)
        assert sorted(found.filter("doc_id IS NULL").select(F.coalesce("component_id", F.lit(-1))).toPandas().iloc[:, 0]) == [-1, 5]


def test_similar_texts_are_linked(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = [(0, " ".join(base), "en", "s", 0)]
    for i in range(1, 30):
        w = list(base)
        for j in rng.sample(range(400), 4):
            w[j] = "changed%d" % rng.randint(0, 10**6)
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(i, " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(300)), "en", "s", 0) for i in range(30, 60)]
    got = by_id(simhash.near_duplicates(spark.createDataFrame(rows, DOCS)))
    assert {i: got[i].component_id for i in got} == {i: 0 if i < 30 else i for i in range(60)}


def shingle_sets(texts):
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]


def similar_components(texts, similarity=0.8):
    sets, n = shingle_sets(texts), len(texts)
    jaccard = lambda a, b: len(a & b) / len(a | b)
    return components(range(n), [(i, j) for i in range(n) for j in range(i + 1, n) if jaccard(sets[i], sets[j]) >= similarity])


def linked_by_similarity(spark, texts, chunk):
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    prints = simhash.written(simhash.fingerprints(rows, 5, True), "prints")
    none = spark.createDataFrame([], "a long, b long")
    found = simhash.components(simhash.similar_links(rows, prints, none, 5, 0.8, chunk))
    named = prints.select("doc_id", simhash._set_node(F.col("sid")).alias("node")).join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("c"))
    first, of = {}, {r.doc_id: r.c for r in named.collect()}
    for i in sorted(of):
        first.setdefault(of[i], i)
    return {i: first[of[i]] for i in of}


def chain(rng, length, words, step):
    """Texts that drift: each has ``step`` more words changed than the last."""
    text = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    places, out = rng.sample(range(0, words - 5, 5), (length - 1) * step), [" ".join(text)]
    for i in range(length - 1):
        for at in places[i * step : (i + 1) * step]:
            text[at] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(text))
    return out


def test_similar_chains_and_large_buckets_are_linked_as_by_brute_force(spark):
    rng = random.Random(3)
    texts = [t for _ in range(12) for t in chain(rng, 6, 500, 8)]  # 0.85 from one to the next, 0.73 over two
    base = chain(rng, 2, 300, 1)[0].split()
    for _ in range(560):  # a bucket over 512, of copies that drift apart
        w = list(base)
        for at in rng.sample(range(300), rng.randint(0, 12)):
            w[at] = f"y{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    expected = similar_components(texts)
    for chunk in (64, 1024):
        assert linked_by_similarity(spark, texts, chunk) == expected


def test_similarity_is_judged_by_the_sets_of_shingles(spark):
    rng = random.Random(8)
    texts, wanted = [], {}
    for changes, linked in ((11, True), (14, False)):  # 504 shingles, 5 changed by each: 0.803 and 0.756
        for _ in range(30):
            wanted |= {len(texts): len(texts), len(texts) + 1: len(texts) + 1 - linked}
            first, last = chain(rng, 2, 508, changes)
            texts += [first, last]
    assert similar_components(texts) == wanted
    assert linked_by_similarity(spark, texts, 1024) == wanted


def test_tasks_hold_two_blocks_of_a_bucket_and_every_pair_meets(spark):
    label = lambda i: 7 if i < 200 else i
    nodes = spark.createDataFrame([(i, label(i), [1]) for i in range(600)], "sid long, label long, bands array<long>")
    groups = {}
    for r in simhash.dealt_blocks(nodes, 32).collect():
        groups.setdefault((r.i, r.j), []).append((r.sid, r.block))
    assert max(map(len, groups.values())) < 4 * 32
    met = {frozenset((a, b)) for (i, j), g in groups.items() for a, x in g for b, y in g if a != b and (x, y) == (i, j)}
    assert all(frozenset((a, b)) in met for a in range(600) for b in range(a) if label(a) != label(b))


# language


def test_language_follows_the_text_and_its_surroundings(spark, empty):
    english, german = "the cat and the dog went over there with that", "der hund und die katze gingen dort zusammen hinüber"
    rows = [(i, (english if i % 2 else german) * (1 + i % 3), "en" if i % 2 else "de", f"s{i % 2}", 0) for i in range(80)]
    rows += [(100, english, "de", "s1", 0), (101, None, "en", "s1", 0), (102, "", None, None, 0), (103, "zu", "de", "s0", 0), (104, english, None, None, 0)]
    got = by_id(langid.identify(langid.document_evidence(spark.createDataFrame(rows, DOCS))).withColumnRenamed("id", "doc_id"))
    assert all(got[i].language == ("en" if i % 2 else "de") and got[i].kept for i in range(80))
    assert (got[100].language, got[103].language, got[104].language) == ("en", "de", "en")
    assert not got[101].kept and not got[102].kept
    assert langid.identify(langid.document_evidence(empty)).count() == 0


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fitted = langid.fit(langid.document_evidence(docs.filter("doc_id % 2 = 0")))
    blind = langid.document_evidence(docs.filter("doc_id % 2 = 1")).withColumn("truth", F.col("declared")).withColumn("declared", F.lit(None).cast("string"))
    got = langid.identify(blind, fitted).join(blind.select("id", "truth"), "id")
    assert got.agg(F.avg((F.col("language") == F.col("truth")).cast("int"))).first()[0] > 0.97


# archives


def test_archives_come_back_as_one_ordered_index(spark):
    body = "x" * 150
    rows = [(1, "http://b.example.org/a?x=1#f", body), (5, "http://www.a.example.org/", body), (3, None, None), (4, "no address", "short"), (2, "http://a.example.org/\nz é", "short"), (9, "http://a.example.org", body), (9, "http://a.example.org", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("ts", F.col("page_id") * 1000).repartition(3)
    for fan_in in (2, 64):
        got = warc.capture_index(pages, fan_in=fan_in).orderBy("range_id", "position").collect()
        assert [(r.url_key, r.ts, r.page_id) for r in got] == sorted((r.url_key, r.ts, r.page_id) for r in got)
        assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter([(1, "response", None, 150), (5, "revisit", 1, 150), (9, "revisit", 1, 150), (9, "revisit", 1, 150), (3, "response", None, 0), (4, "response", None, 5), (2, "response", None, 5)])
        assert {r.payload_digest for r in got} == {hashlib.sha256(x.encode()).hexdigest() for x in (body, "short", "")}
    assert warc.capture_index(pages.limit(0)).count() == 0


def test_url_keys_agree_in_both_forms(spark):
    urls = ["http://www.B.example.org/a?x=1#f", "https://u:p@x/", "plain", "", "http://h:80", "ftp://a.b/c d"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.url_key(F.col("url")).alias("k")).collect()
    assert [r.k for r in rows] == [warc.surt(r.url) for r in rows]


def test_members_are_streamed(tmp_path):
    import io

    parts = [b"a" * 10, b"", bytes(range(256)) * 9000]
    data = b"".join(gzip.compress(p) for p in parts)
    assert [x for _, x in warc.members(io.BytesIO(data))] == parts


# packing


def check_packing(rows, lengths, capacity):
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) <= 1.02 * -(-sum(lengths) // capacity) + 2


def test_packing_places_every_piece(docs, empty):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    expected = {}
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            expected[r.doc_id, k] = (at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes()))
    got = packing.pack_documents(docs, WORD_BPE, capacity=256).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expected
    check_packing(got, [r.length for r in got], 256)
    assert packing.pack_documents(empty, WORD_BPE).count() == 0


def test_sequences_hold_the_ids(docs):
    found = packing.token_pieces(docs.dropDuplicates(["doc_id"]), WORD_BPE, 256, keep_ids=True).cache()
    placed = packing.pack(found, 256)
    whole = {r.sequence_id: r for r in packing.packed_sequences(found, placed).collect()}
    for r in placed.collect():
        part = whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)]
        assert zlib.crc32(bytes(part)) == r.ids_crc32


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200))
def test_best_two_fit_uses_each_item_once(lengths):
    bins = packing.best_two_fit(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)


# shards


def test_shards_are_even_and_keep_small_groups(spark, empty):
    rows = [(i, f"text {i % 700} " * (1 + i % 37), "en", "s", 0) for i in range(4000)] + [(10_000 + i, "hot text of a third", "en", "s", 0) for i in range(3000)] + [(20_000, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    got = sharding.shard_documents(frame, 8).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    texts = {r[0]: r[1] for r in rows}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    sums, slots, groups = Counter(), {}, {}
    for r in got:
        sums[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert set(sums) == set(range(8)) and max(sums.values()) <= 1.04 * min(sums.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for t, s in groups.items() if t != "hot text of a third")
    assert sharding.shard_documents(empty, 8).count() == 0


def test_groups_that_fit_a_shard_stay_whole_at_any_size(spark):
    rows = [(None, f"group {g} " * 9, "en", "s", 0) for g in range(12) for _ in range(10 * 2**g // 8 + 1)] + [(7, f"single {i}", "en", "s", 0) for i in range(3000)]
    got = sharding.shard(sharding.written(sharding.keyed(spark.createDataFrame(rows, DOCS)), "records"), 4, range_rows=500).collect()
    assert len(got) == len(rows)
    sums, slots, groups = Counter(), {}, {}
    for r in got:
        sums[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(r.text_crc32, Counter())[r.shard] += r.size
    share = sum(sums.values()) / 4
    assert max(sums.values()) <= 1.03 * share and min(sums.values()) >= 0.9 * share
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    cut = [sum(g.values()) for g in groups.values() if len(g) > 1]
    assert all(size > share / 4 for size in cut)  # only groups that no shard had room for


# language against plain Bayes


def plain_languages(rows, languages, table, weight=60.0, kappa=20.0):
    """rows: id, text, declared, suffix, host, domain."""
    k, n = len(languages), len(rows)
    grams = [langid.trigrams([r[1]])[0] for r in rows]
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    ll = [np.round(table.T[g].astype(np.float32).sum(axis=0, dtype=np.float64) / max(1, len(g)) * (len(g) / (1 + len(g) / weight)), 6) for g in grams]
    q = [soft(x) for x in ll]
    some = [len(g) > 0 for g in grams]
    add = lambda keep: sum((q[i] for i in range(n) if some[i] and keep(rows[i])), np.zeros(k))
    whole = add(lambda r: True)
    prior = (whole + 1) / (whole.sum() + k)
    out = {}
    for i, r in enumerate(rows):
        known = lambda x: x[2] if x[2] in languages else x[2] is None
        by_declared = np.log((add(lambda x: known(x) == known(r)) + 0.5) / (whole + 1))
        by_suffix = np.log((add(lambda x: x[3] == r[3]) + 0.5) / (whole + 1))
        of_domain = (add(lambda x: x[5] == r[5]) + kappa * prior) / (sum(s and x[5] == r[5] for s, x in zip(some, rows, strict=True)) + kappa)
        mine = q[i] if some[i] else np.zeros(k)
        of_host = np.maximum(add(lambda x: (x[4], x[5]) == (r[4], r[5])) - mine, 0)
        count = sum(s and (x[4], x[5]) == (r[4], r[5]) for s, x in zip(some, rows, strict=True)) - some[i]
        p = soft(np.log((of_host + kappa * of_domain) / (count + kappa)) + ll[i] + by_declared + by_suffix)
        out[r[0]] = (languages[int(p.argmax())], round(float(p.max()), 4))
    return out


def test_fusion_equals_plain_bayes(spark):
    rng = random.Random(4)
    said = {"en": "the cat and the dog went over there with that".split(), "de": "der hund und die katze gingen dort zusammen hin".split(), "none": "le chat et le chien sont allés là avec ça".split()}
    rows = []
    for i in range(90):
        true = rng.choice(list(said))
        text = " ".join(rng.choices(said[true], k=rng.randint(1, 12)))
        rows.append((i, rng.choice([text, text, text, None, ""]), rng.choice([true, true, "en", None, "xx" if i > 80 else true]), rng.choice(["com", true, None]), rng.choice(["a.b", f"{true}.b", None]), rng.choice(["b", None])))
    evidence = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string, domain string")
    languages, table = langid.fit(evidence.filter("declared IS NULL OR declared <> 'xx'"))
    assert languages == ["de", "en", "none"]
    got = {r.id: (r.language, round(r.posterior, 4)) for r in langid.identify(evidence, (languages, table)).collect()}
    expected = plain_languages(rows, languages, table)
    assert all(got[i][0] == expected[i][0] and abs(got[i][1] - expected[i][1]) < 2e-4 for i in got), [(got[i], expected[i]) for i in got if got[i] != expected[i]][:3]
    assert langid.identify(evidence.limit(0), (languages, table)).count() == 0
    assert langid.identify(evidence.limit(0)).count() == 0


def test_every_declared_language_takes_part(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}q{j}" for j in range(30)), f"l{i}-XY", "s", 0) for i in range(70)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    languages, _ = langid.fit(langid.document_evidence(docs))
    assert languages == sorted(f"l{i}" for i in range(70))
    with pytest.raises(ValueError, match="declared languages"):
        langid.fit(langid.document_evidence(docs), most_languages=69)


# line deduplication


def brute_line_dedup(docs, least):
    cut = {}
    lines = {k: [(p, x.strip(" \t\n\x0b\f\r"), len(words_of(x))) for p, x in enumerate((t or "").split("\n")) if words_of(x)] for k, t in docs.items()}
    seen = {}
    for k in sorted(lines):
        s = lines[k]
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                if sum(x[2] for x in s[i:j]) >= least:
                    run = tuple(x[1] for x in s[i:j])
                    if run in seen:
                        cut.setdefault(k, set()).update(range(i, j))
                    else:
                        seen[run] = (k, i)
    out = {}
    for k, t in docs.items():
        gone, marked, s = set(), cut.get(k, set()), lines[k]
        for i in marked:
            gone |= set(range(s[i][0], s[i + 1][0] if i + 1 in marked else s[i][0] + 1))
        out[k] = t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
    return out


def test_line_runs_against_brute_force(spark, docs, empty):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a b", "c", "d e f", "", "  ", "g"]) for _ in range(rng.randint(0, 9))), "en", "s", 0) for i in range(60)]
    for frame, least in ((spark.createDataFrame(rows, DOCS), 5), (docs, 50)):
        texts = {r.doc_id: r.text for r in frame.collect()}
        got = linedup.dedup_lines(frame, least)
        assert set(frame.columns) < set(got.columns)
        assert {r.doc_id: r.text for r in got.collect()} == brute_line_dedup(texts, least)
    assert linedup.dedup_lines(empty).count() == 0
    clash = linedup.dedup_lines(docs.withColumn("Removed_Lines", F.lit("theirs")).withColumn("removed_words", F.lit(-1)))
    assert clash.columns[-2:] == ["removed_lines", "removed_words"] and clash.filter("removed_lines < 0 OR removed_words < 0").count() == 0


def test_line_dedup_runs_no_python(docs, capsys):
    linedup.dedup_lines(docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


# quality


def test_statistics_against_brute_force(docs):
    got = by_id(quality.statistics(docs))
    for r in docs.collect():
        text, w = r.text or "", words_of(r.text)
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for x in text.split("\n"):
            if words_of(x):
                dup += x in seen
                seen.add(x)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(text.count(c) for c in quality.SYMBOLS), dup, len(covered))


def test_rules_learn_from_labels(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [f"word{rng.randint(0, 10**5)}" + ("#%" if bad and rng.random() < 0.3 else "") for _ in range(80)]
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 0 if bad else 1))
    rows += [(1000, "too short", "en", "s", 0), (1001, None, None, None, None)]
    got = by_id(quality.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int")))
    assert sum(got[i].kept == (i % 4 != 0) for i in range(600)) >= 595
    assert got[1000].base_failed and not got[1000].kept and not got[1001].kept
    none = quality.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.filter("kept").count() == 600
    assert quality.judge(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# media


def test_media_round_trip(docs, empty):
    media = avi.write_media(docs).cache()
    got = by_id(avi.read_media(media))
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert g.frames == len(payload) // 576 and g.clips[0].first_frame == 0 and g.clips[-1].last_frame == g.frames - 1
    assert avi.clip_rows(avi.read_media(media)).count() >= docs.count()
    assert avi.read_media(avi.write_media(empty)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=1, max_size=2000))
def test_frames_hold_any_bytes(data):
    payload = data + b"\xff" * (-len(data) % 576)
    media = avi.write_avi(payload)
    assert avi.decode_frames(media, avi.read_index(media)[1]).tobytes() == payload


def test_shots_are_cut_where_frames_change():
    frames = np.concatenate([np.full((5, 24, 24), 10, np.uint8), np.full((4, 24, 24), 200, np.uint8)])
    assert avi.shots(frames) == [(0, 4), (5, 8)]


# tokens


def test_encoders_equal_the_library():
    texts = pa.array([*ODD, "Café naïve, über. Groß!\nNeu", "x" * 5000])
    for encoder, path in ((pieces.WordEncoder(WORD_BPE), WORD_BPE), (pieces.Library(BYTE_BPE), BYTE_BPE), (bpe.Pieces(BYTE_BPE), BYTE_BPE)):
        ids, counts = encoder.encode(texts)
        whole = Tokenizer.from_file(path).encode_batch([x or "" for x in texts.to_pylist()], add_special_tokens=False)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in whole]


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t.,'aAbeéÉ1½漢 　\x1f\x85"), st.characters(codec="utf-8")), max_size=40))
def test_any_text_is_encoded_alike(text):
    for encoder, path in ((_WORDS, WORD_BPE), (_BYTES, BYTE_BPE), (_OWN, BYTE_BPE)):
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == _TOKENIZERS[path].encode(text, add_special_tokens=False).ids
    assert b"".join(bpe.strings(ids, np.array([len(ids)]), _OWN.decoded)).decode() == text


_WORDS, _BYTES, _OWN = pieces.WordEncoder(WORD_BPE), pieces.Library(BYTE_BPE), bpe.Pieces(BYTE_BPE)
_TOKENIZERS = {p: Tokenizer.from_file(p) for p in (WORD_BPE, BYTE_BPE)}


def test_token_files_come_back(docs, empty):
    unique = docs.dropDuplicates(["doc_id"]).repartition(3)
    got = by_id(tokenfiles.token_files(unique, BYTE_BPE))
    at = 0
    for r in sorted(unique.collect(), key=lambda r: r.doc_id):
        ids = np.array([*_TOKENIZERS[BYTE_BPE].encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenfiles.token_files(empty, BYTE_BPE).count() == 0


def test_token_files_keep_null_and_shared_ids(spark):
    rows = [(None, "no id", "en", "s", 0), (None, None, "en", "s", 0), (-1, "minus one", "en", "s", 0)] + [(5, f"text {i % 7}", "en", "s", 0) for i in range(40)] + [(6, "last", "en", "s", 0)]
    got = sorted(tokenfiles.token_files(spark.createDataFrame(rows, DOCS).repartition(3), BYTE_BPE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -1, *[5] * 40, 6]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    crc = lambda t: zlib.crc32(np.array([*_TOKENIZERS[BYTE_BPE].encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((r[0], crc(r[1])) for r in rows)


def test_archives_keep_null_ids(spark):
    both, own = "<p>shared</p>" * 20, "<p>without an id</p>" * 20
    rows = [(None, "http://a.b/1", both, 5), (3, "http://a.b/2", both, 6), (None, "http://a.b/3", own, 7), (None, None, own, 8), (-1, "http://a.b/4", None, 9)]
    index = warc.capture_index(spark.createDataFrame(rows, "page_id long, url string, html string, ts long")).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in index) == Counter(
        [(None, "revisit", 3, len(both)), (3, "response", None, len(both)), (None, "response", None, len(own)), (None, "response", None, len(own)), (-1, "response", None, 0)]
    )


def test_bpe_digests(docs, empty):
    got = by_id(bpe.encode_and_decode(docs, BYTE_BPE, keep_ids=True))
    for r in docs.collect():
        e = _TOKENIZERS[BYTE_BPE].encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.ids) == (len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), e)
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_and_decode(empty, BYTE_BPE).count() == 0


# queries


def test_every_query_runs(spark):
    for name, query in registry.queries().items():
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name


def test_files_are_as_wide_as_the_largest_id(spark, tmp_path):
    import json

    spec = json.loads(open(BYTE_BPE, encoding="utf-8").read())
    spec["added_tokens"][0]["id"] = 70_000
    spec["model"]["vocab"]["<|endoftext|>"] = 70_000
    (tmp_path / "wide.json").write_text(json.dumps(spec), encoding="utf-8")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert tokenfiles.id_width(BYTE_BPE, 2) == tokenfiles.id_width(BYTE_BPE, 65_535) == 2 and tokenfiles.id_width(BYTE_BPE, 65_536) == tokenfiles.id_width(str(tmp_path / "wide.json"), 2) == 4
    for end in (2, 65_535, 65_536, 70_001):
        got = {r.doc_id: r for r in tokenfiles.token_files(docs, BYTE_BPE, end).collect()}
        assert got[2].n_tokens == 1 and got[2].ids_crc32 == zlib.crc32(np.array([end], "<u4").tobytes()) and got[2].start == got[1].n_tokens
