"""The divergence audit, fill-in-middle and license scans against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import duckdb
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartloom.llm import divergence, infill, licenses, registry
from chartloom.llm.shared import written

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clashing(spark, rows):
    """Rows with columns named like the results and the inner columns of the operators."""
    df = spark.createDataFrame(rows, DOCS)
    for c in ("n", "rank", "item", "value", "part", "term", "share", "block", "form", "frames", "spans", "labels", "score", "low", "high", "chunk", "prefix", "absent", "times"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcÄé漢", k=rng.randint(1, 12))) for _ in range(150)] + ["prefix" + "x" * k for k in range(40)]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "1", "\n", "-"]) for _ in range(rng.randint(0, 60)))
    rows = [(i, text(), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "S1", None])) for i in range(120)]
    odd = [None, "", "   ", "1234 567", "Ab" * 30_000, "z" * 40_000, "q" * 5000 + " tail", "q" * 5000, "q" * 5000 + "1", "İi ſK"]
    rows += [(1000 + i, t, "en", "odd") for i, t in enumerate(odd)]
    rows += [(None, "same same words", "fr", "s1"), (None, "same same words", "fr", "s1"), (7, "same same words", "fr", "s2"), (8, "rare", "xx", "s1"), (9, None, "xx", "s2"), (10, None, None, None)]
    return [*rows, rows[5]]


def divergence_by_hand(rows, least, top):
    docs_of, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for i, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)):
            docs_of[lang, term].add(i)
            counts[lang, source][term] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), d in docs_of.items() if x == lang and len(d) >= least]
        own = {s: {t: counts[lang, s][t] for t in kept} for x, s in groups if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def shares(count, kept=kept):
            n = sum(count.values())
            return {t: 1 + floor(Fraction(10**9 * (count[t] + 1), n + len(kept))) for t in kept}

        f = lambda p, q: floor(Fraction((p - q) ** 2, q))
        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])
            for part, found in (("pair", pairs), ("term", terms[:top])):
                out |= {(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("blocks", [{}, {"block_sources": 2, "block_terms": 16, "first_length": 1}])
def test_divergence_against_brute_force(spark, blocks):
    rows = corpus()
    got = [tuple(r) for r in divergence.audit(clashing(spark, rows), least=3, top=20, **blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == divergence_by_hand(rows, 3, 20)


def test_prefixes_are_counted_by_distinct_documents(spark):
    """Two terms of one document share a prefix, so it has one document; a term is kept whatever its neighbours are."""
    rows = [(1, "abcd abce abcf", "en", "s"), (2, "abcd xyz", "en", "s"), (3, "abcd xyz xyz", "en", "t")]
    terms = divergence.term_table(spark.createDataFrame(rows, DOCS), 3)
    assert {(bytes(r.prefix), r.complete) for r in divergence.frequent_prefixes(terms, 2).collect()} == {(b"ab", False)}
    assert {(bytes(r.prefix), r.complete) for r in divergence.frequent_prefixes(terms, 4, 2).collect()} == {(b"abcd", True), (b"xyz", True)}
    assert [bytes(r.term) for r in divergence.kept_terms(terms).collect()] == [b"abcd"]


def test_tasks_that_write_early_change_nothing(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, DOCS)
    sums = lambda t: {(r.lang, bytes(r.term), r.s): r.n for r in t.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", "term", F.col("c.sources").alias("s")).agg(F.sum("c.counts").alias("n")).collect()}
    early, late = divergence.term_table(docs, 3, block_bytes=200), divergence.term_table(docs, 3)
    assert sums(early) == sums(late)
    assert {tuple(r) for r in divergence.frequent_prefixes(early, 4, 3, most_rows=2).collect()} == {tuple(r) for r in divergence.frequent_prefixes(late, 4).collect()}


def test_an_empty_table_has_no_divergence(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def filled_by_hand(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", "<", "<P", "a<S>b", "<<", "P>S>M>", "é漢🙂 ab12", "x" * 200_000, "ab " * 60_000, "漢字" * 50_000, "\n\n", "<P>" * 3, "S><", "aBc"]


def test_outputs_and_digests_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)] + [(None, "null id here", "en", "s")] * 2
    rows += [(100 + i, "".join(rng.choices("aB <>PSM1é漢\n", k=rng.randint(0, 300))), "en", "s") for i in range(200)]
    df = clashing(spark, rows)
    expected = sorted(repr((i, *filled_by_hand(i, t))) for i, t, *_ in rows)
    filled = infill.fill_in_middle(written(infill.store(df, frame_bytes=1 << 12), "frames"))
    outputs = filled.collect()
    text = lambda r: b"".join(zstandard.decompress(f) for f in r.output).decode()
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, text(r))) for r in outputs) == expected
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    wanted = sorted(repr((i, sha(filled_by_hand(i, t)[4]), sha(t))) for i, t, *_ in rows)
    for got in (infill.digests(filled), infill.digests(infill.stored_and_filled(df))):
        assert sorted(repr((r.doc_id, r.output_sha256, r.restored_sha256)) for r in got.collect()) == wanted
    assert {r.form for r in outputs} == {"plain", "psm", "spm"}


def test_outputs_are_files_that_any_reader_opens(spark):
    long = "word " * 100_000
    row = infill.stored_and_filled(spark.createDataFrame([(3, long, "en", "s")], DOCS), infill_percent=100).collect()[0]
    with zstandard.ZstdDecompressor().stream_reader(b"".join(row.output), read_across_frames=True) as f:
        got = f.read().decode()
    assert len(got) == len(long) + 9 and Counter(got.replace("<P>", "").replace("<S>", "").replace("<M>", "")) == Counter(long)


@given(st.text(max_size=60), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_places_equal_the_units(text, size):
    packer = zstandard.ZstdCompressor()
    n, chars, frames = infill.to_frames(text.encode(), size, packer)
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    named = [dict(zip(("units", "chars", "inside", "data"), f, strict=True)) for f in frames]
    assert (n, chars) == (len(units), len(text))
    for k in range(n + 1):
        place = infill.find(named, n, chars, k)
        before = b"".join(zstandard.decompress(f) for f in infill.between(named, infill.Place(0, 0, 0), place, packer))
        assert before.decode() == "".join(units[:k]) and place.chars == len("".join(units[:k]))


def test_an_empty_table_has_no_outputs(spark):
    assert infill.digests(infill.stored_and_filled(spark.createDataFrame([], DOCS))).count() == 0


LICENSED = [
    "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: GPL-2.0-or-later", "see https://creativecommons.org/licenses/by-sa/3.0/ for more", "under the mit license under the MIT   LICENSE, cc by/nc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "distributed under a 3-Clause BSD license", "the mit licence", "cc by",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published, either version 3 or later", "underthe mit license", "Artistic License 2.0 and the Eclipse Public License v1.0",
]


def scanned_by_hand(text, rules):
    """Every rule at every place of the whole text, without keywords; every detection against every other."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    joined = f" {' '.join(words)} "
    kinds, found = list(licenses.KINDS), []
    for i, r in enumerate(rules):
        pattern = re.compile(f"(?=( {r.pattern} ))", re.ASCII)
        for m in pattern.finditer(joined):
            first = joined.count(" ", 0, m.start())
            found.append((first, first + m.group(1).count(" ") - 1, i))
    surer = lambda i: kinds.index(rules[i].kind)
    stands = [
        (s, e, i) for s, e, i in found
        if rules[i].base or not any((a, b, j) != (s, e, i) and a <= s and b >= e and surer(j) <= surer(i) and ((a, b) != (s, e) or (surer(j), j) < (surer(i), i)) for a, b, j in found)
    ]
    return len(words), sorted((s, e, rules[i].label, rules[i].kind, rules[i].base) for s, e, i in stands)


def base_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_scans_against_brute_force(spark):
    rng = random.Random(2)
    filler = "the of a license mit apache gnu public cc by nc sa version 2 3 under terms licensed 4 0 or later é".split()
    texts = [*LICENSED, None, "", "   ", " ".join(LICENSED), " ".join(LICENSED * 2)] + [" ".join(rng.choices(filler, k=rng.randint(1, 60))) for _ in range(60)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, LICENSED[0], None, None)] * 2
    got = licenses.scan(clashing(spark, rows)).collect()
    rules = licenses.rules()
    assert len(rules) > 300 and len({r.pattern for r in rules}) > 300
    assert sorted(repr((r.doc_id, r.n_words, sorted(tuple(s) for s in r.spans))) for r in got) == sorted(repr((i, *scanned_by_hand(t, rules))) for i, t, *_ in rows)


def test_every_rule_has_its_keywords_and_fits_the_window():
    for r in licenses.rules():
        assert r.keywords and len(r.pattern.split()) <= licenses.WINDOW
        longest = re.sub(r"\(\?:\\S\+ \)\{\d+,(\d+)\}|\(\?: \\S\+\)\{\d+,(\d+)\}\??", lambda m: "w " * int(m[1] or m[2]), r.pattern)
        assert len(re.split(r" +", longest)) <= licenses.WINDOW


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_slices_of_a_text_change_nothing(most):
    scanner = licenses.Scanner(licenses.rules())
    text = (" ".join(LICENSED) + " some words in between " * 9) * 3
    n, *found = scanner.scan(text.encode(), most)
    whole, *expected = scanner.scan(text.encode())
    assert n == whole and all((a == b).all() for a, b in zip(found, expected, strict=True)) and len(found[0]) > 20


def test_license_query_keeps_the_base_of_every_document(spark):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in registry.op13_licenses(spark, SF).collect()}
    rules = licenses.rules()
    for i, text in texts:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if r.labels or "licen" in text.lower():
            spans = scanned_by_hand(text, rules)[1]
            assert r.labels == ",".join(sorted({s[2] for s in spans})) and r.score == max((licenses.KINDS[s[3]] for s in spans), default=0)


def test_planted_phrases_reach_the_columns(spark):
    rows = [(1, "Released under the MIT License. x cc-by-nc; Under the mit LICENSE", "en", "s"), (2, None, "en", "s")]
    a, b = licenses.summary(licenses.scan(spark.createDataFrame(rows, DOCS))).orderBy("doc_id").collect()
    assert (a.n_words, a.n_base, a.first_word, a.last_word, a.base_labels, a.labels, a.score) == (13, 3, 1, 9, "cc-by-nc,mit", "cc-by-nc,mit", 0.9)
    assert tuple(b) == (2, 0, 0, None, None, "", "", 0.0)
    assert licenses.summary(licenses.scan(spark.createDataFrame([], DOCS))).count() == 0


@pytest.mark.parametrize("name", ["op11_divergence", "op12_infill"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, expected = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*sorted(got.columns)).collect()) == sorted(map(repr, expected.project(", ".join(sorted(expected.columns))).fetchall()))
