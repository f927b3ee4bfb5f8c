"""License scans: which licenses a text names, grants or quotes, and where.

Method (ordered signature rules): hundreds of regular expressions over the text's words, each with keywords that it can't match
without. A rule runs only over texts that have all its keywords. Rules are ordered by kind, the surest first; a detection that lies
within one of the same or a surer kind goes, and so does the later rule of two with equal intervals. Detections that overlap
without containment both stay. Base phrases are found by the same rules, count at every place and are never suppressed.

Rules are written as families (label, name, versions, links) that are crossed with ways to name a license, and as
single sentences of license texts. No rule spans more than ``WINDOW`` words, so texts are scanned in slices that see so many
words of the next one; a detection belongs to the slice that it starts in.

Edge cases: null and empty texts have no words and no detections, score 0; texts of any length are scanned whole; repeated rows
and rows with a null or shared doc_id stay apart; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.shared import batch_of, blocks, bounded

#: Words are made of ASCII letters, digits and the bytes of all characters beyond ASCII; A-Z count as a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: The longest rule in words.
WINDOW = 40

#: Kinds in order, the surest first, with the score of a standing detection.
KINDS = {"identifier": 1.0, "text": 0.95, "grant": 0.9, "link": 0.85, "phrase": 0.8, "name": 0.5}

#: Families with versions: label | names | versions | words before the version in its links. A name is a pattern over words.
VERSIONED = """
gpl      | gnu general public licen[sc]e;gnu gpl;gpl;general public licen[sc]e           | 1 2 3         | gnu org licenses gpl;opensource org licenses gpl;www gnu org licenses old licenses gpl
lgpl     | gnu (?:lesser|library) general public licen[sc]e;gnu lgpl;lgpl                | 2 2.1 3       | gnu org licenses lgpl;opensource org licenses lgpl
agpl     | gnu affero general public licen[sc]e;affero general public licen[sc]e;agpl    | 1 3           | gnu org licenses agpl;opensource org licenses agpl
gfdl     | gnu free documentation licen[sc]e;gfdl                                       | 1.1 1.2 1.3   | gnu org licenses fdl
apache   | apache (?:software )?licen[sc]e;apache;asl                                   | 1.0 1.1 2     | apache org licenses license;opensource org licenses apache
mpl      | mozilla public licen[sc]e;mpl                                                | 1.0 1.1 2.0   | mozilla org mpl;opensource org licenses mpl
epl      | eclipse public licen[sc]e;epl                                                | 1.0 2.0       | eclipse org legal epl v;opensource org licenses epl
cddl     | common development and distribution licen[sc]e;cddl                          | 1.0 1.1       | opensource org licenses cddl
cpl      | common public licen[sc]e;cpl                                                 | 1.0           | opensource org licenses cpl
eupl     | european union public licen[sc]e;eupl                                        | 1.0 1.1 1.2   | opensource org licenses eupl
artistic | (?:perl )?artistic licen[sc]e                                                | 1.0 2.0       | opensource org licenses artistic license
afl      | academic free licen[sc]e;afl                                                 | 1.1 1.2 2.0 2.1 3.0 | opensource org licenses afl
osl      | open software licen[sc]e;osl                                                 | 1.0 2.0 2.1 3.0 | opensource org licenses osl
bsl      | boost software licen[sc]e                                                    | 1.0           | boost org license
busl     | business source licen[sc]e;busl                                              | 1.1           | mariadb com bsl
zpl      | zope public licen[sc]e;zpl                                                   | 1.1 2.0 2.1   | zope org resources zpl
lppl     | latex project public licen[sc]e;lppl                                         | 1.0 1.1 1.2 1.3 | latex project org lppl lppl
ofl      | (?:sil )?open font licen[sc]e;sil ofl                                        | 1.0 1.1       | scripts sil org ofl
php      | php licen[sc]e                                                               | 3.0 3.01      | php net license
psf      | python software foundation licen[sc]e;psf licen[sc]e                         | 2             | docs python org license
apsl     | apple public source licen[sc]e;apsl                                          | 1.0 1.1 1.2 2.0 | opensource org licenses apsl
rpl      | reciprocal public licen[sc]e;rpl                                             | 1.1 1.5       | opensource org licenses rpl
ecl      | educational community licen[sc]e;ecl                                         | 1.0 2.0       | opensource org licenses ecl
cecill   | cecill(?: free software licen[sc]e)?                                         | 1.0 1.1 2.0 2.1 | cecill info licences licence cecill v
odbl     | open (?:data commons open )?database licen[sc]e;odbl                         | 1.0           | opendatacommons org licenses odbl
upl      | universal permissive licen[sc]e                                              | 1.0           | opensource org licenses upl
sspl     | server side public licen[sc]e;sspl                                           | 1             | mongodb com licensing server side public license
elastic  | elastic licen[sc]e                                                           | 2.0           | elastic co licensing elastic license
qpl      | q public licen[sc]e;qpl                                                      | 1.0           | opensource org licenses qpl
cc-by-nc-nd | cc by nc nd;creative commons attribution non ?commercial no ?deriv(?:ative|ativ)e?s?(?: works)?  | 1.0 2.0 2.5 3.0 4.0 | creativecommons org licenses by nc nd
cc-by-nc-sa | cc by nc sa;creative commons attribution non ?commercial share ?alike                            | 1.0 2.0 2.5 3.0 4.0 | creativecommons org licenses by nc sa
cc-by-nc | cc by nc;creative commons attribution non ?commercial                        | 1.0 2.0 2.5 3.0 4.0 | creativecommons org licenses by nc
cc-by-nd | cc by nd;creative commons attribution no ?deriv(?:ative|ativ)e?s?(?: works)? | 1.0 2.0 2.5 3.0 4.0 | creativecommons org licenses by nd
cc-by-sa | cc by sa;creative commons attribution share ?alike                           | 1.0 2.0 2.5 3.0 4.0 | creativecommons org licenses by sa
cc-by    | cc by;creative commons attribution                                           | 1.0 2.0 2.5 3.0 4.0 | creativecommons org licenses by
"""

#: Families without versions: label | names | links.
PLAIN = """
mit           | mit;mit x11;expat                                    | opensource org licenses mit;mit license org
isc           | isc                                                  | opensource org licenses isc
zlib          | zlib;zlib libpng licen[sc]e                          | opensource org licenses zlib
x11           | x11;x consortium licen[sc]e                          | xfree86 org legal licenses
0bsd          | 0bsd;zero clause bsd;bsd zero clause                 | opensource org licenses 0bsd
bsd-2         | bsd 2 clause;2 clause bsd;simplified bsd;freebsd     | opensource org licenses bsd 2 clause
bsd-3         | bsd 3 clause;3 clause bsd;new bsd licen[sc]e;modified bsd;revised bsd | opensource org licenses bsd 3 clause
bsd-4         | bsd 4 clause;4 clause bsd;original bsd licen[sc]e    | spdx org licenses bsd 4 clause
bsd           | bsd                                                  | opensource org licenses bsd license
ncsa          | university of illinois ncsa(?: open source)?         | opensource org licenses ncsa
postgresql    | postgresql                                           | opensource org licenses postgresql
openssl       | openssl                                              | openssl org source license
unlicense     | the unlicense                                        | unlicense org
wtfpl         | wtfpl;do what the fuck you want to public licen[sc]e | wtfpl net
ms-pl         | microsoft public licen[sc]e                          | opensource org licenses ms pl
ms-rl         | microsoft reciprocal licen[sc]e                      | opensource org licenses ms rl
cc0           | cc0;creative commons zero;cc zero                    | creativecommons org publicdomain zero
public-domain | creative commons public domain;public domain mark    | creativecommons org publicdomain mark
pddl          | public domain dedication and licen[sc]e              | opendatacommons org licenses pddl
odc-by        | open data commons attribution;odc by                 | opendatacommons org licenses by
vim           | vim                                                  | vimdoc sourceforge net htmldoc uganda
ruby          | ruby                                                 | ruby lang org en about license
curl          | curl                                                 | curl se docs copyright
json          | json                                                 | json org license
beerware      | beerware;beer ware licen[sc]e                        | people freebsd org phk
sleepycat     | sleepycat                                            | opensource org licenses sleepycat
blueoak       | blue oak model licen[sc]e                            | blueoakcouncil org license
icu           | icu                                                  | source icu project org repos icu
unicode       | unicode;unicode dfs 2016                             | unicode org license
naist         | naist 2003;nara institute of science licen[sc]e      | opensource org licenses naist
"""

#: Sentences of license texts: label, pattern.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice (?:\\S+ ){0,4}shall be included in all copies or substantial portions"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "altered source versions must be plainly marked as such"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "neither the name of (?:\\S+ ){1,12}nor the names of (?:\\S+ ){0,4}contributors may be used to endorse or promote"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl-3", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("cc0", "to the extent possible under law (?:\\S+ ){1,12}waived all copyright and related or neighboring rights"),
    ("ncsa", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("x11", "except as contained in this notice the name of (?:\\S+ ){1,12}shall not be used in advertising"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("json", "the software shall be used for good not evil"),
    ("public-domain", "(?:is|are|was|been) (?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", "all rights reserved (?:\\S+ ){0,8}(?:proprietary and confidential|no part of this)"),
    ("proprietary", "unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
)

#: What stands before a license's name where it is granted.
_GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|offered|redistribute it|used|shared|governed)(?: \S+){0,3}? (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)?"


class Rule(NamedTuple):
    kind: str
    label: str
    pattern: str
    #: Words that every match has; a word with alternatives is none.
    keywords: frozenset[str]
    base: bool = False


def _keywords(pattern: str) -> frozenset[str]:
    """Words that every match has: those outside of any group, without signs of a pattern in them or after them."""
    sure = re.sub(r"\(\?:[^()]*\)\?", "", pattern.replace(r"\S", "_"))
    depth, flat = 0, []
    for c in sure.replace(" ?", "#"):
        depth += c == "("
        flat.append("#" if depth else c)
        depth -= c == ")"
    return frozenset(w for w in "".join(flat).split() if w.isascii() and w.isalnum())


def _rule(kind: str, label: str, pattern: str, base: bool = False) -> Rule:
    return Rule(kind, label, pattern, _keywords(pattern), base)


def _version(v: str) -> str:
    """Words of a version, with or without 'version', 'v' or a trailing zero."""
    number = " ".join(v.split("."))
    return f"(?:version |v |ver )?v?{number.removesuffix(' 0')}(?: 0)?"


def _ways(label: str, name: str, version: str = "") -> Iterator[Rule]:
    """A license's name as a grant and as a mere name, and with a version that version's or a later one's."""
    if version:
        numbered = f"{name}(?: licen[sc]e)?(?: international)? {_version(version)}(?: international| unported| generic)?(?: licen[sc]e)?"
        yield _rule("grant", label, f"{_GRANT} {numbered}")
        yield _rule("name", label, numbered)
        yield _rule("name", f"{label}-or-later", f"{numbered} or (?:at your option )?(?:any )?(?:later|newer|higher)(?: version)?")
    elif name.isalnum():  # one word alone names too much
        yield _rule("grant", label, f"{_GRANT} {name}(?: licen[sc]e)?")
        yield _rule("name", label, f"{name} licen[sc]e")
    else:
        yield _rule("grant", label, f"{_GRANT} {name}")
        yield _rule("name", label, name)


def _lines(block: str) -> Iterator[list[str]]:
    for line in block.strip().splitlines():
        yield re.split(r"\s+\|\s+", line.strip())


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: by kind, then as written."""
    found = [_rule("phrase", label, phrase, True) for phrase, label in BASE.items()]
    found += [_rule("text", label, pattern) for label, pattern in SENTENCES]
    for label, names, versions, links in _lines(VERSIONED):
        for name in names.split(";"):
            found += _ways(label, name)
            for v in versions.split():
                found += _ways(f"{label}-{v}", name, v)
        for v in versions.split():
            number = " ".join(v.split("."))
            found += [_rule("link", f"{label}-{v}", f"{link} v?{number.removesuffix(' 0')}(?: 0)?") for link in links.split(";")]
            found.append(_rule("identifier", f"{label}-{v}", f"spdx license identifier {label.replace('-', ' ')} {number.removesuffix(' 0')}(?: 0)?(?: only)?"))
            found.append(_rule("identifier", f"{label}-{v}-or-later", f"spdx license identifier {label.replace('-', ' ')} {number.removesuffix(' 0')}(?: 0)? or later"))
    for label, names, links in _lines(PLAIN):
        for name in names.split(";"):
            found += _ways(label, name)
        found += [_rule("link", label, link) for link in links.split(";")]
        found.append(_rule("identifier", label, f"spdx license identifier {label.replace('-', ' ')}(?: clause| 1 0)?"))
    order = list(KINDS)
    return tuple(sorted(found, key=lambda r: order.index(r.kind)))


class Scanner:
    """Rules compiled on their first use, found by one of their keywords."""

    def __init__(self, given: Sequence[Rule]) -> None:
        self.rules = given
        self.by_keyword: dict[bytes, list[int]] = defaultdict(list)
        common = defaultdict(int)
        for r in given:
            for w in r.keywords:
                common[w] += 1
        for i, r in enumerate(given):
            if not r.keywords:
                raise ValueError(f"a rule without a keyword: {r.pattern}")
            self.by_keyword[min(sorted(r.keywords), key=lambda w: (common[w], -len(w))).encode()].append(i)
        self.keywords = [frozenset(w.encode() for w in r.keywords) for r in given]
        self.gate = self.by_keyword.keys()
        self.level = np.array([list(KINDS).index(r.kind) for r in given])
        self.base = np.array([r.base for r in given])
        self.compiled: dict[int, re.Pattern] = {}

    def pattern(self, rule: int) -> re.Pattern:
        if rule not in self.compiled:
            self.compiled[rule] = re.compile(f" {self.rules[rule].pattern} ".encode())
        return self.compiled[rule]

    def detections(self, words: list[bytes], own: int) -> Iterator[tuple[int, int, int]]:
        """Start, end and rule of each match that starts in the first ``own`` words; several rules may match at a place."""
        present = set(words)
        wanted = [i for w in self.gate & present for i in self.by_keyword[w] if self.keywords[i] <= present]
        if not wanted:
            return
        text = b" " + b" ".join(words) + b" "
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        for i in wanted:
            search, at = self.pattern(i).search, 0
            while m := search(text, at):
                first, last = np.searchsorted(spaces, (m.start(), m.end() - 1)).tolist()
                if first >= own:
                    break
                yield first, last, i
                at = m.start() + 1

    def standing(self, start: np.ndarray, end: np.ndarray, rule: np.ndarray) -> np.ndarray:
        """Which detections lie in none of the same or a surer kind; base ones stand always."""
        level, stands = self.level[rule], np.ones(len(rule), bool)
        for k in np.unique(level):
            some = np.flatnonzero(level <= k)
            some = some[np.lexsort((rule[some], level[some], -end[some], start[some]))]
            reach = np.append(0, np.maximum.accumulate(end[some])[:-1])
            stands[some[(reach >= end[some]) & (level[some] == k)]] = False
        return stands | self.base[rule]

    def scan(self, text: bytes, most: int = 1 << 20) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """The number of words, and start, end and rule of each detection that stands, in order of place."""
        data, found = text.translate(WORD_BYTES), array("q")
        at = base = 0
        words: list[bytes] = []
        while at < len(data) or words:
            last = data.find(b" ", at + most)
            last = len(data) if last < 0 else last
            words += data[at:last].split()
            at = last
            own = len(words) if at >= len(data) else max(0, len(words) - WINDOW)
            for first, end, rule in self.detections(words, own):
                found.extend((base + first, base + end, rule))
            base, words = base + own, words[own:]
        start, end, rule = np.array(found, np.int64).reshape(-1, 3).T
        stands = self.standing(start, end, rule) if len(rule) else np.empty(0, bool)
        start, end, rule = start[stands], end[stands], rule[stands]
        order = np.lexsort((rule, end, start))
        return base, start[order], end[order], rule[order]


@functools.cache
def _scanner(given: tuple[Rule, ...]) -> Scanner:
    """One for all tasks of a Python worker."""
    return Scanner(given)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("kind", pa.string()), ("base", pa.bool_())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(_SPAN))])


def scan(docs: DataFrame, given: Sequence[Rule] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, spans (start and end in words, label, kind, base) of the detections that stand."""
    ordered = tuple(given) if given is not None else rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(ordered)
        labels, kinds = pa.array([r.label for r in ordered], pa.string()), pa.array([r.kind for r in ordered], pa.string())
        base = pa.array([r.base for r in ordered], pa.bool_())
        for block in blocks(batches, "text", 4 << 20):
            found = [scanner.scan(t) for t in block["text"].to_pylist()]
            start, end, rule = (np.concatenate([x[i] for x in found]) for i in (1, 2, 3))
            spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end), labels.take(pa.array(rule)), kinds.take(pa.array(rule)), base.take(pa.array(rule))], fields=list(_SPAN))
            cuts = pa.array(np.append(0, np.cumsum([len(x[3]) for x in found])), pa.int32())
            yield batch_of(_OUT, {"doc_id": block["doc_id"], "n_words": [x[0] for x in found], "spans": pa.ListArray.from_arrays(cuts, spans)})

    given_texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return bounded(given_texts).mapInArrow(run, "doc_id long, n_words long, spans array<struct<start: long, end: long, label: string, kind: string, base: boolean>>")


def summary(spans: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (of its surest span)."""
    base = F.filter("spans", lambda s: s.base)
    joined = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda s: s.label))), ",")
    weights = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: weights[s.kind])), F.lit(0.0))
    places = F.transform(base, lambda s: s.start)
    return spans.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), score.alias("score"))
