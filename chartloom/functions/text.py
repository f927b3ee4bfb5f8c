"""Text functions on columns: words, windows, slices, parsing, token sets."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry a dose.
DOSAGE_TOKENS = [
    "one", "two", "three", "four", "five", "mg", "ml", "mcg", "iu", "units", "%", "drop", "drops", "tablet", "tablets", "tab", "tabs",
    "capsule", "capsules", "cap", "caps", "patch", "patches", "sachet", "sachets", "ampoule", "ampoules",
]
#: What the white space of a text is made of, beyond ASCII too.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Who acts after a letter, and in which roles.
ACTION_PARTS, ACTION_ROLES = ("sender_actions", "gp_surgery_actions"), ("doctor", "pharmacist", "reception")
#: Strings in either quotes, braces, runs of anything else, and quotes that pair with none.
_JSON_PARTS = r"""(?s)"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|[{}]|[^{}"']++|["']"""
_PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Without the empty strings that a plain split leaves at both ends."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def slice_text(text: Column, n: int) -> Column:
    """Slices of n characters with their offsets. One pass cuts all of them: a substring for each would count from the beginning again."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{n}}}+"), F.lit(0))
    return F.coalesce(F.transform(parts, lambda part, i: F.struct((i * n).alias("offset"), part.alias("part"))), F.array().cast("array<struct<offset:int,part:string>>"))


def truncate_center(text: Column, tokens: int = 250, words_per_token: float = 0.75) -> Column:
    """The middle words of a text that has too many."""
    most = int(tokens / words_per_token)
    return let(words(text), lambda w: F.array_join(F.when(F.size(w) <= most, w).otherwise(F.slice(w, F.floor((F.size(w) - most) / 2).cast("int") + 1, F.lit(most))), " "))


def normal_token(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def context_window(text: Column, term: Column, size: int = 75, least: int = 50, most: int = 100) -> Column:
    """The words around the first word that begins like the term's first word; else the first words."""
    n = max(least, min(most, size))

    def around(w: Column, first: Column) -> Column:
        found = F.coalesce(F.get(F.filter(F.transform(w, lambda x, i: F.when(F.startswith(normal_token(x), first), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(-1))

        def cut(at: Column) -> Column:
            start = F.greatest(F.lit(0), at - n // 2)
            end = F.least(F.size(w), start + n)
            short = (end - start < least) & (F.size(w) > least)
            back = F.greatest(F.lit(0), start - (least - (end - start)))
            return F.when(at < 0, F.slice(w, 1, n)).otherwise(F.when(short, F.slice(w, back + 1, F.least(F.size(w), F.greatest(end, back + least)) - back)).otherwise(F.slice(w, start + 1, end - start)))

        return F.when(first.isNull(), F.slice(w, 1, n)).otherwise(let(found, cut))

    first = F.get(F.filter(F.transform(words(term), normal_token), lambda x: x != ""), F.lit(0))
    return let(words(text), lambda w: F.array_join(let(first, lambda f: around(w, f)), " "))


def chunk_spans(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Chunks of fixed length: start, end and trimmed text."""
    starts = F.when(F.length(text) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, F.length(text)).alias("end"), F.when(F.length(text) <= size, text).otherwise(F.trim(F.substring(text, s + 1, F.lit(size)))).alias("chunk")))


def chunk_sentences(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Chunks of up to ``size`` characters that end after the last full stop of their second half, trimmed.

    Where a chunk begins follows from where the last one ended, so a fold carries the next start. It looks for a full stop in
    two neighbouring pieces of the text, cut once, so that no step reads the text from its beginning, and keeps the places of
    1,000 chunks at a time, so that none copies all before it: work grows with the text. A null text is one empty chunk.
    """
    if size // 2 + 2 <= overlap:
        raise ValueError("an overlap of half a chunk may never end")
    pair = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    state = lambda at, spans: F.struct(at.cast("int").alias("at"), spans.alias("spans"))

    def of(given: Column) -> Column:
        whole, n, pieces = given.getField("whole"), given.getField("n"), given.getField("pieces")
        window = lambda at, last: F.substring(F.concat(F.get(pieces, F.floor(at / size)), F.coalesce(F.get(pieces, F.floor(at / size) + 1), F.lit(""))), (at % size + 1).cast("int"), (last - at).cast("int"))

        def end_of(at: Column) -> Column:
            full = at + size
            behind = F.locate(".", F.reverse(window(at, full)))  # 1: the window ends with a full stop
            return F.when((full < n) & (behind > 0) & (size - behind > size // 2), full - behind + 1).otherwise(full)

        def step(now: Column, _: Column) -> Column:
            at = now.getField("at")
            return F.when(at >= n, now).otherwise(let(end_of(at), lambda end: state(end - overlap, F.array_append(now.getField("spans"), F.struct(at.alias("start"), F.least(end, n).cast("int").alias("end"))))))

        def steps(now: Column, _: Column) -> Column:
            inner = F.aggregate(F.sequence(F.lit(1), F.lit(1000)), state(now.getField("at"), F.array().cast(pair)), step)
            return F.when(now.getField("at") >= n, now).otherwise(let(inner, lambda x: F.struct(x.getField("at").alias("at"), F.array_append(now.getField("runs"), x.getField("spans")).alias("runs"))))

        rounds = F.floor(n / (1000 * (size // 2 + 2 - overlap))).cast("int") + 1
        spans = F.flatten(F.aggregate(F.sequence(F.lit(1), rounds), F.struct(F.lit(0).alias("at"), F.array().cast(T.ArrayType(pair)).alias("runs")), steps, lambda x: x.getField("runs")))
        cut = F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.btrim(window(s.start, s.end), F.lit(SPACES)).alias("chunk")))
        return F.when(n <= size, F.array(F.struct(F.lit(0).alias("start"), n.alias("end"), whole.alias("chunk")))).otherwise(cut)

    whole = F.coalesce(text, F.lit(""))
    return let(F.struct(whole.alias("whole"), F.length(whole).alias("n"), F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("pieces")), of)


#: Headers that begin a section, by document type.
SECTION_HEADERS = {
    "discharge_summary": ["chief complaint|presenting complaint", "history of present illness|hpi", "past medical history|pmh", "medications|current medications", "physical examination|examination", "assessment|impression|diagnosis", "plan|treatment plan|management", "discharge instructions|instructions"],
    "prescription": ["patient information|patient details", "medication|drug|prescription", "dosage|dose", "instructions|directions", "warnings|contraindications"],
    "lab_report": ["test name|investigation", "result|value|finding", "reference range|normal range", "interpretation|comment"],
}


def section_array(text: Column, headers: Column) -> Column:
    """Sections of a text: a line that matches ``headers`` begins one and names it.

    The places of such lines bound slices of the array of lines, so that each line is copied once. Null headers match nothing.
    """

    def section(lines: Column, first: Column, last: Column, named: bool) -> Column:
        name = F.substring(F.regexp_replace(F.lower(F.btrim(F.get(lines, first), F.lit(" \t\r"))), "[^a-z_]", "_"), 1, 30) if named else F.lit("header")
        return F.struct(name.alias("name"), F.btrim(F.array_join(F.slice(lines, first + 1, last - first), "\n"), F.lit(" \t\r\n")).alias("body"))

    def of(lines: Column) -> Column:
        begins = F.array_compact(F.transform(lines, lambda line, i: F.when(F.regexp_like(line, headers), i)))

        def cut(at: Column) -> Column:
            every = F.transform(at, lambda first, i: section(lines, first, F.coalesce(F.get(at, i + 1), F.size(lines)), True))
            return F.filter(F.concat(F.array(section(lines, F.lit(0), F.coalesce(F.get(at, F.lit(0)), F.size(lines)), False)), every), lambda s: s.body != "")

        return let(begins, cut)

    whole = let(F.split(F.coalesce(text, F.lit("")), "\n"), of)
    return F.when(F.size(whole) > 0, whole).otherwise(F.array(F.struct(F.lit("full_document").alias("name"), text.alias("body"))))


def headers_of(doc_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, parts in SECTION_HEADERS.items():
        out = F.when(doc_type == name, "(?i)(" + "|".join(parts) + ")").otherwise(out)
    return out


def chunk_rows(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """doc_id, text, doc_type to a row per chunk: section, chunk_index, total_chunks, chunk_id, start, chunk."""
    sections = docs.select("doc_id", "text", F.posexplode(section_array(F.col("text"), headers_of(F.col("doc_type")))).alias("section_no", "s"))
    parts = sections.select("doc_id", "text", "section_no", F.col("s.name").alias("section"), chunk_sentences(F.col("s.body"), size, overlap).alias("parts"))
    placed = F.transform("parts", lambda p: F.struct(p.chunk.alias("chunk"), (F.position(p.chunk, F.col("text")) - 1).alias("place")))
    rows = parts.select("doc_id", "section_no", "section", F.size("parts").alias("total_chunks"), F.posexplode(placed).alias("chunk_index", "p"))
    chunk_id = F.substring(F.md5(F.concat_ws("_", F.col("doc_id").cast("string"), "section", F.col("chunk_index").cast("string"))), 1, 12)
    return rows.select("doc_id", "section_no", "section", "chunk_index", "total_chunks", chunk_id.alias("chunk_id"), F.col("p.place").alias("start_pos"), F.col("p.chunk").alias("chunk"))


def parse_model_json(raw: Column, schema: str) -> Column:
    """A model's answer as a struct: fences are stripped; null where it isn't JSON."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(raw), schema, {"mode": "PERMISSIVE"})


def summary_or_raw(raw: Column, schema: str) -> Column:
    """The parsed answer's summary and score; where it can't be parsed, the raw text and 0.5."""
    parsed = parse_model_json(raw, schema)
    return F.when(parsed.getField("summary").isNotNull(), F.struct(parsed.getField("summary").alias("summary"), F.coalesce(parsed.getField("confidence_score"), F.lit(0.5)).alias("confidence_score"))).otherwise(F.struct(raw.alias("summary"), F.lit(0.5).alias("confidence_score")))


def outermost(text: Column) -> Column:
    """The first object in a text, from its brace to the one that closes it; null if there is none or it isn't closed.

    The text from the first brace on is cut into strings, braces and what is between; depth is the running sum over these
    parts, where braces within strings count nothing. Quotes that don't pair are seen as plain characters.
    """
    begin = F.locate("{", text)
    rest = F.substring(text, begin, F.length(text))
    parts = F.regexp_extract_all(rest, F.lit(_JSON_PARTS), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("read"), F.lit(0).alias("closed"))

    def step(now: Column, part: Column) -> Column:
        depth = now.depth + F.when(part == "{", 1).when(part == "}", -1).otherwise(0)
        read = now.read + F.length(part)
        return F.when(now.closed > 0, now).otherwise(F.struct(depth.alias("depth"), read.alias("read"), F.when(depth == 0, read).otherwise(0).alias("closed")))

    closed = F.aggregate(parts, start, step, lambda x: x.closed)
    return F.when(begin > 0, let(closed, lambda n: F.when(n > 0, F.substring(rest, F.lit(1), n))))


def parse_actions_json(raw: Column) -> Column:
    """A model's actions by part and role, as lists of strings; lists that are missing or can't be read are empty.

    Fences are dropped, the outermost object is found by depth, and strings may be in single or double quotes. Empty and null items go;
    items that aren't strings come as their JSON text.
    """
    roles = lambda of: "struct<" + ",".join(f"{r}:{of}" for r in ACTION_ROLES) + ">"
    found = outermost(F.regexp_replace(raw, r"```(?:json)?\s*", ""))
    parsed = F.from_json(found, ",".join(f"{p} {roles('array<string>')}" for p in ACTION_PARTS), {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"})
    items = lambda x, part, role: F.filter(F.coalesce(x.getField(part).getField(role), F.array().cast("array<string>")), lambda i: F.coalesce(i, F.lit("")) != "").alias(role)
    return let(parsed, lambda x: F.struct(*(F.struct(*(items(x, p, r) for r in ACTION_ROLES)).alias(p) for p in ACTION_PARTS)))


def parse_correction_json(raw: Column, ocr_text: Column) -> Column:
    parsed = parse_model_json(raw, "corrected_text string, confidence double, reasoning string")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parsed.getField("confidence"), F.lit(0.0))))
    return F.struct(F.coalesce(parsed.getField("corrected_text"), ocr_text).alias("corrected_text"), score.alias("confidence"), F.coalesce(parsed.getField("reasoning"), F.lit("")).alias("reasoning"))


def strip_markdown(text: Column) -> Column:
    bold = F.regexp_replace(text, r"\*{1,2}([^*\n]+)\*{1,2}", "$1")
    return F.btrim(F.regexp_replace(F.regexp_replace(bold, r"(?m)^#{1,3}\s+", ""), r"(?m)^[-–—]{3,}\s*$", ""), F.lit(" \t\r\n"))


def clip(text: Column, over: int = 45, keep: int = 55) -> Column:
    """Long texts end at a sentence's end in the second half of their first words, a full stop before other marks."""

    def cut(t: Column) -> Column:
        out = t
        for mark in ("?", "!", "."):
            last = F.length(t) - F.locate(mark, F.reverse(t)) + 1
            out = F.when((F.locate(mark, t) > 0) & (last - 1 > F.floor(F.length(t) / 2)), F.substring(t, F.lit(1), last.cast("int"))).otherwise(out)
        return out

    return let(words(text), lambda w: F.when(F.size(w) > over, let(F.array_join(F.slice(w, 1, keep), " "), cut)).otherwise(text))


def clinical_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-zA-Z][a-zA-Z0-9\-]{2,}\b"), F.lit(0)))


def ascii_words(pattern: str) -> str:
    """A pattern whose words and white space are ASCII alone, as RE2 and DuckDB read it: a letter beyond ASCII ends a word."""
    instead = {r"\b": r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))", r"\s": r"[\t\n\f\r ]"}
    read = lambda m: m[0].replace(r"\s", r"\t\n\f\r ") if m[0][0] == "[" else instead.get(m[0], m[0])
    return re.sub(r"\[(?:\\.|[^\]\\])*\]|\\.", read, pattern)


def trie(strings: Iterable[str]) -> str:
    """A pattern of the longest of some strings that begins at a place, which tries each first letter once."""
    by: dict[str, list[str]] = {}
    for s in sorted(set(strings)):
        by.setdefault(s[:1], []).append(s[1:])
    ends = "" in by
    branches = [re.sub(r"([^\w\s])", r"\\\1", c) + trie(rest) for c, rest in by.items() if c]
    body = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})" if branches else ""
    return body + "?" if ends and branches else body


def keyword_terms(text: Column, patterns: list[str], least: int = 4, ascii_only: bool = False) -> Column:
    """Distinct lower-cased matches, in order of the patterns. ``ascii_only``: see ``ascii_words``.

    Where patterns are lists of words between word boundaries, one pass by all their words tells which texts have any; only these are
    searched for every pattern.
    """
    listed = [re.fullmatch(r"\\b\(([\w |-]+)\)\\b", p) for p in patterns]
    bounded = rf"\b{trie(w.lower() for m in listed for w in m[1].split('|') if len(w) >= least)}\b" if patterns and all(listed) else None
    of = lambda p: F.lit(ascii_words(p) if ascii_only else p)

    def found(low: Column) -> Column:
        return F.flatten(F.array(*[F.regexp_extract_all(low, of("(?i)" + p), F.lit(0)) for p in patterns]))

    def terms(low: Column) -> Column:
        every = F.filter(F.array_distinct(F.transform(found(low), F.trim)), lambda t: F.length(t) >= least)
        return every if bounded is None else F.when(~F.regexp_like(low, of(bounded)), F.array().cast("array<string>")).otherwise(every)

    return let(F.lower(text), terms)


def bare_tokens(text: Column) -> Column:
    """Distinct lower-cased words without punctuation."""
    return F.array_distinct(F.filter(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), _PUNCTUATION, ""), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; two empty ones are alike."""
    every = F.size(a) + F.size(b)
    return let(F.size(F.array_intersect(a, b)), lambda n: F.when(every == 0, 1.0).otherwise(n / (every - n)))


def _codes(texts: list[str], width: int) -> np.ndarray:
    """A row of code points for each text, filled up with zeros; the point at the end keeps numpy from dropping them."""
    return np.array([t.ljust(width, "\0") + "." for t in texts]).view(np.uint32).reshape(len(texts), -1)[:, :width]


def _distances(x: list[str], y: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs, row by row of all their tables at once."""
    m, n = np.array([len(t) for t in x]), np.array([len(t) for t in y])
    a, b = _codes(x, m.max()), _codes(y, n.max())
    steps = np.arange(b.shape[1] + 1, dtype=np.int32)
    now = np.tile(steps, (len(x), 1))
    found = np.where(m == 0, n, 0)
    for i in range(a.shape[1]):
        new = now + 1
        np.minimum(new[:, 1:], now[:, :-1] + (b != a[:, i : i + 1]), out=new[:, 1:])
        now = np.minimum.accumulate(new - steps, axis=1) + steps
        ends = m == i + 1
        found[ends] = now[ends, n[ends]]
    return found


@F.pandas_udf(T.DoubleType())
def edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """The Levenshtein distance. Of texts of one length it is at most the places that differ, and at least the characters that one has
    more often than the other, here by 64 classes; only where these two numbers differ the whole table is needed."""
    x, y = a.to_numpy(dtype=object), b.to_numpy(dtype=object)
    out = np.full(len(x), np.nan)
    given = np.flatnonzero([s is not None and t is not None for s, t in zip(x, y, strict=True)])
    size = np.array([max(len(x[k]), len(y[k])) for k in given], dtype=int)
    given, size = given[np.argsort(size, kind="stable")], np.sort(size)
    while len(given):
        n = max(1, min(len(given), int(np.searchsorted(size * np.arange(1, len(size) + 1), 1 << 19))))  # cells of padded texts at once
        at, given, size = given[:n], given[n:], size[n:]
        s, t = list(x[at]), list(y[at])
        width = max(1, *map(len, s), *map(len, t))
        p, q = _codes(s, width), _codes(t, width)
        alike = np.array([len(v) == len(w) for v, w in zip(s, t, strict=True)])
        most = (p != q).sum(axis=1)
        rows = np.arange(n)[:, None] * 64
        of = lambda c: np.bincount((rows + c % 64).ravel(), minlength=64 * n).reshape(n, 64)  # noqa: B023, E731
        more = np.maximum(of(p) - of(q), 0).sum(axis=1)
        left = np.flatnonzero(~alike | (most != more))
        out[at] = most
        if len(left):
            out[at[left]] = _distances([s[k] for k in left], [t[k] for k in left])
    return pd.Series(out)


def dosage_tokens(text: Column) -> Column:
    return of_dosage(bare_tokens(text))


def of_dosage(tokens: Column) -> Column:
    return F.array_sort(F.filter(tokens, lambda t: t.isin(DOSAGE_TOKENS)))


def overlap_ratio(a: Column, b: Column) -> Column:
    """The share of a's tokens that b has."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


#: Fixed value: from this length on the standard library leaves frequent characters out of its index.
AUTOJUNK = 200


def matched(a: str, b: str) -> int:
    """Characters in matching blocks: the longest one, the first in a and then in b among equals, and so on to its left and right."""
    total, open_ = 0, [(a, b)]
    while open_:
        a, b = open_.pop()
        size, at, i, n = 0, 0, 0, len(a)
        while i + size < n:
            if a[i : i + size + 1] in b:
                size, at = size + 1, i
                while at + size < n and a[at : at + size + 1] in b:
                    size += 1
            i += 1
        if size:
            total += size
            j = b.index(a[at : at + size])
            if at and j:
                open_.append((a[:at], b[:j]))
            if at + size < n and j + size < len(b):
                open_.append((a[at + size :], b[j + size :]))
    return total


def _ratios(a: Iterable, b: Iterable, least: Iterable) -> pd.Series:
    """The ratio of each pair, or ``least`` where the ratio can't be larger, whatever matches."""
    from difflib import SequenceMatcher

    plain = lambda x: " ".join((x or "").lower().split())
    found, last, long = [], None, SequenceMatcher(None)
    for x, y, low in zip(a, b, least, strict=False):
        if y != last:  # a long text that rows in a row are held against is indexed once
            last, t = y, plain(y)
            if len(t) >= AUTOJUNK:
                long.set_seq2(t)
        s = plain(x)
        if s == t:
            found.append(1.0)
        elif 2.0 * min(len(s), len(t)) / (len(s) + len(t)) <= low:
            found.append(low)
        elif len(t) < AUTOJUNK:
            found.append(2.0 * matched(s, t) / (len(s) + len(t)))
        else:
            long.set_seq1(s)
            found.append(long.ratio())
    return pd.Series(found, dtype="float64")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest matching blocks, as the standard library's ratio, on lower-cased texts with single spaces."""
    return _ratios(a, b, repeat(0.0))


@F.pandas_udf(T.DoubleType())
def ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The larger of ``least`` and the ratio; pairs whose lengths alone keep the ratio below aren't aligned."""
    return np.maximum(_ratios(a, b, least), least)


#: Ages, identifiers and labels of a person, each with what stands for it.
DEMOGRAPHICS = [
    (r"(?i)\b\d{1,3}\s*[- ]?\s*year\s*[- ]?\s*old\b", ""),
    (r"(?i)\bage\s*(?:of)?\s*\d{1,3}\b", ""),
    (r"(?i)\baged\s*\d{1,3}\b", ""),
    (r"(?i)\b\d{1,3}\s*(?:yo|y/o)\b", ""),
    (r"\b\d{1,3}\s*[mMfF]\b", ""),
    (r"\(\s*\d{1,3}\s*\)", ""),
    (r"(?i)\bNHS\s*(?:No|Number|#)?[:\s]*\d[\d\s]{8,14}\d\b", ""),
    (r"(?i)\b(?:DOB|D\.?\s*O\.?\s*B\.?|Date\s*of\s*birth)\b[:\s-]*[^\.,;\n]*", ""),
    (r"(?i)\b(?:Patient\s*Name|Name|Address|Hospital\s*Number|MRN)\b[:\s-]*[^\.,;\n]*", ""),
    (r"(?i)\b(?:Mr|Mrs|Ms|Miss|Dr)\.?\s+[A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){0,2}\b", "patient"),
    (r"(?i)\bsex[:\s-]*(?:male|female|m|f)\b", ""),
]
#: The subject that a summary begins with, and what a sex that was given makes of it.
SUBJECT, ANY_SUBJECT, TWICE = r"(?i)^(male|female)\s+patient\b", r"(?i)^(the\s+)?patient\b", r"(?i)^(male|female)\s+patient\s+(?:the\s+)?\1\s+patient\b"
SEXES = {"m": "male patient", "male": "male patient", "f": "female patient", "female": "female patient"}


def scrub_demographics(text: Column, sex: Column) -> Column:
    """Ages, numbers, names and labels go; the text begins with a male or female patient, or with a patient. Null is empty.

    Where the sex isn't known, a text that begins with the patient gets one more subject.
    """
    unicode = lambda pattern: pattern if pattern.startswith("\\") else pattern.replace("(?i)", "(?iU)")
    found = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    for pattern, instead in DEMOGRAPHICS:
        found = F.regexp_replace(found, unicode(pattern), instead)
    found = F.btrim(F.regexp_replace(found, r"(?U)\s{2,}", " "), F.lit(" ,.-"))
    given = F.lower(F.btrim(F.coalesce(sex, F.lit("")), F.lit(SPACES)))
    label = F.lit("patient")
    for name, subject in SEXES.items():
        label = F.when(given == name, subject).otherwise(label)

    def named(t: Column) -> Column:
        return let(F.regexp_replace(t, ANY_SUBJECT, label), lambda x: F.when(F.regexp_like(x, F.lit(SUBJECT)), x).otherwise(F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 20), F.lit(" "), F.lower(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))))

    def subject(t: Column) -> Column:
        once = F.when((t == "") | F.regexp_like(t, F.lit(SUBJECT)), t).otherwise(named(t))
        return F.btrim(F.regexp_replace(once, TWICE, "$1 patient"), F.lit(SPACES))

    return let(F.btrim(F.regexp_replace(found, r"(?i)^(the\s+)?(male|female)\s+patient\b", "$2 patient"), F.lit(SPACES)), subject)
