"""Masking of personal data, as folds of regular expressions over columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.text import ascii_words, let, slice_text

#: Fixed values, in the order in which they are applied; all ignore case.
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"(\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "nhs_number": r"\d{3}[-\s]?\d{3}[-\s]?\d{4}",
    "date_of_birth": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "postcode": r"[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}",
    "mrn": r"MRN[:\s]?\d{6,10}",
}
#: Titles before names; these mind case.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Patient"]
#: Fixed values for logs, in order; all ignore case, so names match in any case too.
LOG_PATTERNS = [
    (r"\b(MRN[:\s-]*\d{4,12})\b", "[MRN_REDACTED]"),
    (r"\b(?:DOB|Date of Birth)[:\s-]*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "[DOB_REDACTED]"),
    (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "[DATE_REDACTED]"),
    (r"\b(?:Mr|Mrs|Ms|Miss|Dr|Patient)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b", "[NAME_REDACTED]"),
    (r"\b\d{1,5}\s+[A-Za-z0-9.\- ]+\s(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Boulevard|Blvd)\b", "[ADDRESS_REDACTED]"),
]
#: What a row that isn't redacted must not hold, and the characters of a slice that a detector sees.
RESIDUAL_MARKERS = ["@", "NHS", "MRN"]
DETECTOR_SLICE = 18_000


def anonymise(text: Column) -> Column:
    """text and types: each pattern sees what the patterns before it left; types are sorted.

    Every pattern is a constant of its own step, compiled once; a replacement never equals what it replaces, so a step that changed the
    text found its type.
    """
    steps = [("(?i)" + p, f"[{k.upper()}_REDACTED]", k) for k, p in PATTERNS.items()]
    steps += [(rf"\b{t}\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?", f"{t}. [NAME_REDACTED]", "name") for t in TITLES]

    def after(t: Column, n: int, found: list[Column]) -> Column:
        if n == len(steps):
            return F.struct(t.alias("text"), F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))).alias("types"))
        pattern, token, kind = steps[n]
        return let(F.regexp_replace(t, pattern, token), lambda x: after(x, n + 1, [*found, F.when(x != t, kind)]))

    return after(text, 0, [])


def mask_patterns(text: Column, strict_names: bool = False, ascii_only: bool = False) -> Column:
    """``strict_names``: a name after a title must be capitalised; ``ascii_only``: see ``text.ascii_words``."""
    bounded = lambda p: r"(?<!\w)" + ascii_words(p.removeprefix(r"\b")) if ascii_only else p  # noqa: E731  each begins with a letter or digit
    for pattern, token in LOG_PATTERNS:
        text = F.regexp_replace(text, ("" if strict_names and "NAME" in token else "(?i)") + bounded(pattern), token)
    return text


def pseudonym(value: Column, kind: Column) -> Column:
    return F.concat(F.lit("["), F.upper(F.coalesce(kind, F.lit("PHI"))), F.lit("_"), F.substring(F.sha2(value, 256), 1, 12), F.lit("]"))


def mask_spans(text: Column, spans: Column, merge: bool = True) -> Column:
    """Replace spans (begin_offset, end_offset, type) from the last to the first, then the patterns.

    ``merge``: of overlapping spans only the first is replaced; else all are, with their offsets in the given text.
    """
    valid = F.array_sort(F.filter(spans, lambda s: (s.begin_offset >= 0) & (s.begin_offset < s.end_offset) & (s.end_offset <= F.length(text))))
    if merge:
        apart = lambda acc, s: F.when((F.size(acc) == 0) | (s.begin_offset >= F.element_at(acc, -1).getField("end_offset")), F.array_append(acc, s)).otherwise(acc)
        valid = F.aggregate(valid, F.slice(valid, 1, 0), apart)
    cut = lambda t, s: F.concat(F.substring(t, F.lit(1), s.begin_offset), pseudonym(F.substring(text, s.begin_offset + 1, s.end_offset - s.begin_offset), s["type"]), F.substring(t, s.end_offset + 1, F.length(t)))
    return mask_patterns(F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, F.aggregate(F.reverse(valid), text, cut)).otherwise(text))


def mask_typed(value: Column, kind: T.DataType) -> Column:
    """Every string leaf of a typed column masked."""
    if isinstance(kind, T.StringType):
        return mask_patterns(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: mask_typed(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: mask_typed(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[mask_typed(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    return value


@F.pandas_udf(T.StringType())
def mask_json(raw: pd.Series) -> pd.Series:
    """Every string leaf of a JSON text masked, whatever its shape; keys stay. Text that isn't JSON is masked as text."""
    rules = [(re.compile(p, re.IGNORECASE), t) for p, t in LOG_PATTERNS]

    def plain(x: str) -> str:
        for pattern, token in rules:
            x = pattern.sub(token, x)
        return x

    def masked(x):
        if isinstance(x, str):
            return plain(x)
        if isinstance(x, list):
            return [masked(v) for v in x]
        return {k: masked(v) for k, v in x.items()} if isinstance(x, dict) else x

    def whole(x: str | None) -> str | None:
        if x is None:
            return None
        try:
            return json.dumps(masked(json.loads(x)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return plain(x)

    return raw.map(whole)


def hash_id(value: Column) -> Column:
    return F.substring(F.sha2(value.cast("string"), 256), 1, 16)


def mask_by_role(role: Column, text: Column) -> Column:
    return F.when(role == "clinician", text).otherwise(mask_patterns(text))


def residual_pii(row: Column) -> Column:
    """The markers that a row's JSON still holds although nothing in it is redacted."""
    marks = F.array(*[F.when(F.contains(row, F.lit(m)), m) for m in RESIDUAL_MARKERS])
    return F.when(F.contains(row, F.lit("REDACTED")), F.array().cast("array<string>")).otherwise(F.array_compact(marks))


def verify_masking(before: Column, after: Column) -> Column:
    return (before != after) & F.regexp_like(after, F.lit(r"REDACTED|\[[A-Z]+_[0-9a-f]{12}\]"))


def detect_phi(text: Column, detector: Callable[[Column], Column] | None = None, n: int = DETECTOR_SLICE) -> Column:
    """Spans of a text that a detector sees in slices of n characters, with offsets in the whole and scores of four digits.

    ``detector``: from a text column to an array of structs (begin_offset, end_offset, type, score); a model comes as a pandas UDF.
    """
    found = lambda s: F.transform((detector or detect_spans)(s.getField("part")), lambda x: F.struct((x.begin_offset + s.getField("offset")).alias("begin_offset"), (x.end_offset + s.getField("offset")).alias("end_offset"), x["type"].alias("type"), F.round(x.score, 4).alias("score")))
    return F.flatten(F.transform(slice_text(text, n), found))


def detect_spans(text: Column) -> Column:
    """Default detector: spans of the log patterns, found by their places in the text."""
    kinds = ["MRN", "DOB", "DATE", "NAME", "ADDRESS"]

    def of(pattern: str, kind: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0))
        parts = F.split(text, "(?i)" + pattern, -1)
        ends = F.transform(hits, lambda h, i: F.struct(F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda a, p: a + F.length(p)).alias("gap"), F.aggregate(F.slice(hits, 1, i), F.lit(0), lambda a, p: a + F.length(p)).alias("before"), F.length(h).alias("n")))
        return F.transform(ends, lambda e: F.struct((e.gap + e.before).alias("begin_offset"), (e.gap + e.before + e.n).alias("end_offset"), F.lit(kind).alias("type"), F.lit(1.0).alias("score")))

    return F.flatten(F.array(*[of(p, k) for (p, _), k in zip(LOG_PATTERNS, kinds, strict=True)]))
