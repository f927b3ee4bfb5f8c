"""Classification and field extraction by ordered rules. Rule tables are data: lists, or rows of a table that a user reads."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Review thresholds by letter type; others have DEFAULT_THRESHOLD.
THRESHOLDS = {
    "Discharge Summary": 0.72, "CAMHS Discharge Summary": 0.70, "Cancer Surveillance Letter": 0.72, "HIV / GUM Clinic Letter": 0.72,
    "Maternity / Diabetes Letter": 0.70, "Surgical Outpatient Letter": 0.72, "111 First ED Report": 0.62, "ED Discharge Letter": 0.68,
    "Ambulance Clinical Report": 0.62, "Renal / Nephrology Letter": 0.72, "Paediatric Cardiology Letter": 0.70, "Medication / Prescriber Letter": 0.72,
    "Mental Health Inpatient Discharge": 0.68, "Antenatal Discharge Summary": 0.68, "Early Pregnancy / Gynaecology Letter": 0.68,
    "Pre-admission Letter": 0.70, "Ophthalmology Letter": 0.70, "Ophthalmology Referral": 0.62, "Psychiatry Outpatient Letter": 0.72,
    "Haematology Outpatient Letter": 0.70, "Procedure Report": 0.72,
}
DEFAULT_THRESHOLD = 0.72
#: Types whose first page alone is clinical, and types that are sensitive as such.
PAGE_ONE_TYPES = ["Medication / Prescriber Letter"]
SENSITIVE_TYPES = ["Mental Health Inpatient Discharge", "Antenatal Discharge Summary"]
#: Strings that mark a sensitive text.
SENSITIVE_MARKERS = ["poppy", "neonatal death", "safeguarding referral", "command hallucination", "suicidal ideation", "overdose", "ingested", "mental capacity act", "police transport", "icu", "intubated", "self-harm"]
#: Document types by patterns in the first 1000 characters.
DOCUMENT_TYPES = [
    ("discharge_summary", [r"discharge\s+summar", r"hospital\s+discharge", r"inpatient\s+summar"]),
    ("prescription", [r"prescription", r"rx\s*:", r"medication\s+order"]),
    ("lab_report", [r"lab(oratory)?\s+report", r"blood\s+test", r"pathology\s+report"]),
    ("radiology_report", [r"radiology\s+report", r"x-ray\s+report", r"ct\s+scan", r"mri\s+report"]),
]
#: Document types by parts of an id.
ID_TYPES = [("discharge_summary", ["discharge"]), ("prescription", ["prescription"]), ("lab_report", ["lab"]), ("radiology_report", ["radiology"]), ("clinical_note", ["note"])]
#: Organisations by strings in the first 800 characters.
ORGANISATIONS = [
    ("Frimley Health NHS Foundation Trust", ["frimley health", "frimley park hospital", "wexham park", "heatherwood"]),
    ("Royal Berkshire Hospital NHS Foundation Trust", ["royal berkshire", "rbh", "london road, reading"]),
    ("Berkshire Healthcare NHS Foundation Trust", ["berkshire healthcare", "prospect park", "talking therapies"]),
    ("South Central Ambulance Service NHS Foundation Trust", ["south central ambulance", "scas"]),
    ("University Hospital Southampton NHS Foundation Trust", ["university hospital southampton", "uhs", "tremona road"]),
    ("Kettering General Hospital NHS Foundation Trust", ["kettering", "rothwell road"]),
    ("Evolutio Care Innovations Ltd", ["evolutio", "odtc.co.uk", "newtown house, newtown road"]),
    ("Expert Health Ltd", ["expert health", "expert/health", "experthealth", "expert health ltd", "dr. mitra dutt"]),
]
#: Keywords of entity classes.
ENTITY_CLASSES = [
    ("DIAGNOSIS", ["diabetes", "hypertension", "pneumonia", "infection", "disease", "syndrome"]),
    ("MEDICATION", ["aspirin", "ibuprofen", "amoxicillin", "metformin", "lisinopril"]),
    ("DOSAGE", ["mg", "ml", "mcg", "iu", "tablet", "capsule"]),
    ("CLINICAL", ["cardiac", "renal", "hepatic", "pulmonary", "neurological"]),
]
#: Codes of arrival methods.
ARRIVAL_METHODS = {
    "1": "Self Referral", "2": "Emergency Services", "3": "Police Transport", "4": "Healthcare Provider", "6": "Emergency Ambulance",
    "8": "Emergency Road Ambulance WITH Medical Escort", "10": "Air Ambulance", "15": "Patient arranged own transport / walk-in", "99": "Other",
}

Rules = Sequence[tuple[str, Sequence[str]]]
#: From so many strings on they are looked for in Python.
MANY_STRINGS = 64


def first_match(text: Column, rules: Rules, default: str | None, head: int | None = None, literal: bool = True, word_bounds: bool = False) -> Column:
    """The label of the first rule of which any string (``literal``) or pattern occurs, whatever the case.

    One expression with a branch per rule, so later rules aren't tried. ``word_bounds``: only whole words count. With many literal strings
    the search for each is the work, and Python's skips ahead where ``contains`` looks at every byte; so these are a function over Arrow.
    """
    t = F.coalesce(text, F.lit(""))
    t = F.lower(F.substring(t, 1, head) if head else t)
    if literal and not word_bounds and sum(len(strings) for _, strings in rules) >= MANY_STRINGS:
        return _first_label([(label, [s.lower() for s in strings]) for label, strings in rules], default)(t)

    def branches(t: Column) -> Column:
        out = F.lit(default).cast("string")
        for label, strings in reversed(rules):
            if literal and not word_bounds:
                hit = reduce(lambda a, s: a | F.contains(t, F.lit(s.lower())), strings, F.lit(False))
            else:
                joined = "|".join(re.sub(r"([^\w\s])", r"\\\1", s.lower()) if literal else s for s in strings)
                hit = F.regexp_like(t, F.lit(rf"\b(?:{joined})\b" if word_bounds else f"(?:{joined})"))
            out = F.when(hit, label).otherwise(out)
        return out

    return F.transform(F.array(t), branches)[0]


def _first_label(rules: Rules, default: str | None):
    @F.pandas_udf(T.StringType())
    def label(texts: pd.Series) -> pd.Series:
        return pd.Series([next((name for name, strings in rules if any(s in t for s in strings)), default) for t in texts], dtype=object)

    return label


def rules_from_rows(rows: Iterable) -> list[tuple[str, list[str]]]:
    """Rules from the rows (label, signal) of a table, in the order given."""
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["label"], []).append(r["signal"])
    return list(out.items())


#: How many characters of a text are looked at for its type and its organisation, and read of short and of other types.
TYPE_HEAD, ORGANISATION_HEAD, PAGE_ONE_HEAD, OTHER_HEAD = 1000, 800, 1500, 4000


def document_type(text: Column) -> Column:
    return first_match(text, DOCUMENT_TYPES, "unknown", head=TYPE_HEAD, literal=False)


def type_from_id(doc_id: Column) -> Column:
    return first_match(doc_id, ID_TYPES, "unknown")


def organisation(text: Column) -> Column:
    return first_match(text, ORGANISATIONS, "Unknown Trust", head=ORGANISATION_HEAD)


def entity_class(text: Column) -> Column:
    return first_match(text, ENTITY_CLASSES, None)


def is_sensitive(text: Column, kind: Column | None = None, markers: Sequence[str] = SENSITIVE_MARKERS, word_bounds: bool = False) -> Column:
    marked = F.coalesce(first_match(text, [("yes", markers)], None, word_bounds=word_bounds) == "yes", F.lit(False))
    return marked if kind is None else marked | F.coalesce(kind.isin(SENSITIVE_TYPES), F.lit(False))


def arrival_method(text: Column) -> Column:
    code = F.regexp_extract(text, r"\[(\d+)\]", 1)
    known = F.create_map(*[F.lit(x) for pair in ARRIVAL_METHODS.items() for x in pair])
    return F.when(code == "", text).otherwise(F.coalesce(F.try_element_at(known, code), F.concat(F.lit("Code "), code)))


def page_scope(text: Column, kind: Column) -> Column:
    """As much of the text as a type's later stages read."""
    return F.when(kind.isin(PAGE_ONE_TYPES), F.substring(text, 1, PAGE_ONE_HEAD)).otherwise(F.substring(text, 1, OTHER_HEAD))


def threshold_of(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.lit(DEFAULT_THRESHOLD))


def icd_codes(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]\d{2}(?:\.\d{1,2})?)\b"), F.lit(1)))


#: The pattern of a drug and its dose, and which lines and names count.
SHORTEST_LINE, SHORTEST_NAME, LONGEST_NAME = 8, 4, 59
_AMOUNT = r"\d+\.?\d*\s*(?:mg|ml|mcg|iu|g|mg/ml|ml/hr|units?|%|micrograms?)"
#: A name begins in a run of letters, spaces and hyphens that a dose follows; other runs are passed over at once, so that lines take linear time.
_DOSE = rf"(?i)(?<![a-zA-Z\s\-])(?=[a-zA-Z\s\-]++(?<=\s){_AMOUNT})[a-zA-Z\s\-]*?(\b[A-Z][a-zA-Z\s\-]+?)\s+({_AMOUNT}[^\n,;]{{0,40}})"


def medications(text: Column, most: int = 20) -> Column:
    """name and dose of the first line of each drug, in order. A sort by name finds first lines, and a sort by place their order."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: (F.length(x) >= SHORTEST_LINE) & F.regexp_like(x, F.lit(_DOSE)))
    found = F.transform(lines, lambda x: F.struct(F.regexp_replace(F.trim(F.regexp_extract(x, _DOSE, 1)), "[-– ]+$", "").alias("name"), F.trim(F.regexp_extract(x, _DOSE, 2)).alias("dose"), x.alias("raw")))
    fit = F.filter(found, lambda m: F.length(m.getField("name")).between(SHORTEST_NAME, LONGEST_NAME))
    keyed = F.array_sort(F.transform(fit, lambda m, i: F.struct(F.lower(m.getField("name")).alias("key"), i.alias("i"), m.alias("m"))))
    first = lambda rows: F.filter(rows, lambda r, j: (j == 0) | (F.get(rows, j - 1).getField("key") != r["key"]))
    places = F.array_sort(F.transform(F.transform(F.array(keyed), first)[0], lambda r: F.struct(r["i"].alias("i"), r["m"].alias("m"))))
    return F.slice(F.transform(places, lambda s: s["m"]), 1, most)


#: Fields of letters: name, what marks its line, pattern whose group is the value (none: the next line), longest value, which line counts.
FIELDS = [
    ("admission_date", "admission date", r"(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4})", 0, "last"),
    ("discharge_date", "discharge date", r"(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4})", 0, "last"),
    ("appointment_date", "appointment.?date", r"(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4})", 0, "last"),
    ("consultant", r"discharging consultant|consultant[:\s]|lead professional", r"(?i)(?:consultant|lead professional)[:\s]+([A-Z][^\n,]{3,50})", 0, "first"),
    ("department", r"discharging specialty|department[:\s]|specialty[:\s]", r"(?i)(?:specialty|department)[:\s]+([A-Za-z][^\n]{3,40})", 0, "first"),
    ("admission_method", "admission method", r"(?i)admission method[:\s]+([^\n]{3,60})", 0, "last"),
    ("discharge_method", "discharge method", r"(?i)discharge method[:\s]+([^\n]{3,60})", 0, "last"),
    ("procedure", r"procedure[:\(]|procedure\s*date", "", 120, "last"),
    ("indication", "^indication", "", 200, "last"),
    ("impression", "^overall impression|^impression", "", 300, "last"),
    ("gp_actions", r"actions.*(gp|general practice)|gp.actions", "", 300, "last"),
    ("diagnosis_text", "^diagnosis|^post.op diagnosis", "", 200, "first"),
]


def structured_fields(text: Column, fields: Sequence[tuple] = FIELDS) -> Column:
    """A struct with one string per field, empty where no line has it; no line gives the hospital. Lines are looked at within the row."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))

    def body(lines: Column) -> Column:
        def one(name: str, mark: str, pattern: str, most: int, which: str) -> Column:
            def value(x: Column, i: Column) -> Column:
                if pattern:
                    got = F.trim(F.regexp_extract(x, pattern, 1))
                else:
                    after = F.coalesce(F.get(lines, i + 1), F.lit(""))
                    got = F.substring(F.when(after == "", x).otherwise(after) if name == "gp_actions" else after, 1, most)
                    got = F.when(F.length(after) > 3, got).otherwise("") if name == "procedure" else got
                return F.when(F.regexp_like(F.lower(x), F.lit(mark)), got).otherwise("")

            found = F.filter(F.transform(lines, value), lambda v: v != "")
            return F.coalesce(F.get(found, F.lit(0)) if which == "first" else F.try_element_at(found, F.lit(-1)), F.lit("")).alias(name)

        return F.struct(*[one(*f) for f in fields], F.lit("").alias("hospital"))

    return F.transform(F.array(trimmed), body)[0]
