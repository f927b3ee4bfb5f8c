"""Checks of generated summaries: a row per check, then a report per document and role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions import text
from chartloom.operators.coding import drug_lookup, map_terms

SUMMARY = "summary string, key_points array<string>, medications array<struct<name:string,dosage:string,frequency:string,instructions:string>>, diagnoses array<string>, follow_up_actions array<string>, confidence_score double"
#: Units with the smallest and largest value, both allowed.
DOSAGE_LIMITS = {"mg": (0.1, 5000.0), "mcg": (1.0, 10000.0), "g": (0.01, 10.0), "ml": (0.1, 500.0), "units": (1.0, 1000.0), "iu": (1.0, 1000.0)}
#: The pattern of a dosage, signs of speculation, and names of procedures.
_DOSAGE = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|units|iu)\s*$"
_SPECULATIVE = [r"(?i)\b(probably|possibly|might have|likely has)\b", r"(?i)\b(as an ai|i believe|i think)\b"]
_PROCEDURE = r"(?i)\b(?:catheterization|angioplasty|biopsy|surgery|echocardiogram|ecg|mri|ct scan|x-ray)\b"
KEYS = ["doc_id", "role"]


def _check(name: str, passed: Column, bad: str, message: Column | str, corrected: bool = False) -> Column:
    return F.struct(F.lit(name).alias("check_name"), passed.alias("passed"), F.when(passed, "info").otherwise(bad).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit(corrected).alias("auto_corrected"))


def _rows(df: DataFrame, at: int, *checks: Column) -> DataFrame:
    """A row per check that applies, with its place in the report."""
    listed = df.select(*KEYS, *[c for c in ("idx",) if c in df.columns], F.posexplode(F.array(*checks)).alias("k", "c")).filter("c IS NOT NULL")
    return listed.select(*KEYS, (F.lit(at * 1_000_000) + (F.col("idx") * 10 if "idx" in df.columns else F.lit(0)) + F.col("k")).cast("long").alias("position"), "c.*")


def auto_correct(summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From raw JSON (doc_id, role, raw): the corrected struct as ``s``, and the rows of what was corrected."""
    loose = F.from_json("raw", "medications array<string>, confidence_score string")
    typed = F.from_json("raw", SUMMARY)
    is_object = lambda m: F.startswith(F.trim(m), F.lit("{"))
    med = "name string, dosage string, frequency string, instructions string"

    def fixed(m: Column) -> Column:
        got = F.when(is_object(m), F.from_json(m, med)).otherwise(F.struct(F.trim(m).alias("name"), F.lit("").alias("dosage"), F.lit("").alias("frequency"), F.lit("").alias("instructions")))
        dose = F.trim(F.regexp_replace(got.getField("dosage"), r"\s+", " "))
        for unit in ("mg", "mcg", "ml", "iu"):
            dose = F.regexp_replace(dose, rf"(?i)\b{unit}\b", unit)
        return F.struct(F.trim(got.getField("name")).alias("name"), dose.alias("dosage"), got.getField("frequency").alias("frequency"), got.getField("instructions").alias("instructions"))

    score = loose.getField("confidence_score").try_cast("double")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    parsed = summaries.withColumn("loose", loose).withColumn("typed", typed)
    meds = F.transform(F.coalesce("loose.medications", F.array().cast("array<string>")), fixed)
    fields = [F.coalesce(F.col("typed.summary"), F.get_json_object("raw", "$.summary"), F.lit("")).alias("summary")]
    texts = lambda n: F.coalesce(F.from_json(F.get_json_object("raw", f"$.{n}"), "array<string>"), F.array().cast("array<string>")).alias(n)
    fields += [texts("key_points"), meds.alias("medications"), texts("diagnoses"), texts("follow_up_actions"), F.coalesce(clamped, F.lit(0.5)).alias("confidence_score")]
    fixed_rows = parsed.withColumn("s", F.struct(*fields)).withColumn("raw_score", F.col("loose.confidence_score"))
    strings = F.exists(F.coalesce("loose.medications", F.array().cast("array<string>")), lambda m: ~is_object(m))
    log = _rows(
        fixed_rows,
        0,
        F.when(strings, _check("auto_correct_medication_string", F.lit(True), "info", "converted medication strings to objects", True)),
        F.when(F.col("raw_score").isNotNull() & score.isNull(), _check("auto_correct_confidence_type", F.lit(True), "info", "reset confidence_score to 0.5", True)),
        F.when((score < 0) | (score > 1), _check("auto_correct_confidence_range", F.lit(True), "info", "clamped confidence_score to [0, 1]", True)),
    )
    return fixed_rows.drop("loose", "typed", "raw_score"), log


def check_schema(summaries: DataFrame) -> DataFrame:
    """Required fields and their JSON types, on the raw text."""
    v = F.try_parse_json("raw")
    kinds = {"summary": "STRING", "key_points": "ARRAY", "medications": "ARRAY", "diagnoses": "ARRAY", "follow_up_actions": "ARRAY", "confidence_score": "BIGINT|DOUBLE|DECIMAL"}
    found = {k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) for k in kinds}
    return _rows(summaries, 1, *[_check(f"schema_{k}", F.coalesce(F.regexp_like(found[k], F.lit(f"^({t})")), F.lit(False)), "error", f"field {k}") for k, t in kinds.items()])


def in_source(term: Column, source: Column, least: int, lowered: bool = False) -> Column:
    """Whether a term, or one of its words of more than ``least`` letters, occurs in a text."""
    t, s = F.lower(F.trim(term)), source if lowered else F.lower(source)
    return F.contains(s, t) | F.exists(text.words(t), lambda w: (F.length(w) > least) & F.contains(s, w))


def _with_source(summaries: DataFrame, listed: str, name: str) -> DataFrame:
    """A row per item with its source in lower case; what is looked for in a source is looked for before joins, which then don't shuffle a source per item."""
    low = summaries.withColumn("_source", F.lower("source_text"))
    return low.select(*KEYS, "_source", F.posexplode(listed).alias("idx", name))


def check_medications(summaries: DataFrame, drugs: DataFrame) -> DataFrame:
    whole, inside = F.contains("_source", F.lower(F.trim("name"))), in_source(F.col("name"), F.col("_source"), 3, lowered=True)
    meds = _with_source(summaries, "s.medications", "m").select(*KEYS, "_source", "idx", "m.name").withColumns({"whole": whole, "inside": inside}).drop("_source")
    known = drug_lookup(meds, drugs)
    return _rows(known, 2, _check("medication_reference", F.col("found"), "error", F.concat("name", F.lit(" in the reference"))), F.when(~F.col("whole"), _check("medication_source_crossref", F.col("inside"), "warning", F.concat("name", F.lit(" in the source")))))


def check_dosages(summaries: DataFrame) -> DataFrame:
    meds = summaries.select(*KEYS, F.posexplode("s.medications").alias("idx", "m")).select(*KEYS, "idx", F.trim(F.coalesce("m.dosage", F.lit(""))).alias("dosage"))
    value, unit = F.regexp_extract("dosage", _DOSAGE, 1).try_cast("double"), F.lower(F.regexp_extract("dosage", _DOSAGE, 2))
    inside = F.lit(False)
    for u, (low, high) in DOSAGE_LIMITS.items():
        inside = inside | ((unit == u) & value.between(low, high))
    check = F.when(F.col("dosage") == "", _check("dosage_present", F.lit(False), "warning", "dosage missing")).when(unit == "", _check("dosage_format_check", F.lit(False), "error", F.concat(F.lit("invalid dosage format: "), "dosage"))).otherwise(_check("dosage_range_check", F.coalesce(inside, F.lit(False)), "error", F.concat("dosage", F.lit(" in range"))))
    return _rows(meds, 3, check)


def check_diagnoses(summaries: DataFrame, dictionary: DataFrame) -> DataFrame:
    dx = _with_source(summaries, "s.diagnoses", "d").withColumn("term", F.lower(F.trim("d")))
    mapped = map_terms(dx.withColumn("inside", in_source(F.col("term"), F.col("_source"), 4, lowered=True)).drop("_source"), dictionary)
    empty = F.coalesce(F.col("term") == "", F.lit(True))
    return _rows(mapped, 4, F.when(empty, _check("diagnosis_present", F.lit(False), "error", "diagnosis is empty")).otherwise(_check("diagnosis_code", F.col("code").isNotNull(), "warning", F.col("term"))), F.when(~empty, _check("diagnosis_source_crossref", F.col("inside"), "error", F.col("term"))))


def hallucination(summaries: DataFrame, candidate: Column, source: Column, limit: float = 0.25, sample: int = 15) -> DataFrame:
    """Add unsupported (long candidate tokens without a source token) and the share that they are."""
    both = summaries.withColumn("tokens", text.clinical_tokens(candidate)).withColumn("source_tokens", text.clinical_tokens(source))
    with_gap = both.withColumn("unsupported", F.filter(F.array_except("tokens", "source_tokens"), lambda t: F.length(t) > 5))
    score = F.when(F.size("tokens") == 0, 0.0).otherwise(F.size("unsupported") / F.size("tokens"))
    return with_gap.withColumn("hallucination", score).withColumn("passed", F.col("hallucination") < limit).withColumn("sample", F.slice(F.array_sort("unsupported"), 1, sample)).drop("tokens", "source_tokens")


def summary_text() -> Column:
    names = F.transform("s.medications", lambda m: F.coalesce(m.getField("name"), F.lit("")))
    return F.concat_ws(" ", F.col("s.summary"), F.concat_ws(" ", "s.key_points"), F.concat_ws(" ", "s.diagnoses"), F.concat_ws(" ", names))


def check_speculative(summary: Column) -> list[Column]:
    return [_check("hallucination_speculative_language", ~F.regexp_like(summary, F.lit(p)), "warning", p) for p in _SPECULATIVE]


def validation_report(summaries: DataFrame, drugs: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All checks of raw summaries (doc_id, role, raw, source_text), and the report of each: passed, lists, confidence."""
    fixed, log = auto_correct(summaries)
    fixed = hallucination(fixed, summary_text(), F.col("source_text"))
    said = _rows(fixed, 5, _check("hallucination_token_overlap", F.col("passed"), "error", F.concat(F.lit("score "), F.col("hallucination").cast("string"))), *check_speculative(F.col("s.summary")))
    checks = log
    for more in (check_schema(summaries), check_medications(fixed, drugs), check_dosages(fixed), check_diagnoses(fixed, dictionary), said):
        checks = checks.unionByName(more)
    weight = F.when(F.col("severity") == "error", 1.5).when(F.col("severity") == "warning", 1.0).otherwise(0.5)
    listed = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("position", "message")))), lambda x: x.message)
    failed = ~F.col("passed")
    report = checks.groupBy(*KEYS).agg(
        (~F.bool_or(failed & (F.col("severity") == "error"))).alias("passed"),
        listed(failed & (F.col("severity") == "error")).alias("errors"),
        listed(failed & (F.col("severity") == "warning")).alias("warnings"),
        listed(F.col("auto_corrected")).alias("auto_corrections"),
        F.try_divide(F.sum(F.when(F.col("passed"), weight).otherwise(0.0)), F.sum(weight)).alias("base"),
    )
    scored = report.join(fixed.select(*KEYS, "hallucination"), KEYS, "left")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * F.col("base") + 0.3 * (1 - F.coalesce("hallucination", F.lit(0.0)))))
    return checks, scored.withColumn("confidence", confidence).drop("base")


def critical_terms(summaries: DataFrame) -> DataFrame:
    """doc_id, role, term and category of what a summary must not invent; the first of equal ones."""
    pick = lambda a, f, kind: F.transform(F.filter(F.transform(a, f), lambda t: F.coalesce(t, F.lit("")) != ""), lambda t: F.struct(t.alias("term"), F.lit(kind).alias("category")))
    blob = F.concat_ws(" ", F.col("s.summary"), F.concat_ws(" ", "s.key_points"))
    every = F.concat(
        pick("s.medications", lambda m: F.trim(m.getField("name")), "drug_name"),
        pick("s.medications", lambda m: F.trim(m.getField("dosage")), "dosage"),
        pick("s.diagnoses", lambda d: F.trim(d), "diagnosis"),
        F.transform(F.regexp_extract_all(blob, F.lit(_PROCEDURE), F.lit(0)), lambda t: F.struct(t.alias("term"), F.lit("procedure").alias("category"))),
    )
    rows = summaries.select(*KEYS, F.posexplode(every).alias("pos", "t")).select(*KEYS, "pos", "t.*")
    first = Window.partitionBy(*KEYS, F.lower("term"), "category").orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


_TERM = r"\b[a-zA-Z0-9][a-zA-Z0-9\-./]*\b"


def _plain(c) -> Column:
    return F.array_join(text.words(F.lower(c)), " ")


def _tokens(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(_TERM), F.lit(0)))


def read_source(source: Column) -> Column:
    """A source as ``term_deviation`` looks at it; made before a document's terms become rows, it is made once a document."""
    return text.let(_plain(source), lambda s: F.struct(s.alias("text"), _tokens(s).alias("tokens")))


def term_deviation(terms: DataFrame, source: str = "source_text", exact: bool = True) -> DataFrame:
    """Add deviation, 0 for a term that the source holds to 1. Only terms that the cheap tests leave are aligned.

    The source is a text, or what ``read_source`` makes of it.
    """
    read = F.col(source) if isinstance(terms.schema[source].dataType, T.StructType) else read_source(F.col(source))
    tokens = _tokens
    t = terms.withColumn("_t", _plain("term")).withColumn("_p", read).withColumns({"_s": F.col("_p.text")})
    shares = t.withColumn("_o", text.overlap_ratio(tokens("_t"), F.col("_p.tokens"))).drop("_p")
    easy = (F.col("_t") == "") | (F.col("_s") == "") | F.contains("_s", "_t") | (F.col("_o") >= 1) | (F.size(tokens("_t")) == 0)
    cheap = F.when(F.col("_t") == "", 0.0).when(F.col("_s") == "", 1.0).when(F.contains("_s", "_t"), 0.0).when(F.size(tokens("_t")) == 0, 1.0).otherwise(1 - F.col("_o"))
    done = shares.filter(easy).withColumn("deviation", cheap)
    hard = shares.filter(~easy).withColumn("deviation", 1 - (text.ratio_from("_t", "_s", "_o") if exact else F.col("_o")))
    return done.unionByName(hard).drop("_t", "_s", "_o")


def deviation_gate(terms: DataFrame, limit: float = 0.30) -> DataFrame:
    """Per document: the largest deviation from both sources (deviation_ocr, deviation_refined), and whether a term is in neither."""
    refined = F.coalesce("deviation_refined", "deviation_ocr")
    both = (F.col("deviation_ocr") > limit) & (refined > limit)
    return terms.groupBy("doc_id").agg(F.max(F.greatest("deviation_ocr", refined)).alias("max_deviation"), F.bool_or(both).alias("flagged"), F.count("*").alias("terms"))
