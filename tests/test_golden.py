"""Golden cases: small inputs with results known by hand or from published examples."""

import datetime as dt
import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.functions import letters, privacy, rules, scores, text
from chartloom.operators import assemble, audit, coding, correct, metrics, ocr, prompts, routing, validate, vectors
from chartloom.sources import files, schemas, sinks
from chartloom.streaming import jobs, ledger


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x)


# scores


@pytest.mark.parametrize(("given", "expected"), [("50", 0.5), ("1", 1.0), ("1.5", 0.015), ("bad", 0.3), (None, 0.3), ("-2", 0.0), ("250", 1.0), ("0.4", 0.4)])
def test_unit_interval(spark, given, expected):
    assert one(spark, scores.unit_interval(lit(given).cast("string"), 0.3)) == pytest.approx(expected)


def test_weighted_score_and_bundle(spark):
    parts = dict(zip(scores.COMPONENTS, map(lit, (0.9, 0.8, 0.7, 0.6)), strict=True))
    assert one(spark, scores.weighted_score(parts)) == 0.75
    assert one(spark, scores.resolve_weights({k: lit(0.0) for k in parts})["faiss"]) == 0.25
    rows = spark.createDataFrame([("a", 0.85, 0.90, 0.70, 0.80, None), ("b", 0.1, 0.1, 0.1, 0.1, '{"body": "{\\"unified_confidence_score\\": 0.9}"}')], "doc_id string, textract double, comprehend double, faiss double, llm_logprobs double, stored string")
    got = {r.doc_id: r for r in routing.confidence_bundle(rows).collect()}
    assert (got["a"].score, got["a"].route, got["a"].band) == (0.8125, "human_review", "medium")
    assert (got["b"].score, got["b"].route) == (0.9, "bypass_database")
    assert json.loads(routing.route_payload(routing.route_final(rows)).first().payload)["weights"]["faiss"] == 0.25


def test_self_weighted_and_savings(spark):
    rows = spark.createDataFrame([(0.8,), (0.6,)], "c double")
    assert rows.agg(scores.self_weighted_confidence(F.col("c"))).first()[0] == 0.7143
    assert one(spark, scores.cost_savings(lit(100.0), lit(68.0))) == 32.0
    assert one(spark, scores.cost_savings(lit(0.0), lit(1.0))) == 0.0
    assert [one(spark, scores.batch_status(lit(f), lit(3))) for f in (0, 1, 3)] == ["SUCCESS", "PARTIAL", "FAILED"]


# OCR


def test_mean_confidences(spark):
    blocks = spark.createDataFrame([(1, "LINE", 95.0), (1, "WORD", 85.0), (1, "TABLE", 70.0), (2, "LINE", 0.0)], "doc_id long, type string, conf double")
    got = {r.doc_id: r for r in ocr.mean_confidences(blocks).collect()}
    assert (got[1].router, got[1].aggregator, got[1].metrics, got[1].error_proxy) == (90.0, 0.9, 95.0, 5.0)
    assert (got[2].router, got[2].aggregator, got[2].portal) == (0.0, 0.0, 0.5)
    assert {r.doc_id: r.route for r in ocr.route_by_ocr(ocr.mean_confidences(blocks)).collect()} == {1: "tracks", 2: "refinement"}


def test_pages_and_boxes(spark):
    page = '{"Blocks":[{"BlockType":"LINE","Text":"a","Confidence":90,"Geometry":{"BoundingBox":{"Left":1,"Top":2,"Width":3,"Height":4}}},{"BlockType":"WORD","Text":"x","Confidence":1},{"BlockType":"LINE","Text":"b","Confidence":80}]}'
    pages = spark.createDataFrame([("d", 1, page)], "doc_id string, page int, raw string").select("doc_id", "page", F.from_json("raw", schemas.OCR_PAGE).alias("j")).select("doc_id", "page", "j.*")
    assert pages.select(ocr.ocr_text(F.col("Blocks"), " ")).first()[0] == "a b"
    rows = ocr.explode_blocks(pages).withColumn("bbox", scores.bbox(F.col("box"))).orderBy("pos").collect()
    assert [r.bbox for r in rows] == [[1.0, 2.0, 4.0, 6.0], [], []]


def test_escalations_and_tiers(spark):
    rows = spark.createDataFrame([(1, 0.84), (2, 0.85), (3, None)], "id long, conf double")
    accepted, low = routing.split_escalations(rows)
    assert [r.id for r in accepted.collect()] == [2] and sorted(r.id for r in low.collect()) == [1, 3]
    assert one(spark, rules.threshold_of(lit("ED Discharge Letter"))) == 0.68
    assert one(spark, rules.threshold_of(lit("?"))) == 0.72


def test_actions(spark):
    items = F.from_json(lit('[{"text":" a ","priority":"high"},{"text":"b","priority":"urgent","due_date":"bad-date"},{"text":""},{"text":"c","due_date":"2024-05-06T00:00"}]'), "array<struct<text:string,priority:string,due_date:string,assignee:string>>")
    got = one(spark, routing.normalise_actions(items, lit(dt.date(2024, 1, 1))))
    assert [(x.text, x.priority, x.due_date) for x in got] == [("a", "High", dt.date(2024, 1, 8)), ("b", "Medium", dt.date(2024, 1, 8)), ("c", "Medium", dt.date(2024, 5, 6))]
    assert one(spark, routing.format_actions(routing.parse_actions(lit("- a\n\n -b \n")))) == "- a\n- b"


# text


def test_chunks(spark):
    spans = lambda t: [(c.start, c.end) for c in one(spark, text.chunk_sentences(lit(t), 500, 50))]
    assert spans("x" * 1000) == [(0, 500), (450, 950), (900, 1000)]
    assert spans("x" * 950)[-1] == (900, 950)
    assert spans("a" * 300 + "." + "b" * 400)[:2] == [(0, 301), (251, 701)]
    assert spans("short") == [(0, 5)]


def test_sections(spark):
    t = "intro\nChief Complaint\npain\nPlan:\nrest"
    got = one(spark, text.section_array(lit(t), text.headers_of(lit("discharge_summary"))))
    assert [(s.name, s.body) for s in got] == [("header", "intro"), ("chief_complaint", "Chief Complaint\npain"), ("plan_", "Plan:\nrest")]
    assert one(spark, text.section_array(lit("a\nb"), text.headers_of(lit("unknown"))))[0].name == "header"


def test_windows_and_slices(spark):
    words = [f"w{i}" for i in range(200)]
    words[120] = "Target,"
    got = one(spark, text.context_window(lit(" ".join(words)), lit("target x"))).split()
    assert len(got) == 75 and got[37] == "Target,"
    assert len(one(spark, text.context_window(lit(" ".join(words)), lit("w199"))).split()) >= 50
    assert one(spark, text.truncate_center(lit(" ".join(words * 2)))).split()[0] == words[33]
    assert [(s.offset, s.part) for s in one(spark, text.slice_text(lit("abcde"), 2))] == [(0, "ab"), (2, "cd"), (4, "e")]


def test_parsing(spark):
    schema = "summary string, confidence_score double"
    assert one(spark, text.summary_or_raw(lit('```json\n{"summary": "s", "confidence_score": 0.7}\n```'), schema)).confidence_score == 0.7
    raw = one(spark, text.summary_or_raw(lit("no json"), schema))
    assert (raw.summary, raw.confidence_score) == ("no json", 0.5)
    assert one(spark, text.parse_correction_json(lit('{"confidence": 3}'), lit("ocr"))).asDict() == {"corrected_text": "ocr", "confidence": 1.0, "reasoning": ""}
    assert one(spark, text.strip_markdown(lit("## Head\n**bold** and *it*\n---\n"))) == "Head\nbold and it"
    long = " ".join(["word"] * 40 + ["end.", *["more"] * 20])
    assert one(spark, text.clip(lit(long))).endswith("end.")


def scrubbed(value, sex=""):
    """The same passes over one text, as the standard library's expressions."""
    t = (value or "").strip()
    for pattern, instead in text.DEMOGRAPHICS:
        t = re.sub(pattern, instead, t)
    t = re.sub(r"\s{2,}", " ", t).strip(" ,.-")
    label = text.SEXES.get((sex or "").strip().lower(), "patient")
    t = re.sub(r"(?i)^(the\s+)?(male|female)\s+patient\b", r"\2 patient", t).strip()
    if t and not re.match(text.SUBJECT, t):
        t = re.sub(text.ANY_SUBJECT, label, t, count=1)
        if not re.match(text.SUBJECT, t):
            t = f"{label.capitalize()} {t[0].lower() + t[1:]}"
    return re.sub(text.TWICE, r"\1 patient", t).strip()


def test_demographics_are_scrubbed(spark):
    texts = [
        "A 45-year-old man, Mr John O'Neil, DOB: 01/02/1980, was seen.", "The patient aged 60 has pain", "Patient Name: Jane Doe. Well.", "29M with cough (29)", "", None, "  ", "The male patient the male patient is well", "male patient NHS No: 123 456 7890 has asthma.",
        "Age of 70, sex: female, Hospital Number 77; stable", "Dr Smith Jones wrote. Address: 1 Road, Town", "12 y/o child", "MRN 99", "Ärztin  Dr. Ämi\u00a0\u00a0x", "the patient", "Female Patient rests", "90 year old",
    ]
    sexes = ["Male", " f ", "unknown", None]
    rows = spark.createDataFrame([(t, s) for t in texts for s in sexes], "t string, s string")
    got = rows.select("t", "s", text.scrub_demographics(F.col("t"), F.col("s")).alias("x")).collect()
    assert [(r.t, r.s, r.x) for r in got] == [(t, s, scrubbed(t, s)) for t in texts for s in sexes]
    assert scrubbed("A 45-year-old man, Mr John Smith, was seen", "Male") == "Male patient a man, patient, was seen"


def test_text_accuracy(spark):
    cases = [("a", "Metformin  500 MG", "metformin 500 mg"), ("b", "abcd", "abce"), (None, None, "x")]
    rows = spark.createDataFrame(cases, "document_id string, extracted string, ground_truth string")
    assert {tuple(r) for r in metrics.text_scores(rows).collect()} == {("a", 100.0), ("b", 75.0), ("unknown", 0.0)}
    assert tuple(metrics.text_accuracy(rows).first()) == (3, 58.333, False) and tuple(metrics.text_accuracy(rows.limit(1)).first()) == (1, 100.0, True)
    assert tuple(metrics.text_accuracy(rows.limit(0)).first()) == (0, 0.0, False)


def test_medications_keep_the_first_line_of_each_drug(spark):
    lines = ["Metformin 500 mg daily", "Aspirin 75 mg", "metformin 850 mg", "no dose", "ASPIRIN 300 mg once"]
    got = one(spark, rules.medications(lit("\n".join(lines))))
    assert [(m.name, m.dose) for m in got] == [("Metformin", "500 mg daily"), ("Aspirin", "75 mg")]
    many = "\n".join(f"Drug{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} {i + 1} mg" for i in range(20_000))
    began = time.time()
    assert [m.dose for m in one(spark, rules.medications(lit(many)))] == [f"{i + 1} mg" for i in range(20)] and time.time() - began < 30


def test_nearest_vectors_by_tiles(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (230, 6)).astype(float)  # many ties and zero vectors
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, embedding array<float>")
    queries = rows.filter("id % 3 = 0 AND id < 900").withColumnRenamed("id", "query_id")
    for cosine, k, tile, part in ((True, 4, 16, 1 << 10), (False, 7, 1024, 32 << 20), (True, 300, 50, 1 << 9)):
        length = np.linalg.norm(v, axis=1, keepdims=True)
        with np.errstate(invalid="ignore"):
            u = v / length if cosine else v
        expected = set()
        for q in range(0, 230, 3):
            scored = sorted((-s, i) for i, s in enumerate(np.round(u @ u[q], 6)) if np.isfinite(s))
            expected |= {(q, i, -s, r) for r, (s, i) in enumerate(scored[:k], 1)}
        got = vectors.knn(queries, rows, k, cosine, part, tile)
        assert {tuple(r) for r in got.select("query_id", "id", "score", "rank").collect()} == expected


def test_actions_of_a_model(spark):
    read = lambda raw: one(spark, text.parse_actions_json(lit(raw))).asDict(recursive=True)
    full = {"sender_actions": {"doctor": ["a {b", "it's \"5\" }"], "pharmacist": [], "reception": []}, "gp_surgery_actions": {"doctor": [], "pharmacist": ["p"], "reception": ["r"]}}
    none = {p: dict.fromkeys(text.ACTION_ROLES, []) for p in text.ACTION_PARTS}
    body = {"sender_actions": {"doctor": ["a {b", "", None, "it's \"5\" }"]}, "gp_surgery_actions": {"pharmacist": ["p"], "reception": ["r"], "doctor": "no list"}, "more": {"x": [1]}}
    assert read(f"Here:\n```json\n{json.dumps(body)}\n``` and {{'x': 1}}}}") == full
    assert read(f"{json.dumps(body, indent=2)} trailing }} {{") == full
    single = "{'sender_actions': {'doctor': ['see {x', 'don\\'t'], 'reception': ['call']}, 'gp_surgery_actions': 'none'}"
    assert read(single) == none | {"sender_actions": {"doctor": ["see {x", "don't"], "pharmacist": [], "reception": ["call"]}}
    for raw in ("no object", "", "{'sender_actions': {'doctor': ['open'", "{}", '{"sender_actions": []}', "} {", None):
        assert read(raw) == none
    assert one(spark, text.outermost(lit("x {a {b} c} {d}"))) == "{a {b} c}" and one(spark, text.outermost(lit("{' {} }"))) == "{' {} }"
    assert len(one(spark, text.outermost(lit("{" * 20_000 + '"' + "}" * 20_000 + '"' + "}" * 20_000)))) == 60_002


def sentence_chunks(t, n, back):
    """One chunk after another, as a plain loop."""
    t, out, at = t or "", [], 0
    if len(t) <= n:
        return [(0, len(t), t)]
    while at < len(t):
        end = at + n
        if end < len(t) and (stop := t.rfind(".", at, end)) > at + n // 2:
            end = stop + 1
        out.append((at, min(end, len(t)), t[at:end].strip()))
        at = end - back
    return out


def test_sentence_chunks_against_a_loop(spark):
    rng = random.Random(9)
    texts = [None, "", ".", "." * 1200, "é" * 1501, "a. " * 700, "漢字。." * 400, "x" * 501] + ["".join(rng.choices("ab é.\n\u3000", weights=[9, 9, 4, 2, 1, 1, 1], k=rng.randint(1, 3000))) for _ in range(40)]
    for n, back in ((500, 50), (20, 5), (7, 4), (10, 0)):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.chunk_sentences(F.col("t"), n, back).alias("c"))
        assert {r.i: [tuple(c) for c in r.c] for r in rows.collect()} == {i: sentence_chunks(t, n, back) for i, t in enumerate(texts)}
    with pytest.raises(ValueError, match="overlap"):
        text.chunk_sentences(lit("x"), 10, 7)


def test_long_texts_are_cut_in_linear_time(spark):
    lines = 100_000
    took = []
    for n in (lines // 4, lines):
        t = "\n".join(f"Result: line {i} of text." if i % 50 == 0 else f"line {i} of text." for i in range(n))
        row = spark.createDataFrame([(t,)], "t string").select(text.section_array(F.col("t"), text.headers_of(lit("lab_report"))).alias("s"), text.chunk_sentences(F.col("t")).alias("c"))
        began = time.time()
        got = row.select(F.size("s").alias("sections"), F.size("c").alias("chunks"), F.element_at("c", -1).getField("end").alias("end")).first()
        took.append(time.time() - began)
        assert got.sections == n // 50 and got.end == len(t)
    assert took[1] < 12 * took[0] + 5


def test_token_sets(spark):
    j = text.jaccard(text.bare_tokens(lit("the quick brown fox")), text.bare_tokens(lit("the slow brown dog.")))
    assert one(spark, j) == pytest.approx(2 / 6)
    assert one(spark, text.jaccard(text.bare_tokens(lit("")), text.bare_tokens(lit(" ")))) == 1.0
    assert one(spark, text.sequence_ratio(lit("Metformin 500"), lit("metformin  500"))) == 1.0
    assert one(spark, text.keyword_terms(lit("Asthma and asthma, COPD"), [r"\b(asthma|copd)\b"])) == ["asthma", "copd"]


# rules


def test_rules(spark):
    table = [{"label": "B", "signal": "beta"}, {"label": "A", "signal": "alpha (x)"}, {"label": "B", "signal": "b2"}]
    kinds = rules.rules_from_rows(table)
    assert [one(spark, rules.first_match(lit(t), kinds, "Clinical Letter")) for t in ("alpha (x) b2", "ALPHA (X)", "none")] == ["B", "A", "Clinical Letter"]
    assert one(spark, rules.is_sensitive(lit("some difficulty"))) and not one(spark, rules.is_sensitive(lit("some difficulty"), word_bounds=True))
    assert one(spark, rules.arrival_method(lit("[8] x"))) == "Emergency Road Ambulance WITH Medical Escort"
    assert one(spark, rules.arrival_method(lit("[7]"))) == "Code 7" and one(spark, rules.arrival_method(lit("foot"))) == "foot"
    assert one(spark, rules.document_type(lit("Hospital  Discharge note"))) == "discharge_summary"
    assert one(spark, rules.type_from_id(lit("LAB_1"))) == "lab_report"
    assert one(spark, rules.organisation(lit("x Wexham Park y"))) == "Frimley Health NHS Foundation Trust"
    assert one(spark, rules.entity_class(lit("Aspirin"))) == "MEDICATION" and one(spark, rules.entity_class(lit("chair"))) is None
    assert len(one(spark, rules.page_scope(lit("x" * 5000), lit("Medication / Prescriber Letter")))) == 1500
    assert one(spark, rules.icd_codes(lit("K64.9 then F31.0 and K64.9, ICD10"))) == ["K64.9", "F31.0"]


LETTER = """Patient Name: Ann Example
DOB: 01/02/1980
Gender
F
Admission Date: 03/04/2024
Consultant: Dr Nobody Here
Diagnosis
Essential hypertension
GP Actions
Check blood pressure
Ramipril 5 mg once daily
ramipril 10 mg
Paracetamol 500 mg as needed
She was well."""


def test_letter_extraction(spark):
    f = one(spark, rules.structured_fields(lit(LETTER)))
    assert (f.admission_date, f.consultant, f.diagnosis_text, f.gp_actions, f.hospital) == ("03/04/2024", "Dr Nobody Here", "Essential hypertension", "Check blood pressure", "")
    p = one(spark, letters.patient_info(lit(LETTER)))
    assert (p.name, p.dob, p.sex, p.nhs_number) == ("Ann Example", "01/02/1980", "Female", "Not available")
    assert [m.name for m in one(spark, rules.medications(lit(LETTER)))] == ["Ramipril", "Paracetamol"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("Re: Mr Smith, John\nNHS No: 123 456 7890\nBorn 22-Feb-1996", {"name": "Smith, John", "sex": "Male", "nhs_number": "123 456 7890", "dob": "22-Feb-1996"}),
        ("DOB\n01.02.1990\nDOE, Jane\nLegal Sex: F\nNHS Number\n462 213 3695", {"name": "DOE, Jane", "sex": "Female", "nhs_number": "462 213 3695", "dob": "01.02.1990"}),
        ("Patient: MRN Number 5\nName: Al Bo", {"name": "Al Bo"}),
        ("Gender\nMale\nPatient Name\nAnn Lee\nDate of birth:\n3 March 1950", {"name": "Ann Lee", "sex": "Male", "dob": "3 March 1950"}),
        ("Sex: Ma'e\nMRN: A12345\nSurgery: High Street\nComplaint: chest pain", {"sex": "Male", "hospital_number": "A12345", "gp_practice": "High Street", "presenting_complaint": "chest pain"}),
        ("Pathways disposition\nRefer within 1 hour\nG2 P1 today\nEstimated Delivery Date (EDD): 01/02/2025\nEGA (EGA): 29+1 weeks", {"pathways_urgency": "Refer within 1 hour", "gravida_parity": "G2P1", "edd": "01/02/2025", "gestational_age": "29+1 weeks"}),
        ("Patient: x\nRe - Ann\nsome street\n03/04/1971", {"dob": "03/04/1971"}),
        ("Mrs Jones came", {"sex": "Female", "name": "Not available"}),
        (None, {"name": "Not available", "edd": ""}),
    ],
)
def test_patient_details(spark, given, expected):
    p = one(spark, letters.patient_info(F.lit(given).cast("string"))).asDict()
    assert {k: p[k] for k in expected} == expected


def test_sex_from_context(spark):
    sex = lambda t, *s: one(spark, letters.infer_sex(lit(t), *map(lit, s)))
    assert sex("He saw his doctor") == "Male" and sex("x", "She rests", "and she walks") == "Female" and sex("he and she") == ""
    assert sex("Sex: F. He") == "Female" and sex("Mr Smith") == "Male" and sex("x", "a male patient") == "Male" and sex("x") == ""


def test_each_letter_type_is_known_by_its_signs(spark):
    rows = [(name, f"A {sign.upper()} b") for name, signals in letters.LETTER_RULES for sign in signals]
    got = spark.createDataFrame(rows, "name string, text string").select("name", letters.letter_type(F.col("text")).alias("kind")).distinct().collect()
    assert {r.name for r in got if r.name == r.kind} == set(letters.LETTER_ORDER)
    assert all(letters.LETTER_ORDER.index(r.kind) <= letters.LETTER_ORDER.index(r.name) for r in got)


def test_order_of_letter_rules(spark):
    kind = lambda t: one(spark, letters.letter_type(lit(t)))
    assert kind("nothing here") == "Clinical Letter" and kind("Antenatal discharge") == "Antenatal Discharge Summary" and kind("antenatal clinic") == "Maternity / Diabetes Letter"
    assert kind("ophthalmology") == "Clinical Letter" and one(spark, letters.registry_type(lit("Ophthalmology"))) == "Ophthalmology Letter"
    assert kind("referral for PSA") == "Urology Outpatient Letter" and kind("seen by specsavers") == "Ophthalmology Referral"


@pytest.mark.parametrize(
    ("kind", "given", "expected"),
    [
        ("111 First ED Report", "?? Stroke today\nEncounter Type phone", {"differential_diagnosis": "Stroke today", "encounter_type": "phone"}),
        ("Cancer Surveillance Letter", "pT2 N0 M0\nCEA: 3.1", {"tnm_staging": "pT2 N0 M0", "cea_value": "3.1"}),
        ("Maternity / Diabetes Letter", "OGTT\n0 mins = 5.1 120 mins = 8.2\ntest 4 times per day", {"ogtt_results": "0min=5.1 / 120min=8.2", "monitoring_frequency": "4 times/day"}),
        ("Haematology Outpatient Letter", "HGB: 120 WBC 5.5 hgb: 121", {"key_labs": "HGB=121;WBC=5.5"}),
        ("Renal / Nephrology Letter", "eGFR\n23\nUrea 7.5", {"renal_labs": "egfr=23;urea=7.5"}),
        ("Ophthalmology Letter", "R2M1P0 and R1 M0 P0 then R2M1P0\nright 6/9 left 6/12", {"retinopathy_grade": "R2M1P0 / R1 M0 P0", "visual_acuity": "R: 6/9  L: 6/12"}),
        ("Ambulance Clinical Report", "NEWS2 score: 5\nPulse 88 and\nSpO2 97", {"news2_score": "5", "first_vitals": "Pulse 88 SpO2 97%"}),
        ("Clinical Letter", "Dear Dr Who\n1 High Street\nReading RG1", {"gp_address": "1 High Street, Reading RG1"}),
        ("Clinical Letter", "CEA: 3.1", {}),
    ],
)
def test_findings_by_type(spark, kind, given, expected):
    got = one(spark, letters.clinical_specifics(lit(given), lit(kind)))
    assert {k: got.get(k) for k in expected} == expected and (expected or not got)


# privacy


def test_anonymise(spark):
    got = one(spark, privacy.anonymise(lit("Patient. Dr John Smith (MRN: 12345678) was seen on 01/02/1980. Email: a.b@example.org")))
    assert got.types == ["date_of_birth", "email", "name"] and "[EMAIL_REDACTED]" in got.text and "MRN: 12345678" in got.text
    assert one(spark, privacy.anonymise(lit("NHS 456 956 5328"))).types == ["phone"]
    assert one(spark, privacy.anonymise(lit("MRN:12345678"))).types == ["mrn"]


def test_masking(spark):
    t = "Patient John Doe MRN: 123456 visited on 01/10/2024."
    spans = F.from_json(lit('[{"begin_offset":8,"end_offset":16,"type":"NAME"},{"begin_offset":22,"end_offset":28,"type":"ID"},{"begin_offset":5,"end_offset":900,"type":"X"}]'), "array<struct<begin_offset:int,end_offset:int,type:string,score:double>>")
    got = one(spark, privacy.mask_spans(lit(t), spans))
    assert "John Doe" not in got and "123456 " not in got and "[DATE_REDACTED]" in got
    assert one(spark, privacy.verify_masking(lit(t), lit(got)))
    assert json.loads(one(spark, privacy.mask_json(lit('{"a": ["Mr John Doe"], "n": 1}')))) == {"a": ["[NAME_REDACTED]"], "n": 1}
    assert one(spark, privacy.mask_by_role(lit("clinician"), lit(t))) == t
    found = one(spark, privacy.detect_spans(lit(t)))
    assert {t[s.begin_offset : s.end_offset] for s in found} >= {"MRN: 123456", "01/10/2024"}
    assert one(spark, privacy.residual_pii(lit('{"a": "x@y"}'))) == ["@"] and one(spark, privacy.residual_pii(lit("@ REDACTED"))) == []
    row = spark.createDataFrame([(("Mr John Doe", ["on 01/10/2024"], 3),)], "s struct<a:string,b:array<string>,c:int>")
    masked = row.select(privacy.mask_typed(F.col("s"), row.schema["s"].dataType).alias("s")).first().s
    assert (masked.a, masked.b, masked.c) == ("[NAME_REDACTED]", ["on [DATE_REDACTED]"], 3)


# coding and vectors


def test_entity_mapping(spark):
    rows = spark.createDataFrame(
        [(1, "a", "c", 0.95, [("d", "1", 0.9)]), (2, "b", "c", 0.74, [("d", "2", 0.9)]), (3, "b", "c", 0.2, []), (4, "zz", "c", 0.2, [])],
        "id int, term string, context string, score double, concepts array<struct<Description:string,Code:string,Score:double>>",
    )
    seen = []

    def fallback(keys):
        seen.append(keys.count())
        return keys.filter("term = 'b'").select("key", F.lit("9").alias("code"), F.lit(0.5).alias("confidence"))

    got = {r.id: (r.code, r.confidence, r.source) for r in coding.map_entities(rows, fallback).collect()}
    assert got == {1: ("1", 0.95, "comprehend_medical"), 2: ("9", 0.5, "semantic_fallback"), 3: ("9", 0.5, "semantic_fallback"), 4: ("NOT_MAPPED", 0.0, "failed")}
    assert seen == [2]


def test_condition_like(spark):
    cases = [("Hypertension", "MEDICAL_CONDITION", "DX_NAME", [], "", 0.9, True), ("COPD", "MEDICAL_CONDITION", "", [], "", 0.9, True), ("ABCD", "MEDICAL_CONDITION", "", [], "", 0.9, False), ("well", "MEDICAL_CONDITION", "", [], "", 0.9, False), ("aspirin", "MEDICATION", "", [], "", 0.9, False), ("kidney", "ANATOMY", "", [], "", 0.7, False), ("biopsy", "PROCEDURE", "", [], "biopsy of skin", 0.7, True), ("cough", "OTHER", "", ["SYMPTOM"], "", 0.4, True), ("thing", "OTHER", "", [], "", 0.9, False)]
    rows = spark.createDataFrame(cases, "text string, category string, type string, traits array<string>, description string, score double, expected boolean")
    assert all(r.condition == r.expected for r in coding.condition_like(rows, ["well"]).collect())


def test_knn_and_embedding(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.1]), (8, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.id for r in vectors.knn(q, v, 2).orderBy("rank").collect()] == [1, 3]
    assert vectors.knn(q, v, 9, cosine=False).filter("query_id = 7").count() == 4
    with pytest.raises(ValueError):
        vectors.build_vector_table(v)
    calls = []
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "doc_id long, text string")
    out = vectors.embed(docs).collect()
    del calls
    assert len(out) == 3 and {r.doc_id: r.embedding for r in out}[1] == {r.doc_id: r.embedding for r in out}[2]
    assert one(spark, vectors.retrieval_confidence(lit(0.5))) == 0.75
    ranked = vectors.rerank(spark.createDataFrame([(1, "a b", "c", 1), (1, "a b", "a b", 2)], "query_id long, query string, candidate string, rank int"))
    assert ranked.orderBy("rank").first().candidate == "a b"


# correction and validation


def test_corrections(spark):
    verdict = lambda a, b: one(spark, correct.verdict(lit(a), lit(b)))
    assert verdict("Metformin 500 mg", "Metformin 500 mg").verdict == "NO_CHANGE"
    assert verdict("dose 500 rng oral", "dose 500 mg oral").verdict == "ACCEPTED"
    assert verdict("prednlsone", "a long sentence about something else entirely").verdict == "HIGH_DEVIATION"
    assert one(spark, correct.dosage_changed(lit("500 rng"), lit("500 mg"))) and not one(spark, correct.dosage_changed(lit("500 mg"), lit("50 mg")))
    assert one(spark, correct.dosage_changed(lit("500 mg"), lit("50 mg"), strict_numbers=True))
    box = [0.0, 0.0, 1.0, 1.0]
    regions = spark.createDataFrame([("d", 0, "Metflrmin 500 mg", 0.55, box, 1), ("d", 1, "Metflrmin 500 mg", 0.5, box, 1), ("d", 2, "fine", 0.9, box, 1), ("d", 3, "lost", 0.1, box, 1)], "doc_id string, idx int, text string, confidence double, bbox array<double>, page_number int")
    proposals = spark.createDataFrame([("d", 0, "Metformin 500 mg", 0.9, "", None), ("d", 3, None, None, None, "TIMEOUT")], "doc_id string, idx int, corrected_text string, confidence double, reasoning string, error string")
    done = correct.correct_regions(regions, proposals)
    assert {r.idx: (r.status, r.reason) for r in done.collect()} == {0: ("ACCEPTED", "ACCEPTED"), 1: ("SKIPPED", "DUPLICATE"), 2: ("SKIPPED", "HIGH_CONFIDENCE"), 3: ("REVIEW_REQUIRED", "TIMEOUT")}
    assert {r.idx: r.action for r in correct.correction_audit(done).collect()} == {0: "APPLY", 1: "SKIP", 2: "SKIP", 3: "ESCALATE"}
    assert correct.correction_status(done).first().status == "REVIEW_REQUIRED"
    merged = correct.merge_spans(regions, done.select("doc_id", "idx", "corrected_text", "correction_applied"))
    assert merged.filter("idx = 0").first().text == "Metformin 500 mg"
    with pytest.raises(Exception, match="match"):
        correct.merge_spans(regions, done.filter("idx > 0").select("doc_id", "idx", "corrected_text", "correction_applied")).collect()


def test_validation(spark):
    good = {"summary": "Patient with hypertension takes metformin", "key_points": ["hypertension"], "medications": [{"name": "Metformin", "dosage": "500 MG", "frequency": "", "instructions": ""}], "diagnoses": ["hypertension"], "follow_up_actions": [], "confidence_score": 0.9}
    bad = good | {"medications": ["Xenodrug"], "confidence_score": 1.7, "summary": "zebra giraffe elephants wandering probably", "diagnoses": [""]}
    source = "Patient with hypertension takes metformin 500 mg daily"
    rows = spark.createDataFrame([("g", "clinician", json.dumps(good), source), ("b", "clinician", json.dumps(bad), source)], "doc_id string, role string, raw string, source_text string")
    drugs = spark.createDataFrame([("metformin", ["glucophage"])], "name string, aliases array<string>")
    codes = spark.createDataFrame([("hypertension", "38341003")], "term string, dict_code string")
    checks, report = validate.validation_report(rows, drugs, codes)
    got = {r.doc_id: r for r in report.collect()}
    assert got["g"].passed and not got["g"].errors and got["g"].confidence >= 0.7
    assert not got["b"].passed and got["b"].hallucination > 0.25 and len(got["b"].auto_corrections) == 2
    fixed, _ = validate.auto_correct(rows)
    s = {r.doc_id: r.s for r in fixed.collect()}
    assert s["b"].confidence_score == 1.0 and s["b"].medications[0].name == "Xenodrug" and s["g"].medications[0].dosage == "500 mg"
    names = {(r.doc_id, r.check_name, r.passed) for r in checks.collect()}
    assert ("b", "dosage_present", False) in names and ("b", "diagnosis_present", False) in names and ("b", "hallucination_speculative_language", False) in names
    terms = validate.critical_terms(fixed).filter("doc_id = 'g'")
    assert {(r.term, r.category) for r in terms.collect()} == {("Metformin", "drug_name"), ("500 mg", "dosage"), ("hypertension", "diagnosis")}
    deviations = {r.term: r.deviation for r in validate.term_deviation(spark.createDataFrame([("Metformin", source), ("Xenodrug", source), ("", source)], "term string, source_text string")).collect()}
    assert deviations["Metformin"] == 0 and deviations["Xenodrug"] > 0.3 and deviations[""] == 0


# metrics, prompts, audit


def test_latency_report(spark):
    raw = '{"tier1_pages":[{"latency_seconds":3.8},{"latency_seconds":3.9},{"latency_seconds":4.0},{"latency_seconds":4.1}],"track_a_seconds":8.7,"pipeline_total_seconds":70}'
    profiles = spark.createDataFrame([(raw,)], "raw string").select(F.from_json("raw", schemas.PROFILE).alias("p")).select("p.*")
    got = {r.stage: r for r in metrics.benchmark_report(profiles).collect()}
    ocr_stage = got["tier1_textract_per_page"]
    assert (ocr_stage.n, ocr_stage.avg, ocr_stage.p95, ocr_stage.most, ocr_stage.target_met) == (4, pytest.approx(3.95), 4.0, 4.1, True)
    assert not got["pipeline_end_to_end_per_document"].target_met


def test_places_are_exact_without_sorting_a_group(spark):
    rng = random.Random(8)
    groups = {
        "even": [float(i) for i in range(900)], "ties": [7.0] * 800 + [1.0, 9.0], "two": [1.0] * 30 + [2.0] * 700, "wide": [10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]) for _ in range(700)],
        "heavy": [5.0] * 600 + [5.0 + i / 1e6 for i in range(300)], "small": [3.0, 1.0], "one": [4.0], "odd": [-0.0, 0.0, 1e-320, float("inf")] * 50,
    }
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in [*xs, None]], "g string, x double")
    for share, most in ((0.95, 20), (0.5, 7), (0.0, 20), (1.0, 20), (0.95, 10_000)):
        got = {r.g: (r.n, r.at_place) for r in metrics.value_at_place(rows, "g", "x", share, most).collect()}
        assert got == {g: (len(xs), sorted(xs)[int((len(xs) - 1) * share)]) for g, xs in groups.items()}


def test_points_of_each_stage(spark):
    values = lambda df: sorted((r.metric, r.value) for r in df.collect())
    read = spark.createDataFrame([("t", True, 2.0, 96.5), ("t", False, 3.0, None), ("t", True, 0.0, None)], "document_type string, success boolean, latency_seconds double, line_confidence double")
    assert values(metrics.extraction_points(read.limit(1))) == [("ExtractionConfidenceAvg", 96.5), ("ExtractionErrorRate", 0.0), ("ExtractionErrorRate", 3.5), ("ExtractionSuccessCount", 1.0), ("StageLatencySeconds", 2.0)]
    assert values(metrics.extraction_points(read.filter("NOT success"))) == [("ExtractionErrorRate", 100.0), ("ExtractionSuccessCount", 0.0), ("StageLatencySeconds", 3.0)]
    coded = spark.createDataFrame([("t", 4, 3, 1, 9.0), ("t", 0, 0, 0, 1.0), ("t", None, None, None, None)], "document_type string, total long, mapped long, fallback long, latency_seconds double")
    assert values(metrics.mapping_points(coded)) == [("SNOMEDFallbackCount", 0.0), ("SNOMEDFallbackCount", 1.0), ("SNOMEDMappingSuccessRate", 0.0), ("SNOMEDMappingSuccessRate", 0.0), ("SNOMEDMappingSuccessRate", 75.0), ("StageLatencySeconds", 1.0), ("StageLatencySeconds", 9.0)]
    told = spark.createDataFrame([("t", "clinician", 1500.0, None)], "document_type string, role string, latency_ms double, confidence_score double")
    assert values(metrics.summary_points(told)) == [("LLMInferenceLatencyMs", 1500.0)]
    levels = metrics.metric_rollup(metrics.extraction_points(read)).filter("metric = 'ExtractionErrorRate'").orderBy("level").collect()
    assert [(r.level, r.n, r.total) for r in levels] == [("dimensions", 5, 203.5), ("document_type", 5, 203.5), ("stage", 5, 203.5)]


def test_batches_and_alarms(spark):
    assert [r.batch for r in metrics.batch_number(spark.range(1, 6), 2, "id").orderBy("id").collect()] == [0, 0, 1, 1, 2]
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s, tzinfo=dt.UTC) if s < 60 else dt.datetime(2024, 1, 1, 0, s // 60, s % 60, tzinfo=dt.UTC)
    points = spark.createDataFrame([("q", t(0), 101.0), ("q", t(60), 5.0), ("q", t(120), 101.0), ("q", t(240), 101.0)], "queue string, ts timestamp, value double")
    assert metrics.alarms(points, ["queue"], 100, 60, 1, "max").filter("alarm").count() == 3
    assert metrics.alarms(points, ["queue"], 100, 60, 2, "max").filter("alarm").count() == 0


def test_prompt_versions(spark):
    base = {"template": lit("t"), "document_id": lit("doc_ab_001"), "role": lit("clinician"), "salt": lit("fixed-salt"), "weights": F.create_map(lit("v1"), lit("0.3"), lit("v2"), lit("0.7"), lit("v3"), lit("bad")), "enabled": lit(True), "active_version": lit("v1")}
    rows = spark.createDataFrame([(None,), ("v9",)], "forced string").withColumns(base)
    first, again = (sorted((r.version, r.mode) for r in prompts.assign_variant(rows).collect()) for _ in range(2))
    assert first == again and ("v9", "forced") in first and first[0][1] == "ab_test"
    off = prompts.assign_variant(rows.limit(1).withColumn("enabled", lit(False))).first()
    assert (off.version, off.mode) == ("v1", "active")
    log = spark.createDataFrame([("t", "SET_ACTIVE", "v2", "2024-01-01", 1), ("t", "ROLLBACK", "v1", "2024-01-02", 2)], "template string, action string, after_version string, ts string, seq int")
    assert prompts.active_version(log).first().active_version == "v1"
    assert prompts.active_version(log, "2024-01-01").first().active_version == "v2"


def events(spark, rows):
    return spark.createDataFrame(rows, "audit_id string, document_id string, user_id string, timestamp string, change_type string, before_state string, after_state string, metadata string").withColumn("ts", F.col("timestamp").cast("timestamp"))


def test_daily_export(spark, tmp_path):
    rows = [("1", "d", "u", "2024-01-01T00:00:00.500Z", "SNOMED_STATUS", None, None, "{}"), ("2", "d", "u", "2024-01-01T23:59:59.900Z", "SUMMARY_EDIT", None, '{"summary":"Mr John Doe"}', None), ("3", "d", "u", "2024-01-02T00:00:00Z", "X", None, None, None)]
    log = events(spark, rows)
    day = audit.daily_feedback(log, "2024-01-01")
    assert {r.audit_id: r.category for r in day.collect()} == {"1": "ner", "2": "summarization"}
    assert audit.daily_feedback(log, "2024-01-01", legacy_string_range=True).first().audit_id == "2"  # strings: .5Z comes before Z
    path = str(tmp_path / "export")
    for _ in range(2):
        assert audit.run_daily_export(log, path, "2024-01-01")["status"] == "success"
    assert spark.read.parquet(path).groupBy("category").count().count() == 2 and spark.read.parquet(path).count() == 2
    assert audit.run_daily_export(log, path, "2024-02-01")["status"] == "no_data"
    dirty = events(spark, [("9", "d", "u", "2024-01-03T00:00:00Z", "X", None, "mail x@y.z", None)])
    assert audit.run_daily_export(dirty, path, "2024-01-03")["status"] == "quality_check_failed"


def test_audit_events(spark):
    changes = spark.createDataFrame([("d", "u", "SUMMARY_EDIT", '{"summary": "Mr John Doe"}', "{}", None)], "document_id string, user_id string, change_type string, before_state string, after_state string, metadata string")
    e = audit.build_events(changes).first()
    assert json.loads(e.before_state) == {"summary": "[NAME_REDACTED]"} and e.after_state is None and len(e.audit_id) == 36
    states = spark.createDataFrame([("d", "NEW", 1, "a"), ("d", "REVIEW", 2, "b")], "document_id string, status string, ts int, audit_id string")
    new, log = audit.approve(states, spark.createDataFrame([("d", "boss")], "document_id string, user_id string"))
    assert new.first().status == "APPROVED" and json.loads(log.first().before_state) == {"status": "REVIEW"}


# sources, sinks


def test_artifacts_and_names(spark):
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(["/x/doc_001_clinician_summary.json", "/x/doc_001_summary.txt", "/x/doc_001_snomed.json", "/x/doc_001_textract.json", "/x/doc_001_confidence.json", "/x/doc_001_patient_summary.txt"])], "path string, modificationTime int")
    got = files.catalogue_artifacts(rows).first()
    assert got.doc_id == "doc_001" and got.summary_json == {"clinician": "/x/doc_001_clinician_summary.json"} and set(got.summary_txt) == {"clinician", "patient"} and got.snomed and got.textract and got.confidence
    names = files.parse_page_name(spark.createDataFrame([("/a/discharge_summary1page2_CLEANED.jpg",), ("/a/odd name.jpg",)], "path string")).collect()
    assert [(r.document, r.page) for r in names] == [("discharge_summary1", 2), ("odd name", 0)] and names[1].safe_name == "odd_name"


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert files.scan_document_files(spark, str(tmp_path)).count() == 1
    assert files.list_datasets(spark, str(tmp_path)).count() == 2
    (tmp_path / "d.json").write_text('{"records": [{"conceptId": "1", "term": "old"}, {"conceptId": "1", "term": "new"}, {"term": "none"}]}')
    assert [tuple(r) for r in files.read_dictionary(spark, str(tmp_path / "d.json")).collect()] == [("1", "new")]
    (tmp_path / "d.tsv").write_text("code\tdescription\n7\tseven\n")
    assert files.read_dictionary(spark, str(tmp_path / "d.tsv"), "tsv").first().description == "seven"
    (tmp_path / "letterpage3_textract.json").write_text('{"Blocks": [{"BlockType": "LINE", "Text": "t", "Confidence": 9}]}')
    page = files.read_ocr_json(spark, str(tmp_path / "letterpage3_textract.json")).first()
    assert (page.doc_id, page.page, page.Blocks[0].Text) == ("letter", 3, "t")
    assert json.loads(sinks.manifest(files.list_datasets(spark, str(tmp_path)), "ner").first().value)["count"] >= 2
    assert json.loads(one(spark, sinks.envelope(lit("d"), lit("now"), lit("p"), "hl7_fhir")))["resourceType"] == "Bundle"


def test_summaries_by_role(spark, tmp_path):
    rows = spark.createDataFrame([("d", "clinician", "Mr John Doe", ["Mr John Doe"]), ("d", "patient", "Mr John Doe", ["Mr John Doe"])], "doc_id string, role string, summary string, key_points array<string>")
    sinks.write_role_summaries(rows, str(tmp_path / "s"))
    got = {r.role: (r.summary, r.key_points[0]) for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert got == {"clinician": ("Mr John Doe",) * 2, "patient": ("[NAME_REDACTED]",) * 2}
    routed = spark.createDataFrame([(1, "tracks"), (2, "refinement")], "id int, route string")
    sinks.fan_out(routed, {"tracks": [str(tmp_path / "a"), str(tmp_path / "b")]})
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 1


def test_exports_split_large_categories_and_replace_a_day(spark, tmp_path):
    out = str(tmp_path / "export")
    rows = spark.range(3_000).select(F.when(F.col("id") < 2_900, "ner").otherwise("other").alias("category"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        for _ in range(2):
            sinks.write_export(rows, out, "2024-05-06")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    sinks.write_export(rows.limit(10), out, "2024-05-07")
    got = spark.read.parquet(out)
    assert got.filter("export_date = '2024-05-06'").count() == 3_000 and got.filter("export_date = '2024-05-07'").count() == 10
    assert len(list((tmp_path / "export" / "export_date=2024-05-06" / "category=ner").glob("*.parquet"))) > 1
    assert len(list((tmp_path / "export" / "export_date=2024-05-06" / "category=feedback").glob("*.parquet"))) == 1


def test_the_day_of_an_export_is_in_utc(spark):
    events = spark.createDataFrame([("a", "2024-05-06T23:30:00Z"), ("b", "2024-05-07T00:30:00Z")], "audit_id string, timestamp string").select("*", F.to_timestamp("timestamp").alias("ts"), F.lit("u").alias("user_id"), F.lit("OTHER").alias("change_type"))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert [r.audit_id for r in audit.daily_feedback(events, "2024-05-06", anonymise=False).collect()] == ["a"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_entities_of_both_layouts(spark):
    raw = spark.createDataFrame([("d", '{"Entities":[{"Text":"Diabetes","Category":"MEDICAL_CONDITION","Score":0.9,"SNOMEDCTConcepts":[{"Code":"44054006","Description":"Diabetes"}]}]}')], "doc_id string, raw string").select("doc_id", F.from_json("raw", schemas.ENTITY_RAW).alias("j")).select("doc_id", "j.*")
    cat = spark.createDataFrame([("e", '{"categorized_entities":{"Diagnosis":[{"text":"x","snomed_code":"NOT_MAPPED","confidence":0.1,"source":"semantic_fallback"}]}}')], "doc_id string, raw string").select("doc_id", F.from_json("raw", schemas.ENTITY_CATEGORISED).alias("j")).select("doc_id", "j.*")
    got = files.load_entities(raw, cat)
    assert {(r.doc_id, r.entity_id, r.code) for r in got.collect()} == {("d", "MEDICAL_CONDITION_0", "44054006"), ("e", "Diagnosis_0", "NOT_MAPPED")}
    counts = coding.mapping_counts(got.withColumn("doc_id", lit("all"))).first()
    assert (counts.total, counts.mapped, counts.fallback, counts.success) == (2, 1, 1, 50.0)


# streaming


def test_ttl_in_both_forms(spark, tmp_path):
    arrivals = [("a", t) for t in (0, 5, 9, 10, 12, 25)] + [("b", 3)]
    rows = spark.createDataFrame(arrivals, "key string, arrived_at long")
    accepted = lambda df: sorted((r.key, r.arrived_at) for r in df.filter("NOT duplicate").collect())
    expected = [("a", 0), ("a", 10), ("a", 25), ("b", 3)]
    assert accepted(jobs.dedupe_ttl(rows, 10)) == expected
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = jobs.dedupe_ttl_stream(jobs.read_stream(spark, str(tmp_path / "in"), rows.schema), 10)
    q = stream.writeStream.format("memory").queryName("ttl").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert accepted(spark.table("ttl")) == expected


def accepted_by_hand(arrivals, ttl):
    out, until = [], {}
    for key, at in sorted(arrivals, key=lambda x: (x[0] or "", x[1])):
        duplicate = at < until.get(key, at)
        until[key] = until[key] if duplicate else at + ttl
        out.append((key or "", at, duplicate))
    return sorted(out)


@pytest.mark.parametrize(("ttl", "most", "fan"), [(10, 100_000, 16), (10, 37, 3), (700, 1, 4), (0, 10, 2)])
def test_dedupe_ttl_spreads_a_key_over_blocks_of_time(spark, ttl, most, fan):
    rng = random.Random(ttl)
    hot = [("hot" if i % 3 else None if i % 2 else str(i % 5), i * 7919 % 900) for i in range(1_500)]
    rare = [("a", rng.randint(-3_000, 3_000)) for _ in range(40)] + [("gap", t) for t in (0, 3, 2_999, 3_000, 5_000)] + [("one", 5)] * 7
    rows = spark.createDataFrame([*hot, *rare, ("a", None)], "key string, arrived_at long").repartition(3)
    got = jobs.dedupe_ttl(rows, ttl, most, fan)
    assert sorted((r.key or "", r.arrived_at, r.duplicate) for r in got.collect()) == accepted_by_hand([*hot, *rare], ttl)


def test_blocks_of_a_hot_key_go_to_several_tasks(spark):
    """A key with two thirds of all rows: equal times are counted before they meet, so a block has at most its seconds."""
    hot = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), (F.col("id") % 900).alias("arrived_at"))
    got = jobs.dedupe_ttl(hot, 10, most=100).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = got.filter("key = 'hot'").groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.count() == 30_000 and sum(r["count"] for r in rows) == 20_000 and len(rows) > 2 and max(r["count"] for r in rows) < 14_000
    assert sorted((r.key, r.arrived_at, r.duplicate) for r in got.collect()) == accepted_by_hand([tuple(r) for r in hot.collect()], 10)


def test_dedupe_ttl_of_no_rows(spark):
    assert jobs.dedupe_ttl(spark.createDataFrame([], "key string, arrived_at long"), 10).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    given.write.parquet(str(tmp_path / "in"))
    points = given.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    batch = {tuple(r) for r in jobs.metric_windows(points, ["event_type"], 86400).select("event_type", "start", F.round("stat", 6)).collect()}
    rows = jobs.read_stream(spark, str(tmp_path / "in"), given.schema).select("event_type", "ts", "value")
    q = jobs.metric_windows(rows, ["event_type"], 86400).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("windows").select("event_type", "start", F.round("stat", 6)).collect()} == batch
    out = str(tmp_path / "out")
    q = jobs.track_stream(jobs.read_stream(spark, str(tmp_path / "in"), given.schema), lambda df: df.filter("event_type = 'click'"), lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "c2"))
    q.awaitTermination()
    assert spark.read.parquet(out).count() == given.filter("event_type = 'click'").count()
    assert jobs.breaches(jobs.metric_windows(points, ["event_type"], 86400), ["event_type"], 0.0, 86400, 2).filter("alarm").count() > 0


def test_retries_and_cache(spark):
    rows = spark.createDataFrame([(1, True, 0), (2, False, 0), (3, False, 2)], "id int, ok boolean, attempts int")
    done, again, dead = jobs.split_retries(rows)
    assert [[r.id for r in x.collect()] for x in (done, again, dead)] == [[1], [2], [3]]
    assert {r.id: r.event for r in jobs.export_attempts(rows.withColumn("attempts", F.col("id") * 3)).collect()} == {1: "EXPORT_SUCCESS", 2: "EXPORT_QUEUED", 3: "EXPORT_UNRESOLVED"}
    requests = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "key string")
    cache = spark.createDataFrame([("a", "old", 5), ("b", "new", 50)], "key string, value string, expires_at long")
    hits, misses = jobs.cache_lookup(requests, cache, 10)
    assert [r.key for r in hits.collect()] == ["b"] and sorted(r.key for r in misses.collect()) == ["a", "c"]


def test_assembly_and_guard(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    whole = assemble.assemble_document(docs, {"coding": spark.createDataFrame([("a", 3)], "doc_id string, n int")})
    assert {r.doc_id: r.coding and r.coding.n for r in whole.collect()} == {"a": 3, "b": None}
    terms = spark.createDataFrame([("a", "Xenodrug"), ("b", "Metformin")], "doc_id string, term string")
    ocr_text = spark.createDataFrame([("a", "takes metformin"), ("b", "takes metformin")], "doc_id string, text string")
    gated = validate.deviation_gate(assemble.two_source_deviation(terms, ocr_text, ocr_text.limit(0)))
    review, log = assemble.guard_route(gated)
    assert [r.doc_id for r in review.collect()] == ["a"] and log.first().change_type == "OCR_GUARD"
    assert one(spark, scores.band_visual(lit("low"))).colour == "red"


def test_routing_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.9, 0.9, 0.9, 0.9), ("b", 0.1, 0.9, 0.9, 0.9)], "doc_id string, textract double, comprehend double, faiss double, llm_logprobs double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), rows.schema)
    paths, log = {r: str(tmp_path / r) for r in ("bypass_database", "human_review")}, str(tmp_path / "audit")
    jobs.routing_stream(stream, paths, log, str(tmp_path / "ck")).awaitTermination()
    assert {r: ledger.read_finished(spark, p, f"{log}_ledger").first().doc_id for r, p in paths.items()} == {"bypass_database": "a", "human_review": "b"}
    assert ledger.read_finished(spark, log, f"{log}_ledger").count() == 2


def test_a_batch_that_fails_or_runs_again_leaves_each_row_once(spark, tmp_path):
    a, b, book = (str(tmp_path / x) for x in ("a", "b", "ledger"))
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    broken = rows.select(F.raise_error(F.lit("lost")).cast("int").alias("id"))
    read = lambda path: sorted(r.id for r in ledger.read_finished(spark, path, book).collect())
    assert ledger.write_batch(spark, {a: rows, b: rows}, book, 0)
    with pytest.raises(Exception, match="lost"):
        ledger.write_batch(spark, {a: rows, b: broken}, book, 1)
    assert read(a) == read(b) == [1, 2]  # half of batch 1 is written and not seen
    assert ledger.write_batch(spark, {a: rows.filter("id = 2"), b: rows}, book, 1)
    assert (read(a), read(b)) == ([1, 2, 2], [1, 1, 2, 2])
    assert not ledger.write_batch(spark, {a: broken, b: broken}, book, 0)  # finished: nothing is computed or written
    assert (read(a), read(b)) == ([1, 2, 2], [1, 1, 2, 2])


def test_a_stream_that_fails_between_tables_is_taken_up_again(spark, tmp_path):
    rows = spark.range(40).withColumnRenamed("id", "doc_id")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    a, b, book = (str(tmp_path / x) for x in ("a", "b", "ledger"))
    failing = [True]

    def outputs(df, n):
        lost = df.select(F.raise_error(F.lit("lost")).cast("long").alias("doc_id"))
        return {a: df, b: lost if failing[0] and n == 1 else df}

    def run():
        stream = jobs.read_stream(spark, str(tmp_path / "in"), rows.schema, files=2)
        jobs.track_stream(stream, lambda df: df, ledger.exactly_once(outputs, book), str(tmp_path / "ck")).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    assert ledger.read_finished(spark, a, book).count() == ledger.read_finished(spark, b, book).count() < 40
    failing[0] = False
    run()
    run()  # nothing new
    for path in (a, b):
        assert sorted(r.doc_id for r in ledger.read_finished(spark, path, book).collect()) == list(range(40))


def test_alarms_on_a_stream_equal_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, start = random.Random(6), 1_700_000_000 // 60 * 60
    # windows with and without points, in time order over several files; q2 is silent for a long while
    windows = [w for w in range(40) if w % 7 not in (3, 4)]
    points = [("q1", start + 60 * w + rng.randint(0, 59), rng.choice([5.0, 101.0, 150.0])) for w in windows for _ in range(2)]
    points += [("q2", start + 60 * w, 200.0) for w in (0, 1, 2, 30, 31)]
    points.sort(key=lambda p: p[1])
    schema = "queue string, at long, value double"
    timed = lambda df: df.select("queue", F.timestamp_seconds("at").alias("ts"), "value")
    for i in range(0, len(points), 24):
        spark.createDataFrame(points[i : i + 24], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    spark.createDataFrame([("end", start + 10_000, 0.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    got = jobs.alarm_stream(source, ["queue"], 100, 60, 2, "max", late="1 minute")
    q = got.writeStream.format("memory").queryName("alarms").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    expected = metrics.alarms(timed(spark.createDataFrame(points, schema)), ["queue"], 100, 60, 2, "max").select("queue", "start", "stat", "alarm")
    rows = {tuple(r) for r in spark.table("alarms").filter("queue <> 'end'").collect()}
    assert rows == {tuple(r) for r in expected.collect()} and {r[3] for r in rows} == {True, False}


def test_fallback_and_slices(spark):
    terms = spark.createDataFrame([(1, "11", "high blood pressure"), (2, "22", "broken arm")], "id long, code string, description string")
    table = vectors.embed(terms, "description")
    rows = spark.createDataFrame([(1, "blood pressure", "high", 0.1, []), (2, "arm", "broken", 0.1, [])], "id int, term string, context string, score double, concepts array<struct<Description:string,Code:string,Score:double>>")
    got = {r.id: r.code for r in coding.map_entities(rows, vectors.semantic_fallback(table, k=2)).collect()}
    assert got == {1: "11", 2: "22"}
    whole = "x" * 18_000 + " on 01/02/2024"
    assert [(s.begin_offset, s.type) for s in one(spark, privacy.detect_phi(lit(whole)))] == [(18_004, "DATE")]
    items = F.from_json(lit('[{"text":"","assignee":"a"},{"text":""}]'), "array<struct<text:string,assignee:string,code:string>>")
    assert json.loads(one(spark, routing.serialise_actions(items))) == [{"text": "", "assignee": "a"}]
