"""Work that has to grow no faster than its input, and results that an engine's own reading of patterns or ties could change."""

import random
import time
from difflib import SequenceMatcher

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from chartloom.functions import letters, rules, text
from chartloom.operators import audit, validate
from chartloom.plans import catalogue
from chartloom.plans.views import Views

SF = "/root/testdata/sf0.001"


def seconds(spark, column, *texts) -> tuple[list, float]:
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    df.select(column(F.lit("warm"))).collect()
    began = time.monotonic()
    return [r[0] for r in df.select(column(F.col("text"))).collect()], time.monotonic() - began


def test_customers_letters_are_dealt_out(spark):
    """A file of short rows is one task, however many there are."""
    assert Views(spark, SF).letters().rdd.getNumPartitions() >= 8


def test_details_of_a_long_letter_take_linear_time(spark):
    """Before, what was looked for in all lines was looked for again from every line."""
    letter = "\n".join(f"line {i} of a long letter" for i in range(1_500)) + "\nNHS Number\n943 476 5919\nDOB\n01/02/1980\nRe: MRS JANE DOE\nGender: F"
    (found,), took = seconds(spark, letters.patient_info, letter)
    assert (found.nhs_number, found.dob, found.sex, found.name) == ("943 476 5919", "01/02/1980", "Female", "JANE DOE") and took < 10


def test_medications_of_a_long_line_take_linear_time(spark):
    """Before, the rest of a run of words was read again from each of its words."""
    (found,), took = seconds(spark, rules.medications, "word " * 40_000 + "\n" + "co-amoxiclav tablets  500 mg daily, then Aspirin 75 mg")
    assert [(m.name, m.dose) for m in found] == [("co-amoxiclav tablets", "500 mg daily")] and took < 5


def against_sql(spark, folder, name: str, **tables) -> list[tuple]:
    """Rows of a query over small tables, after a comparison with its SQL."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted(con.sql(catalogue.oracle_sql()[name]).select(*df.columns).fetchall(), key=repr)
    return got


def documents(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_the_sex_of_a_letter_is_inferred_from_its_text(spark, tmp_path):
    """Before, two constants were looked into, so it was null for every letter. A label wins over titles; signs of both sexes say nothing."""
    nations = spark.createDataFrame([(0, "NORWAY"), (1, "HIS ISLAND"), (2, "SPAIN, Sex: F")], "n_nationkey int, n_name string")
    given = [(3, 0, "MACHINERY"), (4, 0, "BUILDING"), (5, 0, "BUILDING"), (6, 0, "HER"), (7, 1, "BUILDING"), (9, 1, "BUILDING"), (9, 1, "BUILDING"), (12, 2, "MACHINERY")]
    customers = spark.createDataFrame(given, "c_custkey long, c_nationkey int, c_mktsegment string")
    got = against_sql(spark, tmp_path, "letter_details", customer=customers, nation=nations)
    told = {3: ("Male", "Male"), 4: ("Female", "Female"), 5: ("Female", "Female"), 6: ("Male", None), 7: ("Female", None), 9: ("Male", "Male"), 12: ("Male", "Female")}
    assert len(got) == 8 and {r[0]: (r[3], r[-1]) for r in got} == told


def test_words_end_at_letters_beyond_ascii_as_in_sql(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "Echoé and chronic pain")], "conv_id long, turn long, role string, text string")
    got = against_sql(spark, tmp_path, "keyword_terms", documents=documents(spark, "painé, but éanginaé", "no term", "Autism spectrum; Renal  cell, renal cell\nCT scan", "", "pain_x para"), conversations=turns)
    assert {r[1] for r in got} == {"angina,pain", "", "autism,ct scan,renal cell", "para", "chronic pain,echo,pain"}


def test_masked_names_end_at_letters_beyond_ascii_as_in_sql(spark, tmp_path):
    got = against_sql(spark, tmp_path, "mask_patterns", documents=documents(spark, "Mr Garcés came", "éMrs Ann Lee, 1/2/2020é", "nothing", "MRN: 12345678 at 12 High Street", "xMr Jones"))
    assert [r[2] for r in got] == [True, True, False, True, False]


def test_equal_approvals_are_told_apart_whatever_their_order(spark):
    states = spark.createDataFrame([], audit.STATES)
    given = [("a", 1, u, "2024-01-01", None) for u in ("u3", "u1", "u2")]
    for rows in (given, given[::-1], given[1:] + given[:1]):
        judged = audit.judged_approvals(states, spark.createDataFrame(rows, "document_id string, request_id long, user_id string, approved_at string, expected long"))
        assert [r.user_id for r in judged.filter("outcome = 'approved'").collect()] == ["u1"]


def test_a_long_text_is_sliced_in_linear_time(spark):
    """Before, every slice counted from the beginning of the text."""
    given = "äb\n𝒳" * 500_000
    (found,), took = seconds(spark, lambda t: F.transform(text.slice_text(t, 60), lambda s: F.struct(s.offset.alias("offset"), s.part.alias("part"))), given)
    assert [(s.offset, s.part) for s in found] == [(k, given[k : k + 60]) for k in range(0, len(given), 60)] and took < 15
    assert seconds(spark, lambda t: F.size(text.slice_text(t, 60)), "", None, "x" * 60, "x" * 61)[0] == [0, 0, 1, 2]


def pairs(n: int, most: int) -> tuple[list[str], list[str]]:
    r, a, b = random.Random(7), [], []
    for _ in range(n):
        of = r.choice(["ab", "abcé", "abcdefgh ", "e c𝒳"])
        a.append("".join(r.choices(of, k=r.randint(0, most))))
        b.append("".join(r.choices(of, k=r.randint(0, most))) if r.random() < 0.5 else a[-1].replace(r.choice(of), r.choice(of), r.randint(0, 9)))
    return a, b


def test_matching_blocks_are_the_standard_librarys():
    a, b = pairs(3_000, 70)
    a, b = [*a, "ab " * 40, "x", None], [*b, "b a" * 90, "ab " * 90, "y"]
    plain = lambda x: " ".join((x or "").lower().split())
    assert text.sequence_ratio.func(pd.Series(a), pd.Series(b)).tolist() == [SequenceMatcher(None, plain(x), plain(y)).ratio() for x, y in zip(a, b, strict=True)]
    assert all(text.matched(x, y) == sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks()) for x, y in zip(*pairs(500, 40), strict=True))


def test_edits_are_levenshteins(spark):
    a, b = pairs(2_000, 40)
    a, b = [*a, "", None, "a\0", "a" * 3_000, "x"], [*b, "", "x", "a", "a" * 2_990 + "b", None]
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b string").select(text.edits(F.col("a"), F.col("b")).alias("n"), F.levenshtein("a", "b").alias("m"))
    assert all(r.n == r.m for r in df.collect())


def test_many_strings_are_searched_fast_and_first_rules_win(spark, tmp_path):
    """Before, every byte was looked at for every string: 244 strings over 17 million characters."""
    signals = [s for _, strings in letters.LETTER_RULES + letters.REGISTRY_RULES for s in strings]
    r = random.Random(11)
    texts = ["x ".join(r.choice([s, s.upper(), s[1:], s[:-1]]) for s in r.choices(signals, k=r.randint(1, 3))) for _ in range(400)]
    got = against_sql(spark, tmp_path, "letter_types", documents=documents(spark, *[t.lower() for t in texts], "", "none"))
    assert len({r[1] for r in got}) > 15 and len({r[2] for r in got}) > 12
    (a, b), took = seconds(spark, letters.letter_type, "prose of no kind " * 1_000_000, None)
    assert a == b == "Clinical Letter" and took < 8


def test_terms_are_aligned_only_where_that_can_count():
    """A term of four words against a long source: the lengths alone keep the ratio below a share of a quarter."""
    a, b = pairs(1_500, 60)
    least = [(k % 5) / 4 for k in range(1_500)]
    ratio = text.sequence_ratio.func(pd.Series(a), pd.Series(b))
    assert text.ratio_from.func(pd.Series(a), pd.Series(b), pd.Series(least)).tolist() == [max(x, y) for x, y in zip(ratio, least, strict=True)]
    began = time.monotonic()
    assert text.ratio_from.func(pd.Series(["one two three four"] * 20_000), pd.Series(["another long source " * 500] * 20_000), pd.Series([0.25] * 20_000)).eq(0.25).all()
    assert time.monotonic() - began < 4


def test_sources_are_not_shuffled_with_their_items(spark):
    """Before, a row per medication or diagnosis took its document's whole source through the join."""
    s = F.struct(F.expr("array(named_struct('name', concat('drug ', id)))").alias("medications"), F.expr("array(concat('term ', id))").alias("diagnoses"))
    given = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("r").alias("role"), F.concat(F.lit("Drug 1 and term "), F.col("id")).alias("source_text"), s.alias("s"))
    drugs = spark.range(20).select(F.concat(F.lit("Drug "), "id").alias("name"), F.array(F.lit("x")).alias("aliases"))
    terms = spark.range(20).select(F.concat(F.lit("term "), "id").alias("term"), F.lit("c").alias("dict_code"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (validate.check_medications(given, drugs), validate.check_diagnoses(given, terms)):
            plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            shuffled = [part.splitlines()[1] for part in plan.split("\n\n") if "Exchange\n" in part and "Input" in part]
            assert shuffled and not any("source" in columns for columns in shuffled)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
