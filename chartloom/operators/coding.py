"""Mapping entities and terms to codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets by an entity's type or category.
BUCKETS = {
    "MEDICAL_CONDITION": "Problems_Issues", "DX_NAME": "Diagnosis", "PROBLEM": "Problems_Issues", "DIAGNOSIS": "Diagnosis", "SIGN": "Problems_Issues",
    "SYMPTOM": "Problems_Issues", "MEDICATION": "Medication", "GENERIC_NAME": "Medication", "BRAND_NAME": "Medication", "PROCEDURE": "Procedures",
    "TEST": "Investigations", "TEST_NAME": "Investigations",
}
#: Acronyms that are conditions although they are short.
ACRONYMS = ["copd", "afib", "af", "uti", "dvt", "pe", "mi", "aki", "ckd", "chf", "htn", "dm", "ra", "sle", "ms", "hiv", "std", "ptsd", "adhd", "ocd", "gord", "gerd", "ibs", "ibd"]
#: Descriptions of findings that aren't conditions, and of procedures that say nothing.
EXAM_EXACT = ["mentally alert (finding)", "oriented to person, time and place (finding)", "normal vital capacity (finding)", "pm category (observable entity)"]
EXAM_PARTS = ["mentally alert", "oriented to person", "normal vital", "vital capacity", "observable entity", "clinical finding (finding)", "normal", "finding of"]
GENERIC_PROCEDURES = ["evaluation procedure", "patient encounter procedure", "consultation", "hospital admission", "patient discharge", "follow-up encounter", "referral to service", "emergency department patient visit"]


def map_terms(entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add code: one of 6 to 18 digits within the term, else the dictionary's. ``dictionary``: term, dict_code; its size decides the join."""
    inside = F.nullif(F.regexp_extract("term", r"\b(\d{6,18})\b", 1), F.lit(""))
    d = dictionary.select(F.lower(F.trim("term")).alias("key"), "dict_code").groupBy("key").agg(F.min("dict_code").alias("dict_code"))
    joined = entities.withColumn("key", F.lower(F.trim("term"))).join(d, "key", "left").drop("key")
    return joined.withColumn("code", F.coalesce(inside, F.col("dict_code"))).drop("dict_code")


def drug_names(drugs: DataFrame) -> DataFrame:
    """canonical, alias and priority: a drug's own name comes before aliases."""
    names = F.concat(F.array(F.struct(F.lower("name").alias("alias"), F.lit(0).alias("priority"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lower(a).alias("alias"), F.lit(1).alias("priority"))))
    return drugs.filter("name <> 'normalisation_rules'").select(F.lower("name").alias("canonical"), F.explode(names).alias("n"), *[c for c in drugs.columns if c not in ("name", "aliases")]).select("canonical", "n.*", *[c for c in drugs.columns if c not in ("name", "aliases")])


def drug_lookup(medications: DataFrame, drugs: DataFrame) -> DataFrame:
    """Add canonical and found by a medication's name."""
    best = drug_names(drugs).groupBy("alias").agg(F.min_by("canonical", F.struct("priority", "canonical")).alias("canonical"))
    joined = medications.withColumn("alias", F.lower(F.trim("name"))).join(best, "alias", "left").drop("alias")
    return joined.withColumn("found", F.col("canonical").isNotNull())


def bucket(kind: Column, category: Column, buckets: dict[str, str] | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in (buckets or BUCKETS).items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(kind)), F.try_element_at(known, F.upper(category)), F.lit("Uncategorized"))


#: The score that an exam, a procedure and a part of the body need.
EXAM_SCORE, PROCEDURE_SCORE, ANATOMY_SCORE = 0.85, 0.65, 0.80


def condition_like(entities: DataFrame, blocked: list[str], acronyms: list[str] = ACRONYMS) -> DataFrame:
    """Add condition: whether an entity (text, category, type, traits, description, score) is a condition, by ordered rules.

    ``blocked``: terms that never are; a parameter, as sites have their own.
    """
    t, cat = F.lower(F.trim("text")), F.upper(F.coalesce("category", F.lit("")))
    desc, score = F.lower(F.trim(F.coalesce("description", F.lit("")))), F.coalesce("score", F.lit(0.0))
    part = lambda c, xs: F.regexp_like(c, F.lit("|".join(x.replace("(", r"\(").replace(")", r"\)") for x in xs)))
    shouted = (F.upper(F.trim("text")) == F.trim("text")) & (F.lower(F.trim("text")) != F.trim("text")) & (F.length(t) <= 4) & ~t.isin(acronyms)
    kept = (
        F.when(t.isNull() | (t == "") | t.isin(blocked) | (F.length(t) <= 3) | shouted, False)
        .when(part(cat, ["MEDICATION", "TEST"]), False)
        .when(desc.isin(EXAM_EXACT) | (part(desc, EXAM_PARTS) & (score < EXAM_SCORE)), False)
        .when(part(cat, ["PROCEDURE", "TREATMENT"]), ~desc.isin(GENERIC_PROCEDURES) & ~F.contains(desc, F.lit("encounter")) & (score >= PROCEDURE_SCORE))
        .when(F.contains(cat, F.lit("ANATOMY")), score >= ANATOMY_SCORE)
        .when(part(cat, ["MEDICAL_CONDITION", "DIAGNOSIS"]), True)
        .when(F.upper(F.coalesce("type", F.lit(""))).isin("DX_NAME", "DIAGNOSIS", "MEDICAL_CONDITION"), True)
        .otherwise(F.coalesce(F.exists("traits", lambda x: F.upper(x).isin("DIAGNOSIS", "SYMPTOM", "SIGN")), F.lit(False)))
    )
    return entities.withColumn("condition", kept)


def top_terms(candidates: DataFrame, dictionary: DataFrame, floor: float = 0.10, first: int = 20, last: int = 6, base: float = 0.6) -> DataFrame:
    """Per document the best candidates (term, score) that the dictionary maps, one per code."""
    by_score = Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    top = candidates.filter(F.col("score") > floor).withColumn("rn", F.row_number().over(by_score)).filter(F.col("rn") <= first)
    d = dictionary.select(F.lower("term").alias("key"), "dict_code").groupBy("key").agg(F.min("dict_code").alias("code"))
    mapped = top.withColumn("key", F.lower("term")).join(d, "key").withColumn("confidence", F.bround(F.lit(base) * F.col("score"), 3))
    per_code = mapped.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "code").orderBy("rn"))).filter("k = 1")
    ranked = per_code.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("rn")))
    return ranked.filter(F.col("rank") <= last).select("doc_id", "term", "code", "confidence", "rank")


def map_entities(entities: DataFrame, fallback, threshold: float = 0.75) -> DataFrame:
    """code, confidence and source of each entity. Only those without a concept over the threshold reach ``fallback``, a
    function from (key, term, context) to (key, code, confidence), which sees each pair of term and context once."""
    sure = (F.size("concepts") > 0) & (F.col("score") >= threshold)
    high = entities.filter(sure).withColumn("code", F.col("concepts")[0].getField("Code")).withColumn("confidence", F.col("score")).withColumn("source", F.lit("comprehend_medical"))
    low = entities.filter(~F.coalesce(sure, F.lit(False))).withColumn("key", F.sha2(F.concat_ws("|", "term", "context"), 256))
    found = fallback(low.select("key", "term", "context").dropDuplicates(["key"]))
    joined = low.join(found, "key", "left").drop("key").withColumn("source", F.when(F.col("code").isNotNull(), "semantic_fallback").otherwise("failed"))
    return high.unionByName(joined.withColumn("code", F.coalesce("code", F.lit("NOT_MAPPED"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))))


def dedupe_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def mapping_counts(entities: DataFrame, by: str = "doc_id") -> DataFrame:
    """Entities, fallbacks, mapped ones and the share of these in per cent."""
    mapped = F.count_if(~F.coalesce("code", F.lit("")).isin("", "NOT_MAPPED"))
    return entities.groupBy(by).agg(F.count("*").alias("total"), mapped.alias("mapped"), F.count_if(F.col("source") == "semantic_fallback").alias("fallback"), F.bround(F.try_divide(100.0 * mapped, F.count("*")), 4).alias("success"))


def category_counts(entities: DataFrame, categories: list[str], by: str = "doc_id") -> DataFrame:
    return entities.groupBy(by).pivot("category", categories).count().na.fill(0, categories)
