"""Readers: document files, OCR pages, dictionaries, stored artefacts, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.sources import schemas

EXTENSIONS = ["pdf", "jpg", "jpeg", "png", "tiff", "tif"]
CODE_NAMES = ["code", "snomed_code", "concept_id", "conceptId", "id"]
TEXT_NAMES = ["description", "term", "name", "preferred_term", "display"]
#: What the names of stored artefacts end in, with the slot and role that each fills.
SUFFIXES = [("_clinician_summary", "summary", "clinician"), ("_patient_summary", "summary", "patient"), ("_pharmacist_summary", "summary", "pharmacist"), ("_summary", "summary", "clinician"), ("_snomed", "snomed", None), ("_textract", "textract", None), ("_confidence", "confidence", None)]


def scan_document_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, length and modificationTime of documents; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length", "modificationTime").filter(F.lower("path").rlike(r"\.(" + "|".join(EXTENSIONS) + ")$"))


def list_datasets(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), F.col("path").alias("uri")).filter("key <> ''")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"\.[^.]*$", "")


def parse_page_name(df: DataFrame, path: str = "path") -> DataFrame:
    """Add document and page of names like letterpage3_CLEANED.jpg; else the name and page 0. safe_name is for files."""
    plain = F.regexp_replace(stem(F.col(path)), "_CLEANED$", "")
    name, page = F.regexp_extract(plain, r"^(.*)page(\d+)$", 1), F.regexp_extract(plain, r"^(.*)page(\d+)$", 2).try_cast("int")
    return df.withColumn("document", F.when(page.isNotNull(), name).otherwise(plain)).withColumn("page", F.coalesce(page, F.lit(0))).withColumn("safe_name", F.lower(F.regexp_replace(plain, r"[^\p{L}\p{N}_-]", "_")))


def read_ocr_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per page; doc_id and page come from its name."""
    pages = spark.read.schema(schemas.OCR_PAGE).option("multiLine", True).json(path).withColumn("path", F.regexp_replace("_metadata.file_path", r"_textract\.json$", ".json"))
    return parse_page_name(pages).select(F.col("document").alias("doc_id"), "page", "Blocks")


def read_dictionary(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """code and description from JSON, JSON lines, {records: [...]}, CSV or TSV; of a code's rows the last wins."""
    if fmt in ("csv", "tsv"):
        rows = spark.read.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    else:
        rows = spark.read.option("multiLine", fmt == "json").json(path)
        if "records" in rows.columns:
            rows = rows.select(F.explode("records").alias("r")).select("r.*")
    given = {c.lower(): c for c in rows.columns}
    first = lambda names: F.coalesce(*[F.nullif(F.trim(F.col(given[n.lower()]).cast("string")), F.lit("")) for n in names if n.lower() in given], F.lit(None).cast("string"))
    listed = rows.select(first(CODE_NAMES).alias("code"), first(TEXT_NAMES).alias("description"), F.monotonically_increasing_id().alias("pos")).filter("code IS NOT NULL AND description IS NOT NULL")
    return dedupe_last(listed, "code", "pos").drop("pos")


def dedupe_last(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(key, "s.*")


def artifact_parts(path: Column) -> tuple[Column, Column, Column]:
    """Document, slot and role of an artefact's name."""
    name = F.lower(stem(path))
    doc, slot, role = stem(path), F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, s, r in reversed(SUFFIXES):
        hit = F.endswith(name, F.lit(suffix))
        doc = F.when(hit, F.regexp_replace(stem(path), f"(?i){suffix}$", "")).otherwise(doc)
        slot = F.when(hit, s).otherwise(slot)
        role = F.when(hit, F.lit(r).cast("string")).otherwise(role)
    return doc, slot, role


def catalogue_artifacts(files: DataFrame) -> DataFrame:
    """A row per document with the newest file of each slot: summaries as maps by role, then snomed, textract, confidence."""
    doc, slot, role = artifact_parts(F.col("path"))
    named = files.select(doc.alias("doc_id"), slot.alias("slot"), role.alias("role"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("ext"), "path", "modificationTime").filter("slot IS NOT NULL")
    newest = named.groupBy("doc_id", "slot", "role", "ext").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
    by_role = lambda ext: F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("slot") == "summary") & (F.col("ext") == ext), F.struct("role", "path")))))
    one = lambda s: F.max(F.when(F.col("slot") == s, F.col("path"))).alias(s)
    return newest.groupBy("doc_id").agg(by_role("txt").alias("summary_txt"), by_role("json").alias("summary_json"), one("snomed"), one("textract"), one("confidence"))


def load_role_summaries(structured: DataFrame, plain: DataFrame) -> DataFrame:
    """Per document and role: fields of the JSON; a text file only fills an empty summary."""
    joined = structured.join(plain.select("doc_id", "role", F.col("text").alias("plain")), ["doc_id", "role"], "full_outer")
    return joined.withColumn("summary", F.coalesce(F.nullif("summary", F.lit("")), F.trim("plain"))).drop("plain")


def load_entities(raw: DataFrame, categorised: DataFrame) -> DataFrame:
    """Both layouts as one: doc_id, entity_id, category, pos, text, code, description, confidence, source."""
    top = F.get("e.SNOMEDCTConcepts", F.lit(0))
    a = raw.select("doc_id", F.posexplode("Entities").alias("pos", "e")).select("doc_id", F.col("e.Category").alias("category"), "pos", F.col("e.Text").alias("text"), top.getField("Code").alias("code"), top.getField("Description").alias("description"), F.col("e.Score").alias("confidence"), F.lit("comprehend_medical").alias("source"))
    b = categorised.select("doc_id", F.explode("categorized_entities").alias("category", "list")).select("doc_id", "category", F.posexplode("list").alias("pos", "e")).select("doc_id", "category", "pos", F.col("e.text").alias("text"), F.col("e.snomed_code").alias("code"), F.col("e.description").alias("description"), F.col("e.confidence").alias("confidence"), F.col("e.source").alias("source"))
    return a.unionByName(b).withColumn("entity_id", F.concat_ws("_", "category", F.col("pos").cast("string")))
