"""Corrections proposed for low-confidence regions: verdicts, routing, audit rows, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import scores, text


def first_seen_regions(regions: DataFrame, threshold: float = 0.80, scale: float = 1.0) -> DataFrame:
    """Add low, and duplicate: a low-confidence region with the page, box and text of an earlier one."""
    box = F.transform("bbox", lambda x: (x * scale).cast("int"))
    seen = Window.partitionBy("doc_id", "page_number", box, F.trim("text"), "low").orderBy("idx")
    low = F.coalesce(F.col("confidence") < threshold, F.lit(True))
    return regions.withColumn("low", low).withColumn("duplicate", F.col("low") & (F.row_number().over(seen) > 1))


def verdict(a: Column, b: Column, small: float = 0.15, large: float = 0.30, least_jaccard: float = 0.30, tokens: tuple[Column, Column] | None = None) -> Column:
    """deviation, token_similarity and verdict of a correction b for a; ``tokens``: those of both, if they are known."""
    x, y = F.trim(a), F.trim(b)
    size = F.greatest(F.length(x), F.length(y))
    dev = F.when(size == 0, 0.0).otherwise(text.edits(x, y) / size)
    p, q = tokens or (text.bare_tokens(x), text.bare_tokens(y))
    sim = F.when(x == y, 1.0).otherwise(text.let(F.struct(p.alias("x"), q.alias("y")), lambda t: text.jaccard(t.x, t.y)))

    def judged(m: Column) -> Column:
        kind = F.when(m.same, "NO_CHANGE").when(m.dev < small, "ACCEPTED").when((m.dev > large) | (m.sim < least_jaccard), "HIGH_DEVIATION").otherwise("ACCEPTED")
        return F.struct(F.bround(m.dev, 4).alias("deviation"), F.bround(m.sim, 4).alias("token_similarity"), kind.alias("verdict"))

    return text.let(F.struct((x == y).alias("same"), dev.alias("dev"), sim.alias("sim")), judged)


def dosage_changed(a: Column, b: Column, strict_numbers: bool = False) -> Column:
    """Whether the words of dose differ; with ``strict_numbers`` the numbers too."""
    changed = text.dosage_tokens(a) != text.dosage_tokens(b)
    numbers = lambda x: F.array_sort(F.regexp_extract_all(x, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
    return (changed | (numbers(a) != numbers(b))) if strict_numbers else changed


def correct_regions(regions: DataFrame, proposals: DataFrame, threshold: float = 0.80, gate: float = 0.60) -> DataFrame:
    """status, reason and applied for every region. Of a duplicated region the first takes the proposal."""
    p = proposals.select("doc_id", "idx", "corrected_text", F.col("confidence").alias("llm_confidence"), "reasoning", "error")
    joined = first_seen_regions(regions, threshold).join(p, ["doc_id", "idx"], "left")
    judged = F.col("low") & ~F.col("duplicate") & F.col("corrected_text").isNotNull()  # others are skipped
    seen = lambda c: F.when(judged, F.col(c))
    with_tokens = joined.withColumns({f"_{c}": F.when(judged, text.bare_tokens(F.col(c))) for c in ("text", "corrected_text")})
    v = verdict(seen("text"), seen("corrected_text"), tokens=(F.col("_text"), F.col("_corrected_text")))
    with_v = with_tokens.withColumn("v", F.when(judged, v))
    missing = F.col("corrected_text").isNull()
    reason = (
        F.when(~F.col("low"), "HIGH_CONFIDENCE")
        .when(F.col("duplicate"), "DUPLICATE")
        .when(missing & (F.col("error") == "TIMEOUT"), "TIMEOUT")
        .when(missing, "SERVICE_ERROR")
        .when(text.of_dosage(F.col("_text")) != text.of_dosage(F.col("_corrected_text")), "DOSAGE_MISMATCH")
        .when(F.col("v.verdict") == "NO_CHANGE", "NO_CHANGE")
        .when(F.coalesce(F.col("llm_confidence"), F.lit(0.0)) < gate, "LOW_LLM_CONFIDENCE")
        .when(F.col("v.verdict") == "HIGH_DEVIATION", "HALLUCINATED")
        .otherwise("ACCEPTED")
    )
    status = F.when(F.col("reason").isin("HIGH_CONFIDENCE", "DUPLICATE"), "SKIPPED").when(F.col("reason").isin("ACCEPTED", "NO_CHANGE"), F.col("reason")).otherwise("REVIEW_REQUIRED")
    out = with_v.withColumn("reason", reason).withColumn("status", status).withColumn("correction_applied", F.col("reason") == "ACCEPTED").drop("_text", "_corrected_text")
    return out.withColumn("final_confidence", scores.blend_confidence(F.col("correction_applied"), F.coalesce("confidence", F.lit(0.0)), F.coalesce("llm_confidence", F.lit(0.0))))


def correction_audit(corrected: DataFrame) -> DataFrame:
    """A row per region, skipped ones with null figures."""
    skipped = F.col("status") == "SKIPPED"
    action = F.when(skipped, "SKIP").when(F.col("status") == "REVIEW_REQUIRED", "ESCALATE").when(F.col("correction_applied"), "APPLY").otherwise("KEEP")
    figure = lambda c: F.when(~skipped, F.bround(c, 4))
    return corrected.select("doc_id", "idx", "page_number", "status", "reason", action.alias("action"), figure("v.deviation").alias("deviation"), figure("v.token_similarity").alias("token_similarity"), figure("llm_confidence").alias("llm_confidence"), F.col("text").alias("original_text"), F.when(~skipped, F.col("corrected_text")).alias("corrected_text"))


def merge_spans(regions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Regions with applied corrections in place; a region or correction without a partner is an error."""
    c = corrections.select("doc_id", "idx", F.col("corrected_text").alias("c_text"), F.col("correction_applied").alias("c_applied"), F.lit(True).alias("c_here"))
    both = regions.withColumn("r_here", F.lit(True)).join(c, ["doc_id", "idx"], "full_outer")
    matched = F.when(F.col("r_here") & F.col("c_here"), F.when(F.col("c_applied"), F.col("c_text")).otherwise(F.col("text"))).otherwise(F.raise_error(F.concat(F.lit("region and correction don't match: "), F.col("doc_id").cast("string"))))
    return both.select("doc_id", "idx", matched.alias("text"), F.col("text").alias("original_text"), F.col("c_applied").alias("correction_applied"))


def correction_status(corrected: DataFrame) -> DataFrame:
    return corrected.groupBy("doc_id").agg(F.when(F.bool_or(F.col("status") == "REVIEW_REQUIRED"), "REVIEW_REQUIRED").otherwise("SUCCESS").alias("status"), F.count_if("correction_applied").alias("accepted"), F.count("*").alias("regions"))


def audit_write_stats(writes: DataFrame) -> DataFrame:
    return writes.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"))
