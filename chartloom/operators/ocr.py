"""OCR pages: text, mean confidences (four definitions that differ), refinement of elements, page quality, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import scores
from chartloom.functions.rules import entity_class


def explode_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, page, pos, type, text, conf and box for each block of Blocks."""
    b = pages.select("doc_id", "page", F.posexplode("Blocks").alias("pos", "b"))
    return b.select("doc_id", "page", "pos", F.col("b.BlockType").alias("type"), F.col("b.Text").alias("text"), F.col("b.Confidence").alias("conf"), F.col("b.Geometry.BoundingBox").alias("box"))


def ocr_text(blocks: Column, sep: str = "\n") -> Column:
    """The text of LINE blocks of one page."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b.BlockType == "LINE") & (b.Text != "")), lambda b: b.Text), sep)


def lines_text(blocks: DataFrame, sep: str = "\n", by: str = "doc_id") -> DataFrame:
    """The same over rows (doc_id, pos, type, text)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return blocks.filter("type = 'LINE' AND text <> ''").groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x.text), sep).alias("text"))


def concat_pages(pages: DataFrame) -> DataFrame:
    """Texts of pages that aren't blank, one blank line between, and the mean of their confidences, 0.5 where there is none."""
    filled = pages.filter(F.trim("text") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x.text), "\n\n")
    return filled.groupBy("doc_id").agg(joined.alias("text"), F.coalesce(F.avg("conf"), F.lit(0.5)).alias("conf"))


def mean_confidences(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """router: LINE and WORD over 0, 0 to 100; aggregator: LINE and WORD, zeros count, 0 to 1; metrics: LINE, with an error
    proxy; portal: WORD, 0 to 1, 0.5 where there is none."""
    both = F.col("type").isin("LINE", "WORD")
    router = F.coalesce(F.avg(F.when(both & (F.col("conf") > 0), F.col("conf"))), F.lit(0.0))
    metrics = F.coalesce(F.avg(F.when(F.col("type") == "LINE", F.col("conf"))), F.lit(0.0))
    return blocks.groupBy(by).agg(
        router.alias("router"),
        scores.unit_interval(F.avg(F.when(both, F.col("conf")))).alias("aggregator"),
        metrics.alias("metrics"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - metrics)).alias("error_proxy"),
        F.coalesce(F.avg(F.when(F.col("type") == "WORD", F.coalesce("conf", F.lit(0.0)))) / 100, F.lit(0.5)).alias("portal"),
    )


def route_by_ocr(confidences: DataFrame, threshold: float = 90.0) -> DataFrame:
    """Documents at or over the threshold go to both tracks, others to refinement."""
    high = F.col("router") >= threshold
    return confidences.withColumn("route", F.when(high, "tracks").otherwise("refinement")).withColumn("needs_refinement", ~high)


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count("*").alias("n"))


def refine_elements(elements: DataFrame, threshold: float = 0.90, least: float = 0.85, classify=entity_class) -> DataFrame:
    """On pages under the threshold elements with a keyword gain 0.1, up to 0.95; those still under ``least`` escalate."""
    page = F.avg(F.coalesce("conf", F.lit(0.8))).over(Window.partitionBy("doc_id", "page"))
    out = elements.withColumn("page_conf", page).withColumn("entity", classify(F.col("text")))
    raised = (F.col("page_conf") < threshold) & F.col("entity").isNotNull()
    refined = F.when(raised, F.least(F.lit(0.95), F.coalesce("conf", F.lit(0.8)) + 0.1)).otherwise(F.coalesce("conf", F.lit(0.8)))
    return out.withColumn("refined", refined).withColumn("escalate", F.col("refined") < least)


def page_quality(elements: DataFrame, conf: str = "refined") -> DataFrame:
    """Mean of accepted elements by page, at most 1, and the layout's complexity."""
    count = lambda t: F.count_if(F.col("type") == t)
    return elements.groupBy("doc_id", "page").agg(F.coalesce(F.least(F.lit(1.0), F.avg(F.when(~F.col("escalate"), F.col(conf)))), F.lit(0.0)).alias("quality"), scores.layout_complexity(count("TABLE"), count("TITLE"), F.coalesce(F.max("megapixels"), F.lit(0.0))).alias("complexity"))


def batch_refine_stats(documents: DataFrame) -> DataFrame:
    """Totals over documents (ok, escalated, accepted elements, seconds)."""
    return documents.agg(F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"), F.sum("escalated").alias("escalated"), F.sum("accepted").alias("elements"), F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_seconds"))
